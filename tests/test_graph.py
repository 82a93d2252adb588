import itertools
import math
import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import catalog
from tessera.operators import biclique, graph, similarity, triangles
from tessera.streaming import reservoir
from tessera.streaming.slots import Reservoir

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TINY = [(0, 5), (0, 6), (0, 7), (1, 5), (1, 6), (1, 7), (2, 5), (2, 6), (2, 8), (3, 7), (3, 8), (4, 5), (4, 6), (4, 7), (4, 9)]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(TINY, "u long, v long")


def rounded(x):
    return round(x, 9) if isinstance(x, float) else tuple(map(rounded, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", ["jaccard_pairs", "kcore_3", "local_candidates", "biclique_global_t2", "triangles_local", "minhash_estimate", "resample", "reservoirplus_full", "minhash_curve", "panel_minhash_error"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(rounded(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(rounded(r[names.index(c)]) for c in sorted(df.columns)) for r in cur.fetchall())
    assert got == want and got


def test_pairs_and_bicliques(tiny):
    assert {(r.u1, r.u2): round(r.jaccard, 3) for r in similarity.pairs(tiny).collect()} == {(0, 1): 1.0, (0, 2): 0.5, (1, 2): 0.5, (0, 3): 0.25, (1, 3): 0.25, (2, 3): 0.25, (0, 4): 0.75, (1, 4): 0.75, (2, 4): 0.4, (3, 4): 0.2}
    assert biclique.search(tiny, 2).collect()[0][1:] == ([0, 1], [5, 6, 7])
    assert biclique.search(tiny, 3).collect()[0][:] == (0.75, [0, 1, 4], [5, 6, 7])
    assert biclique.search(tiny, 4).count() == 0
    assert {r.u for r in graph.core(tiny, 3).collect()} == {0, 1, 4}


def test_ablations_agree(tiny):
    best = {tuple(map(str, biclique.search(tiny, 2, **o).collect())) for o in ({}, {"use_core": False}, {"use_bound": False})}
    assert len(best) == 1


def test_triangles(spark):
    k4 = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)], "src long, dst long")
    assert triangles.triangles(k4).count() == 4
    assert {r.triangles for r in triangles.local_counts(k4).collect()} == {3.0}


def test_triangles_by_cells(spark, monkeypatch):
    """Against brute force, in cells of several colours and of few wedges at a time; wedges aren't shuffled, edges are once for each colour."""
    draw = random.Random(5)
    edges = {tuple(sorted(draw.sample(range(60), 2))) for _ in range(500)} | {(0, x) for x in range(1, 60)}
    near = {x: {y for e in edges for y in e if x in e} - {x} for x in range(60)}
    truth = sorted((x, y, z) for x, y in edges for z in near[x] & near[y] if y < z)
    df = spark.createDataFrame([*edges, *[(b, a) for a, b in list(edges)[:50]], (3, 3)], "src long, dst long")
    for cell in (1 << 20, 1000, 150):
        monkeypatch.setattr(triangles, "CELL", cell)
        found = triangles.triangles(df)
        assert sorted(map(tuple, found.collect())) == truth
        assert "Join" not in found._jdf.queryExecution().toString()
    assert triangles.triangles(df.limit(0)).count() == 0
    a, b = (pa.array(list(c), pa.int64()) for c in zip(*edges, strict=True))
    rows = pa.RecordBatch.from_arrays([a, b, pa.array([False] * len(edges))], names=["a", "b", "same"])
    for most in (1, 40):
        monkeypatch.setattr(triangles, "WEDGES", most)
        parts = list(triangles._closed(iter([rows])))
        assert len(parts) > 10 and sorted(x for p in parts for x in zip(*(c.to_pylist() for c in p.columns), strict=True)) == truth


@pytest.mark.parametrize("variant", ["fixed", "recorded", "adaptive"])
def test_reservoir_means(variant):
    import itertools
    import random

    rng = random.Random(5)
    edges = [e for e in itertools.combinations(range(40), 2) if rng.random() < 0.5]
    rng.shuffle(edges)
    truth = sum(1 for a, b, c in itertools.combinations(range(40), 3) if {(a, b), (a, c), (b, c)} <= set(edges))
    total = 0.0
    for seed in range(150):
        r = Reservoir(150, 0.1, variant, seed=seed)
        for e in edges:
            r.add(*e)
        assert len(r.held.edges) <= 150
        total += r.total
    assert abs(total / 150 / truth - 1) < 0.05


def skewed(seed, left=80, right=60):
    rng = random.Random(seed)
    edges = {(u, rng.randrange(right) ** 2 // right) for u in range(left) for _ in range(rng.randrange(1, 14))}
    return sorted(edges | {(u, 3) for u in range(left)} | {(left + u, v) for u in range(4) for v in range(12 + u)})


def of_brute(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
    return near, {(a, b): (len(near[a] & near[b]), len(near[a] & near[b]) / len(near[a] | near[b])) for a, b in itertools.combinations(sorted(near), 2)}


@pytest.mark.parametrize(("least", "above"), [(2, 0.0), (1, 0.2), (3, 0.34), (1, 0.8)])
def test_ways_to_pairs(spark, least, above, monkeypatch):
    """The three joins give the same rows; the prefix join meets fewer of them."""
    edges = skewed(1)
    df = spark.createDataFrame(edges, "u long, v long")
    near, sims = of_brute(edges)
    want = {p: (c, round(j, 9)) for p, (c, j) in sims.items() if c >= least and j > above}
    for prefix, within in ((1e18, 1e18), (0, 1e18), (1e18, -1)):
        monkeypatch.setattr(similarity, "_prefix_rows", lambda *a, n=prefix: n)
        monkeypatch.setattr(similarity, "pairs_within", lambda e, side, n=within: n if side == "u" else 10.0)
        got = {(r.u1, r.u2): (r.common, round(r.jaccard, 9)) for r in similarity.pairs(df, least, above).collect()}
        assert got == want and want
    monkeypatch.undo()
    if above > 0:
        e = df.join(graph.degree(df, "u"), "u")
        rare = graph.settled(similarity.prefixes(e, above, least))
        found = {(r.u1, r.u2) for r in similarity.prefix_candidates(rare, above, least).collect()}
        assert set(want) <= found and len(found) < sum(c > 0 for c, _ in sims.values())


def test_prefixes_leave_few(spark):
    """Of the pairs that meet over the orders' parts, less than a fifth is compared at a half, less than a tenth at the best similarity, the search's bound."""
    e = catalog.sources.order_part(spark, "/root/testdata/sf0.01")
    e = graph.settled(e.join(graph.degree(e, "u"), "u"))
    every = graph.wedges(e).where("u1 < u2").select("u1", "u2").distinct().count()
    for above, times in ((0.5, 5), (2 / 3 - 1e-9, 10)):
        assert times * similarity.prefix_candidates(graph.settled(similarity.prefixes(e, above)), above).count() < every


def test_hubs_and_hot_pairs(spark):
    """A right hub, a left hub, and a pair of right vertices that thousands of left ones share."""
    edges = [(u, v) for u in range(1500) for v in (0, 1)] + [(9999, v) for v in range(3000)]
    df = spark.createDataFrame(edges, "u long, v long")
    assert similarity.pairs(df, 2).count() == 1500 * 1499 // 2 + 1500
    assert graph.wedges(df, per=64).where("u1 < u2").count() == 2 * (1501 * 1500 // 2)


def test_banded_pairs(spark):
    """Recall of the bands against the exact join; every pair of signatures that agree enough is found."""
    e = catalog.sources.order_part(spark, "/root/testdata/sf0.01")
    exact = graph.settled(similarity.pairs(e, 1, 0.5))
    found = graph.settled(similarity.lsh_pairs(e, 0.5))
    assert found.join(exact, ["u1", "u2"], "left_anti").count() == 0 and found.count() >= 0.9 * exact.count() > 100
    sig = graph.settled(similarity.signatures(e, 72))
    assert 10 * similarity.lsh_candidates(sig, 3, 24).count() < similarity.pairs_within(e, "v")
    small = spark.createDataFrame(skewed(2), "u long, v long")
    sig = graph.settled(similarity.signatures(small, 16))
    every = sig.toDF("u1", "a").join(sig.toDF("u2", "b"), graph.F.col("u1") < graph.F.col("u2")).select("u1", "u2")
    for least in (0.25, 0.5, 1.0):
        want = {(r.u1, r.u2, r.estimate) for r in similarity.estimates(every, sig).where(graph.F.col("estimate") >= least).collect()}
        assert {(r.u1, r.u2, r.estimate) for r in similarity.candidates_above(sig, 16, least).collect()} == want and want


def brute_local(edges, tau, q, members=None):
    near, sims = of_brute(edges)
    best = None
    for rest in itertools.combinations([u for u in near if u != q and (members is None or u in members)], max(2, tau) - 1):
        own = tuple(sorted((q, *rest)))
        right = set.intersection(*(near[u] for u in own))
        if len(right) >= tau:
            sim = min(sims[p][1] for p in itertools.combinations(own, 2))
            if best is None or (-sim, own) < best[0]:
                best = (-sim, own), sorted(right)
    return best and (round(-best[0][0], 9), list(best[0][1]), best[1])


@pytest.mark.parametrize("tau", [2, 3, 4])
def test_local_search(spark, tau):
    """Every form of the search, the joined one for large surroundings too, finds each query's best set; so does the global one."""
    edges = skewed(3, 22, 30)
    df = spark.createDataFrame(edges, "u long, v long")
    queries = spark.createDataFrame([(q,) for q in (0, 1, 5, 9, 22, 24, 25, 777)], "q long")
    want = {q: brute_local(edges, tau, q) for q in (0, 1, 5, 9, 22, 24, 25)}
    want = {q: w for q, w in want.items() if w}
    for options in ({}, {"hop": False}, {"by_sim": False}, {"by_pairs": False}, {"most": 0}) if tau == 3 else ({}, {"most": 0}):
        got = {r.q: (round(r.sim, 9), r.members, r.right) for r in biclique.local(df, tau, queries, **options).collect()}
        assert got == want, options
    near, _ = of_brute(edges)
    best = min((brute_local(edges, tau, q) for q in near if brute_local(edges, tau, q)), key=lambda x: (-x[0], x[1]))
    assert (round((found := biclique.search(df, tau).first()).sim, 9), found.members) == best[:2]
    group = spark.createDataFrame([(u, u % 2) for u in near], "u long, grp long")
    got = {r.q: (round(r.sim, 9), r.members, r.right) for r in biclique.local(df, tau, queries, group=group).collect()}
    want = {q: brute_local(edges, tau, q, {u for u in near if u % 2 == q % 2}) for q in (0, 1, 5, 9, 22, 24, 25)}
    assert got == {q: w for q, w in want.items() if w}


def test_bounds_spare_work():
    edges = skewed(4, 30, 24)
    near, _ = of_brute(edges)
    visits = []
    for by_sim in (True, False):
        ego = biclique.Ego(30, list(near), [sorted(n) for n in near.values()], 3)
        ego.search(by_sim)
        visits.append(ego.visited)
    assert 0 < visits[0] < visits[1]


def test_peeling_follows_the_frontier(spark):
    """A path of triangles' doubles unravels from its end: each round looks at a few vertices alone; hubs and cores are right."""
    ladder = [(u, v) for u in range(6) for v in (u, u + 1)] + [(100 + u, 100 + v) for u in range(5) for v in range(5)] + [(100, 0)]
    gone, sizes, _ = graph.peeled(spark.createDataFrame(ladder, "u long, v long"), 2)
    assert sizes and max(sizes) <= 2 and gone.distinct().count() == gone.count() == sum(sizes)
    for k in (3,):
        edges = skewed(k)
        kept = set(edges)
        while True:
            n = {}
            for u, v in kept:
                n["u", u], n["v", v] = n.get(("u", u), 0) + 1, n.get(("v", v), 0) + 1
            smaller = {(u, v) for u, v in kept if n["u", u] >= k and n["v", v] >= k}
            if smaller == kept:
                break
            kept = smaller
        assert {r[:] for r in graph.core(spark.createDataFrame(edges, "u long, v long"), k).collect()} == kept


def test_approximate_search_recall(spark):
    """Within groups of equal hashes the best pair found comes near the best of all, never above it."""
    e = catalog.sources.user_k(spark, SF)
    exact, found = biclique.search(e, 2).first(), catalog.QUERIES["biclique_global_approx"](spark, SF).first()
    assert 0.8 * exact.sim <= found.sim <= exact.sim + 1e-9


def test_tables_have_owners(spark):
    """What others have written stays; a search leaves its result's table alone."""
    held = graph.settled(spark.range(10))
    before = len(os.listdir(graph.shared_folder(spark)))
    found = biclique.search(spark.createDataFrame(TINY, "u long, v long"), 3)
    assert len(os.listdir(graph.shared_folder(spark))) == before + 1 and found.count() == 1
    with graph.own_tables(spark):
        graph.settled(spark.range(5))
    assert held.count() == 10 and found.count() == 1 and len(os.listdir(graph.shared_folder(spark))) == before + 1


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_remove_nodes_takes_out_the_core(spark, tmp_path):
    rows = [(1, 1), (1, 2), (3, 1), (3, 2), (2, 3), (5, 1), (4, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r.u, r.v) for r in catalog.QUERIES["remove_nodes"](spark, str(tmp_path)).collect()} == {(2, 3), (4, 6)}


def test_dense_pairs_go_block_by_block(spark, monkeypatch):
    """Pairs, estimates and sampled similarities of the blocks against the joins; a dense graph's pairs are not shuffled."""
    rng = random.Random(5)
    rows = sorted({(rng.randrange(-70, 130), rng.randrange(40)) for _ in range(4000)} | {(500, 900), (501, 901)})
    e = graph.settled(spark.createDataFrame(rows, "u int, v long"))
    assert similarity.dense(e) and "FlatMapGroupsInArrow" in similarity.pairs(e)._jdf.queryExecution().toString()
    monkeypatch.setattr(similarity, "COLUMNS", 7)
    sig, keep = graph.settled(similarity.signatures(e, 16)), reservoir.kept(0.5, "v")
    got = {(r.u1, r.u2): r for r in similarity.block_pairs(e, sig=sig, kept=keep).collect()}
    monkeypatch.setattr(similarity, "dense", lambda edges: False)
    monkeypatch.setattr(similarity, "pairs_of_all", lambda edges: math.inf)
    joined = similarity.pairs(e)
    assert "FlatMapGroupsInArrow" not in joined._jdf.queryExecution().toString()
    want = reservoir.sampled_jaccard(e, similarity.estimates(joined, sig), 0.5).collect()
    assert len(got) == len(want) > 5000
    for r in want:
        assert got[r.u1, r.u2][2:6] == (r.common, r.jaccard, r.estimate, r.sampled)
    for least, above in ((2, 0.0), (3, 0.3), (1, 0.5)):
        assert {tuple(r) for r in similarity.block_pairs(e, least, above).collect()} == {tuple(r) for r in similarity.pairs(e, least, above).collect()}
    best = sorted(((-r.jaccard, r.u1, r.u2) for r in want))[:20]
    assert [(-r.jaccard, r.u1, r.u2) for r in similarity.block_pairs(e, most=20).orderBy(F.desc("jaccard"), "u1", "u2").limit(20).collect()] == best


def test_bicliques_among_twins(spark):
    """Of classes of equal neighbours only the smallest ids are looked at; the k best sets and the queries' are those of brute force."""
    rng = random.Random(8)
    shapes = [sorted(rng.sample(range(12), 6)) for _ in range(4)]
    near = {u: set(shapes[u % 4]) for u in range(14)} | {u: set(rng.sample(range(12), 6)) for u in range(14, 20)}
    e = spark.createDataFrame([(u, v) for u in near for v in near[u]], "u long, v long")
    group = spark.createDataFrame([(u, u % 3) for u in near], "u long, grp long")
    assert biclique.without_twins(e, 2).select("u").distinct().count() == 4 * 2 + 6
    sim = {(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a, b in itertools.combinations(near, 2)}
    every = sorted((-min(sim[p] for p in itertools.combinations(s, 2)), s) for s in itertools.combinations(sorted(near), 3) if len(set.intersection(*(near[u] for u in s))) >= 3)
    for k, g in ((1, None), (40, None), (5, group)):
        want = [(s, list(m)) for s, m in every if g is None or len({u % 3 for u in m}) == 1][:k]
        assert [(-r.sim, r.members) for r in biclique.search(e, 3, k=k, group=g).orderBy(F.desc("sim"), "members").collect()] == want
    got = {r.q: (-r.sim, r.members) for r in biclique.local(e, 3, spark.createDataFrame([(13,), (9,), (17,)], "q long")).collect()}
    assert got == {q: next((s, list(m)) for s, m in every if q in m) for q in (13, 9, 17) if any(q in m for _, m in every)}


def test_pairs_are_found_where_they_first_meet(spark, monkeypatch):
    """With short neighbour lists neither pairs nor two-hop rows are shuffled once found; long lists go by the joins, with the same rows."""
    edges = sorted({(u, v) for u, v in skewed(3) if u % 7} | {(u, v) for u in range(300, 420) for v in (u % 5, 70 + u % 9)})
    df = graph.settled(spark.createDataFrame(edges, "u long, v long"))
    near, sims = of_brute(edges)
    monkeypatch.setattr(similarity, "pairs_of_all", lambda e: math.inf)
    for prefix in (0, 1e18):
        monkeypatch.setattr(similarity, "_prefix_rows", lambda *a, n=prefix: n)
        for least, above in ((1, 0.0),) if prefix else ((1, 0.3), (2, 0.5)):
            want = {p: (c, j) for p, (c, j) in sims.items() if c >= least and j > above}
            for long in (4096, 0):
                monkeypatch.setattr(graph, "LONG", long)
                found = similarity.pairs(df, least, above)
                got = found.collect()
                assert {(r.u1, r.u2): (r.common, r.jaccard) for r in got} == want and len(got) == len(want) > 0
                if long and least == 1:
                    assert "HashAggregate(keys=[u1" not in found._jdf.queryExecution().toString()
    two = {(a, b) for p, (c, _) in sims.items() if c for a, b in (p, p[::-1])}
    for long in (4096, 0):
        monkeypatch.setattr(graph, "LONG", long)
        found, repeated = graph.two_hop(df), graph.one_two_hop(df.union(df))
        assert sorted(tuple(r) for r in found.collect()) == sorted(two)
        assert ("Deduplicate" in found._jdf.queryExecution().toString()) == (not long)
        assert sorted(tuple(r) for r in repeated.collect()) == sorted([(u, 1, v) for u, v in edges] + [(a, 2, b) for a, b in two])
        banded = similarity.lsh_pairs(df, 0.4)
        got = banded.collect()
        assert len(got) == len({(r.u1, r.u2) for r in got}) > 0 and all(sims[r.u1, r.u2] == (r.common, r.jaccard) for r in got)
    assert similarity.signatures(df, 8)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_union_of_ids_reads_edges_once(spark):
    """Edges aren't made distinct before their ids: one shuffle, of ids alone."""
    plan = catalog.QUERIES["allgather_union"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("FileScan") == 1


def test_blocks_grow_with_the_table(spark, monkeypatch):
    """Lists are sent to a fixed number of blocks, whatever the vertices, and to more where a task couldn't hold them; parts of blocks are compared as a whole is."""
    draw = random.Random(8)
    near = {u: sorted(draw.sample(range(30), draw.randint(1, 12))) for u in range(900)}
    df = spark.createDataFrame([(u, v) for u, n in near.items() for v in n], "u long, v long")
    truth = {(a, b): len(set(near[a]) & set(near[b])) for a, b in itertools.combinations(near, 2)}
    truth = {p: n for p, n in truth.items() if n >= 3}
    sig = similarity.signatures(df, 8)
    monkeypatch.setattr(similarity, "BLOCK", 20)
    for held, tasks in ((1 << 22, 12 * 13 // 2), (sum(map(len, near.values())) // 19, 20 * 21 // 2)):
        monkeypatch.setattr(similarity, "HELD", held)
        found = similarity.block_pairs(df, 3)
        assert found.rdd.getNumPartitions() == tasks
        assert {(r.u1, r.u2): r.common for r in found.collect()} == truth
    best = similarity.block_pairs(df, 3, most=5).orderBy(F.desc("jaccard"), "u1", "u2").limit(5).collect()
    rank = sorted(truth, key=lambda p: (-truth[p] / (len(near[p[0]]) + len(near[p[1]]) - truth[p]), p))
    assert [(r.u1, r.u2) for r in best] == rank[:5]
    values = {r.u: r.sig for r in sig.collect()}
    agree = {(a, b): sum(x == y for x, y in zip(values[a], values[b], strict=True)) / 8 for a, b in truth}
    assert {(r.u1, r.u2): r.estimate for r in similarity.block_pairs(df, 3, sig=sig, least_estimate=0.5).collect()} == {p: s for p, s in agree.items() if s >= 0.5}


def test_large_surroundings_are_bounded(spark, monkeypatch):
    """Around queries with large surroundings, what the most similar vertices reach bounds the vertices and the pairs looked at; results are brute force's."""
    edges = [(u, v) for u, n in enumerate(itertools.combinations(range(8), 6)) for v in n]  # 12 others share five of six with each
    df = spark.createDataFrame(edges, "u long, v long")
    queries = spark.createDataFrame([(q,) for q in (0, 7, 27)], "q long")
    want = {q: brute_local(edges, 3, q) for q in (0, 7, 27)}
    bounds, paired = [], biclique.pairs
    monkeypatch.setattr(biclique, "pairs", lambda e, least, above, left: bounds.append(above) or paired(e, least, above, left))
    for first, most, options in ((60, 60, {}), (60, 2000, {"by_sim": False}), (60, 2000, {"by_pairs": False})):
        monkeypatch.setattr(biclique, "FIRST", first)
        got = {r.q: (round(r.sim, 9), r.members, r.right) for r in biclique.local(df, 3, queries, most=most, **options).collect()}
        assert got == want and all(want.values())
    assert bounds and all(b > 0 for b in bounds)


def test_errors_are_summed_up_in_blocks(spark, monkeypatch):
    """Errors over all pairs are those of the pairs' rows, with copies and without; no pair leaves a task."""
    rng = random.Random(3)
    shapes = [sorted(rng.sample(range(25), rng.randrange(2, 12))) for _ in range(90)]
    shares = (0.1, 0.5)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    for copies, held in ((1, 1 << 22), (4, 1 << 22), (1, 60)):
        monkeypatch.setattr(similarity, "HELD", held)
        e = graph.settled(spark.createDataFrame([(u + 90 * c, v) for c in range(copies) for u in range(90) for v in shapes[u]], "u int, v long"))
        kept = tuple(reservoir.kept(x, "v") for x in shares)
        got = {r.which: r[1:] for r in similarity.block_errors(e, 0.2, (16, 4), kept).collect()}
        want = [triangles.error_metrics(similarity.block_pairs(e, sig=similarity.signatures(e, h)), "estimate", "jaccard", 0.2).first() for h in (16, 4)]
        want += [triangles.error_metrics(similarity.block_pairs(e, kept=one), "sampled", "jaccard", 0.2).first() for one in kept]
        assert want[0].n > 500 and len(got) == len(want)
        for k, w in enumerate(want):
            assert got[k] == pytest.approx(tuple(w), abs=1e-12)
    for name in ("mae_rmse", "minhash_errors", "sampled_errors"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert plan.count("FlatMapGroupsInArrow") and "u1" not in plan and "Union" not in plan.split("FlatMapGroupsInArrow")[0]


def test_bounds_are_looked_for_in_more_pairs(spark, monkeypatch):
    """Where the most similar pairs hold no set, the first bound comes from more of them, and no threshold is tried; the result is brute force's."""
    rng = random.Random(9)
    near = {u: set(rng.sample(range(40), 20)) for u in range(120)}
    e = graph.settled(spark.createDataFrame([(u, v) for u in near for v in near[u]], "u long, v long"))
    sim = {(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a, b in itertools.combinations(near, 2)}
    floor = sorted(sim.values())[-600]
    found = biclique.grown(spark.createDataFrame([(*p, s) for p, s in sim.items() if s >= floor], "u1 long, u2 long, jaccard double"), 4).collect()
    want = min((-r.sim, r.members) for r in found if len(set.intersection(*(near[u] for u in r.members))) >= 4)
    monkeypatch.setattr(biclique, "BOUND_PAIRS", 10)
    assert similarity.dense(e) and biclique.first_bound(e, 4, 4, 1, None) == pytest.approx(-want[0])
    tried, paired = [], biclique.pairs
    monkeypatch.setattr(biclique, "pairs", lambda e, least, above, left: tried.append(above) or paired(e, least, above, left))
    best = biclique.search(e, 4).first()
    assert (-best.sim, best.members) == (pytest.approx(want[0]), want[1]) and len(tried) == 1 and tried[0] > 0
    assert similarity._least_prefix_rows(similarity.settled(e.join(graph.degree(e, "u"), "u")), 0.5, 4) <= similarity._prefix_rows(similarity.prefixes(e.join(graph.degree(e, "u"), "u"), 0.5, 4), 0.5, 4)


def test_groups_are_paired_within(spark, monkeypatch):
    """Searches within groups pair their vertices there: neither all pairs nor bands' are made."""
    rng = random.Random(10)
    near = {u: set(rng.sample(range(30), 12)) for u in range(90)}
    e = spark.createDataFrame([(u, v) for u in near for v in near[u]], "u long, v long")
    group = spark.createDataFrame([(u, u % 9) for u in near], "u long, grp long")
    sim = {(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a, b in itertools.combinations(near, 2) if a % 9 == b % 9 and len(near[a] & near[b]) >= 2}
    monkeypatch.setattr(biclique, "pairs", None)
    monkeypatch.setattr(biclique, "lsh_pairs", None)
    for k in (1, 7):
        want = sorted((-s, list(p)) for p, s in sim.items())[:k]
        assert [(-r.sim, r.members) for r in biclique.search(e, 2, k=k, group=group).orderBy(F.desc("sim"), "members").collect()] == want
    three = min((-min(sim.get(p, 0) for p in itertools.combinations(s, 2)), s) for g in range(9) for s in itertools.combinations(range(g, 90, 9), 3) if len(set.intersection(*(near[u] for u in s))) >= 3)
    best = biclique.search(e, 3, group=group).first()
    assert (-best.sim, tuple(best.members)) == three
    assert catalog.QUERIES["biclique_global_approx"](spark, SF).count() == 1
