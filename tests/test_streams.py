"""Numbering, files in and out, running windows, reservoirs by colours, Structured Streaming."""

import gc
import itertools
import json
import math
import random
import tracemalloc
import weakref

import pytest

from tessera import catalog
from tessera.functions.adaptive import link_factor
from tessera.operators import graph, similarity, triangles
from tessera.plans import reports
from tessera.sources import edges as sources
from tessera.sources import live
from tessera.streaming import reservoir
from tessera.streaming import similarity as stream_similarity
from tessera.streaming.slots import Slots, StateSlots

SF = "/root/testdata/sf0.01"


def test_numbering_of_many_partitions(spark):
    """Default adaptive settings join partitions; every row stays, with its place."""
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        rows = spark.range(400_000).selectExpr("(id * 7919) % 400000 AS k", "id AS payload", "concat('text ', id) AS more")
        found = graph.settled(sources.numbered(rows, "k"))
        assert found.count() == 400_000 and found.where("seq <> k + 1").count() == 0
        assert found.selectExpr("count(DISTINCT payload) AS n", "count(DISTINCT more) AS m").first()[:] == (400_000, 400_000)
        best = graph.settled(reports.running_best(rows.selectExpr("k", "CAST((k * 31) % 1000 AS DOUBLE) AS v"), "k", "v"))
        assert best.count() == 400_000
        so_far = 0.0
        for r in best.where("k < 2000 OR k > 399000").orderBy("k").collect():
            so_far = max(so_far, float(r.k * 31 % 1000))
            assert r.best == (so_far if r.k < 2000 else 999.0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_empty_numbering(spark):
    none = spark.createDataFrame([], "k long, v double")
    assert sources.numbered(none, "k").count() == 0 and reports.running_best(none, "k", "v").count() == 0 and reports.resampled(none, "k", "v", 5).count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("5 5 4\n0 5\n0 6\nx y\n1\t5\n0 5\n1 5 9\n\n 2   7 \n99999999999999999999 1\n")
    assert sorted(sources.read_edge_list(spark, str(tmp_path / "edges.txt")).collect()) == [(0, 5), (0, 6), (1, 5), (2, 7)]
    (tmp_path / "two.txt").write_text("3 4\n0 5\n")
    assert sources.read_edge_list(spark, str(tmp_path / "two.txt")).collect() == [(0, 5)]
    assert len(sources.read_edge_list(spark, str(tmp_path / "two.txt"), header=False).collect()) == 2
    (tmp_path / "stream.tsv").write_text("1\t2\n3\t3\n2\t1\nbad\t4\n4\t1\n")
    assert [tuple(r) for r in sources.read_stream_file(spark, str(tmp_path / "stream.tsv")).orderBy("seq").collect()] == [(1, 1, 2), (2, 2, 1), (3, 4, 1)]
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 5)], "src long, dst long")
    sources.write_counts(triangles.dense_counts(edges, triangles.local_counts(edges)), str(tmp_path / "counts"))
    truth = sources.read_counts(spark, str(tmp_path / "counts"))
    assert sorted(map(tuple, truth.collect())) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0), (5, 0.0)]
    estimate = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 1.0), (3, 0.0), (4, 1.0)], "node long, triangles double")
    r = triangles.error_metrics(triangles.with_estimates(truth, estimate), "estimate", "truth").first()
    assert r.n == 5 and r.lape == pytest.approx((1 + 1) / 5) and r.mae == pytest.approx(3 / 5)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_edge_list(spark, str(tmp_path / "none.txt"))


def test_small_rules(spark):
    rows = spark.createDataFrame([(3.2,), (32.0,), (640.0,)], "b double").select(link_factor(sources.F.col("b")).alias("f")).collect()
    assert [r.f for r in rows] == [0.1, 0.5, 1.0]
    edges = spark.createDataFrame([(0, 5), (1, 5), (2, 6), (3, 6), (3, 5)], "u long, v long")
    assert {r.u for r in graph.overlapping(edges, edges.select("u").distinct(), 0).collect()} == {0, 1, 3}
    tiles = spark.createDataFrame([("dense", 30), ("sparse", 10), ("sparse", 10)], "target string, work long")
    assert reports.tile_balance(tiles).first()[:] == (30, 20, pytest.approx(2 / 3))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "u1 long, u2 long")
    assert {(r.u1, r.u2): r.sampled for r in reservoir.sampled_jaccard(edges, pairs, 1.0).collect()} == {(0, 1): 1.0, (0, 2): 0.0, (1, 1): 1.0}
    assert sorted(r.seq for r in similarity.seeded_order(edges).collect()) == [1, 2, 3, 4]


def random_graph(n, share, seed):
    rng = random.Random(seed)
    edges = [e for e in itertools.combinations(range(n), 2) if rng.random() < share]
    rng.shuffle(edges)
    return edges


def triangles_of(edges):
    have = set(edges)
    return [t for t in itertools.combinations(sorted({x for e in edges for x in e}), 3) if {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])} <= have]


def test_colours():
    for a in range(4):
        for b in range(4):
            for c in range(4):  # all edges of a triangle meet in the triple of its colours
                own = tuple(sorted((a, b, c)))
                for x, y in ((a, b), (a, c), (b, c)):
                    assert own in {tuple(sorted((x, y, z))) for z in range(4)}


@pytest.mark.parametrize("colours", [1, 3, 5])
def test_reservoirs_with_room_are_exact(spark, colours):
    edges = random_graph(40, 0.4, 1)
    assert all(reservoir.colour(x, 5) == spark.createDataFrame([(x,)], "v long").select(reservoir._colour("v", 5)).first()[0] for x in (0, 7, -3, 1 << 40))
    want = triangles_of(edges)
    stream = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*edges, (3, 3)])], "seq long, src long, dst long")
    got = {r.node: r.triangles for r in reservoir.estimate(stream, colours=colours, k=10_000, rate=0.1).collect()}
    assert got.pop(-1) == len(want)
    assert got == {x: sum(x in t for t in want) for x in got} and sum(got.values()) == 3 * len(want)
    assert reservoir.estimate(stream.limit(0), colours=colours, k=100, rate=0.1).collect() == [(-1, 0.0)]


@pytest.mark.parametrize("variant", ["fixed", "recorded", "adaptive"])
def test_coloured_reservoirs_are_unbiased(variant):
    """Small reservoirs for each triple of three colours, driven by hand: the mean of their sums is near the truth."""
    edges = random_graph(45, 0.5, 2)
    truth, total, runs = len(triangles_of(edges)), 0.0, 60
    colour = {x: reservoir.colour(x, 3) for e in edges for x in e}
    for seed in range(runs):
        held = reservoir.Coloured(3, k=100, rate=0.1, variant=variant, seed=seed)
        for a, b in edges:
            for triple in {tuple(sorted((colour[a], colour[b], c))) for c in range(3)}:
                held[triple].add(a, b)
        assert all(len(r.held.edges) <= 100 for r in held.held.values())
        total += sum(r.total for r in held.held.values())
    assert abs(total / runs / truth - 1) < 0.06


def test_structured_streaming(spark, tmp_path):
    """Micro-batches of files give what the batch replay gives; the log holds a row for each round."""
    edges = random_graph(30, 0.5, 3)
    rows = [(i, a, b) for i, (a, b) in enumerate(edges)]
    schema = "seq long, src long, dst long"
    for k in range(0, len(rows), 80):
        spark.createDataFrame(rows[k : k + 80], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    options = {"colours": 2, "k": 5000, "rate": 0.1}
    query = reservoir.stream_estimate(files, **options).writeStream.format("memory").queryName("estimates").outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    last = spark.sql("SELECT triple, max_by(total, t) AS total, max(t) AS t FROM estimates GROUP BY triple").collect()
    assert sum(r.total for r in last) == len(triangles_of(edges))
    log = reservoir.rounds(spark.createDataFrame(rows, schema), colours=2, k=40, rate=0.25, variant="adaptive").collect()
    assert log and all(r.increment >= 0 and r.rate >= 0.25 for r in log)
    assert all([x.round for x in sorted(own, key=lambda x: x.t)] == list(range(1, len(own) + 1)) for _, own in ((t, [x for x in log if x.triple == t]) for t in {x.triple for x in log}))


def grown_stream(spark, tmp_path, name, parts, run):
    """The rows' parts come one after the other; after each the stream is run to its end and stopped."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(*rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        stream = spark.readStream.schema(rows[1]).parquet(f"{tmp_path}/{name}-in")
        found = live.written(run(stream), f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-at")
    return found


@pytest.mark.parametrize("variant", ["recorded", "adaptive"])
def test_restarted_reservoirs(spark, tmp_path, variant):
    """Two restarts with evictions in between give what the batch replay gives; the state holds at most k slots."""
    edges = random_graph(60, 0.5, 4)
    rows = [(i, a, b) for i, (a, b) in enumerate(edges)]
    schema = "seq long, src long, dst long"
    options = {"colours": 2, "k": 120, "rate": 0.2, "variant": variant}
    parts = [(rows[:150], schema), (rows[150:400], schema), (rows[400:], schema)]
    found = grown_stream(spark, tmp_path, "edges", parts, lambda s: reservoir.stream_estimate(s, output_mode="append", **options))
    last = found.groupBy("triple").agg(sources.F.max_by("total", "t").alias("total"), sources.F.max("t").alias("t"), sources.F.max("round").alias("round"))
    batch = {r.node: r.triangles for r in reservoir.estimate(spark.createDataFrame(rows, schema), **options).collect()}
    assert sum(r.total for r in last.collect()) == pytest.approx(batch[-1]) and max(r.round for r in last.collect()) > 3
    nodes = grown_stream(spark, tmp_path, "local", parts, lambda s: reservoir.stream_estimate(s, local=True, output_mode="append", **options))
    assert {r.node: r.n for r in nodes.groupBy("node").agg(sources.F.sum("triangles").alias("n")).collect()} == pytest.approx({k: v for k, v in batch.items() if k >= 0})
    state = spark.read.format("statestore").option("stateVarName", "slots").load(f"{tmp_path}/edges-at")
    near = spark.read.format("statestore").option("stateVarName", "near").load(f"{tmp_path}/edges-at")
    slots = {r.triple: r.n for r in state.groupBy("key.triple").agg(sources.F.count("*").alias("n")).collect()}
    ends = {r.triple: r.n for r in near.groupBy("key.triple").agg(sources.F.sum(sources.F.size("user_map_value.ids")).alias("n")).collect()} if "user_map_value" in near.columns else {}
    assert slots and all(n <= 120 for n in slots.values()) and all(n <= 240 for n in ends.values())


def test_rates_by_round(spark):
    """The curve of rates against one replay for each triple of colours; the panels are JSON with as many values as places."""
    rng = random.Random(4)
    some = [(i, *rng.sample(range(60), 2)) for i in range(4_000)]
    stream = spark.createDataFrame(some, "seq long, src long, dst long")
    edges = {}
    for r in reservoir.dealt(stream, 4).orderBy("seq").collect():
        edges.setdefault(r.triple, []).append((r.src, r.dst))
    for z in (0.1, 0.9):
        rates = {}
        for triple, mine in edges.items():
            held = reservoir.Coloured(4, k=200, rate=0.1, variant="adaptive", z=z)[reservoir._numbers(triple, 4)]
            for e in mine:
                held.ended = None
                held.add(*e)
                if held.ended:
                    rates.setdefault(held.ended[0], []).append(held.ended[2])
        want = {k: sum(v) / len(v) for k, v in rates.items()}
        got = reservoir.rounds(stream, k=200, rate=0.1, variant="adaptive", z=z).groupBy("round").agg({"rate": "avg"}).collect()
        assert want and {r[0]: pytest.approx(r[1]) for r in got} == want
    panels = {r.z: json.loads(r.json) for r in catalog.QUERIES["panel_rates"](spark, SF).collect()}
    assert list(sorted(panels)) == [0.1, 0.3, 0.5, 0.7, 0.9] and all(len(p["point"]) == len(p["value"]) == 20 for p in panels.values())
    errors = json.loads(catalog.QUERIES["panel_reservoir_error"](spark, SF).first().json)
    assert [float(k) for k in errors["k"]] == [500, 5000, 50000, 1 << 22] and float(errors["mae"][-1]) == 0


def test_hubs_stay_exact(spark):
    """A hub with 8,000 leaves in a path: 7,999 triangles, however few slots a cell has."""
    edges = [(0, i) for i in range(1, 8001)] + [(i, i + 1) for i in range(1, 8000)]
    random.Random(0).shuffle(edges)
    stream = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "seq long, src long, dst long")
    for colours, k in ((4, 2048), (10, 600)):
        assert reservoir.fitted(stream, colours, k).groupBy("cell").count().agg(sources.F.max("count")).first()[0] <= k
        got = {r.node: r.triangles for r in reservoir.estimate(stream, colours=colours, k=k, rate=0.1, exact=True).collect()}
        assert got.pop(-1) == 7999 and got[0] == 7999 and got[1] == 1 and got[5] == 2


def test_full_reservoirs_stay_small(spark, monkeypatch):
    """Colours go by the number of edges, results stay exact, and a cell's reservoir goes when the next one begins, without garbage collection."""
    draw = random.Random(3)
    edges = {tuple(sorted(draw.sample(range(50), 2))) for _ in range(400)}
    stream = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "seq long, src long, dst long")
    truth = {r.node: r.triangles for r in triangles.local_counts(stream).collect()}
    monkeypatch.setattr(reservoir, "ROOM", 60)
    assert reservoir.colours_for(len(edges)) > 4
    got = {r.node: r.triangles for r in reservoir.estimate(stream, colours=None, exact=True, k=1 << 22, rate=0.1).collect()}
    assert got.pop(-1) == sum(truth.values()) / 3 and got == truth
    for parts, cell in ((1, "1"), (2, "1 0:0 0:1 1:0")):
        gc.disable()
        try:
            r = reservoir._reservoir(1, parts, cell, 4, k=10, rate=0.1)
            r.add(1, 2)
            freed = weakref.ref(r)
            del r
            assert freed() is None
        finally:
            gc.enable()


def test_live_edges(spark, tmp_path):
    """Lines come in three goes; each position is given once, in line order; other lines and self-loops get none."""
    (tmp_path / "in").mkdir()
    want = []
    for k in range(3):
        lines = [(100 * k + i, 7 * i + k) for i in range(50 + k)]
        want += [e for e in lines if e[0] != e[1]]
        (tmp_path / "in" / f"part-{k}").write_text("\n".join([*(f"{a}\t{b}" for a, b in lines), "1\t1", "x\ty", "", "5"]) + "\n")
        found = live.written(live.read_edge_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"))
        assert [tuple(r) for r in found.orderBy("seq").collect()] == [(i + 1, *e) for i, e in enumerate(want)]
    apart = live.written(live.read_edge_stream(spark, str(tmp_path / "in"), parts=4), str(tmp_path / "out4"), str(tmp_path / "at4")).collect()
    assert len({r.seq for r in apart}) == len(apart) == len(want) and sorted(r[1:] for r in apart) == sorted(want)
    assert [tuple(r[1:]) for r in sorted(apart) if r.src >= 200] == [e for e in want if e[0] >= 200]


def test_live_edges_in_ranges(spark, tmp_path, monkeypatch):
    """Lines come in three goes, the last one in two files; positions go on without gaps, in line order, and no task numbers all lines. A repeated micro-batch changes nothing."""
    monkeypatch.setattr(live, "sequenced", None)
    (tmp_path / "in").mkdir()
    (tmp_path / "empty").mkdir()
    assert live.write_edge_stream(spark, str(tmp_path / "empty"), str(tmp_path / "none"), str(tmp_path / "none-at")).count() == 0
    want = []
    run = lambda: live.write_edge_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at"))
    for go in ([0], [1], [2, 3]):
        for k in go:
            lines = [(100 * k + i, 7 * i + k) for i in range(50 + k)]
            want += [e for e in lines if e[0] != e[1]]
            (tmp_path / "in" / f"part-{k}").write_text("\n".join([*(f"{a}\t{b}" for a, b in lines), "1\t1", "x\ty", "", "5"]) + "\n")
        found = run()
        assert [tuple(r) for r in found.orderBy("seq").collect()] == [(i + 1, *e) for i, e in enumerate(want)]
    for last in list((tmp_path / "at" / "commits").glob("*2*")):
        last.unlink()  # as if it had failed after writing
    assert [tuple(r) for r in run().orderBy("seq").collect()] == [(i + 1, *e) for i, e in enumerate(want)]


def test_states_by_blocks():
    """Slots read back from a state's blocks are those that were put and not removed; a state has a row for each block, not for each slot."""

    class State(dict):
        containsKey, getValue = dict.__contains__, dict.__getitem__  # noqa: N815

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

        removeKey = dict.__delitem__  # noqa: N815

    draw, kept, slot_state, near_state = random.Random(2), Slots(), State(), State()
    for _ in range(4):
        held = StateSlots(slot_state, near_state)
        for _ in range(600):
            i = draw.randrange(1500)
            if i in kept.edges:
                assert held.slot(i) == kept.slot(i)
                kept.remove(i)
                held.remove(i)
            else:
                edge = (draw.randrange(3000), draw.randrange(3000), draw.random(), draw.randrange(9), draw.random())
                kept.put(i, edge)
                held.put(i, edge)
        held.write()
        again = StateSlots(slot_state, near_state)
        assert {i: again.slot(i) for i in kept.edges} == kept.edges and set(again.edges) == set(kept.edges)
        assert {v: again.neighbours(v) for v in range(3000) if again.neighbours(v)} == kept.near
    assert len(slot_state) <= 6 and len(near_state) <= 3
    for i in list(again.edges):
        again.remove(i)
    again.write()
    assert not slot_state and not near_state


def bipartite(seed, left=24, right=120, share=0.4):
    rng = random.Random(seed)
    edges = [(u, v) for u in range(left) for v in range(right) if rng.random() < share * (0.5 + (u % 3) / 3)]
    rng.shuffle(edges)
    return edges


def jaccard(edges, pair):
    a, b = ({v for u, v in edges if u == x} for x in pair)
    return len(a & b) / len(a | b)


def test_reservoir_jaccard_exact(spark):
    edges = bipartite(1)
    stream = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "seq long, src long, dst long")
    pairs = spark.createDataFrame([*itertools.combinations(range(24), 2), (3, 3), (0, 99)], "u1 long, u2 long")
    right = stream_similarity.fitting(stream, 3, 200)
    assert right > 1
    for colours, cut_up, k in ((1, 1, 5000), (3, right, 200)):
        for r in stream_similarity.reservoir_jaccard(stream, pairs, colours, cut_up, k=k, rate=0.1).collect():
            want = 1.0 if r.u1 == r.u2 else 0.0 if r.u2 == 99 else jaccard(edges, (r.u1, r.u2))
            assert r.sampled == pytest.approx(want) and r.estimate == pytest.approx(want)


def test_reservoir_jaccard_means():
    """100 seeds, half and less of the edges kept: the mean estimate is within 2 % of the mean similarity."""
    edges = bipartite(2)
    pairs = list(itertools.combinations(range(24), 2))
    truth, total, raw = sum(jaccard(edges, p) for p in pairs), 0.0, 0.0
    for seed in range(100):
        r = stream_similarity._made(0, None, {"k": 500, "rate": 0.1, "seed": seed})
        for e in edges:
            r.add(*e)
        assert len(r.held.edges) <= 500 and len(edges) > 900
        probe = stream_similarity.Probe(r)
        for p in pairs:
            met, sizes, c, d, vc, cv, vd = probe.pair(*p)
            if d > c:
                total += c / (d - c) - (d * vc - (d + c) * cv + c * vd) / (d - c) ** 3
            raw += met / max(1, sizes - met)
    assert abs(total / 100 / truth - 1) < 0.02 and raw / 100 / truth < 0.9


def test_dense_reservoir_pairs_go_block_by_block(spark):
    """The blocks' pairs, with and without copies, against those asked for one by one; the catalog's dense pairs are not shuffled."""
    rng = random.Random(4)
    near = {u: sorted(rng.sample(range(30), 12)) for u in range(60)}
    for copies in (1, 5):
        edges = [(u + 60 * c, v) for c in range(copies) for u in near for v in near[u]]
        e = graph.settled(spark.createDataFrame(edges, "u long, v long"))
        stream = graph.settled(sources.as_stream(e))
        for right, k in ((1, 40), (2, 150), (1, 5000)):
            options = {"colours": 3, "right": right, "k": k, "rate": 0.1}
            blocks = similarity.block_pairs(e, samples=stream_similarity.samples(stream, **options))
            got = {(r.u1, r.u2): r for r in blocks.collect()}
            want = stream_similarity.reservoir_jaccard(stream, similarity.pairs(e), **options).collect()
            assert len(got) == len(want) > 1000
            for r in want:
                g = got[r.u1, r.u2]
                assert (g.common, g.jaccard) == (r.common, r.jaccard) and g.sampled == pytest.approx(r.sampled) and g.estimate == pytest.approx(r.estimate, abs=1e-9)
        if copies > 1:
            deg = {u: len(near[u % 60]) for u in range(300)}
            assert all((r.deg1, r.deg2) == (deg[r.u1], deg[r.u2]) for r in got.values())
    for name in ("stream_jaccard_reservoir", "stream_jaccard_full"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


def test_copies_are_compared_once(spark, monkeypatch):
    """Classes of copies of unequal sizes and degrees: pairs, estimates and samples as those of the joins."""
    rng = random.Random(6)
    shapes = [sorted(rng.sample(range(20), rng.randrange(3, 12))) for _ in range(12)]
    rows = [(u, v) for u in range(150) for v in shapes[u * u % 12]]
    e = graph.settled(spark.createDataFrame(rows, "u int, v long"))
    sig, keep = graph.settled(similarity.signatures(e, 16)), reservoir.kept(0.5, "v")
    monkeypatch.setattr(similarity, "PACK", 4)
    for most in (similarity.BROADCAST, 0):
        monkeypatch.setattr(similarity, "BROADCAST", most)
        found = similarity.block_pairs(e, sig=sig, kept=keep)
        assert "explode(a" in str(found._jdf.queryExecution())
        got = sorted(tuple(r) for r in found.collect())
        deg = {u: len(shapes[u * u % 12]) for u in range(150)}
        assert all(r[6:] == (deg[r[0]], deg[r[1]]) for r in got)
    monkeypatch.setattr(similarity, "dense", lambda edges: False)
    monkeypatch.setattr(similarity, "pairs_of_all", lambda edges: math.inf)
    want = reservoir.sampled_jaccard(e, similarity.estimates(similarity.pairs(e), sig), 0.5)
    assert [r[:6] for r in got] == sorted(tuple(r) for r in want.select(found.columns[:6]).collect()) and len(got) > 5000


def test_stream_similarities(spark, tmp_path):
    """Probes are answered as of their place; two restarts give what the batch replay gives."""
    edges = bipartite(3)
    schema = "seq long, src long, dst long, probe boolean"
    rows = [(i, *e, False) for i, e in enumerate(edges)]
    n = len(rows)
    asked = [(n, 0, 1, True), (n + 1, 2, 5, True)]
    parts = [([*rows[:400], (399, 0, 1, True)], schema), (rows[400:900], schema), ([*rows[900:], *asked], schema)]
    options = {"colours": 2, "right": 2, "k": 150, "rate": 0.2}
    found = {(r.seq, r.u1, r.u2): r.estimate for r in stream_similarity.similarities(grown_stream(spark, tmp_path, "probes", parts, lambda s: stream_similarity.stream_similarities(s, **options))).collect()}
    assert set(found) == {(399, 0, 1), (n, 0, 1), (n + 1, 2, 5)}
    stream = spark.createDataFrame([r[:3] for r in rows], "seq long, src long, dst long")
    batch = {(r.u1, r.u2): r.estimate for r in stream_similarity.reservoir_jaccard(stream, spark.createDataFrame([(0, 1), (2, 5)], "u1 long, u2 long"), **options).collect()}
    assert found[n, 0, 1] == pytest.approx(batch[0, 1]) and found[n + 1, 2, 5] == pytest.approx(batch[2, 5])


def test_survivors_by_place(monkeypatch):
    """What a reservoir holds is known from the number of edges alone: as one that is fed with them, in a few numbers a slot."""
    for variant in ("recorded", "fixed", "adaptive"):
        for n, k, rate, drawn in ((5, 10, 0.1, 99), (11, 10, 0.1, 99), (300, 10, 0.1, 7), (5000, 137, 0.33, 1000), (20000, 500, 0.1, 1 << 18)):
            monkeypatch.setattr(stream_similarity, "DRAWN", drawn)
            made = lambda: stream_similarity._made(5, None, {"k": k, "rate": rate, "variant": variant, "seed": 3})  # noqa: B023, E731
            r = made()
            for t in range(1, n + 1):
                r.add(t, t)
            want = sorted((r.held.edges[i][0], 1 / r.survival(i)) for i in r.held.edges)
            places, weights = stream_similarity.survivors(n, made())
            assert places.tolist() == [p for p, _ in want] and weights == pytest.approx([w for _, w in want])
    tracemalloc.start()
    places, _ = stream_similarity.survivors(400_000, stream_similarity._made(1, None, {"k": 100_000, "rate": 0.1}))
    assert 80_000 < len(places) <= 100_000 and tracemalloc.get_traced_memory()[1] < 250 * 100_000
    tracemalloc.stop()


def test_reservoir_errors_are_summed_up_in_blocks(spark, monkeypatch):
    """Several reservoirs' errors in one pass, with copies and without, are those of their pairs' rows; the stream is dealt out once."""
    rng, slots = random.Random(4), (12, 60, 200, 5000)
    near = {u: sorted(rng.sample(range(30), rng.randrange(4, 12))) for u in range(70)}
    monkeypatch.setattr(similarity, "BLOCK", 16)
    for copies, right in ((1, 1), (3, 2)):
        e = graph.settled(spark.createDataFrame([(u + 70 * c, v) for c in range(copies) for u in near for v in near[u]], "u long, v long"))
        stream = graph.settled(sources.as_stream(e))
        found = stream_similarity.several_samples(stream, slots, 3, right, rate=0.1)
        got = {r.which: r[1:] for r in similarity.block_errors(e, 0.01, samples=tuple(found)).collect()}
        for which, k in enumerate(slots):
            rows = similarity.block_pairs(e, samples=stream_similarity.samples(stream, 3, right, k=k, rate=0.1))
            want = triangles.error_metrics(rows, "estimate", "jaccard", 0.01).first()
            assert want.n > 1000 and got[which] == pytest.approx(tuple(want), abs=1e-6)
        assert got[3][1:] == pytest.approx((0, 0, 0), abs=1e-12) and got[0][1] > got[2][1] > 0
    plan = catalog.QUERIES["reservoir_errors"](spark, SF)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "u1" not in plan
