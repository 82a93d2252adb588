"""Registries of the library's queries and of SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.adaptive import adaptive_rate, link_factor
from tessera.operators import biclique, graph, similarity, triangles
from tessera.plans import reports
from tessera.sources import edges as sources
from tessera.sources import live
from tessera.streaming import reservoir
from tessera.streaming import similarity as stream_similarity

ORDER_PART = "e AS (SELECT DISTINCT l_orderkey AS u, l_partkey AS v FROM lineitem)"
USER_K = "e AS (SELECT DISTINCT user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"
USER_NEXT = """p AS (SELECT user_id AS a, lead(user_id) OVER (ORDER BY event_id) AS b, row_number() OVER (ORDER BY event_id) AS s FROM events),
g AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(s) AS first FROM p WHERE a <> b GROUP BY 1, 2)"""
TRIANGLES = "t AS (SELECT x.src AS x, x.dst AS y, z.dst AS z FROM g x JOIN g y ON x.dst = y.src JOIN g z ON z.src = x.src AND z.dst = y.dst)"
LOCAL = "l AS (SELECT node, CAST(count(*) AS DOUBLE) AS triangles FROM (SELECT unnest([x, y, z]) AS node FROM t) GROUP BY 1)"
DEGREES = "d AS (SELECT u, count(*) AS deg FROM e GROUP BY 1)"
PAIRS = "p AS (SELECT a.u AS u1, b.u AS u2, count(*) AS common FROM e a JOIN e b ON a.v = b.v AND a.u < b.u GROUP BY 1, 2)"
JACCARD = "j AS (SELECT u1, u2, common, common / (x.deg + y.deg - common) AS jaccard FROM p JOIN d x ON x.u = u1 JOIN d y ON y.u = u2)"


HASH_COUNTS = similarity.hash_counts()
#: Each one and the next are two hashes that draw a sample's pairs.
SAMPLE_SEEDS = (42, 44, 46)


def core_sql(k: int, rounds: int = 10) -> str:
    """Unrolled rounds of peeling; c is the core's edges."""
    steps = []
    for i in range(rounds):
        a = "e" if i == 0 else f"k{i}"
        steps.append(f"h{i + 1} AS (SELECT * FROM {a} WHERE u IN (SELECT u FROM {a} GROUP BY 1 HAVING count(*) >= {k})), k{i + 1} AS (SELECT * FROM h{i + 1} WHERE v IN (SELECT v FROM h{i + 1} GROUP BY 1 HAVING count(*) >= {k}))")
    return ", ".join(steps) + f", c AS (SELECT * FROM k{rounds})"


def minhash_sql(hashes: int) -> str:
    each = ", ".join(f"min((v * {similarity.parameters(h)[0]} + {similarity.parameters(h)[1]}) % {similarity.PRIME})" for h in range(hashes))
    return f"s AS (SELECT u, [{each}] AS sig FROM e GROUP BY u)"


def biclique_sql(tau: int, tail: str, pairs: str = "j", above: float = 0.25) -> str:
    """b: sets of max(2, tau) with least similarity and right sides; of more than two, those whose pairs are above a bound."""
    sets = [f"q AS (SELECT * FROM {pairs} WHERE common >= {tau} AND jaccard > {0.0 if tau == 2 else above}), m2 AS (SELECT [u1, u2] AS members, jaccard AS sim FROM q)"]
    for n in range(3, tau + 1):
        joins = " ".join(f"JOIN q p{k} ON p{k}.u1 = m.members[{k}] AND p{k}.u2 = p1.u2" for k in range(2, n))
        least = ", ".join(["m.sim", *(f"p{k}.jaccard" for k in range(1, n))])
        sets.append(f"m{n} AS (SELECT list_append(m.members, p1.u2) AS members, least({least}) AS sim FROM m{n - 1} m JOIN q p1 ON p1.u1 = m.members[1] AND p1.u2 > m.members[{n - 1}] {joins})")
    return f"""{", ".join(sets)}, x AS (SELECT members, sim, v FROM (SELECT members, sim, unnest(members) AS u FROM m{max(2, tau)}) JOIN e USING (u) GROUP BY 1, 2, 3 HAVING count(*) = len(members)),
b AS (SELECT sim, members, list_sort(list(v)) AS "right" FROM x GROUP BY sim, members HAVING count(*) >= {tau}) {tail}"""


def affine_sql(value: str, h: int) -> str:
    a, b = similarity.parameters(h)
    return f"((({value}) % {similarity.PRIME}) * {a} + {b}) % {similarity.PRIME}"


def kept_sql(share: float, *ids: str) -> str:
    """As reservoir.kept."""
    a, b = similarity.parameters(1)
    value = str(b)
    for k, name in enumerate(ids):
        value = f"(({value} + ({name} % {similarity.PRIME}) * {similarity.parameters(k + 2)[0]}) % {similarity.PRIME})"
    return f"(({value} * {a}) % {similarity.PRIME} < {int(share * similarity.PRIME)})"


def sampled_jaccard_sql(share: float) -> str:
    """js: pairs with ``sampled``; needs e, j."""
    return f"""ek AS (SELECT * FROM e WHERE {kept_sql(share, "v")}), dk AS (SELECT u, count(*) AS deg FROM ek GROUP BY 1), pk AS (SELECT a.u AS u1, b.u AS u2, count(*) AS common FROM ek a JOIN ek b ON a.v = b.v AND a.u < b.u GROUP BY 1, 2),
js AS (SELECT j.u1, j.u2, j.common, j.jaccard, coalesce(pk.common / (x.deg + y.deg - pk.common), 0.0) AS sampled FROM j LEFT JOIN pk ON pk.u1 = j.u1 AND pk.u2 = j.u2 LEFT JOIN dk x ON x.u = j.u1 LEFT JOIN dk y ON y.u = j.u2)"""


def _bicliques(graph_of, tau, **options):
    return lambda s, d: biclique.search(graph_of(s, d), tau, **options)


def _local_without(**rules):
    """The local search without one of its rules."""

    def run(s, d):
        e = sources.user_k(s, d)
        return biclique.local(e, 3, _queries_of(s, e), **rules)

    return run


def _queries_of(s, edges):
    return edges.select(F.col("u").alias("q")).distinct().orderBy("q").limit(20)


def _stream(variant, k, colours=4, exact=False):
    """exact: colours go by the number of edges, and triples with more edges than fit are split until all do, hubs' as well."""
    return lambda s, d: reservoir.estimate(sources.user_next(s, d), colours=None if exact else colours, exact=exact, k=k, rate=0.1, variant=variant)


def _live(s, d):
    """The edges of the event log as text files, read as a live stream: seq, src, dst as they are numbered, and the folder."""
    folder = f"{graph.shared_folder(s)}/live-{uuid.uuid4().hex}"
    lines = sources.user_next(s, d).repartitionByRange("seq").sortWithinPartitions("seq").select(F.concat_ws("\t", "src", "dst"))
    lines.write.text(f"{folder}/lines")
    return live.write_edge_stream(s, f"{folder}/lines", f"{folder}/edges", f"{folder}/edges-at"), folder


def _live_reservoir(s, d):
    """Triangles of the live stream, by reservoirs whose slots are states of a second stream; all edges fit."""
    edges, folder = _live(s, d)
    stream = s.readStream.schema(edges.schema).parquet(f"{folder}/edges/*")
    found = live.written(reservoir.stream_estimate(stream, colours=reservoir.colours_for(edges.count()), k=1 << 22, rate=0.1, variant="adaptive", output_mode="append"), f"{folder}/found", f"{folder}/found-at")
    return found.groupBy("triple").agg(F.max_by("total", "t").alias("total")).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("triangles"))


def _estimates(s, d, hashes=64):
    return similarity.estimated(sources.user_k(s, d), hashes)


def _candidates_above(s, d):
    """Pairs whose signatures agree in two of five hashes and more, found by the signatures alone, with their similarities."""
    e = graph.settled(sources.user_k(s, d))
    if similarity.dense(e):
        return similarity.block_pairs(e, hashes=64, least_estimate=0.4).drop("deg1", "deg2")
    found = graph.settled(similarity.candidates_above(graph.settled(similarity.signatures(e, 64)), 64, 0.4))
    return similarity.compared(found, e).join(found, ["u1", "u2"])


def _hash_jaccard(share):
    def run(s, d):
        e = graph.settled(sources.user_k(s, d))
        if similarity.dense(e):
            return similarity.block_pairs(e, kept=reservoir.kept(share, "v")).drop("deg1", "deg2")
        return reservoir.sampled_jaccard(e, similarity.pairs(e), share)

    return run


def _reservoir_jaccard(s, d, k=None, colours=4):
    """Pairs with their similarity, and what reservoirs of k slots over the replayed stream say; without k, all edges fit."""
    e = graph.settled(sources.user_k(s, d))
    stream = graph.settled(sources.as_stream(e))
    right = 1 if k else stream_similarity.fitting(stream, colours, 1 << 22)
    if similarity.dense(e):
        return similarity.block_pairs(e, samples=stream_similarity.samples(stream, colours, right, k=k or 1 << 22, rate=0.1)).drop("deg1", "deg2")
    return stream_similarity.reservoir_jaccard(stream, similarity.pairs(e), colours, right, k=k or 1 << 22, rate=0.1)


def _reservoir_errors(s, d):
    """Errors of the reservoirs' estimate by number of slots, above the noise; none where all edges fit."""
    slots, e = (500, 5_000, 50_000, 1 << 22), graph.settled(sources.user_k(s, d))
    if similarity.dense(e):
        stream = graph.settled(sources.as_stream(e))
        return _named(similarity.block_errors(e, 0.01, samples=tuple(stream_similarity.several_samples(stream, slots, rate=0.1))), "k", slots)
    found = None
    for k in slots:
        one = triangles.error_metrics(_reservoir_jaccard(s, d, k), "estimate", "jaccard", 0.01).withColumn("k", F.lit(k))
        found = found.union(one) if found else one
    return found


def _hybrid(s, d):
    e = graph.settled(sources.user_k(s, d))
    if similarity.dense(e):
        rows = similarity.block_pairs(e, hashes=64, kept=reservoir.kept(0.5, "v"))
    else:
        deg = graph.degree(e, "u")
        rows = reservoir.sampled_jaccard(e, similarity.estimated(e, 64), 0.5).join(deg.toDF("u1", "deg1"), "u1").join(deg.toDF("u2", "deg2"), "u2")
    return rows.select("u1", "u2", similarity.confidence_blend(F.col("estimate"), F.col("sampled"), F.col("deg1"), F.col("deg2")).alias("estimate"))


def _sampled_errors(s, d):
    """Errors of the sampled similarity by share, above the noise."""
    shares, e = (0.1, 0.3, 0.5), graph.settled(sources.user_k(s, d))
    if similarity.dense(e):
        return _named(similarity.block_errors(e, 0.01, kept=tuple(reservoir.kept(x, "v") for x in shares)), "share", shares)
    found = None
    for share in shares:
        one = triangles.error_metrics(_hash_jaccard(share)(s, d), "sampled", "jaccard", 0.01).withColumn("share", F.lit(share))
        found = found.union(one) if found else one
    return found


def _named(errors, name, values):
    """The errors of several estimates, which are numbered, with what they are called."""
    return errors.withColumn(name, F.element_at(F.array(*map(F.lit, values)), F.col("which").cast("int") + 1)).drop("which")


def _minhash_errors(s, d, counts=(16, 32, 64), noise=None):
    """Errors of the estimate by number of hashes."""
    e, found = graph.settled(sources.user_k(s, d)), None
    if similarity.dense(e):
        return _named(similarity.block_errors(e, noise, hashes=counts), "hashes", counts)
    for hashes in counts:
        one = triangles.error_metrics(similarity.estimated(e, hashes), "estimate", "jaccard", noise).withColumn("hashes", F.lit(hashes))
        found = found.union(one) if found else one
    return found


def _lape(s, d):
    """Written and read again: dense counts, exact and by a sample of half of the edges."""
    edges = sources.user_next(s, d)
    tables = []
    for counts in (triangles.local_counts(edges), reservoir.sampled_counts(edges, 0.5)):
        path = f"{graph.shared_folder(s)}/counts-{uuid.uuid4().hex}"
        sources.write_counts(triangles.dense_counts(edges, counts), path)
        tables.append(sources.read_counts(s, path))
    return triangles.error_metrics(triangles.with_estimates(*tables), "estimate", "truth")


def _core_sets(s, d, k=2):
    """The vertices of the k-core's two sides, as frames of u and of v."""
    found = graph.core(sources.order_part(s, d), k)
    return sources.order_part(s, d), found.select("u").distinct(), found.select("v").distinct()


def _lsh_local(s, d):
    e = sources.user_k(s, d)
    group = similarity.signatures(e, 1).select("u", F.col("sig")[0].alias("grp"))
    return biclique.local(e, 2, _queries_of(s, e), group=group)


def _overlapping(s, d):
    e = sources.user_k(s, d)
    return graph.overlapping(e, e.select("u").distinct(), e.agg(F.min("u")).first()[0])


def _convergence(s, d):
    rows = similarity.pairs(sources.user_k(s, d)).groupBy(F.col("u1").alias("u")).agg(F.max("jaccard").alias("sim"))
    return reports.running_best(rows.withColumn("part", F.lit(0)), "u", "sim")


def _hash_curve(s, d):
    """sample, hashes, n, mae over three samples of 300 pairs each; only their vertices get signatures."""
    e = sources.user_k(s, d)
    drawn = None
    for seed in SAMPLE_SEEDS:
        one = similarity.validation_pairs(e, 300, seed).withColumn("sample", F.lit(seed))
        drawn = drawn.union(one) if drawn else one
    drawn = graph.settled(drawn)
    ends = drawn.select(F.explode(F.array("u1", "u2")).alias("u")).distinct()
    sig = graph.settled(similarity.signatures(e.join(ends, "u", "left_semi"), max(HASH_COUNTS)))
    return similarity.error_curve(drawn, sig, HASH_COUNTS, "sample")


def _rate_curve(s, d):
    """z, point, value: the reservoirs' mean rate by round, at 20 places from the first round to the last, for five bases of the rate's rule."""
    stream = graph.settled(sources.user_next(s, d))
    found = None
    for z in (0.1, 0.3, 0.5, 0.7, 0.9):
        rates = graph.settled(reservoir.rounds(stream, k=200, rate=0.1, variant="adaptive", z=z).groupBy("round").agg(F.avg("rate").alias("rate")))
        one = reports.resampled(rates, "round", "rate", 20).withColumn("z", F.lit(z))
        found = found.union(one) if found else one
    return found


def _minhash_skip(s, d):
    """Vertices in a shuffled order, and whether a search would skip them: its best so far is above a half, and no neighbour's estimate comes to half of it. Lossy."""
    e = sources.user_k(s, d)
    found = similarity.pairs(e).select(F.explode(F.array("u1", "u2")).alias("u"), "jaccard").groupBy("u").agg(F.max("jaccard").alias("sim"))
    order = similarity.seeded_order(e)
    best = reports.running_best(order.join(found, "u"), "seq", "sim").select("seq", "best")
    rows = similarity.neighbour_estimates(order, similarity.signatures(e, 64)).join(best.select((F.col("seq") + 1).alias("seq"), "best"), "seq", "left")
    rows = rows.withColumn("best", F.coalesce("best", F.lit(0.0)))
    return rows.withColumn("skip", (F.col("best") > 0.5) & (F.col("estimate") < F.col("best") * 0.5))


def _alpha(s, d):
    e = sources.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("hits"), F.countDistinct("o_orderpriority").alias("interval"))
    return e.select("o_custkey", adaptive_rate(0.25, F.col("interval"), F.col("hits"), 0.1).alias("rate"))


def _approximate(s, d):
    e = sources.user_k(s, d)
    left = graph.core(e, 2).select("u").distinct()
    return biclique.search(e, 2, group=similarity.prefix_groups(similarity.signatures(e, 10).join(left, "u", "left_semi"), 2).select("u", "grp"))


QUERIES = {
    "edges_distinct": lambda s, d: sources.order_part(s, d),
    "degree_left": lambda s, d: graph.degree(sources.order_part(s, d), "u"),
    "degree_right": lambda s, d: graph.degree(sources.order_part(s, d), "v"),
    "adjacency": lambda s, d: graph.adjacency(sources.order_part(s, d)),
    "replay_stream": lambda s, d: sources.as_stream(sources.user_k(s, d)),
    "twohop_pairs": lambda s, d: graph.two_hop(sources.order_part(s, d)),
    "onetwohop": lambda s, d: graph.one_two_hop(sources.order_part(s, d)),
    "jaccard_pairs": lambda s, d: similarity.pairs(sources.order_part(s, d), 2),
    "jaccard_above": lambda s, d: similarity.pairs(sources.order_part(s, d), above=0.3),
    "lsh_pairs": lambda s, d: similarity.lsh_pairs(sources.order_part(s, d), 0.5),
    "local_candidates": lambda s, d: similarity.candidates(sources.user_k(s, d), _queries_of(s, sources.user_k(s, d)), 0.2),
    "kcore_2": lambda s, d: graph.core_vertices(sources.order_part(s, d), 2),
    "kcore_3": lambda s, d: graph.core_vertices(sources.order_part(s, d), 3),
    "induced_subgraph": lambda s, d: graph.induced(*_core_sets(s, d)),
    "remove_nodes": lambda s, d: graph.without(*_core_sets(s, d)),
    "overlapping": _overlapping,
    "biclique_global_t2": _bicliques(sources.order_part, 2),
    "biclique_global_t3": _bicliques(sources.user_k, 3),
    "biclique_global_t4": _bicliques(sources.user_k, 4),
    "biclique_topk": _bicliques(sources.order_part, 2, k=10),
    "biclique_local_t2": lambda s, d: biclique.local(sources.user_k(s, d), 2, _queries_of(s, sources.user_k(s, d))),
    "biclique_local_t3": lambda s, d: biclique.local(sources.user_k(s, d), 3, _queries_of(s, sources.user_k(s, d))),
    "biclique_local_nohop": _local_without(hop=False),
    "biclique_local_nosfs": _local_without(by_sim=False),
    "biclique_local_nosfs2": _local_without(by_pairs=False),
    "biclique_local_group_t2": _lsh_local,
    "biclique_print": lambda s, d: biclique.printed(biclique.search(sources.order_part(s, d), 2, k=5)),
    "biclique_ablation_nocore": _bicliques(sources.order_part, 2, use_core=False),
    "biclique_ablation_nosim": _bicliques(sources.order_part, 2, use_bound=False),
    "biclique_global_approx": _approximate,
    "minhash_sig": lambda s, d: similarity.signatures(sources.order_part(s, d), 16),
    "minhash_estimate": _estimates,
    "minhash_candidates": _candidates_above,
    "trie_groups": lambda s, d: similarity.prefix_groups(similarity.signatures(sources.user_k(s, d), 10), 2),
    "lsh_groups": lambda s, d: similarity.lsh_groups(similarity.signatures(sources.order_part(s, d), 4), 1),
    "lsh_groups_4": lambda s, d: similarity.lsh_groups(similarity.signatures(sources.order_part(s, d), 4), 4),
    "stream_jaccard_full": lambda s, d: _reservoir_jaccard(s, d).drop("estimate"),
    "stream_jaccard_reservoir": lambda s, d: _reservoir_jaccard(s, d, 2_000),
    "reservoir_errors": _reservoir_errors,
    "stream_jaccard_sampled": _hash_jaccard(0.5),
    "hybrid_estimate": _hybrid,
    "mae_rmse": lambda s, d: _minhash_errors(s, d, (64,), 0.01).drop("hashes"),
    "minhash_errors": _minhash_errors,
    "sampled_errors": _sampled_errors,
    "minhash_skip": _minhash_skip,
    "validation_pairs": lambda s, d: similarity.validation_pairs(sources.user_k(s, d), 300),
    "seeded_order": lambda s, d: similarity.seeded_order(sources.order_part(s, d)),
    "triangles_global": lambda s, d: triangles.triangles(sources.user_next(s, d)).agg(F.count("*").alias("n")),
    "triangles_local": lambda s, d: triangles.local_counts(sources.user_next(s, d)),
    "triangles_dense_output": lambda s, d: triangles.dense_counts(sources.user_next(s, d), triangles.local_counts(sources.user_next(s, d))),
    "triangle_vertices": lambda s, d: triangles.local_counts(sources.user_next(s, d)).agg(F.count_if(F.col("triangles") > 0).alias("n")),
    "lape": _lape,
    "reservoir1_full": _stream("fixed", 1 << 22, exact=True),
    "reservoir2_full": _stream("recorded", 1 << 22, exact=True),
    "reservoirplus_full": _stream("adaptive", 1 << 22, exact=True),
    "reservoir1_sampled": _stream("fixed", 500),
    "reservoir2_sampled": _stream("recorded", 500),
    "reservoirplus_sampled": _stream("adaptive", 500),
    "reservoir_rounds": lambda s, d: reservoir.rounds(sources.user_next(s, d), k=500, rate=0.1, variant="adaptive"),
    "live_edges": lambda s, d: _live(s, d)[0],
    "live_reservoir": _live_reservoir,
    "triangles_hash_sampled": lambda s, d: reservoir.sampled(sources.user_next(s, d), 0.5),
    "tiles": lambda s, d: reports.tiles(sources.order_part(s, d), 2, 0.5),
    "tile_balance": lambda s, d: reports.tile_balance(reports.tiles(sources.order_part(s, d), 2, 0.5)),
    "blocks": lambda s, d: reports.blocks(sources.order_part(s, d), "u"),
    "blocks_right": lambda s, d: reports.blocks(sources.order_part(s, d), "v"),
    "link_factor": lambda s, d: sources.table(s, d, "part").select("p_partkey", link_factor(F.col("p_size")).alias("factor")),
    "alpha_fold": _alpha,
    "convergence": _convergence,
    "resample": lambda s, d: reports.resampled(_convergence(s, d), "u", "best", 20).withColumn("part", F.lit(0)),
    "panel_json": lambda s, d: reports.panel(reports.resampled(_convergence(s, d), "u", "best", 20), "point", "value"),
    "minhash_curve": _hash_curve,
    "panel_minhash_error": lambda s, d: reports.panel(_hash_curve(s, d), "hashes", "mae", by=("sample",)),
    "panel_reservoir_error": lambda s, d: reports.panel(_reservoir_errors(s, d), "k", "mae"),
    "panel_rates": lambda s, d: reports.panel(_rate_curve(s, d), "point", "value", by=("z",)),
    "allgather_union": lambda s, d: sources.table(s, d, "lineitem").where("l_orderkey is not null and l_partkey is not null").select(F.explode(F.array("l_orderkey", "l_partkey")).alias("id")).distinct(),
    "allreduce_best": lambda s, d: similarity.pairs(sources.user_k(s, d)).agg(F.max(F.struct("jaccard", (-F.col("u1")).alias("a"), (-F.col("u2")).alias("b"))).alias("m")).select("m.jaccard", (-F.col("m.a")).alias("u1"), (-F.col("m.b")).alias("u2")),
    "top_queries": lambda s, d: _queries_of(s, sources.order_part(s, d)),
}

_sim = f"WITH {ORDER_PART}, {DEGREES}, {PAIRS}, {JACCARD}, "
_usim = f"WITH {USER_K}, {DEGREES}, {PAIRS}, {JACCARD}, "
_tri = f"WITH {USER_NEXT}, {TRIANGLES}, {LOCAL} "
_est = f"{_usim}{minhash_sql(64)}, m AS (SELECT u1, u2, common, jaccard, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 64 AS estimate FROM j JOIN s x ON x.u = u1 JOIN s y ON y.u = u2) "
_best = 'SELECT * FROM b ORDER BY sim DESC, members LIMIT '
#: The best of four has pairs above this over the test data; a lower bound gives the same row more slowly.
_T4_ABOVE = 0.4
_LOCAL_BEST = ", k AS (SELECT DISTINCT u FROM e ORDER BY u LIMIT 20), o AS (SELECT unnest(members) AS q, * FROM b) SELECT q, sim, members, \"right\" FROM o WHERE q IN (FROM k) QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, members) = 1"
_local3 = _usim + """k AS (SELECT DISTINCT u FROM e ORDER BY u LIMIT 20), w AS (SELECT u1 AS a, u2 AS b, jaccard FROM j WHERE common >= 3 UNION ALL SELECT u2, u1, jaccard FROM j WHERE common >= 3),
m AS (SELECT x.a AS q, list_sort([x.a, x.b, y.b]) AS members, least(x.jaccard, y.jaccard, z.jaccard) AS sim FROM w x JOIN w y ON x.a = y.a AND x.b < y.b JOIN w z ON z.a = x.b AND z.b = y.b WHERE x.a IN (FROM k)),
r AS (SELECT u, list_sort(list(v)) AS n FROM e GROUP BY 1), o AS (SELECT q, sim, members, list_sort(list_intersect(list_intersect(x.n, y.n), z.n)) AS "right" FROM m JOIN r x ON x.u = members[1] JOIN r y ON y.u = members[2] JOIN r z ON z.u = members[3])
SELECT * FROM o WHERE len("right") >= 3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, members) = 1"""
_metrics = lambda t, p: f"SELECT count(*) AS n, avg(abs({p} - {t})) AS mae, sqrt(avg(({p} - {t}) * ({p} - {t}))) AS rmse, avg(abs({p} - {t}) / ({t} + 1)) AS lape"
_minhash = lambda h: f"SELECT * FROM (WITH {minhash_sql(h)}, m AS (SELECT u1, u2, common, jaccard, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {h} AS estimate FROM j JOIN s x ON x.u = u1 JOIN s y ON y.u = u2) {_metrics('jaccard', 'estimate')}, {h} AS hashes FROM m)"
_sampled = lambda share: f"SELECT * FROM (WITH {sampled_jaccard_sql(share)} {_metrics('jaccard', 'sampled')}, CAST({share} AS DOUBLE) AS share FROM js WHERE jaccard > 0.01)"
_half = f"gk AS (SELECT * FROM g WHERE {kept_sql(0.5, 'src', 'dst')}), tk AS (SELECT x.src AS x, x.dst AS y, z.dst AS z FROM gk x JOIN gk y ON x.dst = y.src JOIN gk z ON z.src = x.src AND z.dst = y.dst)"
_prefix = "CASE " + " ".join(f"WHEN {'(SELECT count(*) FROM s)' if d == 0 else f'count(*) OVER (PARTITION BY sig[1:{d}])'} <= 20 THEN {d}" for d in range(10)) + " ELSE 10 END"
_tiles = f"""WITH RECURSIVE {ORDER_PART}, {core_sql(2)}, {DEGREES}, i AS (SELECT u, deg, row_number() OVER (ORDER BY u) - 1 AS r FROM (SELECT DISTINCT u FROM c) JOIN d USING (u)),
z AS (SELECT greatest(1, floor(count(*) / 64)) AS size FROM i), w AS (SELECT CAST(floor(r / size) AS BIGINT) AS tile_id, min(u) AS first_u, max(u) AS last_u, count(*) AS n, CAST(sum(deg * deg) AS BIGINT) AS work, avg(deg) AS mean_deg FROM i, z GROUP BY 1),
o AS (SELECT *, sum(work) OVER () * 1.1 * 0.5 AS budget FROM w), f AS (SELECT CAST(-1 AS BIGINT) AS tile_id, CAST(0 AS BIGINT) AS used, false AS dense UNION ALL SELECT o.tile_id, f.used + CASE WHEN f.used + o.work <= o.budget THEN o.work ELSE 0 END, f.used + o.work <= o.budget FROM f JOIN o ON o.tile_id = f.tile_id + 1),
tl AS (SELECT tile_id, first_u, last_u, n, work, mean_deg, CASE WHEN dense THEN 'dense' ELSE 'sparse' END AS target FROM o JOIN f USING (tile_id)) """
_conv = "b0 AS (SELECT u1 AS u, max(jaccard) AS sim, 0 AS part FROM j GROUP BY 1), b1 AS (SELECT *, max(sim) OVER (ORDER BY u) AS best FROM b0), b2 AS (SELECT *, best - coalesce(lag(best) OVER (ORDER BY u), 0.0) AS gain FROM b1) "
_full = _tri + "SELECT * FROM l UNION ALL SELECT -1, CAST(count(*) AS DOUBLE) FROM t"

_affine_of = lambda seed: f"(SELECT range AS id, {affine_sql('range', seed)} % (SELECT max(size) FROM i) AS a, {affine_sql('range', seed + 1)} % (SELECT max(size) FROM i) AS b FROM range(300))"
_drawn = " UNION ALL ".join(f"SELECT {seed} AS sample, x.u AS u1, y.u AS u2 FROM {_affine_of(seed)} JOIN i x ON x.seq = a JOIN i y ON y.seq = b WHERE x.u <> y.u" for seed in SAMPLE_SEEDS)
_curve = f"""{_usim}{minhash_sql(max(HASH_COUNTS))}, i AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS seq, count(*) OVER () AS size FROM d), w AS (SELECT sample, least(u1, u2) AS u1, greatest(u1, u2) AS u2 FROM ({_drawn})),
o AS (SELECT sample, hashes, abs(len(list_filter(list_zip(x.sig[1:hashes], y.sig[1:hashes]), lambda z: z[1] = z[2])) / hashes - coalesce(jaccard, 0.0)) AS off FROM w JOIN s x ON x.u = w.u1 JOIN s y ON y.u = w.u2 LEFT JOIN j ON j.u1 = w.u1 AND j.u2 = w.u2, (SELECT unnest({HASH_COUNTS}) AS hashes)),
c AS (SELECT CAST(sample AS INTEGER) AS sample, CAST(hashes AS INTEGER) AS hashes, count(*) AS n, avg(off) AS mae FROM o GROUP BY 1, 2) """

ORACLES = {
    "minhash_curve": _curve + "SELECT * FROM c",
    "panel_minhash_error": _curve + """SELECT sample, '{"hashes":["' || string_agg(printf('%.8f', CAST(hashes AS DOUBLE)), '","' ORDER BY hashes) || '"],"mae":["' || string_agg(printf('%.8f', mae), '","' ORDER BY hashes) || '"]}' AS json FROM c GROUP BY 1""",
    "live_edges": f"WITH {USER_NEXT} SELECT row_number() OVER (ORDER BY first) AS seq, src, dst FROM g",
    "live_reservoir": _tri + "SELECT CAST(count(*) AS DOUBLE) AS triangles FROM t",
    "edges_distinct": f"WITH {ORDER_PART} SELECT * FROM e",
    "degree_left": f"WITH {ORDER_PART} SELECT u, count(*) AS deg FROM e GROUP BY 1",
    "degree_right": f"WITH {ORDER_PART} SELECT v, count(*) AS deg FROM e GROUP BY 1",
    "adjacency": f"WITH {ORDER_PART} SELECT u, list_sort(list(v)) AS nbrs FROM e GROUP BY 1",
    "replay_stream": f"WITH {USER_K} SELECT row_number() OVER (ORDER BY u, v) AS seq, u AS src, v AS dst FROM e",
    "twohop_pairs": f"WITH {ORDER_PART} SELECT DISTINCT a.u, b.u AS w FROM e a JOIN e b ON a.v = b.v AND a.u <> b.u",
    "onetwohop": f"WITH {ORDER_PART} SELECT DISTINCT u, 1 AS hop, v AS id FROM e UNION ALL SELECT DISTINCT a.u, 2, b.u FROM e a JOIN e b ON a.v = b.v AND a.u <> b.u",
    "jaccard_above": f"{_sim} z AS (SELECT 1) SELECT * FROM j WHERE jaccard > 0.3",
    "lsh_pairs": f"{_sim}{minhash_sql(72)}, w AS (SELECT u, b, sig[3 * b + 1:3 * b + 3] AS h FROM s, range(24) r(b)), n AS (SELECT DISTINCT x.u AS u1, y.u AS u2 FROM w x JOIN w y ON x.b = y.b AND x.h = y.h AND x.u < y.u) SELECT j.* FROM j JOIN n USING (u1, u2) WHERE jaccard > 0.5",
    "jaccard_pairs": f"{_sim} z AS (SELECT 1) SELECT * FROM j WHERE common >= 2",
    "local_candidates": f"{_usim} k AS (SELECT DISTINCT u FROM e ORDER BY u LIMIT 20) SELECT u1 AS q, u2 AS u, common, jaccard FROM j WHERE u1 IN (FROM k) AND jaccard > 0.2 UNION ALL SELECT u2, u1, common, jaccard FROM j WHERE u2 IN (FROM k) AND jaccard > 0.2",
    "kcore_2": f"WITH {ORDER_PART}, {core_sql(2)} SELECT DISTINCT 'L' AS side, u AS id FROM c UNION ALL SELECT DISTINCT 'R', v FROM c",
    "kcore_3": f"WITH {ORDER_PART}, {core_sql(3)} SELECT DISTINCT 'L' AS side, u AS id FROM c UNION ALL SELECT DISTINCT 'R', v FROM c",
    "induced_subgraph": f"WITH {ORDER_PART}, {core_sql(2)} SELECT * FROM e WHERE u IN (SELECT u FROM c) AND v IN (SELECT v FROM c)",
    "remove_nodes": f"WITH {ORDER_PART}, {core_sql(2)} SELECT * FROM e WHERE u NOT IN (SELECT u FROM c) AND v NOT IN (SELECT v FROM c)",
    "biclique_global_approx": f"{_usim}{core_sql(2)}, s AS (SELECT * FROM (WITH {minhash_sql(10)} SELECT * FROM s) WHERE u IN (SELECT u FROM c)), l AS (SELECT u, sig, {_prefix} AS level FROM s), gr AS (SELECT u, min(u) OVER (PARTITION BY level, sig[1:level]) AS grp FROM l), jg AS (SELECT j.* FROM j JOIN gr x ON x.u = u1 JOIN gr y ON y.u = u2 WHERE x.grp = y.grp AND u1 IN (SELECT u FROM c) AND u2 IN (SELECT u FROM c)), {biclique_sql(2, _best + '1', 'jg')}",
    "overlapping": f"WITH {USER_K} SELECT DISTINCT u FROM e WHERE v IN (SELECT v FROM e WHERE u = (SELECT min(u) FROM e))",
    "biclique_global_t2": _sim + biclique_sql(2, _best + "1"),
    "biclique_global_t3": _usim + biclique_sql(3, _best + "1"),
    "biclique_global_t4": _usim + biclique_sql(4, _best + "1", above=_T4_ABOVE),
    "biclique_topk": _sim + biclique_sql(2, _best + "10"),
    "biclique_local_t2": _usim + biclique_sql(2, _LOCAL_BEST),
    "biclique_local_t3": _local3,
    "biclique_local_nohop": _local3,
    "biclique_local_nosfs": _local3,
    "biclique_local_nosfs2": _local3,
    "biclique_local_group_t2": f"{_usim}{minhash_sql(1)}, jg AS (SELECT j.* FROM j JOIN s x ON x.u = u1 JOIN s y ON y.u = u2 WHERE x.sig = y.sig), " + biclique_sql(2, _LOCAL_BEST, "jg"),
    "biclique_print": _sim + biclique_sql(2, "SELECT 'sim: ' || printf('%.5f', sim) || ' L: ' || array_to_string(members, ' ') || ' R: ' || array_to_string(\"right\", ' ') AS line FROM (FROM b ORDER BY sim DESC, members LIMIT 5)"),
    "biclique_ablation_nocore": _sim + biclique_sql(2, _best + "1"),
    "biclique_ablation_nosim": _sim + biclique_sql(2, _best + "1"),
    "minhash_sig": f"WITH {ORDER_PART}, {minhash_sql(16)} SELECT * FROM s",
    "minhash_estimate": _est + "SELECT * FROM m",
    "minhash_candidates": _est + "SELECT * FROM m WHERE estimate >= 0.4",
    "lsh_groups": f"WITH {ORDER_PART}, {minhash_sql(1)} SELECT sig AS band, count(*) AS n, min(u) AS least FROM s GROUP BY 1 HAVING count(*) >= 2",
    "lsh_groups_4": f"WITH {ORDER_PART}, {minhash_sql(4)} SELECT sig AS band, count(*) AS n, min(u) AS least FROM s GROUP BY 1 HAVING count(*) >= 2",
    "trie_groups": f"WITH {USER_K}, {minhash_sql(10)}, l AS (SELECT u, sig, CAST({_prefix} AS INTEGER) AS level FROM s) SELECT u, level, min(u) OVER (PARTITION BY level, sig[1:level]) AS grp FROM l",
    "stream_jaccard_full": f"{_usim}z AS (SELECT 1) SELECT *, jaccard AS sampled FROM j",
    "stream_jaccard_sampled": f"{_usim}{sampled_jaccard_sql(0.5)} SELECT * FROM js",
    "hybrid_estimate": _est.rstrip() + f", {sampled_jaccard_sql(0.5)} SELECT m.u1, m.u2, least(1.0, least(x.deg, y.deg) / 10) * sampled + (1 - least(1.0, least(x.deg, y.deg) / 10)) * estimate AS estimate FROM m JOIN js ON js.u1 = m.u1 AND js.u2 = m.u2 JOIN d x ON x.u = m.u1 JOIN d y ON y.u = m.u2",
    "mae_rmse": f"{_est}{_metrics('jaccard', 'estimate')} FROM m WHERE jaccard > 0.01",
    "minhash_errors": f"{_usim}z AS (SELECT 1) " + " UNION ALL ".join(_minhash(h) for h in (16, 32, 64)),
    "sampled_errors": f"{_usim}z AS (SELECT 1) " + " UNION ALL ".join(_sampled(x) for x in (0.1, 0.3, 0.5)),
    "minhash_skip": f"""{_usim}{minhash_sql(64)}, o AS (SELECT row_number() OVER (ORDER BY {affine_sql("u", 42)}, u) AS seq, u, sig FROM s), f AS (SELECT u, max(jaccard) AS sim FROM (SELECT u1 AS u, jaccard FROM j UNION ALL SELECT u2, jaccard FROM j) GROUP BY 1),
h AS (SELECT o.seq, max(sim) OVER (ORDER BY o.seq) AS best FROM o JOIN f USING (u)), n AS (SELECT x.seq, x.u, max(len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 64) AS estimate FROM o x JOIN o y ON y.seq BETWEEN x.seq - 10 AND x.seq + 9 AND y.seq <> x.seq GROUP BY 1, 2)
SELECT n.seq, n.u, estimate, coalesce(best, 0.0) AS best, coalesce(best, 0.0) > 0.5 AND estimate < coalesce(best, 0.0) * 0.5 AS skip FROM n LEFT JOIN h ON h.seq = n.seq - 1""",
    "validation_pairs": f"{_usim}i AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS seq, count(*) OVER () AS size FROM d), r AS (SELECT range AS id, {affine_sql('range', 42)} % (SELECT max(size) FROM i) AS a, {affine_sql('range', 43)} % (SELECT max(size) FROM i) AS b FROM range(300)), w AS (SELECT id, least(x.u, y.u) AS u1, greatest(x.u, y.u) AS u2 FROM r JOIN i x ON x.seq = a JOIN i y ON y.seq = b) SELECT id, w.u1, w.u2, CASE WHEN w.u1 = w.u2 THEN 1.0 ELSE coalesce(jaccard, 0.0) END AS exact FROM w LEFT JOIN j ON j.u1 = w.u1 AND j.u2 = w.u2",
    "seeded_order": f"WITH {ORDER_PART} SELECT row_number() OVER (ORDER BY {affine_sql('u', 42)}, u) AS seq, u FROM (SELECT DISTINCT u FROM e)",
    "triangle_vertices": _tri + "SELECT count(*) AS n FROM l",
    "triangles_hash_sampled": f"WITH {USER_NEXT}, {_half} SELECT count(*) / 0.125 AS total FROM tk",
    "lape": f"{_tri.rstrip()}, {_half}, lk AS (SELECT node, count(*) / 0.125 AS estimate FROM (SELECT unnest([x, y, z]) AS node FROM tk) GROUP BY 1), r AS (SELECT i, coalesce(triangles, 0.0) AS truth, coalesce(estimate, 0.0) AS estimate FROM range(0, (SELECT max(dst) + 1 FROM g)) r(i) LEFT JOIN l ON l.node = i LEFT JOIN lk ON lk.node = i) {_metrics('truth', 'estimate')} FROM r",
    "tiles": _tiles + "SELECT * FROM tl",
    "tile_balance": _tiles + ", k AS (SELECT coalesce(sum(work) FILTER (target = 'dense'), 0)::BIGINT AS dense, coalesce(sum(work) FILTER (target = 'sparse'), 0)::BIGINT AS sparse FROM tl) SELECT dense, sparse, least(dense, sparse) / greatest(dense, sparse) AS balance FROM k",
    "blocks_right": f"WITH {ORDER_PART} SELECT CAST(floor(v / 256) AS BIGINT) AS block_id, count(*) AS n, avg(deg) AS mean_deg, 'sparse' AS target FROM (SELECT v, count(*) AS deg FROM e GROUP BY 1) GROUP BY 1",
    "link_factor": "SELECT p_partkey, greatest(0.1, least(1.0, p_size / 64)) AS factor FROM part",
    "triangles_global": _tri + "SELECT count(*) AS n FROM t",
    "triangles_local": _tri + "SELECT * FROM l",
    "triangles_dense_output": _tri + "SELECT i AS node, coalesce(triangles, 0.0) AS triangles FROM range(0, (SELECT max(dst) + 1 FROM g)) r(i) LEFT JOIN l ON node = i",
    "reservoir1_full": _full,
    "reservoir2_full": _full,
    "reservoirplus_full": _full,
    "blocks": f"WITH {ORDER_PART}, {DEGREES} SELECT CAST(floor(u / 256) AS BIGINT) AS block_id, count(*) AS n, avg(deg) AS mean_deg, CASE WHEN avg(deg) > 10 THEN 'dense' ELSE 'sparse' END AS target FROM d GROUP BY 1",
    "alpha_fold": "SELECT o_custkey, greatest(0.1, round(1 - pow(0.25, count(*) / count(DISTINCT o_orderpriority)), 4)) AS rate FROM orders GROUP BY 1",
    "convergence": _usim + _conv + "SELECT * FROM b2",
    "resample": _usim + _conv + ", i AS (SELECT unnest(range(1, 21)) AS point, (SELECT max(u) FROM b0) AS last) SELECT 0 AS part, CAST(point AS INTEGER) AS point, (SELECT max(best) FROM b1 WHERE u <= ceil(last * point / 20) AND u < ceil(last * point / 20) + 1) AS value FROM i",
    "panel_json": _usim + _conv + """, i AS (SELECT unnest(range(1, 21)) AS point, (SELECT max(u) FROM b0) AS last), r AS (SELECT point, (SELECT max(best) FROM b1 WHERE u <= ceil(last * point / 20) AND u < ceil(last * point / 20) + 1) AS value FROM i)
SELECT '{"point":["' || string_agg(printf('%.8f', CAST(point AS DOUBLE)), '","' ORDER BY point) || '"],"value":["' || string_agg(printf('%.8f', value), '","' ORDER BY point) || '"]}' AS json FROM r""",
    "allgather_union": f"WITH {ORDER_PART} SELECT u AS id FROM e UNION SELECT v FROM e",
    "allreduce_best": f"{_usim} z AS (SELECT 1) SELECT jaccard, u1, u2 FROM j ORDER BY jaccard DESC, u1, u2 LIMIT 1",
    "top_queries": f"WITH {ORDER_PART} SELECT DISTINCT u AS q FROM e ORDER BY 1 LIMIT 20",
}
