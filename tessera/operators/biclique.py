"""Most similar bicliques: sets of left vertices with enough common right neighbours, by least pairwise Jaccard.

Global: a first bound comes from pairs that banded MinHash signatures bring together. All pairs that reach it are joined and
grown level by level; as all sets above the bound were enumerated, the best of them is the optimum. Without a first bound
thresholds go down until a set is found.

Local: each query's search stays within the vertices that share enough neighbours with it, and has the best set found so far as
its bound.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import adjacency, core, outlasting, settled, wedges
from tessera.operators.similarity import block_pairs, candidates, dense, lsh_pairs, met_once, pairs, pairs_of_all, pairs_within

THRESHOLDS = (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.0)
#: Pairs that the first bound is looked for in, and bands of hashes that find them; where they hold no set, four times as many, up to so many and of two blocks.
BOUND_PAIRS, BOUND_ROWS, BOUND_BANDS = 2_000, 3, 3
BOUND_MOST, BOUND_BLOCKS = 1 << 19, 1 << 13
#: Neighbours of the vertices most similar to a query that its first bound is looked for in, and similarities that a search remembers, at most.
FIRST, KNOWN = 1 << 16, 1 << 20


def grown(found: DataFrame, size: int) -> DataFrame:
    """members (ascending), sim: all sets of ``size`` whose pairs are all in ``found``."""
    sets = found.select(F.array("u1", "u2").alias("members"), F.col("jaccard").alias("sim"))
    edge = found.select(F.col("u1").alias("a"), F.col("u2").alias("b"), "jaccard")
    for have in range(2, size):
        new = sets.join(edge, F.element_at("members", -1) == F.col("a")).select("members", F.col("b").alias("next"), F.least("sim", "jaccard").alias("sim"))
        for k in range(1, have):  # the new member pairs with every other, too
            new = new.join(edge, (F.element_at("members", k) == F.col("a")) & (F.col("next") == F.col("b"))).select("members", "next", F.least("sim", "jaccard").alias("sim"))
        sets = new.select(F.concat("members", F.array("next")).alias("members"), "sim")
    return sets


def with_right(sets: DataFrame, edges: DataFrame, size: int, least: int) -> DataFrame:
    """Add ``right``, the common neighbours of the ``size`` members, where there are enough: one join of neighbour lists for each."""
    lists = adjacency(edges, "u")
    found = sets.withColumn("right", F.lit(None).cast("array<bigint>"))
    for k in range(1, size + 1):
        both = found.join(lists, F.element_at("members", k) == F.col("u"))
        common = F.when(F.col("right").isNull(), F.col("nbrs")).otherwise(F.array_intersect("right", "nbrs"))
        found = both.select("members", "sim", common.alias("right")).where(F.size("right") >= least)
    return found.withColumn("right", F.sort_array("right"))


def _within_groups(found: DataFrame, group: DataFrame | None) -> DataFrame:
    """Pairs of one group (u, grp), if groups are given."""
    if group is None:
        return found
    a, b = group.select(F.col("u").alias("u1"), F.col("grp").alias("g1")), group.select(F.col("u").alias("u2"), F.col("grp").alias("g2"))
    return found.join(a, "u1").join(b, "u2").where("g1 = g2").drop("g1", "g2")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.desc("sim"), "members").limit(k)


def without_twins(edges: DataFrame, most: int, group: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """The edges of the ``most`` left vertices with the smallest ids of each class with equal neighbours (and group), and of those to ``keep`` (u).

    A set keeps its similarity and its right side, and comes earlier in order, when a member gives way to a smaller one of its
    class. So the k best sets of a size are all among the vertices that ``most`` = size + k - 1 leave: a member of a higher rank
    could give way to k others that are not in the set. Classes are told by two 64-bit hashes of their neighbours.
    """
    lists = adjacency(edges, "u").select("u", F.size("nbrs").alias("n"), F.xxhash64("nbrs").alias("h"), F.xxhash64(F.lit(1), "nbrs").alias("g"))
    key = ["n", "h", "g"]
    if group is not None:
        lists, key = lists.join(group.select("u", "grp"), "u", "left"), [*key, "grp"]
    few = lists.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("u"))).where(F.col("r") <= most).select("u")
    return edges.join(few.union(keep) if keep is not None else few, "u", "left_semi")


def _paired_in_groups(edges: DataFrame, left: DataFrame, group: DataFrame, tau: int) -> DataFrame | None:
    """u1 < u2, common, jaccard of the pairs within groups (u, grp) of left vertices, which come with their neighbours; None where groups make more pairs than there are anyway."""
    mine = group.join(left, "u", "left_semi").select("u", F.col("grp").alias("v"))
    if pairs_within(mine, "v") > min(pairs_within(edges, "v"), pairs_of_all(edges)):
        return None
    met = wedges(mine.join(adjacency(edges).select("u", F.col("nbrs").alias("n")), "u")).where("u1 < u2")
    return settled(met_once(met, tau, 0.0, F.size("__x") > 0))


def _sets(near: DataFrame, edges: DataFrame, size: int, tau: int) -> DataFrame | None:
    """Sets of ``size`` with their right sides; None if there are none. Only members' neighbours are read more than once."""
    sets = settled(grown(near, size))
    if not sets.limit(1).count():
        return None
    members = sets.select(F.explode("members").alias("u")).distinct()
    return settled(with_right(sets, settled(edges.join(members, "u", "left_semi")), size, tau))


def first_bound(edges: DataFrame, tau: int, size: int, k: int, group: DataFrame | None, near: DataFrame | None = None) -> float:
    """A similarity that k sets reach, at least: the k-th best of those within pairs that banded signatures bring together, or those of ``near``; 0 if there are fewer."""
    if near is not None:
        pass
    elif group is None and dense(edges):  # bands bring too many together; each two blocks' most similar pairs are looked at
        near = block_pairs(edges, tau, most=BOUND_PAIRS if size == 2 else BOUND_BLOCKS).drop("deg1", "deg2")
    else:
        near = _within_groups(lsh_pairs(edges, 0.0, BOUND_ROWS, BOUND_BANDS, tau), group)
    order = [F.desc("jaccard"), "u1", "u2"]
    if size == 2:  # each pair has a right side that is large enough
        best = near.orderBy(*order).limit(k).agg(F.count("*").alias("n"), F.min("jaccard").alias("sim")).first()
        return best["sim"] if best["n"] >= k else 0.0
    near, most = settled(near.orderBy(*order).limit(BOUND_MOST)), BOUND_PAIRS
    there = near.count()
    while True:
        sets = _sets(near.orderBy(*order).limit(most), edges, size, tau)
        if sets is not None:
            best = _best(sets, k).agg(F.count("*").alias("n"), F.min("sim").alias("sim")).first()
            if best["n"] >= k:
                return best["sim"]
        if most >= there:
            return 0.0
        most *= 4


@outlasting
def search(edges: DataFrame, tau: int, k: int = 1, thresholds=THRESHOLDS, use_core: bool = True, use_bound: bool = True, group: DataFrame | None = None) -> DataFrame:
    """The k best bicliques: sim, members, right. No rows where there is none. group: u, grp; members are of one group.

    use_core and use_bound leave rules out, which the result doesn't depend on; without bound all pairs are joined and all
    sets grown.
    """
    size, edges = max(2, tau), settled(edges)
    group = settled(group.select("u", "grp")) if group is not None else None
    left = settled(core(edges, tau).select("u").distinct()) if use_core else None
    own = edges.join(left, "u", "left_semi") if use_core else edges
    own = settled(without_twins(own, size + k - 1, group))
    left = own.select("u").distinct()
    within = _paired_in_groups(edges, left, group, tau) if group is not None else None
    bound = first_bound(own, tau, size, k, group, within) if use_bound else 0.0
    for theta in (bound - 1e-9,) if bound > 0 else thresholds if use_bound else (0.0,):
        if within is not None:
            near = within.where(F.col("jaccard") > max(theta, 0.0))
        else:
            near = settled(_within_groups(pairs(edges, tau, max(theta, 0.0), left), group))
        if size == 2:  # each pair has a right side that is large enough
            found = _best(grown(near, 2), k)
            if theta == 0.0 or found.count() >= k:
                return with_right(found, edges, 2, tau).select("sim", "members", "right")
            continue
        sets = _sets(near, edges, size, tau)
        if sets is not None and sets.limit(k).count() >= k:
            break
    if sets is None:
        sets = with_right(grown(near, size).limit(0), edges, size, tau)
    return _best(sets, k).select("sim", "members", "right")


class Ego:
    """A query vertex and those around it, as bits over the right vertices that they have."""

    def __init__(self, q: int, members: list[int], neighbours: list, tau: int, floor: float = 0.0):
        places: dict[int, int] = {}
        self.bits = {u: sum(1 << places.setdefault(int(v), len(places)) for v in near) for u, near in zip(members, neighbours, strict=True)}
        self.ids, self.q, self.tau, self.size = list(places), q, tau, max(2, tau)
        self.near = {u: b & self.bits[q] for u, b in self.bits.items()}
        self.known: dict[tuple[int, int], float] = {}
        self.floor = floor  # what the best set reaches, as is known from elsewhere
        self.best: tuple[float, list[int], int] | None = None
        self.visited = 0

    def sim(self, a: int, b: int) -> float:
        key = (a, b) if a < b else (b, a)
        if key not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            common = (self.bits[a] & self.bits[b]).bit_count()
            self.known[key] = common / (self.bits[a].bit_count() + self.bits[b].bit_count() - common)
        return self.known[key]

    def peel(self) -> None:
        """Vertices that have fewer than tau neighbours left go, on either side in turn."""
        while True:
            counts: dict[int, int] = {}
            for bits in self.near.values():
                while bits:
                    low = bits & -bits
                    counts[low] = counts.get(low, 0) + 1
                    bits ^= low
            mask = sum(b for b, n in counts.items() if n >= self.size)
            kept = {u: b & mask for u, b in self.near.items() if (b & mask).bit_count() >= self.tau}
            if kept == self.near:
                return
            self.near = kept

    def worse(self, sim: float) -> bool:
        return sim < (self.floor if self.best is None else self.best[0])

    def grow(self, members: list[int], right: int, sim: float, rest: list[int], by_sim: bool) -> None:
        self.visited += 1
        if self.worse(sim) or len(members) + len(rest) < self.size or right.bit_count() < self.tau:
            return
        if len(members) == self.size:
            found = sim, sorted(members), right
            if self.best is None or sim > self.best[0] or found[1] < self.best[1]:
                self.best = found
            return
        each = [(min(self.sim(u, m) for m in members), u) for u in rest]
        if by_sim:
            each.sort(key=lambda x: (-x[0], x[1]))
        for k, (own, u) in enumerate(each):
            self.grow([*members, u], right & self.near[u], min(sim, own), [w for _, w in each[k + 1 :]], by_sim)

    def search(self, by_sim: bool = True, by_pairs: bool = True) -> tuple[float, list[int], list[int]] | None:
        """The best set that holds the query. by_sim: the most similar vertices first; by_pairs: growth starts from pairs, each with the vertices before it."""
        self.peel()
        if self.q not in self.near:
            return None
        others = sorted((u for u in self.near if u != self.q), key=lambda u: (-self.sim(self.q, u), u) if by_sim else (0.0, u))
        if by_pairs:
            for k, u in enumerate(others):
                if by_sim and self.worse(self.sim(self.q, u)):
                    break
                self.grow([self.q, u], self.near[self.q] & self.near[u], self.sim(self.q, u), others[:k], by_sim)
        else:
            self.grow([self.q], self.near[self.q], 1.0, others, by_sim)
        if self.best is None:
            return None
        sim, members, _ = self.best
        right = self.bits[members[0]]
        for m in members[1:]:
            right &= self.bits[m]
        return sim, members, sorted(v for k, v in enumerate(self.ids) if right >> k & 1)


def _every(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """As ``candidates``, without looking at shared neighbours first: each query with every left vertex; queries are few."""
    lists = adjacency(edges, "u")
    asked = queries.join(lists.toDF("q", "mine"), "q")
    both = lists.join(F.broadcast(asked), F.col("u") != F.col("q"))
    common = F.size(F.array_intersect("mine", "nbrs")).cast("long")
    return both.select("q", "u", common.alias("common"), (common / (F.size("mine") + F.size("nbrs") - common)).alias("jaccard"))


@outlasting
def local(edges: DataFrame, tau: int, queries: DataFrame, group: DataFrame | None = None, hop: bool = True, by_sim: bool = True, by_pairs: bool = True, most: int = 2_000_000) -> DataFrame:
    """q, sim, members, right: the best biclique that holds each query vertex (a frame of q), of those within its group if given.

    What a query's search needs are the vertices that share tau neighbours with it, and their neighbours: work grows with
    those. Where they have more than ``FIRST``, the best set within the most similar ones gives a bound first, and only vertices
    that reach it are looked at. These make a group of a task if they have at most ``most`` neighbours in all; the pairs around larger
    ones, of those that reach the least bound, are joined and grown. hop, by_sim and by_pairs leave rules of the search out, which the result doesn't depend on.
    """
    size, edges = max(2, tau), settled(edges.select("u", "v"))
    queries = settled(queries.select("q").distinct())
    edges = settled(without_twins(edges, size, group, queries.select(F.col("q").alias("u"))))
    near = candidates(edges, queries) if hop else _every(edges, queries)
    near = near.where(F.col("common") >= tau).select("q", "u", "jaccard")
    if group is not None:
        grp = group.select("u", "grp")
        near = near.join(grp, "u").join(grp.toDF("q", "own"), "q").where("grp = own").drop("grp", "own")
    near, order = settled(near), Window.partitionBy("q").orderBy(F.desc("sim"), "members")
    if size == 2:
        pair = near.select("q", F.col("jaccard").alias("sim"), F.sort_array(F.array("q", "u")).alias("members"))
        best = pair.groupBy("q").agg(F.min(F.struct((-F.col("sim")).alias("s"), "members")).alias("m")).select("q", (-F.col("m.s")).alias("sim"), "m.members")
        return best.join(with_right(best.select("members", "sim").distinct(), edges, 2, tau).drop("sim"), "members").select("q", "sim", "members", "right")
    lists = settled(adjacency(edges, "u"))
    sized = near.join(lists.select("u", F.size("nbrs").alias("n")), "u")
    sized = settled(sized.withColumn("so_far", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("jaccard"), "u").rowsBetween(Window.unboundedPreceding, 0))))
    wide = sized.where(F.col("so_far") > min(most, FIRST)).select("q").distinct()
    floors = queries.select("q", F.lit(0.0).alias("floor"))

    def searched(around: DataFrame, floors: DataFrame) -> DataFrame:
        members = around.select("q", "u").union(around.select("q", F.col("q").alias("u")).distinct())

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            q = int(rows["q"].iloc[0])
            found = Ego(q, rows["u"].tolist(), rows["nbrs"].tolist(), tau, float(rows["floor"].iloc[0])).search(by_sim, by_pairs)
            return pd.DataFrame([(q, *found)] if found else [], columns=["q", "sim", "members", "right"])

        ego = members.join(lists, "u").join(F.broadcast(floors), "q")
        return ego.groupBy("q").applyInPandas(one, "q long, sim double, members array<long>, right array<long>")

    first = searched(sized.where(F.col("so_far") <= min(most, FIRST)).join(F.broadcast(wide), "q", "left_semi"), floors)
    # a little less than what is reached
    floors = settled(floors.select("q").join(first.select("q", "sim"), "q", "left").select("q", F.greatest(F.lit(0.0), F.coalesce("sim", F.lit(0.0)) - 1e-9).alias("floor")))
    near = settled(sized.join(F.broadcast(floors), "q").where(F.col("jaccard") >= F.col("floor")).select("q", "u", "n", "floor"))
    large = settled(near.groupBy("q").agg(F.sum("n").alias("n"), F.first("floor").alias("floor")).where(F.col("n") > most).select("q", "floor"))
    found = searched(near.join(F.broadcast(large), "q", "left_anti"), floors)
    if large.limit(1).count():
        around = settled(near.join(large.select("q"), "q", "left_semi"))
        joined = settled(pairs(edges, tau, large.agg(F.min("floor")).first()[0], around.select("u").union(around.select("q")).distinct()))
        star = around.select("q", "u")  # all members of a set are around its query, and so in its group
        sets = with_right(grown(joined, size), edges, size, tau).withColumn("q", F.explode("members")).join(large.select("q"), "q", "left_semi")
        inside = sets.select("q", "sim", "members", "right", F.explode("members").alias("u")).where("u <> q").join(star, ["q", "u"])
        whole = inside.groupBy("q", "sim", "members", "right").count().where(F.col("count") == size - 1)
        best = whole.withColumn("r", F.row_number().over(order)).where("r = 1").select("q", "sim", "members", "right")
        found = found.union(best)
    return found


def printed(found: DataFrame) -> DataFrame:
    """line: the bicliques as text."""
    ids = lambda c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))
    return found.select(F.concat(F.lit("sim: "), F.format_string("%.5f", "sim"), F.lit(" L: "), ids("members"), F.lit(" R: "), ids("right")).alias("line"))
