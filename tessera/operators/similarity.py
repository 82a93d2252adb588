"""Pairs of left vertices with common neighbours and Jaccard similarity; MinHash and hybrid estimates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import degree, listed, outlasting, settled, short_lists, wedges
from tessera.sources.edges import numbered

#: Left vertices of either block that are compared at once, at most, and right ones whose columns are held at once.
BLOCK, COLUMNS = 2048, 4096
#: Rows of a part that are compared at once, and numbers that stay in a core's cache meanwhile, about.
STRIP, CACHED = 16, 1 << 15
#: Blocks that left vertices are dealt to, at least, and numbers in a block's lists, at most.
BLOCKS, HELD = 12, 1 << 22
#: Members of a class in a row, and vertices of which such rows are broadcast, at most.
PACK, BROADCAST = 1024, 1 << 20
#: A prime; hash values of the affine family are below it.
PRIME = 2147483647


def pairs(edges: DataFrame, least_common: int = 1, above: float = 0.0, left: DataFrame | None = None) -> DataFrame:
    """u1 < u2, common, jaccard: pairs with enough common neighbours and a similarity above the bound.

    ``left`` restricts the ends, not what is counted. There are three ways to the same rows, chosen by what the degrees say
    they make: with a bound, pairs that meet in the rarest neighbours of either (``prefix_candidates``), whose neighbours are
    then compared; where two common neighbours are asked for, pairs of neighbours joined instead of single ones, so that hubs
    on the right side are met only by vertices that share another neighbour, too; else all wedges, counted. Where the cheapest of
    these makes more rows than there are pairs, all pairs are compared block by block (``block_pairs``).
    """
    if left is not None:
        edges = edges.join(left.select("u").distinct(), "u", "left_semi")
    e = edges.select("u", "v").join(degree(edges, "u").where(F.col("deg") >= least_common), "u")
    e = settled(e)  # read several times below
    wedge_rows = pairs_within(e, "v")
    every = pairs_of_all(e)
    if above > 0:
        if min(wedge_rows, _least_prefix_rows(e, above, least_common)) > every:
            return block_pairs(e, least_common, above)
        short = short_lists(e, wedge_rows)
        rare = settled(prefixes(e, above, least_common, short))
        prefix_rows = _prefix_rows(rare, above, least_common)
        if min(prefix_rows, wedge_rows) > every:
            return block_pairs(e, least_common, above)
        if prefix_rows < wedge_rows:
            return prefix_pairs(rare, above, least_common) if short else compared(prefix_candidates(rare, above, least_common), e, least_common, above)
    if wedge_rows > every:
        return block_pairs(e, least_common, above)
    if least_common > 1 and 4 * pairs_within(e, "u") < wedge_rows:
        two = wedges(e.select(F.col("u").alias("v"), F.col("v").alias("u"), "deg")).where("u1 < u2")  # neighbours that meet in a left vertex
        met = wedges(settled(two.select(F.col("v").alias("u"), F.struct("u1", "u2").alias("v"), F.col("deg1").alias("deg"))))
        # n common neighbours are n * (n - 1) / 2 common pairs
        count = F.round((1 + F.sqrt(1 + 8 * F.count("*"))) / 2).cast("long")
    elif short_lists(e, wedge_rows):
        return met_once(wedges(listed(e), most=_most(e)), least_common, above)
    else:
        met, count = wedges(e), F.count("*")
    counted = met.where((F.col("u1") < F.col("u2")) & _may_reach(above)).groupBy("u1", "u2", "deg1", "deg2").agg(count.alias("common"))
    found = counted.where(F.col("common") >= least_common).withColumn("jaccard", _jaccard())
    return found.where(F.col("jaccard") > above).select("u1", "u2", "common", "jaccard")


def _most(edges: DataFrame) -> int:
    """How many edges a right vertex has at most."""
    return degree(edges, "v").agg(F.max("deg")).first()[0] or 0


def met_once(met: DataFrame, least_common: int, above: float, first: Column | None = None) -> DataFrame:
    """u1 < u2, common, jaccard of pairs that meet in right vertices (v, u1, n1, u2, n2), each in the first that they share (or where ``first`` holds).

    The lists that come with a pair say all of it where it meets, so that no pair is shuffled.
    """
    shared = F.explode(F.array(F.array_intersect("n1", "n2")))  # generated, so that it is made once and not by each condition
    pair = met.where(F.col("u1") < F.col("u2")) if first is None else met
    pair = pair.select("v", "u1", "u2", F.size("n1").alias("deg1"), F.size("n2").alias("deg2"), shared.alias("__x")).where((F.col("__x")[0] == F.col("v")) if first is None else first)
    counted = pair.withColumn("common", F.size("__x").cast("long")).where(F.col("common") >= least_common).withColumn("jaccard", _jaccard())
    return counted.where(F.col("jaccard") > above).select(F.least("u1", "u2").alias("u1"), F.greatest("u1", "u2").alias("u2"), "common", "jaccard")


def _jaccard() -> Column:
    return F.col("common") / (F.col("deg1") + F.col("deg2") - F.col("common"))


def pairs_within(edges: DataFrame, side: str) -> float:
    """How many pairs of edges share an end on the side."""
    return edges.groupBy(side).count().agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2)).first()[0] or 0.0


def pairs_of_all(edges: DataFrame) -> float:
    """How many pairs of left vertices there are, for ids that blocks can hold; else more than any."""
    if not {t for c, t in edges.dtypes if c in ("u", "v")} <= {"int", "bigint"}:
        return math.inf
    n = edges.select("u").distinct().count()
    return n * (n - 1) / 2


def dense(edges: DataFrame) -> bool:
    """Do more edges meet in right vertices than there are pairs of left ones?"""
    return pairs_within(edges, "v") > pairs_of_all(edges)


class _Part:
    """Some vertices' lists: the row of each number, and its place among the different ones (``words``)."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, values: np.ndarray | None = None):
        self.sizes, self.row, self.values = sizes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), values
        self.words, at = np.unique(flat, return_inverse=True)
        self.at = at.astype(np.int32)

    def matrix(self, words: np.ndarray, *values: np.ndarray) -> np.ndarray:
        """A row for each list, a column for each of the words (some): 1 where the list has it; or as many columns for each of the values of its numbers."""
        place = np.searchsorted(words, self.words)
        has = (words[np.minimum(place, len(words) - 1)] == self.words)[self.at]
        row, at = self.row[has], place[self.at[has]]
        out = np.zeros((len(self.sizes), max(1, len(values)) * len(words)), values[0].dtype if values else np.float32)
        if not values:
            out[row, at] = 1
        for k, one in enumerate(values):
            out[row, at + k * len(words)] = one[has]
        return out


def _words(a: _Part, b: _Part) -> Iterator[np.ndarray]:
    """The numbers that lists of both have, some at a time."""
    words = np.intersect1d(a.words, b.words, assume_unique=True)
    for first in range(0, len(words), COLUMNS):
        yield words[first : first + COLUMNS]


def _common(a: _Part, b: _Part) -> np.ndarray:
    """How many numbers the lists of a and those of b share."""
    found = None
    for words in _words(a, b):
        one = a.matrix(words) @ b.matrix(words).T
        found = one if found is None else found + one
    return np.zeros((len(a.sizes), len(b.sizes)), np.float32) if found is None else found


class _Sampled:
    """The similarity over some of the right vertices."""

    def __init__(self, a: _Part, b: _Part):
        self.met, self.sizes = _common(a, b), (a.sizes.astype(np.float64), b.sizes.astype(np.float64))

    def similarities(self, rows: slice) -> list[np.ndarray]:
        met = self.met[rows].astype(np.float64)
        union = self.sizes[0][rows, None] + self.sizes[1]
        union -= met
        np.maximum(union, 1, out=union)
        met /= union
        return [met]


class _Sums:
    """What samples say of the pairs of two parts: common neighbours and degrees, each by the weights of the edges, and their variances.

    Only vertices of which the samples hold any edge are looked at; all others' similarities are 0.
    """

    def __init__(self, a: _Part, b: _Part, exact: bool = True):
        """exact: in floats of 64 bits; else of 32, which means of many estimates don't tell from it, unless weights are too large."""
        self.shape, self.any = (len(a.sizes), len(b.sizes)), [x.sizes > 0 for x in (a, b)]
        self.even = bool((a.values == 1).all() and (b.values == 1).all())
        kind = np.float64 if exact or a.values.max(initial=1) * b.values.max(initial=1) > 1e15 else np.float32
        a, b = (_Part(x.words[x.at], x.sizes[some], x.values.astype(kind)) for x, some in zip((a, b), self.any, strict=True))
        self.sizes = [x.sizes.astype(np.float64) for x in (a, b)]
        self.met = _common(a, b) if exact or self.even else None
        if self.even:
            return
        self.weights = [np.bincount(x.row, x.values, len(x.sizes)).astype(kind) for x in (a, b)]
        self.own = [np.bincount(x.row, x.values * (x.values - 1), len(x.sizes)).astype(kind) for x in (a, b)]
        self.common = self.variance = self.covariance = None
        for words in _words(a, b):
            x, y, n = a.matrix(words, a.values, a.values**2), b.matrix(words, b.values, b.values**2), len(words)
            # the last: one's weights by the other's squares, and the other way round
            found = x[:, :n] @ y[:, :n].T, x[:, n:] @ y[:, n:].T, x @ np.roll(y, n, 1).T
            self.common, self.variance, self.covariance = found if self.common is None else (z + one for z, one in zip((self.common, self.variance, self.covariance), found, strict=True))
        if self.common is None:
            self.common, self.variance, self.covariance = (np.zeros((len(a.sizes), len(b.sizes)), kind) for _ in range(3))

    def known(self, rows: slice) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
        """Of some rows: those of which any edge is held, the others' places likewise, and the similarities of these, within the sample (if exact) and, last, as estimated of all edges."""
        rows = slice(*rows.indices(self.shape[0]))
        first = np.count_nonzero(self.any[0][: rows.start])
        at = np.flatnonzero(self.any[0][rows]), np.flatnonzero(self.any[1])
        return at, self._similarities(slice(first, first + len(at[0])))

    def similarities(self, rows: slice) -> list[np.ndarray]:
        at, found = self.known(rows)
        whole = [np.zeros((len(range(self.shape[0])[rows]), self.shape[1])) for _ in found]
        for one, some in zip(whole, found, strict=True):
            one[np.ix_(*at)] = some
        return whole

    def _similarities(self, part: slice) -> list[np.ndarray]:
        found = []
        if self.met is not None:
            raw = self.met[part].astype(np.float64)
            union = self.sizes[0][part, None] + self.sizes[1]
            union -= raw
            np.maximum(union, 1, out=union)
            raw /= union
            found.append(raw)
        if self.even:
            return [raw, raw]
        c, d = self.common[part], self.weights[0][part, None] + self.weights[1]
        union = d - c
        some = union > 0
        if not some.all():
            union[~some] = 1.0
        off = self.variance[part] - c
        off *= d
        other = self.covariance[part] - 2 * c
        d += c
        other *= d
        off -= other
        np.add(self.own[0][part, None], self.own[1], out=other)
        other *= c
        off += other
        np.divide(c, union, out=other)
        union *= union * union
        off /= union
        other -= off
        np.clip(other, 0, 1, out=other)
        if not some.all():
            other[~some] = 0.0
        return [*found, other]


def _small(codes: np.ndarray) -> np.ndarray:
    """In as few bytes as hold them."""
    return codes.astype(np.uint8 if (most := codes.max(initial=0)) < 256 else np.uint16 if most < 1 << 16 else np.uint32)


def _signed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], hashes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each hash the ranks of ``signatures``' values, for the lists (numbers, sizes) of either side."""
    words, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    sizes = np.concatenate([a[1], b[1]])
    starts = np.cumsum(sizes) - sizes
    for h in range(hashes):
        x, y = parameters(h)
        rank = _small(np.unique(np.mod(words * np.int64(x) + np.int64(y), PRIME), return_inverse=True)[1])
        least = np.minimum.reduceat(rank[at], starts)
        yield least[: len(a[1])], least[len(a[1]) :]


class _Blocks:
    """Two blocks of left vertices, of which each pair is compared in parts: what the rows of a task hold."""

    def __init__(self, batches: Iterator[pa.RecordBatch], kept: int = 0, samples: int = 0, hashes: int = 0):
        rows = pa.Table.from_batches(list(batches))
        self.empty = True
        if not len(rows):
            return
        self.same = rows["i"][0].as_py() == rows["j"][0].as_py()
        first = rows["first"].to_numpy()
        sides = [rows.filter(pa.array(x)) for x in (first, ~first)]
        del rows
        if not all(map(len, sides)):
            return
        self.empty = False
        if self.same:  # in one order, so that parts behind are enough
            sides = [x.sort_by("u") for x in sides]
        lists_of = lambda x, c: x[c].combine_chunks()
        self.u = [x["u"].to_numpy() for x in sides]
        self.members = [x["members"].to_numpy().astype(np.float64) for x in sides]
        self.sig, held = None, [(lists_of(x, "n").flatten().to_numpy(), np.diff(lists_of(x, "n").offsets.to_numpy())) for x in sides]
        if hashes:
            self.sig = [np.array(x) for x in zip(*_signed(*held, hashes), strict=True)]
        elif "sig" in sides[0].column_names:
            one, two = (lists_of(x, "sig").flatten().to_numpy().reshape(len(x), -1).T for x in sides)
            codes = [_small(np.unique(np.concatenate(x), return_inverse=True)[1]) for x in zip(one, two, strict=True)]
            self.sig = [np.array([c[: one.shape[1]] for c in codes]), np.array([c[one.shape[1] :] for c in codes])]
        heights = (max(1, BLOCK // 4), 4 * BLOCK if self.sig else BLOCK)  # low and wide: signatures are compared row by row
        self.parts = []
        for x, (flat, sizes), height in zip(sides, held, heights, strict=True):
            flags = lists_of(x, "f").flatten().to_numpy() if kept else None
            sampled = []
            for k in range(samples):
                right = lists_of(x, f"m{k}")
                counted = np.concatenate([[0], np.cumsum(np.diff(right.offsets.to_numpy()))])
                sampled.append((right.flatten().to_numpy(), lists_of(x, f"w{k}").flatten().to_numpy(), counted))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            mine = []
            for at in range(0, len(x), height):
                some, numbers = slice(at, at + height), slice(ends[at], ends[min(len(x), at + height)])
                part = {"at": at, "n": _Part(flat[numbers], sizes[some])}
                for k in range(kept):
                    has = flags[numbers] >> k & 1 > 0
                    part["kept", k] = _Part(flat[numbers][has], np.bincount(part["n"].row[has], minlength=len(part["n"].sizes)))
                for k, (right, weights, offsets) in enumerate(sampled):
                    own = offsets[at : at + height + 1]
                    part["samples", k] = _Part(right[own[0] : own[-1]], np.diff(own), weights[own[0] : own[-1]])
                mine.append(part)
            self.parts.append(mine)

    def __iter__(self) -> Iterator[tuple[dict, dict]]:
        """Two parts at a time; of one block with itself those where a vertex may be before another."""
        for a in [] if self.empty else self.parts[0]:
            for b in self.parts[1]:
                if not self.same or b["at"] + len(b["n"].sizes) > a["at"]:
                    yield a, b

    def overlap(self, a: dict, b: dict) -> bool:
        return self.same and b["at"] < a["at"] + len(a["n"].sizes)

    def agreeing(self, a: dict, b: dict, rows: slice, counts: list[int]) -> list[np.ndarray]:
        """For each number of hashes, ascending, how many of the first ones agree: of some rows with all of b."""
        sa, sb = self.sig
        sa, sb = sa[:, a["at"] + rows.start : a["at"] + min(rows.stop, len(a["n"].sizes))], sb[:, b["at"] : b["at"] + len(b["n"].sizes)]
        agree, equal, found = np.zeros((sa.shape[1], sb.shape[1]), np.uint8 if counts[-1] < 256 else np.int32), np.empty((sa.shape[1], sb.shape[1]), bool), []
        for h in range(counts[-1]):
            np.equal(sa[h][:, None], sb[h], out=equal)
            agree += equal.view(np.uint8)
            if h + 1 in counts:
                found.append(agree.copy())
        return found


def _dealt(edges: DataFrame, sig: DataFrame | None = None, kept: tuple[Column, ...] = (), samples: tuple[DataFrame, ...] = (), classes: bool = True) -> tuple[DataFrame, int, DataFrame | None]:
    """Rows of vertices with their sorted neighbours (n) and what else is compared, by the ``task`` of two blocks; how many tasks; and
    the members (u, rep) of classes of equal vertices, of which only rep has a row then, if there are enough of these and ``classes``. ``members``: their number.
    """
    v, names = F.col("v").cast("long"), ["n"]
    if kept:
        flag = F.lit(0)
        for k, one in enumerate(kept):
            flag = flag + F.when(one, F.lit(1 << k)).otherwise(F.lit(0))
        pairs_of = edges.groupBy("u").agg(F.sort_array(F.collect_list(F.struct(v.alias("v"), flag.cast("byte").alias("f")))).alias("s"))
        lists, names = pairs_of.select("u", F.col("s.v").alias("n"), F.col("s.f").alias("f")), ["n", "f"]
    else:
        lists = edges.groupBy("u").agg(F.sort_array(F.collect_list(v)).alias("n"))
    if sig is not None:
        lists, names = lists.join(sig.select("u", F.col("sig").cast("array<int>").alias("sig")), "u"), [*names, "sig"]  # below PRIME
    plain, colours = [*names], 1
    for k, one in enumerate(samples):
        of_cells = [f"by{k}"] if k else ["colour", "by0"]
        lists, names = lists.join(one.withColumnRenamed("by", f"by{k}").select("u", *of_cells), "u"), [*names, *of_cells]
    key = [F.xxhash64(*names).alias("h"), F.xxhash64(F.lit(1), *names).alias("g")]
    lists = settled(lists.select(F.col("u").cast("long").alias("u"), *names, *key))
    n, members = lists.count(), None
    if classes and 2 * lists.select("h", "g").distinct().count() <= n:
        same = lists.groupBy("h", "g").agg(F.min("u").alias("rep"), F.count("*").alias("members"))
        members = settled(lists.select("u", "h", "g").join(same, ["h", "g"]).select("u", "rep"))
        lists = settled(lists.join(same.select(F.col("rep").alias("u"), "members"), "u"))
        n = lists.count()
    else:
        lists = lists.withColumn("members", F.lit(1).cast("long"))
    if samples:
        colours = 1 + (lists.agg(F.max("colour")).first()[0] or 0)
    numbers = lists.agg(F.sum(sum((F.size(c) for c in plain if c != "f"), F.lit(0)).cast("long"))).first()[0] or 0
    fewest = max(-(-numbers // HELD), min(BLOCKS, -(-n // 64)))
    per = max(1, -(-fewest // colours))  # blocks of a colour
    own = F.pmod(F.xxhash64("u"), F.lit(per)).cast("int")
    if samples:
        own = (F.col("colour") * per + own).cast("int")
    last = F.lit(colours * per - 1)
    sent = ["u", "members", *plain, *[f"{c}{k}" for k in range(len(samples)) for c in "mw"]]

    def looked(rows: DataFrame, other: str) -> DataFrame:
        """With what is compared with the other block: of samples, the cells of both colours."""
        for k in range(len(samples)):
            mine = F.element_at(f"by{k}", F.floor(F.col(other) / per).cast("int") + 1)
            rows = rows.withColumn(f"m{k}", F.coalesce(mine["v"], F.array().cast("array<long>"))).withColumn(f"w{k}", F.coalesce(mine["w"], F.array().cast("array<double>")))
        return rows

    left = looked(lists.select(own.alias("i"), F.explode(F.sequence(own, last)).alias("j"), F.lit(True).alias("first"), "u", "members", *names), "j").select("i", "j", "first", *sent)
    right = looked(lists.select(F.explode(F.sequence(F.lit(0), own)).alias("i"), own.alias("j"), F.lit(False).alias("first"), "u", "members", *names), "i").select("i", "j", "first", *sent)
    number, tasks = (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("int"), colours * per * (colours * per + 1) // 2
    # each two blocks are a task: hashes would give some tasks several
    return left.union(right).withColumn("task", number).repartitionById(tasks, "task"), tasks, members


def block_pairs(edges: DataFrame, least_common: int = 1, above: float = 0.0, sig: DataFrame | None = None, least_estimate: float = 0.0, kept: Column | None = None, most: int | None = None, samples: DataFrame | None = None, hashes: int = 0) -> DataFrame:
    """As ``pairs``, of distinct edges, with deg1, deg2 behind: all pairs, block of left vertices by block, without any shuffle of pairs.

    sig (u, sig) or a number of hashes, of which tasks make the signatures: adds ``estimate``, the share of hashes that agree; pairs below ``least_estimate`` go. kept, a
    condition on edges that looks at v alone: adds ``sampled``, the similarity over the right vertices kept. samples (u, colour, by), of
    ``streaming.similarity.samples``: adds ``sampled`` and ``estimate`` of the reservoirs. most: only that many pairs of two blocks, the
    most similar ones. A task holds two blocks, counts the common neighbours of parts of them, and gives pairs as it goes; what is
    shuffled are the neighbours of each block's vertices, once for each block. There are as few blocks as keep the tasks busy, and more only
    where a task couldn't hold their lists: up to ``BLOCKS`` * ``HELD`` numbers what is shuffled grows in proportion to the edges.
    Where a similarity is asked for, it is worked out only of pairs with enough common neighbours for their degrees.

    Where at least half of the vertices are copies, of which all that is compared is equal (told by two 64-bit hashes), each class is compared by one
    of its vertices, and what is found of two classes is given to all pairs of their members.
    """
    types, signed, sampled, replayed = dict(edges.dtypes), bool(hashes) or sig is not None, kept is not None, samples is not None
    dealt, _, members = _dealt(edges, sig, (kept,) if sampled else (), (samples,) if replayed else (), most is None)
    more = [*(["estimate double"] if signed else []), *(["sampled double"] if sampled else []), *(["sampled double", "estimate double"] if replayed else [])]
    out = ["u1 long", "u2 long", "common long", "jaccard double", "deg1 long", "deg2 long", *more]
    columns = [c.split()[0] for c in out]
    twins = members is not None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(batches, int(sampled), int(replayed), hashes)
        best: list[list[np.ndarray]] = []
        least = above  # or what the most similar pairs so far reach
        for a, b in blocks:
            common, at_least = _common(a["n"], b["n"]), max(1, least_common)
            others = [_Sampled(a["kept", 0], b["kept", 0])] if sampled else [_Sums(a["samples", 0], b["samples", 0])] if replayed else []
            ua, ub = (x[part["at"] : part["at"] + len(part["n"].sizes)] for x, part in zip(blocks.u, (a, b), strict=True))
            da, db = a["n"].sizes, b["n"].sizes
            for at in range(0, len(ua), STRIP):
                part = slice(at, at + STRIP)
                wanted = common[part] >= at_least
                if least > 0:  # c / (da + db - c) > least, but for what floats lose; below it is looked at again
                    share = least / (1 + least) * (1 - 1e-5)
                    wanted &= common[part] >= (share * da[part, None]).astype(np.float32) + (share * db).astype(np.float32)
                if blocks.overlap(a, b):  # a class and itself: its members' pairs
                    wanted &= ua[part, None] <= ub if twins else ua[part, None] < ub
                if signed and wanted.any():
                    agree = blocks.agreeing(a, b, part, [len(blocks.sig[0])])[0]
                    wanted &= agree / len(blocks.sig[0]) >= least_estimate
                i, j = np.divmod(np.flatnonzero(wanted), len(ub))
                c = common[at + i, j].astype(np.int64)
                jaccard = c / (da[at + i] + db[j] - c)
                if (enough := jaccard > above if most is None or least == above else jaccard >= least).all():
                    enough = slice(None)
                i, j, c, jaccard = i[enough], j[enough], c[enough], jaccard[enough]
                if not len(i):
                    continue
                swap = ua[at + i] > ub[j]
                found = [np.where(swap, ub[j], ua[at + i]), np.where(swap, ua[at + i], ub[j]), c, jaccard]
                found += [np.where(swap, db[j], da[at + i]).astype(np.int64), np.where(swap, da[at + i], db[j]).astype(np.int64)]
                if signed:
                    found.append(agree[i, j] / len(blocks.sig[0]))
                found += [x[i, j] for other in others for x in other.similarities(part)]
                if most is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=columns)
                    continue
                best.append(found)
                if sum(len(c[0]) for c in best) > 4 * most:
                    best = [most_similar(best)]
                    least = max(above, float(best[0][3][-1]))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in most_similar(best)], names=columns)

    def most_similar(some: list[list[np.ndarray]]) -> list[np.ndarray]:
        joined = [np.concatenate(x) for x in zip(*some, strict=True)]
        order = np.lexsort((joined[1], joined[0], -joined[3]))[:most]
        return [x[order] for x in joined]

    found = dealt.groupBy("task").applyInArrow(compare, ", ".join(out))
    if members is not None:
        found = _given_to_members(found, members, columns)
    ends = [F.col(c).cast(types["u"]).alias(c) for c in ("u1", "u2")]
    return found.select(*ends, "common", "jaccard", *columns[6:], "deg1", "deg2") if columns[6:] or most else found.select(*ends, "common", "jaccard")


def _weighed(off: np.ndarray, more: np.ndarray, counted: np.ndarray | None, wa: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """The sums of what is off, of the squares and of the shares of more, over the pairs counted, by weights of either side."""
    part = off if counted is None else off * counted
    return np.array([wa @ (part @ wb), wa @ (part * off @ wb), wa @ (part / more @ wb)])


def _summed(blocks: _Blocks, noise: float, hashes: tuple[int, ...], kept: int, samples: int) -> tuple[float, np.ndarray]:
    """How many pairs are above the noise, and for each estimate the sums of what it is off, of the squares, and of the shares of 1 + the similarity."""
    counts, n = sorted(set(hashes)), 0.0
    sums = np.zeros((len(hashes) + kept + samples, 3))
    for a, b in blocks:
        common, da, db = _common(a["n"], b["n"]), a["n"].sizes.astype(np.float64), b["n"].sizes.astype(np.float64)
        wa, wb = (x[part["at"] : part["at"] + len(part["n"].sizes)] for x, part in zip(blocks.members, (a, b), strict=True))
        others, replays = [_Sampled(a["kept", k], b["kept", k]) for k in range(kept)], [_Sums(a["samples", k], b["samples", k], False) for k in range(samples)]
        few = max(1, CACHED // len(db))
        for at in range(0, len(da), STRIP):
            agree = blocks.agreeing(a, b, slice(at, at + STRIP), counts) if counts else []
            for low in range(at, min(at + STRIP, len(da)), few):
                part = slice(low, min(low + few, at + STRIP, len(da)))
                jaccard = common[part].astype(np.float64)
                union = da[part, None] + db
                union -= jaccard
                jaccard /= union
                counted = jaccard > noise
                if blocks.overlap(a, b):
                    before = np.subtract.outer(np.arange(low, part.stop) + a["at"], np.arange(len(db)) + b["at"])
                    counted = np.where(before < 0, 1.0, np.where(before == 0, (wb - 1) / (2 * wb), 0.0)) * counted
                elif counted.all():
                    counted = None
                else:
                    counted = counted.astype(np.float64)
                n += wa[part].sum() * wb.sum() if counted is None else wa[part] @ (counted @ wb)
                np.add(jaccard, 1, out=union)
                each = [agree[counts.index(h)][low - at : part.stop - at] / h for h in hashes]
                each += [x.similarities(part)[-1] for x in others]
                for k, estimate in enumerate(each):
                    estimate -= jaccard
                    sums[k] += _weighed(np.abs(estimate, out=estimate), union, counted, wa[part], wb)
                if replays:  # where nothing is held of a vertex, the estimate is 0
                    none = _weighed(jaccard, union, counted, wa[part], wb)
                for k, one in enumerate(replays, len(each)):
                    (x, y), found = one.known(part)
                    if len(x) == len(jaccard) and len(y) == len(wb):
                        sums[k] += _weighed(np.abs(found[-1] - jaccard), union, counted, wa[part], wb)
                        continue
                    sums[k] += none
                    if len(x) and len(y):
                        at_both = np.ix_(x, y)
                        some = jaccard[at_both], union[at_both], None if counted is None else counted[at_both], wa[part][x], wb[y]
                        sums[k] += _weighed(np.abs(found[-1] - some[0]), *some[1:]) - _weighed(*some)
    return n, sums


def block_errors(edges: DataFrame, noise: float | None = None, hashes: tuple[int, ...] = (), kept: tuple[Column, ...] = (), samples: tuple[DataFrame, ...] = ()) -> DataFrame:
    """which, n, mae, rmse, lape: as ``triangles.error_metrics`` of the pairs and estimates of ``block_pairs``, which are summed up where they are made.

    A row for each number of hashes, each condition and each of the samples, which counts them from 0 on. Of a class of copies one vertex is compared, and each
    pair counts as often as the classes' members make it.
    """
    dealt, _, _ = _dealt(edges, None, kept, samples)
    most, conditions, replays = max(hashes, default=0), len(kept), len(samples)
    estimates = len(hashes) + conditions + replays

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = _summed(_Blocks(batches, conditions, replays, most), noise or 0.0, hashes, conditions, replays)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(estimates)), pa.array(np.full(estimates, round(n))), *map(pa.array, sums.T)], names=["which", "n", "off", "square", "share"])

    found = dealt.groupBy("task").applyInArrow(compare, "which long, n long, off double, square double, share double")
    total = found.groupBy("which").agg(*[F.sum(c).alias(c) for c in ("n", "off", "square", "share")])
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return total.select("which", "n", mean("off").alias("mae"), F.sqrt(mean("square")).alias("rmse"), mean("share").alias("lape"))


def _given_to_members(found: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of classes (u1, u2, the smallest members, and u1 = u2) made pairs of members (u, rep), u1 < u2."""
    size = members.groupBy("rep").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    packs = members.join(size, "rep").groupBy("rep", F.pmod(F.xxhash64("u"), F.col("packs")).alias("pack")).agg(F.collect_list("u").alias("m")).drop("pack")
    packs = settled(packs)
    if members.count() <= BROADCAST:
        packs = F.broadcast(packs)
    both = found.join(packs.toDF("u1", "a"), "u1").join(packs.toDF("u2", "b"), "u2")
    each = both.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).where("u1 <> u2 OR a < b")
    swap = F.col("a") > F.col("b")
    ends = {"u1": F.least("a", "b"), "u2": F.greatest("a", "b"), "deg1": F.when(swap, F.col("deg2")).otherwise(F.col("deg1")), "deg2": F.when(swap, F.col("deg1")).otherwise(F.col("deg2"))}
    return each.select(*[ends[c].alias(c) if c in ends else F.col(c) for c in columns])


def estimated(edges: DataFrame, hashes: int) -> DataFrame:
    """u1 < u2, common, jaccard, estimate: all pairs with common neighbours, and what signatures say of them."""
    edges = settled(edges)
    if dense(edges):
        return block_pairs(edges, hashes=hashes).drop("deg1", "deg2")
    return estimates(pairs(edges), signatures(edges, hashes))


def _may_reach(above: float) -> Column:
    return F.least("deg1", "deg2") > F.greatest("deg1", "deg2") * F.lit(above)


def prefixes(e: DataFrame, above: float, least_common: int = 1, whole: bool = False) -> DataFrame:
    """u, v, deg, at: the edges (u, v, deg) to each left vertex's rarest neighbours, by place in the order of rarity; whole: and n, all neighbours in it.

    Two sets above the similarity have a neighbour in common among so many of either: the others are too few.
    """
    rarity = degree(e, "v").select("v", F.col("deg").alias("__n"))
    lists = e.join(rarity, "v").groupBy("u", "deg").agg(F.sort_array(F.collect_list(F.struct("__n", "v"))).alias("s"))
    needed = F.greatest(F.lit(least_common), F.ceil(F.col("deg") * F.lit(above) - 1e-9))
    return lists.select("u", "deg", F.posexplode(F.slice("s", 1, (F.col("deg") - needed + 1).cast("int"))).alias("at", "x"), *([F.col("s.v").alias("n")] if whole else [])).select("u", F.col("x.v").alias("v"), "deg", "at", *(["n"] if whole else []))


def _short(above: float, least_common: int) -> Column:
    """Is the edge among those of a set's rarest neighbours that the smaller of two sets needs? A larger one shares more with it than one of its size."""
    needed = F.greatest(F.lit(least_common), F.ceil(F.col("deg") * F.lit(2 * above / (1 + above)) - 1e-9))
    return F.col("at") <= F.col("deg") - needed


def _enough(above: float, least_common: int) -> Column:
    """Is the set with 1 the smaller one, do the sizes allow the similarity, and are enough neighbours left from where they meet?"""
    needed = F.greatest(F.lit(least_common), F.ceil((F.col("deg1") + F.col("deg2")) * F.lit(above / (1 + above)) - 1e-9))
    ordered = (F.col("deg1") < F.col("deg2")) | ((F.col("deg1") == F.col("deg2")) & (F.col("u1") < F.col("u2")))
    return ordered & _may_reach(above) & (F.least(F.col("deg1") - F.col("at1"), F.col("deg2") - F.col("at2")) >= needed)


def prefix_candidates(rare: DataFrame, above: float, least_common: int = 1) -> DataFrame:
    """u1 < u2: pairs that meet in ``prefixes``, whose sizes allow the similarity, and of which enough neighbours are left where they first meet.

    The smaller set of a pair (of equal ones, that of the smaller id) is looked for by a shorter prefix.
    """
    met = wedges(rare, first=_short(above, least_common)).where(_enough(above, least_common))
    return met.select(F.least("u1", "u2").alias("u1"), F.greatest("u1", "u2").alias("u2")).distinct()


def prefix_pairs(rare: DataFrame, above: float, least_common: int = 1) -> DataFrame:
    """u1 < u2, common, jaccard: as ``compared`` of ``prefix_candidates``, each pair where it first meets, with the neighbours (n) that came along.

    Two sets' rarest common neighbour is in both prefixes wherever the sets meet in one: it is where ``at`` counts from, and the smaller of equally rare.
    """
    met = wedges(rare, first=_short(above, least_common)).where(_enough(above, least_common))
    return met_once(met, least_common, above, F.col("__x")[0] == F.col("v"))


def _prefix_rows(rare: DataFrame, above: float, least_common: int) -> float:
    """How many rows ``prefix_candidates`` meets."""
    n = rare.groupBy("v").agg(F.count("*").alias("all"), F.count_if(_short(above, least_common)).alias("short"))
    return n.agg(F.sum(F.col("all") * F.col("short") * 1.0)).first()[0] or 0.0


def _least_prefix_rows(e: DataFrame, above: float, least_common: int) -> float:
    """``_prefix_rows`` at least, by degrees alone: were the shorter prefixes' edges spread evenly over all right vertices."""
    least = F.greatest(F.lit(least_common), F.ceil(F.col("deg") * F.lit(2 * above / (1 + above)) - 1e-9))
    edges = e.select("u", "deg").distinct().agg(F.sum(F.greatest(F.lit(0), F.col("deg") - least + 1) * 1.0)).first()[0] or 0.0
    return edges**2 / max(1, e.select("v").distinct().count())


def compared(some: DataFrame, edges: DataFrame, least_common: int = 1, above: float = 0.0) -> DataFrame:
    """u1, u2, common, jaccard of pairs (u1, u2): their neighbour lists are fetched and intersected."""
    lists = edges.groupBy("u").agg(F.collect_set("v").alias("n"))
    both = some.select("u1", "u2").join(lists.toDF("u1", "n1"), "u1").join(lists.toDF("u2", "n2"), "u2")
    counted = both.select("u1", "u2", F.size("n1").alias("deg1"), F.size("n2").alias("deg2"), F.size(F.array_intersect("n1", "n2")).cast("long").alias("common"))
    found = counted.where(F.col("common") >= least_common).withColumn("jaccard", _jaccard())
    return found.where(F.col("jaccard") > above).select("u1", "u2", "common", "jaccard")


def candidates(edges: DataFrame, queries: DataFrame, above: float = 0.0) -> DataFrame:
    """q, u, common, jaccard for query vertices (a frame of q)."""
    d = degree(edges, "u")
    mine = edges.join(queries.select(F.col("q").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("q"), "v")
    common = mine.join(edges, "v").where("q != u").groupBy("q", "u").agg(F.count("*").alias("common"))
    both = common.join(d.select("u", F.col("deg").alias("du")), "u").join(d.select(F.col("u").alias("q"), F.col("deg").alias("dq")), "q")
    found = both.withColumn("jaccard", F.col("common") / (F.col("du") + F.col("dq") - F.col("common")))
    return found.where(F.col("jaccard") > above).select("q", "u", "common", "jaccard")


def parameters(h: int) -> tuple[int, int]:
    """Multiplier and offset of hash h: fixed small numbers below the prime, the same in any engine."""
    return (h * 48271 * 16807 + 1220703125) % (PRIME - 1) + 1, (h * 69621 * 40692 + 362436069) % PRIME


def signatures(edges: DataFrame, hashes: int) -> DataFrame:
    """u, sig: the least value of each affine hash over the neighbours. Edges are shuffled, not partial signatures, which are longer."""
    value = lambda h: F.min(F.pmod(F.col("v") * F.lit(parameters(h)[0]) + F.lit(parameters(h)[1]), F.lit(PRIME)))
    return edges.repartition("u").groupBy("u").agg(F.array(*[value(h) for h in range(hashes)]).alias("sig"))


def agreement(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def estimates(some: DataFrame, sig: DataFrame) -> DataFrame:
    """Add ``estimate`` to pairs u1, u2; a vertex without a signature matches nothing, a vertex itself fully."""
    both = some.join(sig.select(F.col("u").alias("u1"), F.col("sig").alias("s1")), "u1", "left").join(sig.select(F.col("u").alias("u2"), F.col("sig").alias("s2")), "u2", "left")
    found = F.when(F.col("u1") == F.col("u2"), 1.0).otherwise(F.coalesce(agreement("s1", "s2"), F.lit(0.0)))
    return both.withColumn("estimate", found).drop("s1", "s2")


def hash_counts(least: int = 4, most: int = 512) -> list[int]:
    """Numbers of hashes for an error curve, each about 1.3 times the one before."""
    counts = [least]
    while (n := int(counts[-1] * 1.3) + 1) <= most:
        counts.append(n)
    return counts


def error_curve(some: DataFrame, sig: DataFrame, counts: list[int], *by: str) -> DataFrame:
    """hashes, n, mae: how far the estimate by the first ``hashes`` of a signature (u, sig) is off, over the pairs (u1, u2, exact).

    Signatures are made once, for the longest; each number of hashes reads as much of them. A vertex and itself is no pair here.
    """
    both = some.where("u1 != u2").join(sig.toDF("u1", "s1"), "u1").join(sig.toDF("u2", "s2"), "u2")
    agree = both.select(*by, "exact", F.zip_with("s1", "s2", lambda x, y: x == y).alias("agree"), F.explode(F.array(*map(F.lit, counts))).alias("hashes"))
    share = F.size(F.filter(F.slice("agree", 1, F.col("hashes")), lambda x: x)) / F.col("hashes")
    return agree.groupBy(*by, "hashes").agg(F.count("*").alias("n"), F.avg(F.abs(share - F.col("exact"))).alias("mae"))


def lsh_candidates(sig: DataFrame, rows: int, bands: int) -> DataFrame:
    """u1 < u2: pairs of left vertices whose signatures (u, sig) agree in all ``rows`` hashes of one of the bands at least.

    Two vertices of similarity s are found with a probability of 1 - (1 - s^rows)^bands. Buckets are met as right vertices
    are, large ones in parts; the graph's own wedges are never made.
    """
    return wedges(_filed(sig, rows, bands)).where("u1 < u2").select("u1", "u2").distinct()


def _filed(sig: DataFrame, rows: int, bands: int) -> DataFrame:
    """u, v: left vertices and their buckets, those that hold others as well."""
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows)))
    filed = sig.select("u", F.explode(band).alias("v"))
    return settled(filed.withColumn("n", F.count("*").over(Window.partitionBy("v"))).where("n > 1").select("u", "v"))


def lsh_pairs(edges: DataFrame, above: float, rows: int = 3, bands: int = 24, least_common: int = 1) -> DataFrame:
    """u1 < u2, common, jaccard: candidates of the bands with a similarity above the bound; some pairs may be missed."""
    edges = settled(edges)
    filed = _filed(signatures(edges, rows * bands), rows, bands)
    if not short_lists(edges, math.inf):
        met = wedges(filed).where("u1 < u2").select("u1", "u2").distinct()
        return compared(met, edges, least_common, above)
    # compared where they meet: what is similar enough is shuffled, once for each bucket that it shares
    lists = edges.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("n"))
    met = wedges(filed.join(lists, "u"), most=_most(filed)).where("u1 < u2")
    return met_once(met, least_common, above, F.size("__x") > 0).distinct()


def lsh_groups(sig: DataFrame, band: int = 4) -> DataFrame:
    """Groups of two and more that agree in the first ``band`` hashes: band, members' number and least member."""
    groups = sig.groupBy(F.slice("sig", 1, band).alias("band")).agg(F.count("*").alias("n"), F.min("u").alias("least"))
    return groups.where("n >= 2")


def candidates_above(sig: DataFrame, hashes: int, least: float) -> DataFrame:
    """u1 < u2, estimate: all pairs of left vertices whose signatures (u, sig) agree in a share ``least`` of the hashes and more.

    Such a pair disagrees in too few hashes to do so in all of the first ones: it meets in one of those. Nothing is missed.
    """
    needed = max(1, math.ceil(least * hashes - 1e-9))
    met = lsh_candidates(sig, 1, hashes - needed + 1)
    return estimates(met, sig).where(F.col("estimate") >= least)


def prefix_groups(sig: DataFrame, tau: int, depth: int = 10) -> DataFrame:
    """u, level, least: members are split by one hash more while a group has over 10 * tau, at most ``depth`` times."""
    level, rows = F.lit(depth), sig
    for d in reversed(range(depth)):
        size = F.count("*").over(Window.partitionBy(*[F.col("sig")[i] for i in range(d)])) if d else F.lit(sig.count())
        rows = rows.withColumn(f"__n{d}", size)
        level = F.when(F.col(f"__n{d}") <= 10 * tau, d).otherwise(level)
    rows = rows.withColumn("level", level.cast("int")).withColumn("prefix", F.slice("sig", 1, F.col("level")))
    return rows.withColumn("grp", F.min("u").over(Window.partitionBy("level", "prefix"))).select("u", "level", "grp")


def confidence_blend(estimate: Column, sampled: Column, d1: Column, d2: Column) -> Column:
    """The sampled similarity counts the more, the larger the smaller degree is, up to ten."""
    weight = F.least(F.lit(1.0), F.least(d1, d2) / 10.0)
    return weight * sampled + (1 - weight) * estimate


def affine(value: Column, h: int) -> Column:
    """The hash ``h`` of whole numbers, below PRIME."""
    a, b = parameters(h)
    return F.pmod(F.pmod(value, F.lit(PRIME)) * F.lit(a) + F.lit(b), F.lit(PRIME))


@outlasting
def validation_pairs(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """u1, u2, exact: n pairs of left vertices drawn by a hash, with their similarity (0 of pairs without common neighbours)."""
    ids = numbered(edges.select("u").distinct(), "u").select((F.col("seq") - 1).alias("seq"), "u")
    size = F.lit(max(1, edges.select("u").distinct().count()))
    drawn = edges.sparkSession.range(n).select("id", F.pmod(affine(F.col("id"), seed), size).alias("i"), F.pmod(affine(F.col("id"), seed + 1), size).alias("j"))
    both = drawn.join(ids.toDF("i", "u1"), "i").join(ids.toDF("j", "u2"), "j").select("id", F.least("u1", "u2").alias("u1"), F.greatest("u1", "u2").alias("u2"))
    both = settled(both)
    found = both.join(compared(both.select("u1", "u2").distinct(), edges).select("u1", "u2", "jaccard"), ["u1", "u2"], "left")
    return found.select("id", "u1", "u2", F.when(F.col("u1") == F.col("u2"), 1.0).otherwise(F.coalesce("jaccard", F.lit(0.0))).alias("exact"))


def seeded_order(edges: DataFrame, seed: int = 42) -> DataFrame:
    """seq, u: left vertices in the order of a hash, which stands for a shuffle with that seed."""
    ids = edges.select("u").distinct().withColumn("h", affine(F.col("u"), seed))
    return numbered(ids, "h", "u").select("seq", "u")


def neighbour_estimates(order: DataFrame, sig: DataFrame, reach: int = 10) -> DataFrame:
    """seq, u, estimate: for vertices in an order (seq, u) the largest MinHash estimate with those from ``reach`` places before to ``reach`` - 1 after."""
    rows = order.join(sig, "u")
    near = rows.select("seq", "u", F.col("sig").alias("s1"), F.explode(F.sequence(F.col("seq") - reach, F.col("seq") + reach - 1)).alias("at")).where("at <> seq")
    both = near.join(rows.select(F.col("seq").alias("at"), F.col("sig").alias("s2")), "at", "left")
    return both.groupBy("seq", "u").agg(F.max(F.coalesce(agreement("s1", "s2"), F.lit(0.0))).alias("estimate"))
