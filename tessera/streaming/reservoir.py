"""One-pass triangle estimates in a fixed number of edges, and exact or sampled counts that need no order.

A reservoir sees edges in order of arrival and keeps ``k`` of them. So that this scales out, vertices get one of
``colours`` colours by a hash, and there is a reservoir for each triple of colours: an edge goes to the triples that
hold both of its ends' colours, and a triangle counts in the one triple of its three corners' colours. Each
reservoir is unbiased for its triangles, so their sums are unbiased for all; with one colour it is the classical
estimator. Memory of a task is bounded by its ``k`` slots. Repeated edges are counted again, self-loops are dropped.

Where all edges have to fit, loads are measured: a triple of colours with more edges than slots, as hubs make them, is split by
second colours of its vertices until each of its cells fits.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import settled
from tessera.operators.similarity import PRIME, parameters
from tessera.operators.triangles import triangles
from tessera.streaming.slots import Reservoir, SlotProcessor, Slots, with_states

#: Edges of a triple of colours, about, where colours go by the number of edges: Python holds some 500 bytes for each.
ROOM = 1 << 19


def colours_for(edges: int) -> int:
    """Colours that keep triples at about ``ROOM`` edges, four at least: an edge goes to as many triples, and there are colours ** 3 / 6 of them."""
    return max(4, math.ceil(math.sqrt(6 * edges / ROOM)))


def colour(vertex: int, colours: int) -> int:
    """As ``_colour``, for an id at hand: Spark's xxhash64 of a long, with its seed."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", vertex), 42)
    return (h - (h >> 63 << 64)) % colours


def _colour(vertex: str, colours: int) -> Column:
    return F.pmod(F.xxhash64(F.col(vertex).cast("long")), F.lit(colours))


class Coloured:
    """The reservoirs of a task's triples."""

    def __init__(self, colours: int, **options):
        self.colours, self.options, self.held = colours, options, {}

    def __getitem__(self, triple: tuple[int, int, int]) -> Reservoir:
        if triple not in self.held:
            colours = self.colours  # not self: a reservoir that is in a cycle stays until garbage is collected
            mine = None if colours == 1 else lambda *corners: tuple(sorted(colour(x, colours) for x in corners)) == triple
            self.held[triple] = Reservoir(mine=mine, **{**self.options, "seed": hash((self.options.get("seed", 1), *triple))})
        return self.held[triple]


def dealt(stream: DataFrame, colours: int) -> DataFrame:
    """seq, src, dst, triple (a number): the stream's edges, each for every triple that it can complete."""
    third = F.transform(F.sequence(F.lit(0), F.lit(colours - 1)), lambda c: F.sort_array(F.array(_colour("src", colours), _colour("dst", colours), c.cast("long"))))
    each = stream.where("src != dst").select("seq", "src", "dst", F.explode(F.array_distinct(third)).alias("t"))
    number = (F.col("t")[0] * colours + F.col("t")[1]) * colours + F.col("t")[2]
    return each.select("seq", "src", "dst", number.alias("triple"))


def _numbers(triple: int, colours: int) -> tuple[int, int, int]:
    return triple // colours**2, triple // colours % colours, triple % colours


def _second(vertex: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(vertex.cast("long"), F.lit("second")), parts)


def second(vertex: int, parts: int) -> int:
    """As ``_second``: Spark's hash of a long is the seed of that of the text."""
    h = xxhash.xxh64_intdigest(b"second", xxhash.xxh64_intdigest(struct.pack("<q", vertex), 42))
    return (h - (h >> 63 << 64)) % parts


def fitted(stream: DataFrame, colours: int, k: int) -> DataFrame:
    """seq, src, dst, triple, parts, cell: as ``dealt``, triples of more than k edges split so that every cell has at most k.

    In a split triple, each vertex has a second colour of ``parts``; a cell is a triple of both colours, and an edge goes to
    the cells of every second colour that the third corner may have. A cell of one hub and two shares of its neighbours
    loses edges in proportion to ``parts``, others faster. An edge repeated more than k times can't be split.
    """
    rows = dealt(settled(stream.select("seq", "src", "dst")), colours).withColumn("first", F.array(*[F.pmod(F.floor(F.col("triple") / colours**p), F.lit(colours)) for p in (2, 1, 0)]))
    heavy = {r["triple"]: math.ceil(1.5 * r["count"] / k) for r in rows.groupBy("triple").count().where(F.col("count") > k).collect()}  # of colours ** 3 / 6 triples at most
    whole = rows.select("seq", "src", "dst", "triple", F.lit(1).alias("parts"), F.col("triple").cast("string").alias("cell"))
    done, todo = whole.where(~F.col("triple").isin(list(heavy))) if heavy else whole, heavy
    while todo:
        parts = F.create_map(*[F.lit(x) for pair in todo.items() for x in pair])[F.col("triple")]
        some = rows.where(F.col("triple").isin(list(todo))).withColumn("parts", parts.cast("int"))
        corner = lambda c: F.struct(_colour(c, colours).alias("c"), _second(F.col(c), F.col("parts")).alias("s"))
        # what the triple has beside the edge's two colours
        rest = F.aggregate("first", F.lit(0).cast("long"), lambda a, x: a + x) - _colour("src", colours) - _colour("dst", colours)
        cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: F.sort_array(F.array(corner("src"), corner("dst"), F.struct(rest.alias("c"), s.cast("long").alias("s")))))
        split = some.select("seq", "src", "dst", "triple", "parts", F.explode(F.array_distinct(cells)).alias("x"))
        split = settled(split.select("seq", "src", "dst", "triple", "parts", F.concat_ws(" ", "triple", F.transform("x", lambda x: F.concat_ws(":", x["c"], x["s"]))).alias("cell")))
        over = [r["triple"] for r in split.groupBy("triple", "cell").count().where(F.col("count") > k).select("triple").distinct().collect()]
        over = [t for t in over if todo[t] < 1 << 12]
        done, todo = done.union(split.where(~F.col("triple").isin(over)) if over else split), {t: 2 * todo[t] for t in over}
    return done


def _rows_in_order(stream: DataFrame, colours: int, k: int, exact: bool) -> DataFrame:
    """triple, parts, cell, src, dst: a cell's rows stand together, in order of arrival."""
    each = fitted(stream, colours, min(k, 2 * ROOM)) if exact else dealt(stream, colours).select("*", F.lit(1).alias("parts"), F.col("triple").cast("string").alias("cell"))
    return each.repartition("cell").sortWithinPartitions("cell", "seq").select("triple", "parts", "cell", "src", "dst")


def _reservoir(triple: int, parts: int, cell: str, colours: int, **options) -> Reservoir:
    if parts == 1:
        return Coloured(colours, **options)[_numbers(triple, colours)]

    def mine(*corners: int) -> bool:
        own = sorted((colour(x, colours), second(x, parts)) for x in corners)
        return cell == " ".join([str(triple), *(f"{c}:{s}" for c, s in own)])

    return Reservoir(mine=mine, **{**options, "seed": xxhash.xxh32_intdigest(cell, options.get("seed", 1))})


def _replayed(stream: DataFrame, colours: int, exact: bool, options: dict, schema: str, after_edge, after_cell) -> DataFrame:
    """A batch replay: rows (of tuples) that the functions give, of a cell's reservoir, after each edge and each cell."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, r = None, None
        for pdf in batches:
            out: list[tuple] = []
            for triple, parts, cell, src, dst in zip(*(pdf[c].tolist() for c in ("triple", "parts", "cell", "src", "dst")), strict=True):
                if cell != last:
                    if r:
                        out += after_cell(last, r)
                    last, r = cell, _reservoir(triple, parts, cell, colours, **options)
                r.add(src, dst)
                if after_edge:
                    out += after_edge(triple, r)
            yield pd.DataFrame(out, columns=names)
        if r:
            yield pd.DataFrame(after_cell(last, r), columns=names)

    return _rows_in_order(stream, colours, options["k"], exact).mapInPandas(run, schema)


def estimate(stream: DataFrame, colours: int | None = 4, exact: bool = False, **options) -> DataFrame:
    """node, triangles and, as node -1, the total: a batch replay, a reservoir of k slots for each triple of colours.

    exact: triples are split until all their edges fit (and a task's memory holds them), so that nothing is estimated. Without a
    number of colours there are ``colours_for`` the stream's edges.
    """
    if colours is None:
        stream = settled(stream.select("seq", "src", "dst"))
        colours = colours_for(stream.count())
    found = _replayed(stream, colours, exact, options, "node long, triangles double", None, lambda cell, r: [(-1, r.total), *r.nodes.items()])
    none = stream.sparkSession.createDataFrame([(-1, 0.0)], "node long, triangles double")  # a total, even of nothing
    return found.union(none).groupBy("node").agg(F.sum("triangles").alias("triangles"))


READ_OUT = "triple long, t long, round long, rate double, total double, increment double, hits long, interval long"


def stream_estimate(stream: DataFrame, colours: int = 4, local: bool = False, output_mode: str = "update", **options) -> DataFrame:
    """Structured Streaming over micro-batches of seq, src, dst: rows of what each triple's reservoir holds after a batch.

    triple, t, round, rate, total, increment (since the last round's end), hits and interval of the round so far. The
    estimate of all triangles is the sum of the triples' latest totals. local: instead, node and triangles, what the batch
    adds to each vertex's count, to be summed up where it is written. The state of a triple is its slots, one by one, and the
    neighbours of each vertex in them; a batch writes what it changes.
    """
    with_states(stream.sparkSession)
    schema = "node long, triangles double" if local else READ_OUT

    def make(triple: int, held: Slots) -> Reservoir:
        r = Coloured(colours, **options)[_numbers(triple, colours)]
        r.held = held
        return r

    processor = SlotProcessor(make, [c.split()[0] for c in schema.split(", ")], local)
    return dealt(stream, colours).groupBy("triple").transformWithStateInPandas(processor, schema, output_mode, "none")


def rounds(stream: DataFrame, colours: int = 4, **options) -> DataFrame:
    """triple, round, t, rate, total, increment, hits, interval, mean: the read-out at the end of each round; mean: of the intervals of its hits."""
    schema = "triple long, round long, t long, rate double, total double, increment double, hits long, interval long"

    def after(triple: int, r: Reservoir) -> list[tuple]:
        found, r.ended = r.ended, None
        return [(triple, *found)] if found else []

    found = _replayed(stream, colours, False, options, schema, after, lambda cell, r: [])
    return found.withColumn("mean", F.when(F.col("hits") > 0, F.col("interval") / F.col("hits")))


def kept(share: float, *ids: str) -> Column:
    """Is the hash of the ids below the share of its range? The affine hash is the same in any engine."""
    a, b = parameters(1)
    value = F.lit(b)
    for k, name in enumerate(ids):
        value = F.pmod(value + F.pmod(F.col(name).cast("long"), F.lit(PRIME)) * F.lit(parameters(k + 2)[0]), F.lit(PRIME))
    return F.pmod(value * F.lit(a), F.lit(PRIME)) < F.lit(int(share * PRIME))


def sampled_triangles(edges: DataFrame, share: float) -> DataFrame:
    """x, y, z: triangles among the edges kept by a hash; each stands for share^-3 of them."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return triangles(e.where(kept(share, "src", "dst")))


def sampled(edges: DataFrame, share: float) -> DataFrame:
    """total: triangles among edges kept by a hash, over share cubed."""
    return sampled_triangles(edges, share).agg((F.count("*") / F.lit(share**3)).alias("total"))


def sampled_counts(edges: DataFrame, share: float) -> DataFrame:
    """node, triangles: as ``sampled``, by vertex."""
    each = sampled_triangles(edges, share).select(F.explode(F.array("x", "y", "z")).alias("node"))
    return each.groupBy("node").agg((F.count("*") / F.lit(share**3)).alias("triangles"))


def sampled_jaccard(edges: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """Add ``sampled`` to pairs u1, u2 of left vertices: their Jaccard over the right vertices that a hash keeps.

    A right vertex is kept with all its edges, so that a pair's common and different neighbours are kept alike. 0 where
    nothing of one is kept; 1 of a vertex with itself. A share of 1 is exact.
    """
    sets = edges.where(kept(share, "v")).groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("n"))
    both = pairs.join(sets.toDF("u1", "__a"), "u1", "left").join(sets.toDF("u2", "__b"), "u2", "left")
    found = F.size(F.array_intersect("__a", "__b")) / F.size(F.array_union("__a", "__b"))
    return both.withColumn("sampled", F.when(F.col("u1") == F.col("u2"), 1.0).otherwise(F.coalesce(found, F.lit(0.0)))).drop("__a", "__b")
