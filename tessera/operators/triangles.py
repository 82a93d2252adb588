"""Exact triangle counts of undirected edges (src < dst), and error metrics of estimates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import settled

#: Edges of a cell, about, and wedges that a task looks at at once.
CELL, WEDGES = 1 << 20, 1 << 20


def _colour(vertex: str, colours: int) -> Column:
    return F.pmod(F.xxhash64(F.col(vertex).cast("long")), F.lit(colours))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, z of a cell's triangles, some wedges at a time; of a cell of two colours, those that have both."""
    rows = pa.Table.from_batches(list(batches))
    if not len(rows):
        return
    ids, ends = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
    n, half = len(ids), len(rows)
    rank = np.empty(n, np.int64)
    rank[np.argsort(np.bincount(ends, minlength=n), kind="stable")] = np.arange(n)
    named = np.empty(n, np.int64)
    named[rank] = ids
    a, b = rank[ends[:half]], rank[ends[half:]]
    keys = np.minimum(a, b) * n + np.maximum(a, b)
    order = np.argsort(keys)
    keys, same = keys[order], rows["same"].to_numpy()[order]
    s, d = np.divmod(keys, n)
    more = np.searchsorted(s, s, "right") - np.arange(half) - 1  # edges of the same start after each
    total = np.cumsum(more)
    mixed = same.any()  # a triangle of one colour counts in that colour's own cell
    first = 0
    while first < half:
        last = max(first + 1, int(np.searchsorted(total, total[first] - more[first] + WEDGES, "right")))
        one = np.repeat(np.arange(first, last), more[first:last])
        two = one + 1 + np.arange(len(one)) - np.repeat(total[first:last] - more[first:last] - (total[first] - more[first]), more[first:last])
        if mixed:
            some = ~(same[one] & same[two])
            one, two = one[some], two[some]
        asked = d[one] * n + d[two]
        closed = keys[np.minimum(np.searchsorted(keys, asked), half - 1)] == asked
        one, two = one[closed], two[closed]
        corners = np.sort(named[np.stack([s[one], d[one], d[two]])], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in corners], names=["x", "y", "z"])
        first = last


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z with x < y < z, each once.

    Vertices get colours by a hash, and an edge goes to the cells, triples of colours, that hold both of its ends' colours: a
    triangle is whole in the cell of its corners' colours. There are as many colours as keep cells at about ``CELL`` edges, and only edges are
    shuffled, once for each colour, never wedges. Within a cell, edges go from the end of the smaller degree (ties: the
    smaller id), so that no vertex, a hub least of all, has more than about sqrt(2 * edges) of them, and wedges are made of these only.
    """
    e = settled(edges.select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).where("a != b").distinct())
    colours = max(1, math.ceil(math.sqrt(6 * e.count() / CELL)))
    a, b = _colour("a", colours), _colour("b", colours)
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(colours - 1).cast("long")), lambda c: F.sort_array(F.array(a, b, c)))
    each = e.select("a", "b", (a == b).alias("same"), F.explode(F.array_distinct(cell)).alias("t"))
    number = ((F.col("t")[0] * colours + F.col("t")[1]) * colours + F.col("t")[2]).cast("int")
    whole = F.col("t")[0] == F.col("t")[2]
    return each.select("a", "b", (F.col("same") & ~whole).alias("same"), number.alias("cell")).groupBy("cell").applyInArrow(_closed, "x long, y long, z long")


def local_counts(edges: DataFrame) -> DataFrame:
    return triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").cast("double").alias("triangles"))


def dense_counts(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for every id from 0 to the largest."""
    last = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    ids = edges.sparkSession.range(0 if last is None else last + 1).withColumnRenamed("id", "node")
    return ids.join(counts, "node", "left").select("node", F.coalesce("triangles", F.lit(0.0)).alias("triangles"))


def with_estimates(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """node, truth, estimate: two tables of counts (node, triangles) joined; a node that one lacks goes."""
    return truth.toDF("node", "truth").join(estimate.toDF("node", "estimate"), "node")


def error_metrics(rows: DataFrame, estimate: str, truth: str, noise: float | None = None) -> DataFrame:
    """n, mae, rmse and lape, the mean of |estimate - truth| / (truth + 1); of rows with a truth above ``noise`` if given."""
    if noise is not None:
        rows = rows.where(F.col(truth) > noise)
    off = F.abs(F.col(estimate) - F.col(truth))
    return rows.agg(F.count("*").alias("n"), F.avg(off).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off / (F.col(truth) + 1)).alias("lape"))
