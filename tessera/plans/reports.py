"""Partitioning reports and running metrics of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.adaptive import density_class
from tessera.operators.graph import core, degree
from tessera.sources.edges import in_ranges, numbered


def tiles(edges: DataFrame, tau: int, dense_share: float, parts: int = 64) -> DataFrame:
    """tile_id, first_u, last_u, n, work, mean_deg, target of runs of the core's left ids.

    Tiles go to the dense side, in order, while their work still fits 1.1 times its share; larger ones are skipped.
    At most about two times ``parts`` rows: the ordered fold runs over one array.
    """
    ids = numbered(core(edges, tau).select("u").distinct(), "u").join(degree(edges, "u"), "u")
    size = F.greatest(F.lit(1), F.floor(F.lit(ids.count()) / parts))
    rows = ids.groupBy(F.floor((F.col("seq") - 1) / size).alias("tile_id")).agg(F.min("u").alias("first_u"), F.max("u").alias("last_u"), F.count("*").alias("n"), F.sum(F.col("deg") * F.col("deg")).alias("work"), F.avg("deg").alias("mean_deg"))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("tile_id", "first_u", "last_u", "n", "work", "mean_deg"))).alias("t"), F.sum("work").alias("total"))
    budget = F.col("total") * F.lit(1.1 * dense_share)
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("dense"))

    def take(acc, x):
        fits = acc["used"] + x["work"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["work"]).otherwise(0)).alias("used"), F.concat(acc["dense"], F.array(fits)).alias("dense"))

    folded = whole.withColumn("dense", F.aggregate("t", start, take)["dense"])
    each = folded.select(F.explode(F.arrays_zip("t", "dense")).alias("x"))
    return each.select("x.t.*", F.when(F.col("x.dense"), "dense").otherwise("sparse").alias("target"))


def blocks(edges: DataFrame, side: str, size: int = 256) -> DataFrame:
    """block_id, n, mean_deg, target for runs of ids of a side; the right side is always sparse."""
    rows = degree(edges, side).groupBy(F.floor(F.col(side) / size).alias("block_id")).agg(F.count("*").alias("n"), F.avg("deg").alias("mean_deg"))
    return rows.withColumn("target", density_class(F.col("mean_deg")) if side == "u" else F.lit("sparse"))


def running_best(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Add ``best``, the largest value so far, and ``gain`` over the row before: within ranges, on top of the ranges before."""
    ranged = in_ranges(rows, order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    tops = ranged.groupBy("__part").agg(F.max(value).alias("__top")).select("__part", F.max("__top").over(before).alias("__before"))
    w = Window.partitionBy("__part").orderBy(order)
    found = ranged.join(F.broadcast(tops), "__part").withColumn("best", F.greatest(F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__before"))
    return found.withColumn("gain", F.col("best") - F.coalesce(F.lag("best").over(w), "__before", F.lit(0.0))).drop("__part", "__before")


def resampled(rows: DataFrame, order: str, value: str, points: int) -> DataFrame:
    """point, value: the step function at ``points`` even places from 1 to the last position (whole numbers).

    Each step goes to the first place that is not before it, where the last of them stays; places are few.
    """
    last = rows.agg(F.max(order).cast("long")).first()[0]
    spark = rows.sparkSession
    place = F.greatest(F.lit(1), F.floor((F.col(order).cast("long") - 1) * F.lit(points) / F.lit(last or 1)) + 1).cast("int")
    steps = rows.groupBy(place.alias("point")).agg(F.max_by(F.col(value).cast("double"), order).alias("value"))
    grid = spark.range(1, 0 if last is None else points + 1).select(F.col("id").cast("int").alias("point"))
    so_far = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, 0)  # ``points`` rows
    return grid.join(steps, "point", "left").select("point", F.last("value", True).over(so_far).alias("value"))


def panel(rows: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """json: the columns' values, in order of the first, as named lists of text; a row for each curve, which ``by`` names. For the few rows of a plot."""
    ordered = F.sort_array(F.collect_list(F.struct(*columns)))

    def texts(name: str) -> Column:
        return F.transform(ordered, lambda x: F.format_string("%.8f", x[name].cast("double"))).alias(name)

    lists = [texts(c) for c in columns]
    return rows.groupBy(*by).agg(F.to_json(F.struct(*lists)).alias("json"))


def tile_balance(tiles: DataFrame) -> DataFrame:
    """dense, sparse: work of the two targets; balance: the smaller over the larger, 0 where one has none."""
    work = lambda target: F.coalesce(F.sum(F.when(F.col("target") == target, F.col("work"))), F.lit(0))
    both = tiles.agg(work("dense").alias("dense"), work("sparse").alias("sparse"))
    return both.withColumn("balance", F.when(F.greatest("dense", "sparse") > 0, F.least("dense", "sparse") / F.greatest("dense", "sparse")).otherwise(0.0))
