"""Edge lists: text and TSV readers and writers, and the graphs that the relational tables hold.

A bipartite graph is a frame of distinct ``u``, ``v``; an edge stream is ``seq``, ``src``, ``dst`` in order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import settled


def distinct_edges(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null").distinct()


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """value: a row for each line; with ``header``, without the first line of each file."""
    return spark.read.csv(path, schema="value string", sep="\x01", quote="", header=header, enforceSchema=True)


def read_edge_list(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Two whole numbers a line, white space between; the first line is the header, lines of other shapes are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path, header).select(parts.alias("p")).where(F.size("p") == 2)
    return distinct_edges(rows.select(F.col("p")[0].try_cast("long").alias("u"), F.col("p")[1].try_cast("long").alias("v")), "u", "v")


def read_stream_file(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """An edge stream in line order; self-loops go before positions are given."""
    rows = spark.read.csv(path, sep=sep, schema="src long, dst long").where("src != dst")  # nulls, of lines of other shapes, go as well
    return numbered(rows.withColumn("__at", F.monotonically_increasing_id()), "__at").select("seq", "src", "dst")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """node, triangles: white space between; lines of other shapes are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path, False).select(parts.alias("p")).where(F.size("p") == 2)
    return rows.select(F.col("p")[0].try_cast("long").alias("node"), F.col("p")[1].try_cast("double").alias("triangles")).where("node is not null and triangles is not null")


def write_counts(counts: DataFrame, path: str) -> None:
    counts.select("node", "triangles").write.mode("overwrite").csv(path, sep="\t")


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows dealt out by ranges of the order, written with ``__part``, the number of the range.

    The number is only the same in all that reads it because it is written: of a plan that is run twice, adaptive
    execution may join other partitions each time.
    """
    return settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``seq`` from 1 in the order given, without bringing all rows to one task: ranges are ranked, then counts added."""
    ranged = in_ranges(df, *order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = ranged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__part").orderBy(*order)
    return ranged.join(F.broadcast(counts), "__part").withColumn("seq", F.row_number().over(own) + F.col("__before")).drop("__part", "__before")


def as_stream(edges: DataFrame) -> DataFrame:
    """A bipartite graph replayed in order of u, v."""
    return numbered(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")), "src", "dst").select("seq", "src", "dst")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_edges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def user_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return distinct_edges(events, "user_id", "k")


def user_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive users of the event log, as undirected edges src < dst with the first arrival."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    pairs = numbered(events, "event_id")
    after = pairs.select((F.col("seq") - 1).alias("seq"), F.col("user_id").alias("b"))
    both = pairs.join(after, "seq").where(F.col("user_id") != F.col("b"))
    edges = both.groupBy(F.least("user_id", "b").alias("src"), F.greatest("user_id", "b").alias("dst")).agg(F.min("seq").alias("first"))
    return numbered(edges, "first").select("seq", "src", "dst")
