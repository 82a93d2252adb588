"""Degrees, neighbourhoods, induced subgraphs and cores of bipartite edge frames (u, v)."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Neighbours of a list that goes along with its edges, at most.
LONG = 4096
_folders: dict[str, str] = {}
#: Of each application, lists of the tables written; the last one is of the innermost ``own_tables``.
_written: dict[str, list[list[str]]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local session may go without: it gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _folders[app]


def _tables(spark: SparkSession) -> list[list[str]]:
    return _written.setdefault(spark.sparkContext.applicationId, [[]])


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors cost no lineage, and it isn't computed twice."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    _tables(df.sparkSession)[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """The tables that ``settled`` writes within are deleted at its end: what is to stay has to be written by then. Others' tables stay."""
    tables = _tables(spark)
    mine: list[str] = []
    tables.append(mine)
    try:
        yield
    finally:
        tables[:] = [t for t in tables if t is not mine]
        _delete(spark, mine)


def outlasting(made: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of a frame that write tables on the way: only the result's own table stays."""

    @functools.wraps(made)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        spark = df.sparkSession
        with own_tables(spark):
            found = settled(made(df, *args, **options))
            _tables(spark)[-2].append(_tables(spark)[-1].pop())
        return found

    return run


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables that ``settled`` has written so far, whoever reads them; for the end of a session. ``own_tables`` is for parts of one."""
    for tables in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, tables)


def degree(edges: DataFrame, side: str) -> DataFrame:
    return edges.groupBy(side).agg(F.count("*").alias("deg"))


def adjacency(edges: DataFrame, side: str = "u") -> DataFrame:
    other = "v" if side == "u" else "u"
    return edges.groupBy(side).agg(F.sort_array(F.collect_set(other)).alias("nbrs"))


def peeled(edges: DataFrame, k: int) -> tuple[DataFrame, list[int], DataFrame]:
    """side, id of all vertices outside of the k-core (of distinct edges), how many went in each round, and the edges, written.

    Degrees are counted once. A round takes out the vertices that fell below k in the one before, counts what their
    neighbours lose, and looks again at these neighbours only: what is shuffled falls with the number of vertices that go.
    """
    arcs = edges.select(F.lit("u").alias("side"), F.col("u").alias("id"), F.col("v").alias("other")).union(edges.select(F.lit("v"), "v", "u"))
    arcs = settled(arcs)  # of both directions
    degrees = settled(arcs.groupBy("side", "id").agg(F.count("*").alias("deg")))
    frontier = settled(degrees.where(F.col("deg") < k).select("side", "id"))
    gone, losses, sizes = frontier, None, []
    while size := frontier.count():
        sizes.append(size)
        met = arcs.join(frontier, ["side", "id"], "left_semi")
        loss = settled(met.groupBy(F.when(F.col("side") == "u", "v").otherwise("u").alias("side"), F.col("other").alias("id")).agg(F.count("*").alias("lost")))
        losses = loss if losses is None else losses.union(loss)
        touched = losses.join(loss.select("side", "id"), ["side", "id"], "left_semi").groupBy("side", "id").agg(F.sum("lost").alias("lost"))
        low = touched.join(degrees, ["side", "id"]).where(F.col("deg") - F.col("lost") < k).select("side", "id")
        frontier = settled(low.join(gone, ["side", "id"], "left_anti"))
        gone = gone.union(frontier)
        if len(sizes) % 8 == 0:  # so that plans of many rounds stay small
            gone, losses = settled(gone), settled(losses.groupBy("side", "id").agg(F.sum("lost").alias("lost")))
    return gone, sizes, arcs.where("side = 'u'").select(F.col("id").alias("u"), F.col("other").alias("v"))


@outlasting
def core(edges: DataFrame, k: int) -> DataFrame:
    """Edges of the largest subgraph in which every vertex has k neighbours."""
    gone, sizes, edges = peeled(edges, k)
    if not sizes:
        return edges
    of = lambda side: gone.where(F.col("side") == side).select(F.col("id").alias(side))
    return without(edges, of("u"), of("v")).select("u", "v")


def core_vertices(edges: DataFrame, k: int) -> DataFrame:
    found = core(edges, k)
    return found.select(F.lit("L").alias("side"), F.col("u").alias("id")).union(found.select(F.lit("R"), "v")).distinct()


def induced(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges with both ends in the sets (frames of u, of v)."""
    return edges.join(left, "u", "left_semi").join(right, "v", "left_semi")


def without(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return edges.join(left, "u", "left_anti").join(right, "v", "left_anti")


def wedges(e: DataFrame, per: int = 256, first: Column | None = None, most: int | None = None) -> DataFrame:
    """Edges (u, v and other columns) that meet in a right vertex, in both orders and with themselves: v, and all else with 1 and with 2 behind its name.

    first: a condition that holds for those with 1. most: how many edges a right vertex has at most, if known.
    A vertex with many edges is dealt to a part for each ``per`` of them: an edge on the left goes to one of the parts, on the right to
    all. What comes out is much more than what goes in, so the number of partitions is given, lest few are made of them.
    """
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in e.columns if c != "v"]
    if most is not None and most <= per and first is None:  # a part for each: both sides read one shuffle
        dealt = e.repartition(parts, "v")
        return dealt.select("v", *[F.col(c).alias(f"{c}1") for c in rest]).join(dealt.select("v", *[F.col(c).alias(f"{c}2") for c in rest]), "v")
    shares = degree(e, "v").select("v", F.ceil(F.col("deg") / per).cast("int").alias("__shares"))
    e = e.join(shares, "v")
    a = (e if first is None else e.where(first)).select("v", F.pmod(F.xxhash64("u"), "__shares").cast("int").alias("__part"), *[F.col(c).alias(f"{c}1") for c in rest])
    b = e.select("v", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)).alias("__part"), *[F.col(c).alias(f"{c}2") for c in rest])
    return a.repartition(parts, "v", "__part").join(b.repartition(parts, "v", "__part"), ["v", "__part"]).drop("__part")


def short_lists(edges: DataFrame, most: float) -> bool:
    """Do the neighbour lists that go with each edge hold at most so much in all, and is none of them long?"""
    deg = degree(edges, "u").agg(F.max("deg").alias("longest"), F.sum(F.col("deg") * F.col("deg") * 1.0).alias("held")).first()
    return (deg["longest"] or 0) <= LONG and (deg["held"] or 0.0) <= most


def listed(edges: DataFrame) -> DataFrame:
    """u, n, v: edges, each once, with the sorted neighbours of their left end."""
    return edges.groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("n")).select("u", "n", F.explode("n").alias("v"))


def two_hop(edges: DataFrame) -> DataFrame:
    """u, w: left vertices that share a right one, each other than itself. Hubs on the right side are split.

    Where no left vertex has many neighbours, they go along: two vertices are found in the first that they share, and nothing has to be made distinct.
    """
    edges = settled(edges.select("u", "v"))
    right = degree(edges, "v").agg(F.max("deg").alias("most"), F.sum(F.col("deg") * (F.col("deg") - 1.0) / 2).alias("rows")).first()
    if short_lists(edges, right["rows"] or 0.0):
        met = wedges(listed(edges), most=right["most"]).where(F.col("u1") < F.col("u2")).where(F.array_intersect("n1", "n2")[0] == F.col("v"))
        return met.select(F.explode(F.array(F.struct(F.col("u1").alias("u"), F.col("u2").alias("w")), F.struct(F.col("u2").alias("u"), F.col("u1").alias("w")))).alias("x")).select("x.*")
    met = wedges(edges)
    return met.where("u1 <> u2").select(F.col("u1").alias("u"), F.col("u2").alias("w")).distinct()


def one_two_hop(edges: DataFrame) -> DataFrame:
    """u, hop, id: neighbours and neighbours' neighbours."""
    return edges.select("u", F.lit(1).alias("hop"), F.col("v").alias("id")).distinct().union(two_hop(edges).select("u", F.lit(2), "w"))


def overlapping(edges: DataFrame, left: DataFrame, q: int) -> DataFrame:
    """Members of ``left`` (u) that share a right vertex with q."""
    near = edges.where(F.col("u") == q).select("v")
    return left.join(edges.join(near, "v", "left_semi").select("u").distinct(), "u", "left_semi")
