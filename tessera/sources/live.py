"""Edge streams that arrive as lines of text files, with positions that survive restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.graph import own_tables
from tessera.sources.edges import numbered
from tessera.streaming.slots import with_states

EDGES = "seq long, src long, dst long"


class Sequence(StatefulProcessor):
    """Numbers the rows of each key from 1 on; the state of a key is the last number given."""

    def __init__(self, columns: list[str], parts: int):
        self.columns, self.parts = columns, parts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        found = pd.concat(list(rows))
        found.columns = [*self.columns, "__at", "__key"]  # made-up names of computed columns don't get here
        found = found.sort_values("__at", kind="stable")
        n = self.last.get()[0] if self.last.exists() else 0
        place = n + pd.Series(range(1, len(found) + 1), index=found.index)
        self.last.update((n + len(found),))
        yield found[self.columns].assign(seq=(place - 1) * self.parts + int(key[0]) + 1)

    def close(self) -> None:
        pass


def sequenced(rows: DataFrame, at: Column, part: Column | None = None, parts: int = 1, output_mode: str = "append") -> DataFrame:
    """Add ``seq`` to a stream: each number once, whatever restarts there are, in order of ``at`` within a micro-batch and of micro-batches.

    With one part, numbers go from 1 on without gaps, and one task gives them. More parts share the work: a row's part
    (``part``, any value of it) takes every ``parts``-th number, in order within the part; a number is still given once.
    """
    with_states(rows.sparkSession)
    key = F.lit(0) if part is None else F.pmod(F.xxhash64(part), F.lit(parts)).cast("int")
    keyed = rows.withColumn("__at", at).withColumn("__key", key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return keyed.groupBy("__key").transformWithStateInPandas(Sequence(rows.columns, parts), f"{schema}, seq long", output_mode, "none")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a task's count of rows, which go up within a file's block as the lines do."""
    n = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(n, n + batch.num_rows), pa.int64())], names=[*batch.schema.names, "row"])
        n += batch.num_rows


def read_edge_stream(spark: SparkSession, path: str, sep: str = "\t", parts: int = 1, output_mode: str = "append", **options) -> DataFrame:
    """A live edge stream seq, src, dst of the text files that come into a folder: two whole numbers a line, in line order.

    Files of one micro-batch go by their paths, micro-batches as they come; with parts, order holds within a file. Self-loops
    and lines of other shapes go before positions are given.
    """
    rows = _parsed(spark, path, sep, options)
    order = F.concat_ws("/", "file_path", F.lpad(F.col("file_block_start").cast("string"), 19, "0"), F.lpad(F.col("row").cast("string"), 19, "0"))
    return sequenced(rows, order, F.col("file_path"), parts, output_mode).select("seq", "src", "dst")


def _parsed(spark: SparkSession, path: str, sep: str, options: dict) -> DataFrame:
    """src, dst and where they stand: file_path, file_block_start and row."""
    lines = spark.readStream.options(**options).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.mapInArrow(_counted, "value string, file_path string, file_block_start long, row long")
    p = F.split("value", sep)
    rows = lines.select(F.when(F.size(p) == 2, p[0].try_cast("long")).alias("src"), F.when(F.size(p) == 2, p[1].try_cast("long")).alias("dst"), "file_path", "file_block_start", "row")
    return rows.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def write_edge_stream(spark: SparkSession, path: str, out: str, checkpoint: str, sep: str = "\t", **options) -> DataFrame:
    """As ``read_edge_stream`` with one part, run to the source's end and written: seq, src, dst without gaps, in line order.

    Positions of a micro-batch are given by ranges of its lines, on top of how many the micro-batches before it have written: no task
    sees all lines. A micro-batch has a folder of its own below ``out``, which it writes anew when it is repeated. Called again, it goes on.
    """

    def number(rows: DataFrame, batch: int) -> None:
        with own_tables(rows.sparkSession):
            found = numbered(rows, "file_path", "file_block_start", "row")
            before = 0
            if batch:
                earlier = rows.sparkSession.read.schema(EDGES).parquet(f"{out}/*").where(F.regexp_extract(F.col("_metadata.file_path"), r"batch-(\d+)/[^/]*$", 1).try_cast("long") < batch)
                before = earlier.count()
            found.select((F.col("seq") + before).alias("seq"), "src", "dst").write.mode("overwrite").parquet(f"{out}/batch-{batch:09d}")

    spark.createDataFrame([], EDGES).write.mode("overwrite").parquet(f"{out}/none")  # read where there are no lines at all
    query = _parsed(spark, path, sep, options).writeStream.foreachBatch(number).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(EDGES).parquet(f"{out}/*")


def written(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream's source holds now, run to its end and written; the table as it is after that. Called again, it goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
