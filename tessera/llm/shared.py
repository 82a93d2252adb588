"""Helpers that several operators share: checkpoints, row keys, text hashing, tiles, components."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import clear_tables, own_tables, shared_folder
from tessera.operators.graph import settled as cut

__all__ = ["clear_tables", "cut", "own_tables", "shared_folder"]

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def lean(spark: SparkSession) -> None:
    """Let Python tasks get rows in batches of ``BATCH_BYTES`` at most, whatever texts they hold, unless the session sets another bound."""
    if spark.conf.get(BATCH_CONF) in ("64m", "67108864b", "67108864"):  # Spark's own default
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16 bytes that name a document by its id and text; repeated rows share them. Nulls are allowed.

    The key itself is never null, and Spark knows: a shuffle of texts by it serves both inner and outer joins.
    """
    parts = F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull()
    return F.coalesce(F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts))])), F.lit(b""))


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of ``df`` bears."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def parts_for(rows: int, per_part: int, least: int = 12) -> int:
    return max(least, -(-rows // per_part))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class SpanHash:
    """Hashes of any spans of one buffer, each in constant time, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        """values: uint64, one for each position."""
        size = 1 << max(16, int(len(values)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def raw(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, stop))


def chunked(texts: list, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``limit`` characters; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size + n > limit and i > start:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def tiled(df: DataFrame, keys: list[str], member: str, limit: int, weight: str | None = None, most: int = 0, many: DataFrame | None = None, broadcast_keys: int = 50_000) -> DataFrame:
    """Add ``tile_i``, ``tile_j`` and ``tile_own``, so that a key of more than ``limit`` rows becomes many small groups.

    The rows of a key are dealt to ceil(count / limit) chunks (more, where their ``weight`` is over ``most`` a chunk) by a
    hash of ``member``; each pair of chunks is a tile, and a row goes to every tile of its chunk. Pairs whose rows are in
    the tile's two chunks (or in its one chunk, where i = j) are that tile's to compare, so none is lost or met twice.
    many: a written table of the keys over the limit, with their ``count``; where they are at most ``broadcast_keys``, the
    rows of df needn't be dealt out for it.
    """
    if many is None:
        chunks = F.ceil(F.count("*") / limit)
        if weight:
            chunks = F.greatest(chunks, F.ceil(F.sum(weight) / most))
        many = df.groupBy(*keys).agg(chunks.cast("int").alias("__chunks")).where("__chunks > 1")
    else:
        few = many.count() <= broadcast_keys
        many = many.select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("__chunks"))
        many = F.broadcast(many) if few else many
    chunks = F.coalesce("__chunks", F.lit(1))
    df = df.join(many, keys, "left").withColumn("tile_own", F.pmod(F.xxhash64(member), chunks).cast("int"))
    df = df.withColumn("__other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return df.select(
        *[c for c in df.columns if c not in ("__chunks", "__other")],
        F.least("tile_own", "__other").cast("int").alias("tile_i"),
        F.greatest("tile_own", "__other").cast("int").alias("tile_j"),
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: ``node``, ``root`` (the smallest node of its component) for each node of an edge.

    Minimum labels spread over the edges and along themselves (pointer jumping), until none changes.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("s"), F.col(b).alias("d"))
    pairs = cut(pairs.union(pairs.select("d", "s")).distinct())
    labels = cut(pairs.groupBy(F.col("s").alias("node")).agg(F.min("d").alias("d")).select("node", F.least("node", "d").alias("root")))
    while True:
        near = pairs.join(labels.select(F.col("node").alias("d"), "root"), "d").groupBy(F.col("s").alias("node")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("via"))
        jumped = spread.join(labels.select(F.col("node").alias("via"), F.col("root").alias("over")), "via")
        new = cut(jumped.select("node", "old", F.least("via", "over").alias("root")))
        changed = new.where(F.col("old") != F.col("root")).limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point that the links reach."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
