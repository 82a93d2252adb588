"""Sums over documents of values that belong to keys (pre-tokens, groups of ids), each key's value being found once.

A table of keys has ``key`` (64 bits of a hash), ``n`` (occurrences) and values. Its most frequent keys, at most ``HOT`` of
them, go to all tasks as sorted arrays of numbers; what a document has of other keys is joined by shuffles. So no key of
the shuffle is frequent, and what is broadcast doesn't grow with the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import BYTE_VALUES, SpanHash, mix

#: Keys in the arrays that are broadcast: 8 bytes each, and 8 for each value.
HOT = 1_000_000


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
    """Signed 64-bit hashes of spans of a buffer of bytes."""
    found = SpanHash(BYTE_VALUES[data]).raw(start, stop)
    return mix(found ^ mix(np.full(1, seed + 1, np.uint64))).view(np.int64)


def hashes_of(items: list[bytes], seed: int) -> np.ndarray:
    """The same hashes, of strings."""
    stop = np.cumsum([len(x) for x in items], dtype=np.int64)
    return hashes(np.frombuffer(b"".join(items), np.uint8), np.r_[0, stop[:-1]], stop, seed) if items else np.zeros(0, np.int64)


def collide(table: DataFrame, key: str) -> bool:
    """Do two rows of a table of different strings share a key? Then the caller takes another seed."""
    return table.groupBy(key).count().where("count > 1").limit(1).count() > 0


def frequent(table: DataFrame, most: int) -> int:
    """The least ``n`` of which at most ``most`` keys of the table have as much or more."""
    bucket = F.floor(8 * F.log2("n"))
    rows = table.groupBy(bucket.alias("b")).agg(F.count("*").alias("keys"), F.min("n").alias("n")).collect()  # some hundred rows
    bound, total = 1 << 62, 0
    for r in sorted(rows, key=lambda r: -r["b"]):
        total += r["keys"]
        if total > most:
            break
        bound = r["n"]
    return bound


class Hot:
    """The frequent keys and their values, for tasks."""

    def __init__(self, table: DataFrame, values: list[str], most: int):
        self.bound = frequent(table, most)
        found = table.where(F.col("n") >= self.bound).select("key", *values).toArrow()  # at most ``most`` rows
        keys = found.column(0).to_numpy()
        order = np.argsort(keys)
        self.columns = table.sparkSession.sparkContext.broadcast((keys[order], [found.column(v).to_numpy()[order] for v in values]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys are frequent, and their values; 0 of the others."""
        known, values = self.columns.value
        if not len(known):
            return np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in values]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, [np.where(hit, v[at], 0) for v in values]


def joined_sums(rows: DataFrame, table: DataFrame, values: list[str]) -> DataFrame:
    """uid and, for each value, the sum of ``ns`` times the value over the row's ``keys``: rows have uid, keys, ns; all keys are in the table."""
    each = rows.select("uid", F.explode(F.arrays_zip("keys", "ns")).alias("x")).select("uid", F.col("x.keys").alias("key"), F.col("x.ns").alias("times"))
    return each.join(table.select("key", *values), "key").groupBy("uid").agg(*[F.sum(F.col("times") * F.col(v)).alias(v) for v in values])
