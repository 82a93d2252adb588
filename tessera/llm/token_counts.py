"""Token counts (13): pieces are counted once for each distinct pre-token, and summed over documents by joins.

A pre-token is what lies between two places that no piece of the vocabulary spans, whatever two bytes meet there: merges
never cross such a place, so that the pre-tokens of a text, the space before it included, have as many pieces as the text.
Tasks find them in whole buffers of bytes and give each a hash. One pass makes the table of distinct pre-tokens, whose pieces
are counted; another looks the frequent ones up at hand and joins the others (see ``lookups``). Ids are never kept.

Pre-tokens of more than ``LONG`` bytes are counted where they stand: hardly one of them repeats. Two strings of one hash in
different tasks' tables are found, and another seed is taken; within one buffer that is as unlikely as 1e-10.

Null and empty texts have no tokens; repeated rows are counted each; an empty table gives no rows. Very long texts are taken one
by one and need some 60 bytes of memory for each of their own. Other columns than the text are carried along, whatever
their names; those of the result take the place of others of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import lookups
from tessera.llm.shared import chunked, cut

LONG, BLOCK, DISTINCT = 256, 1 << 20, 300_000
_state: dict = {}


class Pieces:
    """A piece model: where its merges can't cross, and how many pieces strings have."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        joins = np.zeros((256, 256), bool)
        for i in range(m.get_piece_size()):
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)):
                data = m.id_to_piece(i).replace("▁", " ").encode()
                for x, y in zip(data, data[1:], strict=False):
                    joins[x, y] = True
        joins[:, 0x80:0xC0] = True  # within a character
        self.apart = ~joins.ravel()
        alone = [c for c in range(1, 32) if not (joins[32, c] or joins[c, :0x80].any() or joins[c, 0xC0:].any())]
        if not alone or "".join(m.encode("a  b", out_type=str)) != "▁a▁▁b":
            raise ValueError("the model changes texts, or joins every character to others")
        self.alone = chr(alone[0])

    def count(self, items: list[bytes]) -> list[int]:
        """Pieces of pre-tokens. The library puts a space before a text, and a character that joins nothing parts it from the pre-token."""
        found = self.model.encode([self.alone + x.decode() for x in items], num_threads=1)
        own = len(self.model.encode(self.alone))
        return [len(ids) - own for ids in found]

    def spans(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """A buffer of the texts that aren't empty, a space before each; the starts and ends of its pre-tokens; each one's text's number."""
        rows = [k for k, t in enumerate(texts) if t]
        parts = [(" " + texts[k]).replace("▁", " ").encode() for k in rows]
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        flags = np.zeros(len(data) + 1, bool)
        flags[1:-1] = self.apart[data[:-1].astype(np.uint16) << 8 | data[1:]]
        flags[0] = len(data) > 0
        flags[ends[:-1]] = True
        flags[-1] = False
        start = np.flatnonzero(flags)
        stop = np.r_[start[1:], len(data)] if len(start) else start
        return raw, start, stop, np.array(rows, np.int64)[np.searchsorted(ends, start, "right")] if len(start) else start


def pieces_of(path: str) -> Pieces:
    if path not in _state:
        _state[path] = Pieces(path)
    return _state[path]


def _distinct(docs: DataFrame, model: str, seed: int) -> DataFrame:
    """key, token (bytes), n: the pre-tokens of all texts; rows of one task differ, up to ``DISTINCT`` at a time."""

    def emit(seen: dict[bytes, int]) -> pa.RecordBatch:
        items = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(lookups.hashes_of(items, seed)), pa.array(items, pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["key", "token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = pieces_of(model), {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunked(texts, BLOCK):
                raw, start, stop, _ = pieces.spans(texts[a:b])
                short = stop - start <= LONG
                start, stop = start[short], stop[short]
                _, first, n = np.unique(lookups.hashes(np.frombuffer(raw, np.uint8), start, stop, seed), return_index=True, return_counts=True)
                for s, e, c in zip(start[first].tolist(), stop[first].tolist(), n.tolist(), strict=True):
                    seen[raw[s:e]] = seen.get(raw[s:e], 0) + c
                if len(seen) > DISTINCT:
                    yield emit(seen)
                    seen = {}
        if seen:
            yield emit(seen)

    return docs.select("text").where("text <> ''").mapInArrow(run, "key long, token binary, n long")


def pre_tokens(docs: DataFrame, model: str, seed: int = 0) -> tuple[DataFrame, int]:
    """A written table key, n, pieces of the distinct pre-tokens, and the seed of its keys."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pieces_of(model).count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int32())], names=["key", "n", "pieces"])

    while True:
        each = _distinct(docs, model, seed).groupBy("key", "token").agg(F.sum("n").alias("n"))
        table = cut(each.mapInArrow(counted, "key long, n long, pieces int"))
        if not lookups.collide(table, "key"):
            return table, seed
        seed += 1


def token_counts(docs: DataFrame, model: str, limit: int = 4096, hot: int = lookups.HOT) -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each document (text), beside its other columns."""
    table, seed = pre_tokens(docs, model)
    most = lookups.Hot(table, ["pieces"], hot)
    names = [c for c in docs.columns if c.lower() not in ("text", "n_bytes", "n_tokens", "over_limit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, uid = pieces_of(model), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            keys, ns, ends = [], [], []
            for a, b in chunked(texts, BLOCK):
                size[a:b] = [len(t.encode()) if t else 0 for t in texts[a:b]]
                raw, start, stop, row = pieces.spans(texts[a:b])
                long = stop - start > LONG
                for s, e, r in zip(start[long].tolist(), stop[long].tolist(), row[long].tolist(), strict=True):
                    total[a + r] += pieces.count([raw[s:e]])[0]
                start, stop, row = start[~long], stop[~long], row[~long]
                key = lookups.hashes(np.frombuffer(raw, np.uint8), start, stop, seed)
                hit, (n,) = most.find(key)
                total[a:b] += np.bincount(row, n, b - a).astype(np.int64)
                key, row = key[~hit], row[~hit]
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][: len(key)]
                first = np.flatnonzero(new)
                keys.append(key[first])
                ns.append(np.diff(np.r_[first, len(key)]))
                ends.append(np.bincount(row[first], minlength=b - a))
            offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(ends))].astype(np.int32)) if ends else pa.array([0], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], t)) for x, t in ((keys, pa.int64()), (ns, pa.int32()))]
            ids = pa.array(np.arange(uid, uid + len(texts), dtype=np.int64))
            uid += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(size), pa.array(total), *lists], names=["row", "uid", "n_bytes", "n_tokens", "keys", "ns"])

    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    schema = StructType([carried.schema["row"], *StructType.fromDDL("uid long, n_bytes long, n_tokens long, keys array<long>, ns array<int>")])
    rows = cut(carried.mapInArrow(run, schema))
    rest = lookups.joined_sums(rows.where(F.size("keys") > 0), table.where(F.col("n") < most.bound), ["pieces"])
    found = rows.join(rest, "uid", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("pieces", F.lit(0)))
    return found.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
