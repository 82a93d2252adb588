"""Cross-tokenizer alignment (12): groups of two tokenizers' ids that cover the same bytes, by a dictionary of groups.

A text, with a space before it, is encoded by a byte-level tokenizer (A) and a piece model (B). Where tokens of both end, the
text is cut into groups; all pairs of an A and a B token of a group are links. A pair of ids counts the documents that hold
it linked.

Tasks cut texts before words, at spaces that neither tokenizer reads together with what stands before them, and encode each
such chunk once. They intern the groups met and write, for each document, its different groups and how often it has them.
Groups of equal ids become one row of the dictionary, with the number of its documents; links are expanded once for each row
and multiplied by that number. A document with a pair in several groups would count more than once; how much too often is
known in the task, and is taken off. What a group adds to a document goes back to the documents by the group's key (see
``lookups``).

Texts that are null, empty, or that the tokens don't give back byte for byte, have no tokens: zeros, and ``''`` for the hash.
Repeated rows count as documents of their own; an empty table gives no rows. A text without spaces is one chunk; memory grows
with the longest chunk. Other columns than the text are carried along, whatever their names; those of the result take the place
of others of their name.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm import lookups
from tessera.llm.shared import chunked, cut

RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
BLOCK, CHUNKS = 1 << 20, 250_000
#: Before a single space that a character other than white space follows.
WORDS = re.compile(r"(?<=[^ ])(?= \S)")
_state: dict = {}


def byte_values() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        values = byte_values()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(values.__getitem__, token)) if all(c in values for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])

    def encode(self, chunks: list[str]) -> tuple[list[int], list[int]] | None:
        """Ids of chunks that begin with a space, put together to one text; None where bytes differ."""
        text = "".join(chunks)
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        raw = text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else None

    def groups(self, chunks: list[str]) -> list[list[str] | None]:
        """For each chunk its groups as text; None where bytes differ."""
        found = self.encode(chunks)
        if found is None:
            return [None] if len(chunks) == 1 else [self.groups([c])[0] for c in chunks]
        a, b = found
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_ends, b_ends = a_end[np.r_[a_end[1:] > a_end[:-1], True]], b_end[np.r_[b_end[1:] > b_end[:-1], True]]
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cut = np.searchsorted(a_end, ends, "right").tolist()
        b_cut = np.searchsorted(b_end, ends, "right").tolist()
        a_text, b_text = [str(x) for x in a], [str(x) for x in b]
        texts = []
        i = j = 0
        for p, q in zip(a_cut, b_cut, strict=True):
            texts.append(f"{a_text[i]}|{b_text[j]}" if p - i == 1 == q - j else f"{','.join(a_text[i:p])}|{','.join(b_text[j:q])}")
            i, j = p, q
        stops = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in chunks]), "right").tolist()
        return [texts[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _state:
        _state[a_path, b_path] = Aligner(a_path, b_path)
    return _state[a_path, b_path]


def _pairs(group: str) -> tuple[int, int, list[tuple[int, int]]]:
    """Numbers of A and B tokens, and the different pairs of ids."""
    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
    return len(a), len(b), [(x, y) for x in set(a) for y in set(b)]


class Interned:
    """A task's chunks, groups and pairs, each under a number of its own."""

    def __init__(self, align: Aligner, seed: int):
        self.align, self.seed = align, seed
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.texts: list[str | None] = []  # of chunks
        self.chunk_groups: list[np.ndarray] = []
        self.numbers: dict[str, int] = {}  # of groups
        self.sizes: list[tuple[int, int]] = []
        self.group_pairs: list[np.ndarray] = []
        self.pairs: dict[tuple[int, int], int] = {}
        self.docs, self.extra = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: of groups: key, numbers of A and B tokens, of pairs
        self.known = np.zeros((0, 4), np.int64)

    def group(self, text: str) -> int:
        at = self.numbers.get(text)
        if at is None:
            at = self.numbers[text] = len(self.sizes)
            n_a, n_b, links = _pairs(text)
            self.sizes.append((n_a, n_b))
            self.group_pairs.append(np.array([self.pairs.setdefault(p, len(self.pairs)) for p in links], np.int64))
        return at

    def learn(self, chunks: list[str]) -> None:
        for s, e in chunked(chunks, 1 << 15):
            for chunk, groups in zip(chunks[s:e], self.align.groups(chunks[s:e]), strict=True):
                self.chunks[chunk] = len(self.texts)
                self.texts.append(None if groups is None else ";".join(groups))
                self.chunk_groups.append(np.array([self.group(g) for g in groups or ()], np.int64))

    def documents(self, texts: list[str | None]) -> tuple:
        """Columns of rows: n_a, n_b, n_groups, n_links, hash, and the different groups' keys and frequencies with their offsets."""
        cut_up = [WORDS.split(" " + t) if t else [] for t in texts]
        known = self.chunks
        new = {c for words in cut_up for c in words if c not in known}
        # a chunk that ends with a space, as only a text's last one may, is not put together with others
        self.learn([c for c in new if not c.endswith(" ")])
        for c in new:
            if c.endswith(" "):
                self.learn([c])
        hashed, rows, sizes = [], [], []
        for k, words in enumerate(cut_up):
            ids = [known[w] for w in words]
            own = [self.texts[i] for i in ids]
            if None in own or not ids:
                hashed.append("")
                continue
            hashed.append(hashlib.sha256(";".join(own).encode()).hexdigest())
            groups = np.concatenate([self.chunk_groups[i] for i in ids])
            rows.append(groups)
            sizes.append((k, len(groups)))
        n = len(texts)
        doc = np.repeat([k for k, _ in sizes], [c for _, c in sizes]).astype(np.int64)
        met = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        each, times = np.unique(doc << 32 | met, return_counts=True)
        doc, met = each >> 32, each & 0xFFFFFFFF
        self.number()
        keys, n_a, n_b, pairs = self.known[met].T
        total = lambda x: np.bincount(doc, times * x, n).astype(np.int64)
        self.docs = self._more(self.docs, met, np.ones(len(met), np.int64), len(self.sizes))
        # pairs that several groups of one document have
        flat = np.concatenate([self.group_pairs[g] for g in met]) if len(met) else met
        pair, over = np.unique(np.repeat(doc, pairs) << 32 | flat, return_counts=True)
        again = over > 1
        self.extra = self._more(self.extra, pair[again] & 0xFFFFFFFF, over[again] - 1, len(self.pairs))
        return total(n_a), total(n_b), total(np.ones(len(met), np.int64)), total(n_a * n_b), hashed, keys, times, np.bincount(doc, minlength=n)

    def number(self) -> None:
        """Complete ``known``."""
        at = len(self.known)
        keys = lookups.hashes_of([g.encode() for g in itertools.islice(self.numbers, at, None)], self.seed)
        sizes = np.array(self.sizes[at:], np.int64).reshape(-1, 2)
        self.known = np.concatenate([self.known, np.column_stack([keys, sizes, np.array([len(p) for p in self.group_pairs[at:]], np.int64)])])

    @staticmethod
    def _more(counts: np.ndarray, at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        found = np.bincount(at, n, size).astype(np.int64)
        found[: len(counts)] += counts
        return found


OWN = "kind int, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, ns array<int>, key long, grp string, a int, b int, n long"


def _interned(docs: DataFrame, a_path: str, b_path: str, seed: int) -> DataFrame:
    """Rows of three kinds: 0 documents, 1 a task's groups with the number of their documents, 2 pairs and how often they'd be counted too often."""
    schema = StructType([StructField("row", docs.schema["row"].dataType), *StructType.fromDDL(OWN)])
    names = [f.name for f in schema]

    def table(size: int, row_type: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "groups_sha256": pa.string(), "grp": pa.string(), "keys": pa.list_(pa.int64()), "ns": pa.list_(pa.int32()), "a": pa.int32(), "b": pa.int32(), "row": row_type}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kinds.get(c, pa.int64())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, uid, row_type = Interned(aligner(a_path, b_path), seed), TaskContext.get().partitionId() << 33, None

        def emit() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(held.docs)
            if not len(some):
                return
            groups, pairs = list(held.numbers), np.array(list(held.pairs), np.int32).reshape(-1, 2)
            yield table(len(some), row_type, kind=pa.array(np.full(len(some), 1, np.int32)), key=pa.array(held.known[some, 0]), grp=pa.array([groups[i] for i in some.tolist()]), n=pa.array(held.docs[some]))
            over = np.flatnonzero(held.extra)
            if len(over):
                yield table(len(over), row_type, kind=pa.array(np.full(len(over), 2, np.int32)), a=pa.array(pairs[over, 0]), b=pa.array(pairs[over, 1]), n=pa.array(held.extra[over]))

        for batch in batches:
            row_type = batch.column(0).type
            texts = batch.column(1).to_pylist()
            for s, e in chunked(texts, BLOCK):
                n_a, n_b, n_groups, n_links, hashed, keys, ns, counts = held.documents(texts[s:e])
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                ids = np.arange(uid, uid + e - s, dtype=np.int64)
                uid += e - s
                numbers = {name: pa.array(x) for name, x in (("uid", ids), ("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links))}
                lists = {"keys": pa.ListArray.from_arrays(offsets, pa.array(keys)), "ns": pa.ListArray.from_arrays(offsets, pa.array(ns.astype(np.int32)))}
                yield table(e - s, row_type, row=batch.column(0).slice(s, e - s), kind=pa.array(np.zeros(e - s, np.int32)), groups_sha256=pa.array(hashed, pa.string()), **numbers, **lists)
                if len(held.texts) > CHUNKS:
                    yield from emit()
                    held.clear()
        yield from emit()

    return cut(docs.mapInArrow(run, schema))


def _ids(side: int) -> Column:
    """id, times: the different ids of a side of a group."""
    each = F.split(F.split("grp", r"\|")[side], ",")
    return F.transform(F.array_distinct(each), lambda x: F.struct(x.cast("int").alias("id"), F.size(F.filter(each, lambda y: y == x)).alias("times")))


def alignment(docs: DataFrame, a_path: str, b_path: str, hot: int = lookups.HOT // 2) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document (text), beside its other columns."""
    names = [c for c in docs.columns if c.lower() not in ("text", *RESULT)]
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    seed = 0
    while True:
        rows = _interned(carried, a_path, b_path, seed)
        groups = cut(rows.where("kind = 1").groupBy("key", "grp").agg(F.sum("n").alias("n")))
        if not lookups.collide(groups, "key"):
            break
        seed += 1
    links = groups.select("key", "n", "grp", F.explode(_ids(0)).alias("a")).select("key", "n", "a", F.explode(_ids(1)).alias("b"))
    links = links.select("key", "n", F.col("a.id").alias("a"), F.col("b.id").alias("b"), (F.col("a.times") * F.col("b.times")).alias("times"))
    counted = links.select("a", "b", "n").union(rows.where("kind = 2").select("a", "b", -F.col("n")))
    counts = cut(counted.groupBy("a", "b").agg(F.sum("n").alias("count")))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    counts = counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))
    per_group = links.join(counts, ["a", "b"]).groupBy("key").agg(F.first("n").alias("n"), F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    per_group, found = cut(per_group), rows.where("kind = 0")
    most = lookups.Hot(per_group, ["n_best", "count_sum"], hot)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The frequent groups' sums; the other groups' keys and frequencies are left."""
        for batch in batches:
            keys, ns = batch.column(1), batch.column(2)
            n = batch.num_rows
            counts = np.diff(keys.offsets.to_numpy())
            row, key, times = np.repeat(np.arange(n), counts), keys.flatten().to_numpy(), ns.flatten().to_numpy()
            hit, values = most.find(key)
            sums = [np.zeros(n, np.int64) for _ in values]
            for total, value in zip(sums, values, strict=True):
                np.add.at(total, row, value * times)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=n))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], t)) for x, t in ((key, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s) for s in sums], *lists], names=["uid", "best_hot", "count_hot", "keys", "ns"])

    looked = cut(found.select("uid", "keys", "ns").mapInArrow(look, "uid long, best_hot long, count_hot long, keys array<long>, ns array<int>"))
    rest = lookups.joined_sums(looked.where(F.size("keys") > 0), per_group.where(F.col("n") < most.bound), ["n_best", "count_sum"])
    both = looked.select("uid", "best_hot", "count_hot").join(rest, "uid", "left")
    both = both.select("uid", *[(F.col(h) + F.coalesce(c, F.lit(0))).alias(c) for h, c in (("best_hot", "n_best"), ("count_hot", "count_sum"))])
    return found.drop("keys", "ns").join(both, "uid").select("row.*", *RESULT)
