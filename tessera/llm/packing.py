"""Best-fit packing (10): a configuration linear program over the length histogram.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of piece lengths, at most
``capacity`` numbers whatever the corpus, reaches the driver. There a covering program over
configurations is solved by multiplicative weights; each round prices configurations with an unbounded
knapsack. The fractional solution is rounded down and made exact: a configuration's slots take the
longest pieces left in their length class, best fit fills what room remains, and what no configuration
took is packed the same way from the longest piece down. Tasks then place every piece by its rank
among the pieces of its length.

Null texts count as empty and give the closing id alone; repeated rows are packed as rows of their own;
an empty table gives no rows. Other columns of the documents are not looked at.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut

#: Python's str.split() also splits at these four, the tokenizer doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: ASCII signs other than the apostrophe. Letters and signs after them are never joined.
SIGNS = "".join(c for c in string.punctuation if c != "'")
#: Of Latin-1, these count as letters in Python, but their case or form is changed.
NO_LETTERS = "\xaa\xb5\xba"
#: Words whose ids are remembered: some 90 MB, dropped at the end of a task.
CACHED_CHARS, CACHE_ENTRIES = 40, 400_000
_state: dict = {}


#: A character that isn't a letter, and that no word of a text has: Python splits at it.
OTHER = "\x1f"


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of texts, as little-endian 32-bit numbers.

    The tokenizer drops white space and joins nothing across it, so words are encoded one by one and
    the ids of short ones are remembered. It lowers the case, which is done for whole texts first where they are Latin-1, as
    nothing else changes there. A word of letters with signs after it is put together from these two; they
    skip the tokenizer's normaliser and splitter, which do no more there. tests/llm holds this
    against whole texts; with a tokenizer of other rules, texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.parts = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        vocabulary = self.parts.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        probe = "Über den  Fluß,### it's\n12 Ähren... "
        try:
            words = self.words(probe)
            self.by_word = self.whole(probe) == self.joined(words, self.learn(words))
        except ValueError:
            self.by_word = False

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def remember(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            found = self.tokenizer.encode_batch_fast([w.removesuffix(OTHER) for w in words[i : i + 4096]], add_special_tokens=False)
            self.known.update(zip(words[i : i + 4096], [np.asarray(e.ids, "<u4").tobytes() for e in found], strict=True))

    def remember_parts(self, parts: list[str]) -> None:
        """All in one text: each part is one word of it, and an id that ends a word ends the part."""
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            ids = np.array(self.parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            if len(cuts) != len(some) + 1:
                raise ValueError("the tokenizer marks word ends in another way")
            data = ids.tobytes()
            self.known.update(zip(some, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def words(self, text: str) -> list[str]:
        """The text's words: in lower case if the text is Latin-1, else those of ASCII alone."""
        if text.isascii() or (_is_latin(text) and not any(c in text for c in NO_LETTERS)):
            return text.lower().split()
        return [w.lower() if w.isascii() else w + OTHER for w in text.split()]

    def learn(self, words) -> dict[str, bytes]:
        """Remember the ids of short words and return those of the others. ``OTHER`` ends words that only the tokenizer itself reads rightly."""
        known, parts, pairs, rest, long = self.known, set(), [], [], {}
        for w in words:
            if w in known:
                continue
            if len(w) > CACHED_CHARS:
                long[w] = self.whole(w.removesuffix(OTHER))
            elif not (letters := w.rstrip(SIGNS)).isalpha():
                rest.append(w)
            else:
                parts.add(letters)
                if len(letters) < len(w):
                    signs = w[len(letters) :]
                    parts.add(signs)
                    pairs.append((w, letters, signs))
        self.remember_parts([p for p in parts if p not in known])
        known.update([(w, known[letters] + known[signs]) for w, letters, signs in pairs])
        self.remember(rest)
        return long

    def joined(self, words: list[str], long: dict[str, bytes]) -> bytes:
        known = self.known
        return b"".join([known[w] if w in known else long[w] for w in words] if long else map(known.__getitem__, words))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 1024):
            block = [self.words(t) if self.by_word and not any(c in t for c in NOT_SPACE) else None for t in texts[at : at + 1024]]
            here = set().union(*filter(None, block))
            if len(self.known) > CACHE_ENTRIES:  # the frequent ones are here again
                self.known = {w: self.known[w] for w in here if w in self.known}
            long = self.learn(here)
            for text, words in zip(texts[at : at + 1024], block, strict=True):
                yield self.whole(text) if words is None else self.joined(words, long)


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path](texts)


def forget(path: str) -> None:
    """Drop the words remembered, which the task's worker would else hold while it runs other operators."""
    if path in _state:
        _state[path].known = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut at ``capacity``."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            close = np.uint32(end_id).tobytes()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encode_texts(texts, tokenizer), strict=True):
                ids += close
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        forget(tokenizer)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_configuration(values: np.ndarray, units: int) -> np.ndarray:
    """Counts of each class (class c fills c + 1 units) that make most of ``units``: an unbounded knapsack."""
    most, pick = np.zeros(units + 1), np.zeros(units + 1, int)
    for room in range(1, units + 1):
        k = min(room, len(values))
        got = most[room - 1 :: -1][:k] + values[:k]
        pick[room] = got.argmax()
        most[room] = got[pick[room]]
    counts, room = np.zeros(len(values), int), units
    while room > 0 and values[pick[room]] > 0:
        counts[pick[room]] += 1
        room -= pick[room] + 1
    return counts


def configurations(histogram: dict[int, int], capacity: int, units: int = 128, rounds: int = 600, rate: float = 0.7) -> list[tuple[tuple[int, ...], int]]:
    """Classes of lengths that share a sequence and how many sequences: the rounded-down program."""
    width = -(-capacity // units)
    demand = np.zeros(units)
    for length, n in histogram.items():
        demand[(length - 1) // width] += n
    live = demand > 0
    if not live.any():
        return []
    weight = np.where(live, 1 / np.maximum(demand, 1), 0.0)
    used: dict[tuple[int, ...], float] = {}
    covered = np.zeros(units)
    for _ in range(rounds):
        counts = _best_configuration(weight, units)
        took = counts > 0
        step = (demand[took] / counts[took]).min()
        used[tuple(counts)] = used.get(tuple(counts), 0) + step
        share = np.zeros(units)
        share[took] = step * counts[took] / demand[took]
        covered += share
        weight = weight * np.exp(-rate * share)
        weight /= weight.max()
    scale = max(covered[live].mean(), 1e-9)
    plan = [(tuple(np.repeat(np.arange(units), counts)), int(x / scale)) for counts, x in used.items()]
    return sorted((p for p in plan if p[1]), key=lambda p: (-max(p[0]), -p[1], p[0]))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Exact fillings, each with its number of sequences; every piece of the histogram is in one."""
    left = np.zeros(capacity + 2, np.int64)
    for length, n in histogram.items():
        left[length] = n

    def longest(upto: int) -> int:
        """The longest length not above ``upto`` of which pieces are left, or 0."""
        there = np.flatnonzero(left[: upto + 1])
        return int(there[-1]) if len(there) else 0

    width = -(-capacity // 128)
    out: list[tuple[dict[int, int], int]] = []

    def fill(classes: tuple[int, ...], times: int) -> int:
        """Make up to ``times`` sequences, as far as one exact filling goes; the number made."""
        room, took = capacity, {}
        for c in sorted(classes, reverse=True):
            got = longest(min((c + 1) * width, room))
            if got > c * width:
                took[got] = took.get(got, 0) + 1
                left[got] -= 1
                room -= got
        if not took:
            return -1
        while got := longest(room):
            took[got] = took.get(got, 0) + 1
            left[got] -= 1
            room -= got
        for length, n in took.items():
            left[length] += n
        made = min(times, *(int(left[length]) // n for length, n in took.items()))
        for length, n in took.items():
            left[length] -= made * n
        out.append((took, made))
        return made

    for classes, times in configurations(histogram, capacity):
        while times > 0 and (made := fill(classes, times)) > 0:
            times -= made
    while top := longest(capacity):
        fill(((top - 1) // width,), 1 << 60)
    return out


def pack(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of pieces, which need a ``length`` of 1 to ``capacity``.

    ``found`` is read more than once: pass a materialised frame.
    """
    spark = found.sparkSession
    rows = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    slots, base = [], 0
    taken: dict[int, int] = {}
    for lengths, times in plan({r["length"]: r["count"] for r in rows}, capacity):
        offset = 0
        for length, n in sorted(lengths.items(), reverse=True):
            first = taken.get(length, 0)
            slots.append((length, first, base, n, offset))
            taken[length] = first + times * n
            offset += length * n
        base += times
    slots.sort()
    lookup = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 5))  # bounded by the histogram

    # rank among the pieces of a length, salted: first within a salt, then over the salts' counts
    salts = max(1, sum(r["count"] for r in rows) // 20_000)
    fields = [c for c in found.columns]
    salted = found.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece", "ids_crc32") if c in fields] or ["length"]), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").count()
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__salt").orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in fields] or ["length"])
    ranked = salted.withColumn("__rank", F.row_number().over(own) - 1).join(counts, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__salt", "__before")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        s = lookup.value
        rank, length = rank.to_numpy(np.int64), length.to_numpy(np.int64)
        keys = s[:, 0] * (1 << 48) + s[:, 1]
        at = s[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
        far = rank - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 2] + far // at[:, 3], "offset": at[:, 4] + far % at[:, 3] * length})

    return ranked.withColumn("__at", place("length", "__rank")).select(*fields, "__at.sequence_id", "__at.offset")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document."""
    return pack(cut(pieces(docs, tokenizer, capacity, end_id)), capacity)
