"""Line dedup (4): a segment-partition edit join.

A line (stripped) is a copy if an equal line stands earlier, or an earlier line is within the edits that the
longer one's length allows: those of its band (``BANDS``), or ``percent`` in 100 of its characters where these are more (none by default);
earlier is by document id (nulls last), row key and line number. Lines under the first band are copies only if equal.
With ``edits`` given, there is one band, from ``min_chars`` on, and no share. In the band
of e edits, a line is split into e + 1 even segments; of two lines within the threshold, the longer holds a segment
of the shorter near its own place. Each line is filed under the hashes of its segments and looks for those of lines of
its length and up to e shorter, at the places that the length difference leaves open; a line up to e shorter than a
band is filed there as well. No pair within a band's edits is missed.

Segments for a share of the length would need keys by the cube of the edits. Such lines are filed under ``BINS`` strings
of ``GRAM`` characters besides: a line's strings are dealt to bins by their hashes, and each bin's smallest hash is a key,
together with the string's place and the line's length on grids that are shifted from bin to bin. The keys don't grow
with the edits; a pair with more edits than its band's is missed now and then (tests measure how often), never made up.

Hashes that two lines share bring
their texts together, where banded bit-parallel edit distance decides; a very common key's lines are
compared tile by tile.

White lines are kept and never copies. Null texts stay null. Repeated rows are decided alike: the first
place of a line is kept in each of them. Other columns are kept, whatever their names; one called ``lines_removed`` is
replaced. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import SpanHash, chunked, cut, mix, parts_for, row_key, tiled


#: (characters from which it holds, edits)
BANDS = ((16, 1), (32, 2), (256, 3))
GRAM, BINS = 12, 12
#: cells of the grids: parts of a line, and the ratio of two lengths
PARTS, RATIO = 4, 1.25


def allowed(size: int, bands: tuple[tuple[int, int], ...] = BANDS, percent: int = 0) -> int:
    """Edits within which a line is a copy of one of ``size`` characters, the longer of the two."""
    return max((e for least, e in (*bands, (bands[0][0], size * percent // 100)) if size >= least), default=0)


def within(a: str, b: str, edits: int) -> bool:
    """Is the edit distance at most ``edits``? Equal ends are set aside; the rest runs in a band of bits."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return False
    lo, n = 0, len(b)
    step = n
    while step and lo < n:  # the common prefix, by halving
        if a[lo : lo + step] == b[lo : lo + step]:
            lo += min(step, n - lo)
        else:
            step //= 2
    a, b = a[lo:], b[lo:]
    end, n = 0, len(b)
    step = n
    while step and end < n:
        if a[len(a) - end - step if len(a) > end + step else 0 : len(a) - end] == b[max(0, n - end - step) : n - end]:
            end += min(step, n - end)
        else:
            step //= 2
    a, b = a[: len(a) - end], b[: n - end]
    if not b:
        return len(a) <= edits
    return banded(a, b, edits) <= edits


def banded(a: str, b: str, edits: int) -> int:
    """Edit distance of a and the shorter b if it is at most ``edits``, else more than ``edits``.

    One word holds the vertical differences of a column within the band; it moves down a row each column.
    The value followed is that of the band's lowest cell, then of the last row.
    """
    word = max(64, 2 * edits + 2)
    mask, band = (1 << word) - 1, ((1 << (2 * edits + 1)) - 1) << (word - 1 - 2 * edits)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    plus, minus = (mask << (word - edits - 1)) & mask, 0
    distance, top, most = edits, 1 << (word - 1), 3 * edits + 1
    row = 1 << (word - 2)
    for i, c in enumerate(b):
        move = word - 1 - i - edits
        equal = places.get(c, 0)
        equal = (equal << move if move > 0 else equal >> -move) & band
        zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
        up, down = (minus | ~(zero | plus)) & mask, zero & plus
        if i + edits < len(a):
            distance += not zero & top
            if distance > most:
                return distance
        else:
            distance += bool(up & row) - bool(down & row)
            row >>= 1
        plus, minus = (down | ~((zero >> 1) | up)) & mask, (zero >> 1) & up
    return distance


def segments(length: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of the lengths; the last segments take what doesn't divide."""
    size, rest = length // (edits + 1), length % (edits + 1)
    longer = np.maximum(0, i - (edits + 1 - rest))
    return i * size + longer, size + (i >= edits + 1 - rest)


def line_keys(hashes: SpanHash, start: np.ndarray, size: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, key, filed) of the lines that start there: hashes of segments filed under, and of those looked for."""
    number = np.arange(len(size))
    out: list[tuple] = []
    for short in range(edits + 1):
        length = size - short
        for i in range(edits + 1):
            at, width = segments(length, edits, i)
            name = mix((length * (edits + 1) + i).astype(np.uint64) + np.uint64(1))
            for move in range(max(-i, short - (edits - i)), min(i, short + (edits - i)) + 1):
                fits = (at + move >= 0) & (at + move + width <= size) & (length > edits)
                s = (start + at + move)[fits]
                key = mix(hashes.raw(s, s + width[fits]) ^ name[fits])
                out.append((number[fits], key.view(np.int64), np.full(len(s), short == 0 and move == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gram_keys(hashes: SpanHash, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As line_keys, all filed: each bin's smallest string, with its place and the line's length on the bin's grids.

    The strings of all lines of the buffer are hashed in one go; of those, each line's own are looked at.
    """
    grams = hashes.sums[GRAM:] - hashes.sums[:-GRAM]
    grams *= hashes.down[: len(grams)]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xFF51AFD7ED558CCD)
    bins = ((grams & np.uint64(0xFFFFFFFF)) * np.uint64(BINS) >> np.uint64(32)).view(np.int64)
    spans = np.zeros(len(grams) + 1, np.int64)  # a line's number + 1 where its strings start, its negative behind the last
    number = np.arange(1, len(size) + 1)
    np.add.at(spans, start, number)
    np.add.at(spans, start + size - GRAM + 1, -number)
    slot = np.cumsum(spans[:-1])
    slot *= BINS
    slot += bins  # those of no line come first
    least = np.full((len(size) + 1) * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, grams)
    first = np.flatnonzero(grams == least[slot])
    slot, one = np.unique(slot[first], return_index=True)
    one, slot = one[slot >= BINS], slot[slot >= BINS] - BINS
    first = first[one]
    line, bin_ = slot // BINS, slot % BINS
    part = np.floor((first - start[line]) * PARTS / size[line] + bin_ * 0.618 % 1)
    length = np.floor(np.log(size[line]) / np.log(RATIO) + bin_ * 0.414 % 1)
    name = mix((length * (PARTS + 1) + part).astype(np.uint64) * np.uint64(BINS) + bin_.astype(np.uint64) + np.uint64(1))
    return line, mix(grams[first] ^ ~name).view(np.int64), np.ones(len(line), bool)


def band_keys(lines: list[str], bands: tuple[tuple[int, int], ...] = BANDS, percent: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As line_keys, each line in its band and in the next ones that a longer partner may be of; those of gram_keys where
    the share allows more, for a line or for a longer partner."""
    values = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = SpanHash(mix(values + np.uint64(1)))
    size = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(size) - size
    out: list[tuple] = []
    for k, (least, edits) in enumerate(bands):
        most = bands[k + 1][0] if k + 1 < len(bands) else np.inf
        at = np.flatnonzero((size >= max(bands[0][0], least - edits)) & (size < most))
        if len(at):
            number, key, filed = line_keys(hashes, start[at], size[at], edits)
            out.append((at[number], key, filed))
    longest = size * 100 // max(1, 100 - percent) + 1
    at = np.flatnonzero((size >= max(GRAM, bands[0][0])) & (allowances(longest, bands, percent) > allowances(longest, bands, 0)))
    if len(at):
        number, key, filed = gram_keys(hashes, start[at], size[at])
        out.append((at[number], key, filed))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


def allowances(size: np.ndarray, bands: tuple[tuple[int, int], ...], percent: int) -> np.ndarray:
    """``allowed`` for many sizes."""
    edits = np.where(size >= bands[0][0], size * percent // 100, 0)
    for least, e in bands:
        edits[size >= least] = np.maximum(edits[size >= least], e)
    return edits


def line_hash(line: str) -> bytes:
    return xxhash.xxh128_digest(line.encode("utf-8", "replace"))


def short_hashes(hashes: list[bytes]) -> pa.Array:
    """Half of each, as a whole number."""
    return pa.array(np.frombuffer(b"".join(hashes), np.int64)[::2])


def buckets_of(rows: pa.Table, number: np.ndarray) -> Iterator[np.ndarray]:
    """The different numbers of the lines of each key and tile, in order."""
    keys = [rows[k].to_numpy() for k in ("key", "tile_i", "tile_j")]
    order = np.lexsort((number, *keys))
    number, keys = number[order], [k[order] for k in keys]
    if len(number):
        new = np.any([np.diff(k, prepend=k[0]) != 0 for k in keys], axis=0)
        fresh = new | (np.diff(number, prepend=-1) != 0)
        yield from np.split(number[fresh], np.flatnonzero(new[fresh]))


def close_lines(lines: list[str], buckets: Iterable[np.ndarray], bands: tuple[tuple[int, int], ...], percent: int) -> list[int]:
    """Numbers of the lines that are copies of one with a smaller number of a bucket that they share.

    Pairs are met once, and ruled out by their lengths and by numbers of characters (an edit changes two of them at
    most) before any distance is computed.
    """
    size = np.array([len(x) for x in lines], np.int64)
    edits = allowances(size, bands, percent)
    counts = np.zeros((len(lines), 32), np.int32)
    for at, stop in chunked(lines):
        letters = np.frombuffer("".join(lines[at:stop]).encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(31)
        owner = np.repeat(np.arange(stop - at) * 32, size[at:stop])
        counts[at:stop] = np.bincount(owner + letters, minlength=32 * (stop - at)).reshape(-1, 32)
    met: set[int] = set()
    copies: set[int] = set()

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            most = edits[np.where(size[i] > size[j], i, j)]
            near = np.flatnonzero((np.abs(size[i] - size[j]) <= most) & (np.minimum(size[i], size[j]) >= bands[0][0]))
            i, j, most = i[near], j[near], most[near]
            near = np.flatnonzero(np.abs(counts[i] - counts[j]).sum(1) <= 2 * most)
            for x, y, e in zip(i[near].tolist(), j[near].tolist(), most[near].tolist(), strict=True):
                if y not in copies and (pair := x * len(lines) + y) not in met:
                    if within(lines[x], lines[y], e):
                        copies.add(y)
                    elif len(met) < 1 << 20:
                        met.add(pair)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for bucket in buckets:
        if len(bucket) <= 64:
            i, j = np.triu_indices(len(bucket), 1)
            held.append((bucket[i], bucket[j]))
            n += len(i)
        else:
            for k, line in enumerate(bucket[:-1].tolist()):
                compare(np.full(len(bucket) - k - 1, line), bucket[k + 1 :])
        if n > 1 << 16:
            compare(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        compare(*map(np.concatenate, zip(*held, strict=True)))
    return sorted(copies)


def _split(text: str | None) -> list[str]:
    return [x.strip() for x in text.split("\n")] if text else []


def line_copies(docs: DataFrame, edits: int | None = None, min_chars: int = 64, percent: int = 0, tile: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """__rkey, gone (numbers of the document's lines that are copies): a row for each document that has some.

    docs: the id, __rkey and __text among others.

    """
    base = docs
    bands, percent = (BANDS, percent) if edits is None else (((min_chars, edits),), 0)

    def occur(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for doc, rkey, text in zip(*(batch.column(k).to_pylist() for k in (id_col, "__rkey", "__text")), strict=True):
                for n, line in enumerate(_split(text)):
                    if line:
                        for c, v in zip(cols, (doc, rkey, n, line_hash(line)), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)), short_hashes(cols[3])], names=["id", "rkey", "n", "line", "own"])

    def keyed(batches):
        for batch in batches:
            lines = list({x for text in batch.column("__text").to_pylist() for x in _split(text) if len(x) >= bands[0][0]})
            for at, stop in chunked(lines):
                number, key, filed = band_keys(lines[at:stop], bands, percent)
                own = short_hashes([line_hash(x) for x in lines[at:stop]]).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[number]), pa.array(filed)], names=["key", "own", "filed"])

    few = base.select(id_col, "__rkey", "__text")
    places = few.mapInArrow(occur, "id long, rkey binary, n int, line binary, own long")
    order = F.struct(F.col("id").isNull(), "id", "rkey", "n")
    firsts = cut(places.groupBy("line", "own").agg(F.min(order).alias("first"), F.count("*").alias("times")))

    # a key's rows are hashes of lines alone; the first place of each line is looked up for those that share a key
    keys = few.mapInArrow(keyed, "key long, own long, filed boolean").repartition("key")
    of_key = Window.partitionBy("key")
    shared = (F.min("own").over(of_key) != F.max("own").over(of_key)) & F.max("filed").over(of_key)
    shared = cut(keys.withColumn("shared", shared).where("shared").select("key", "own").distinct())
    found = tiled(shared, ["key"], "own", tile).join(firsts.select("own", "first.rkey", "first.n"), "own")
    wanted = cut(found.groupBy(F.col("rkey").alias("__rkey")).agg(F.collect_list(F.struct("key", "n", "tile_i", "tile_j")).alias("wanted")))
    groups = parts_for(wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0, 10_000)

    def fetch(batches):
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("key", "tile_i", "tile_j", "id", "rkey", "n", "text")}
            for doc, rkey, text, wanted in zip(*(batch.column(k).to_pylist() for k in (id_col, "__rkey", "__text", "wanted")), strict=True):
                lines = _split(text)
                for w in wanted:
                    for k, v in (("key", w["key"]), ("tile_i", w["tile_i"]), ("tile_j", w["tile_j"]), ("id", doc), ("rkey", rkey), ("n", w["n"]), ("text", lines[w["n"]])):
                        cols[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.string()), strict=True)], names=list(cols))

    met = base.join(wanted, "__rkey").mapInArrow(fetch, "key long, tile_i int, tile_j int, id long, rkey binary, n int, text string")
    met = met.withColumn("grp", F.pmod(F.xxhash64("key", "tile_i", "tile_j"), F.lit(groups)))

    def compare(rows: pa.Table) -> pa.Table:
        texts, number = np.unique(np.array(rows["text"].to_pylist(), object), return_inverse=True)
        places = list(zip(*(rows[k].to_pylist() for k in ("id", "rkey", "n")), strict=True))
        first: list = [None] * len(texts)
        for k, (doc, rkey, n) in zip(number.tolist(), places, strict=True):
            place = doc is None, doc or 0, rkey, n
            if first[k] is None or place < first[k]:
                first[k] = place
        rank = np.empty(len(texts), np.int64)
        rank[sorted(range(len(texts)), key=first.__getitem__)] = np.arange(len(texts))
        texts = texts[np.argsort(rank)]  # from here on a line's number is its place in the order
        copies = close_lines(texts.tolist(), buckets_of(rows, rank[number]), bands, percent)
        return pa.table({"line": pa.array([line_hash(texts[k]) for k in copies], pa.binary())})

    near = met.groupBy("grp").applyInArrow(compare, "line binary").distinct().withColumn("near", F.lit(True))
    firsts = firsts.join(near, "line", "left").where("times > 1 or near")
    gone = places.select("rkey", "n", "line").join(firsts.select("line", "first", "near"), "line")
    gone = gone.where(F.coalesce("near", F.lit(False)) | (F.col("rkey") != F.col("first.rkey")) | (F.col("n") != F.col("first.n")))
    return gone.groupBy(F.col("rkey").alias("__rkey")).agg(F.collect_set("n").alias("__gone"))


def line_dedup(docs: DataFrame, edits: int | None = None, min_chars: int = 64, percent: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with copies taken out of the text, and ``lines_removed``."""
    # by position, so that no name clashes; the same columns go to both joins by row key, so that Spark deals the texts out once
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, own_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = docs.toDF(*names).withColumn("__rkey", row_key(own_id, own_text)).withColumnRenamed(own_text, "__text")
    copies = line_copies(rows, edits, min_chars, percent, id_col=own_id)

    @F.pandas_udf("string")
    def rest(texts, gone):
        import pandas as pd

        out = []
        for t, g in zip(texts, gone, strict=True):
            if t is None or g is None:
                out.append(t)
            else:
                g = set(g.tolist())
                out.append("\n".join(x for n, x in enumerate(t.split("\n")) if n not in g))
        return pd.Series(out, dtype=object)

    # not deterministic, as Spark has it: a condition on the text then doesn't have it made twice
    rows = rows.join(copies, "__rkey", "left").withColumn("__left", rest.asNondeterministic()("__text", "__gone")).withColumn("lines_removed", F.coalesce(F.size("__gone"), F.lit(0)))
    return rows.select(*[F.col("__left" if c == text_col else n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != "lines_removed"], "lines_removed")
