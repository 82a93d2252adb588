"""Suffix-array dedup (8): repeated substrings of ``length`` bytes, through longest-previous-factor arrays.

Every window of ``length`` bytes holds an anchor: the ``gram``-byte string with the smallest hash among the
window's. Equal windows have equal anchors at equal places, so the windows around an anchor need only be
compared with those around the same anchor. Anchors whose whole surroundings (all windows that hold them)
are equal are counted alone. Where an anchor has different surroundings, one of each
kind is brought together; a suffix array of these texts, its LCP array and previous and next smaller
positions in suffix order give each position's longest previous factor: a window that also starts earlier.
A very common anchor's surroundings are compared tile by tile.

``keep="none"`` removes all bytes of repeated windows; ``keep="first"`` removes later copies only, in the order
of the documents' row keys and of places in them. Texts are UTF-8; null counts as empty; texts shorter
than ``length`` stay whole. Repeated rows are documents of their own, so ``none`` removes them. Other columns of the
documents are not looked at; an empty table gives no rows.

Pieces that meet are first cut down to the bytes of windows whose hashes stand twice among them; the suffix array, which
decides, is made of these alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import BYTE_VALUES, SpanHash, chunked, cut, mix, parts_for, row_key, tiled

LEVELS = (8, 16, 32, 64, 128)


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` neighbours, by doubling; shorter by width - 1."""
    have = 1
    while 2 * have <= width:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def anchors_of(texts: list[str | None], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, place, hash of the gram, hash of the surroundings) of the texts' anchors."""
    out = []
    width = length - gram + 1
    for a, b in chunked(texts):
        raw = [(t or "").encode("utf-8", "replace") for t in texts[a:b]]
        ends = np.cumsum([len(r) for r in raw])
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        if len(buffer) < length:
            continue
        starts = ends - [len(r) for r in raw]
        hashes = SpanHash(BYTE_VALUES[buffer])
        at = np.arange(len(buffer) - gram + 1)
        values = hashes(at, at + gram) | np.uint64(1)
        least = _sliding(values, width, np.minimum)
        fits = np.zeros(len(least) + 1, np.int32)  # windows that lie in one text
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s >= length:
                fits[s] += 1
                fits[e - length + 1] -= 1
        least[np.cumsum(fits[:-1]) == 0] = 0
        most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        place = np.flatnonzero(most == values)
        text = np.searchsorted(ends, place, "right")
        low = np.maximum(starts[text], place - (width - 1))
        high = np.minimum(ends[text], place + length)
        around = mix(hashes.raw(low, high) ^ mix((place - low).astype(np.uint64) * np.uint64(1 << 20) + (high - place).astype(np.uint64)))
        out.append((text + a, place - starts[text], values[place].view(np.int64), around.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def suffix_ranks(data: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 8, 16, ... 256 bytes (prefix doubling)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(len(data), np.uint64)
    for k in range(8):
        first |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    ranks = [np.unique(first, return_inverse=True)[1].astype(np.uint32)]
    for step in LEVELS:
        r = ranks[-1].astype(np.uint64)
        after = np.zeros(len(r), np.uint64)
        after[: len(r) - step] = r[step:] + np.uint64(1)
        ranks.append(np.unique((r << np.uint64(32)) | after, return_inverse=True)[1].astype(np.uint32))
    return ranks


def _nearest_smaller(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order: the nearest one before it that starts earlier (or -1), and the LCP with it.

    lcp[i] is that of suffixes i - 1 and i. Pointers jump over what starts later.
    """
    near, common = np.arange(len(place)) - 1, lcp.copy()
    live = np.arange(1, len(place))
    while len(live):
        live = live[(near[live] >= 0) & (place[near[live]] > place[live])]
        over = near[live]
        low, further = np.minimum(common[live], common[over]), near[over]
        common[live], near[live] = low, further
    common[near < 0] = 0
    return near, common


def longest_previous_factor(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, factors, sources): suffixes with an earlier match of ``least`` (at most 256) bytes and more, and where.

    Factors count up to 256 bytes. Byte 255, which UTF-8 never has, ends a text: no factor runs over it.
    """
    n = len(data)
    ranks = suffix_ranks(data)
    order = np.argsort(ranks[-1], kind="stable")
    left, right = order[:-1], order[1:]
    lcp = np.zeros(max(0, n - 1), np.int64)
    whole = ranks[-1][left] == ranks[-1][right]
    for step, rank in zip((128, 64, 32, 16, 8), ranks[-2::-1], strict=True):
        i, j = np.minimum(left + lcp, n - 1), np.minimum(right + lcp, n - 1)
        lcp += step * ((rank[i] == rank[j]) & (right + lcp < n) & (left + lcp < n))
    for _ in range(8):
        i, j = np.minimum(left + lcp, n - 1), np.minimum(right + lcp, n - 1)
        lcp += (data[i] == data[j]) & (right + lcp < n) & (left + lcp < n)
    lcp[whole] = 256
    stops = np.flatnonzero(data == 255)
    room = np.append(stops, n)[np.searchsorted(stops, order)] - order
    lcp = np.minimum(lcp, np.minimum(room[:-1], room[1:]))
    lcp[lcp < least] = 0
    some = np.zeros(n, bool)
    some[:-1] |= lcp > 0
    some[1:] |= lcp > 0
    kept = np.flatnonzero(some)
    order, lcp = order[kept], np.concatenate([[0], lcp])[kept]
    before, a = _nearest_smaller(order, lcp)
    after, b = _nearest_smaller(order[::-1], np.concatenate([[0], lcp[:0:-1]]) if len(lcp) else lcp)
    after, b = len(order) - 1 - after[::-1], b[::-1]
    factor = np.maximum(a, b)
    source = np.where(a >= b, before, np.minimum(after, len(order) - 1))
    found = factor >= least
    return order[found], factor[found], order[source[found]]


def _shared_runs(data: np.ndarray, least: int) -> np.ndarray:
    """Places of the bytes in which every window of ``least`` bytes that stands twice lies, and 256 from its start, run by run.

    Windows are told apart by hashes: a collision only keeps too much. -1 stands between runs; 255 in the data is a text's end.
    """
    n = len(data)
    if n < least:
        return np.empty(0, np.int64)
    stops = np.append(np.flatnonzero(data == 255), n)
    clear = np.ones(n - least + 1, np.int32)
    clear[np.cumsum(data == 255)[least - 1 :] != np.cumsum(data == 255)[: n - least + 1] - (data[: n - least + 1] == 255)] = 0
    start = np.flatnonzero(clear)
    window = SpanHash(BYTE_VALUES[data]).raw(start, start + least)
    order = np.argsort(window)
    again = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(start), bool)
    twice[order[1:][again]] = twice[order[:-1][again]] = True
    start = start[twice]
    if not len(start):
        return np.empty(0, np.int64)
    stop = np.minimum(start + 256, stops[np.searchsorted(stops, start)])
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, stop, -1)
    kept = np.flatnonzero(np.cumsum(depth[:n]) > 0)
    cuts = np.flatnonzero(np.diff(kept) > 1) + 1
    return np.append(np.insert(kept, cuts, -1), -1)


def _repeats(rows: list[tuple[bytes, int, bytes]], length: int, later_only: bool) -> list[tuple[bytes, int]]:
    """(document, place) of the windows that repeat, among pieces (document, start, bytes) of documents."""
    rows = sorted(set(rows))
    buffers, docs, starts = [], [], []
    for doc, start, data in rows:
        if docs and docs[-1] == doc and start <= starts[-1] + len(buffers[-1]):
            have = starts[-1] + len(buffers[-1]) - start
            buffers[-1] += data[have:]
        else:
            docs.append(doc)
            starts.append(start)
            buffers.append(bytearray(data))
    joined = np.frombuffer(b"\xff".join(bytes(b) for b in buffers) + b"\xff", np.uint8)
    begin = np.cumsum([0, *(len(b) + 1 for b in buffers[:-1])])
    at = _shared_runs(joined, length)  # the suffix array is made of these bytes only
    if not len(at):
        return []
    place, _, source = longest_previous_factor(np.where(at < 0, np.uint8(255), joined[at]), length)
    if not later_only:
        place = np.union1d(place, source)
    place = at[place]
    piece = np.searchsorted(begin, place, "right") - 1
    return list(zip([docs[k] for k in piece.tolist()], (place - begin[piece] + np.array(starts, np.int64)[piece]).tolist(), strict=True))


def substring_dedup(docs: DataFrame, length: int = 200, gram: int = 32, keep: str = "none", tile: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the text that is left (undecodable bytes dropped)."""
    if not gram < length <= 256 or keep not in ("none", "first"):
        raise ValueError("gram < length <= 256, keep is none or first")
    base = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rkey"), F.col(text_col).alias("text"))
    reach = length - gram

    def mark(batches):
        for batch in batches:
            text, place, gram_hash, around = anchors_of(batch.column("text").to_pylist(), length, gram)
            # equal anchors of a batch are one row already, in which those of repeated rows stand once
            keys, rank = np.unique(np.array(batch.column("rkey").to_pylist(), object), return_inverse=True)
            text = rank[text]
            order = np.lexsort((place, text, around, gram_hash))
            gram_hash, around, text, place = gram_hash[order], around[order], text[order], place[order]
            if not len(order):
                continue
            kind = np.r_[True, (gram_hash[1:] != gram_hash[:-1]) | (around[1:] != around[:-1])]
            one = kind | np.r_[True, (text[1:] != text[:-1]) | (place[1:] != place[:-1])]
            first = np.flatnonzero(kind)
            offsets = pa.array(np.append(0, np.cumsum(one))[np.append(first, len(order))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(keys.tolist(), pa.binary()).take(pa.array(text[one])), pa.array(place[one].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(gram_hash[first]), pa.array(around[first]), pa.array(np.diff(np.append(first, len(order)))), *lists], names=["gram", "around", "times", "rkeys", "places"])

    anchors = base.where(F.octet_length("text") >= length).mapInArrow(mark, "gram long, around long, times long, rkeys array<binary>, places array<int>").repartition("gram")
    kind, own = Window.partitionBy("gram", "around"), Window.partitionBy("gram")
    first = F.struct(F.element_at("rkeys", 1).alias("rkey"), F.element_at("places", 1).alias("place"))
    anchors = anchors.withColumn("n", F.sum("times").over(kind)).withColumn("first", F.min(first).over(kind))
    anchors = anchors.withColumn("mixed", F.min("around").over(own) != F.max("around").over(own)).where("n > 1 or mixed")
    anchors = cut(anchors.select("gram", "rkeys", "places", (F.col("n") > 1).alias("again"), "mixed", (F.col("first") == first).alias("leads"), *["first"] * (keep == "first")))
    each = anchors.where("again").select(*["first"] * (keep == "first"), F.explode(F.arrays_zip("rkeys", "places")).alias("x")).select(*["first"] * (keep == "first"), F.col("x.rkeys").alias("rkey"), F.col("x.places").alias("place"))
    if keep == "first":
        each = each.where(F.struct("rkey", "place") != F.col("first"))
    whole = each.select("rkey", (F.col("place") - reach).alias("start"), (F.col("place") + length).alias("stop"))

    sent = cut(anchors.where("mixed and leads").select("gram", F.element_at("rkeys", 1).alias("rkey"), F.element_at("places", 1).alias("place")).distinct())
    sent = cut(tiled(sent, ["gram"], "rkey", tile).groupBy("rkey").agg(F.collect_list(F.struct("gram", "place", "tile_i", "tile_j")).alias("sent")))
    n_sent = sent.agg(F.sum(F.size("sent"))).first()[0] or 0
    groups = parts_for(n_sent, 4_000)

    def send(batches):
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("gram", "tile_i", "tile_j", "rkey", "start", "bytes")}
            for rkey, text, wanted in zip(*(batch.column(k).to_pylist() for k in ("rkey", "text", "sent")), strict=True):
                data = text.encode("utf-8", "replace")
                for w in wanted:
                    low = max(0, w["place"] - reach)
                    for k, v in (("gram", w["gram"]), ("tile_i", w["tile_i"]), ("tile_j", w["tile_j"]), ("rkey", rkey), ("start", low), ("bytes", data[low : w["place"] + length])):
                        cols[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in (("gram", pa.int64()), ("tile_i", pa.int32()), ("tile_j", pa.int32()), ("rkey", pa.binary()), ("start", pa.int32()), ("bytes", pa.binary()))], names=list(cols))

    around = base.join(sent, "rkey").mapInArrow(send, "gram long, tile_i int, tile_j int, rkey binary, start int, bytes binary")
    around = around.withColumn("grp", F.pmod(F.xxhash64("gram", "tile_i", "tile_j"), F.lit(groups)))

    def compare(rows: pa.Table) -> pa.Table:
        mark = mix(rows["gram"].to_numpy().view(np.uint64) + (rows["tile_i"].to_numpy().astype(np.uint64) << np.uint64(20)) + rows["tile_j"].to_numpy().astype(np.uint64))
        order = np.argsort(mark, kind="stable")
        docs_, starts, data = rows["rkey"].to_pylist(), rows["start"].to_pylist(), rows["bytes"].to_pylist()
        found: set[tuple[bytes, int]] = set()
        part: list = []
        for x, ends in zip(order.tolist(), np.append(np.diff(mark[order]) != 0, True).tolist(), strict=True):
            part.append((docs_[x], starts[x], data[x]))
            if ends and len(part) > 2500:  # whole anchors, about a megabyte
                found.update(_repeats(part, length, keep == "first"))
                part = []
        if part:
            found.update(_repeats(part, length, keep == "first"))
        runs: list[tuple[bytes, int, int]] = []
        for doc, at in sorted(found):
            if runs and runs[-1][0] == doc and at <= runs[-1][2]:
                runs[-1] = doc, runs[-1][1], at + length
            else:
                runs.append((doc, at, at + length))
        return pa.table({"rkey": pa.array([r[0] for r in runs], pa.binary()), "start": pa.array([r[1] for r in runs], pa.int32()), "stop": pa.array([r[2] for r in runs], pa.int32())})

    parts = around.groupBy("grp").applyInArrow(compare, "rkey binary, start int, stop int")
    covers = whole.union(parts).groupBy("rkey").agg(F.collect_set(F.struct("start", "stop")).alias("covers"))

    def finish(batches):
        for batch in batches:
            rows: list[tuple] = []
            lists = batch.column("covers")
            for i, (doc, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                data = (text or "").encode("utf-8", "replace")
                n = len(data)
                if (cover := lists[i].values) is None or not len(cover):
                    rows.append((doc, n, 0, 0, hashlib.sha256(data).hexdigest(), text))
                    continue
                depth = np.zeros(n + 1, np.int32)
                np.add.at(depth, np.maximum(cover.field("start").to_numpy(), 0), 1)
                np.add.at(depth, np.minimum(cover.field("stop").to_numpy(), n), -1)
                gone = np.cumsum(depth[:n]) > 0
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((doc, n, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1).sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: 6 if with_text else 5], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=False)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 6 if with_text else 5])

    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return base.join(covers, "rkey", "left").mapInArrow(finish, schema)
