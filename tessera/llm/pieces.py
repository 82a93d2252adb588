"""SentencePiece encoding and decoding (5): N-best segmentation over the piece lattice.

A forward Viterbi pass gives the best score of every prefix; these are exact heuristics for an A* search
that runs backward from the end, so that segmentations come out best first. Pieces never run over a word
boundary, so words are segmented one by one (short ones are remembered), and a text's N best are the N best
ways to combine its words'. Pieces and their scores are those of a given model file; characters
that no piece has fall back to the model's byte pieces, at a penalty.

The lattice search takes any additive scores. Those of the model file at hand are negated merge ranks, not log-probabilities,
so the best segmentation is the one of the least sum of ranks; it is that of the file's own merge order for about half of
the different words (6,092 of 11,563 in one sample). Tokenizers aren't trained here, so they are taken as they are.

White space is kept: a space becomes the model's space mark, one is put before the text, and decoding turns them
back. (The space mark itself, U+2581, counts as a space.) A null text has null ids; an empty one has none.
Repeated rows are encoded one by one. Ties go to the segmentation whose last pieces are longer. Other columns of the
rows are kept; one of the name that a function adds is replaced.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import operator
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import chunked

SPACE = "▁"
#: Words whose segmentations are remembered: some 80 MB, dropped at the end of a task.
CACHED_CHARS, CACHE_ENTRIES = 40, 200_000
PENALTY = 10.0
NEVER = float("-inf")
_models: dict = {}


class PieceModel:
    """Pieces with ids and scores; words' segmentations, best first. Ids are bytes: little-endian 32-bit numbers."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        as_bytes = [np.array([i], "<u4").tobytes() for i in ids]
        plain = {m.id_to_piece(i): i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        scores = {p: float(m.get_score(i)) for p, i in plain.items()}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): as_bytes[i] for i in ids if m.is_byte(i)}
        self.fallback = min(s for s in scores.values() if s > -1e8) - PENALTY
        self.unknown = as_bytes[m.unk_id()]
        self.spelled = [b""] * len(ids)
        for p, i in plain.items():
            self.spelled[i] = p.replace(SPACE, " ").encode()
        for i in ids:
            if m.is_byte(i):
                self.spelled[i] = bytes([int(m.id_to_piece(i)[3:5], 16)])
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece runs over a word boundary")
        self.pieces = {p: (as_bytes[i], scores[p]) for p, i in plain.items()}
        self.alone = frozenset(p for p in plain if len(p) == 1)
        self.matches, self.longer = ahocorasick.Automaton(), ahocorasick.Automaton()
        #: by code point: the piece that is this one character, or its byte's
        self.single = np.zeros(0x110000, np.int32)
        for p, i in plain.items():
            self.matches.add_word(p, i)
            if len(p) > 1:
                self.longer.add_word(p, i)
            else:
                self.single[ord(p)] = i
        self.matches.make_automaton()
        self.longer.make_automaton()
        self.edge = {i: (len(p), scores[p], as_bytes[i]) for p, i in plain.items()}
        self.length, self.score = np.zeros(len(ids), np.int32), np.zeros(len(ids))
        for i, (length, score, _) in self.edge.items():
            self.length[i], self.score[i] = length, score
        self.simple = set(self.alone)
        for i in ids:
            if m.is_byte(i) and (code := int(m.id_to_piece(i)[3:5], 16)) < 128 and chr(code) not in self.alone:
                self.single[code], self.length[i], self.score[i] = i, 1, self.fallback
                self.simple.add(chr(code))
        self.known: dict[int, dict[str, tuple]] = {}
        #: words' places in the table of what ``two_best`` gives
        self.pairs: dict[str, int] = {}
        self.table: tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]] = np.zeros(0), np.zeros(0), [], []

    def n_best(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """(score, ids) of up to n segmentations, best first."""
        size = len(word)
        best = [0.0] + [NEVER] * size
        into: list[list] = [[] for _ in best]  # edges that end here, the longest first
        found: list[list] = [[] for _ in best]
        for last, i in self.matches.iter(word):
            found[last + 1].append(self.edge[i])
        for end in range(1, size + 1):
            if word[end - 1] not in self.alone:
                raw = word[end - 1].encode("utf-8", "replace")
                found[end].append((1, self.fallback, b"".join([self.bytes.get(b, self.unknown) for b in raw])))
            into[end] = [(best[end - length] + score, end - length, piece) for length, score, piece in found[end]]
            best[end] = max(edge[0] for edge in into[end])
        # A*: entries are a loss against the best, the cuts so far from the end, and the ids after the last cut. An entry's
        # best edges lose nothing, so they are followed at once to the start, and the others wait.
        out: list[tuple[float, bytes]] = []
        heap: list[tuple[float, tuple[int, ...], bytes]] = [(0.0, (size,), b"")]
        while heap and len(out) < n:
            loss, cuts, ids = heapq.heappop(heap)
            at, more = cuts[-1], n - len(out) - 1
            while at:
                top, chosen = best[at], None
                for edge in into[at]:
                    if chosen is None and edge[0] == top:
                        chosen = edge
                        if not more:
                            break
                    elif more > 1 or more and (not heap or loss + top - edge[0] <= heap[0][0]):
                        heapq.heappush(heap, (loss + top - edge[0], (*cuts, edge[1]), edge[2] + ids))
                at, ids = chosen[1], chosen[2] + ids
                cuts = (*cuts, at)
            out.append((best[size] - loss, ids))
        return out

    def two_best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
        """Scores, losses of the next best (infinite where there is none), ids of the best, ids of the next, of words without their space mark.

        As ``n_best`` of two for each word, step by step for all at once: the forward pass goes from place to place; the
        search follows best edges from the ends to the starts, keeps the least loss of the edges left aside, and follows
        that edge to the start. Words with wider characters that no piece has, or with space marks, are searched one by one.
        """
        score, loss = np.zeros(len(words)), np.full(len(words), np.inf)
        best, following = [b""] * len(words), [b""] * len(words)
        plain = [k for k, w in enumerate(words) if SPACE not in w and self.simple.issuperset(w)]
        for k in {*range(len(words))}.difference(plain):
            every = self.n_best(SPACE + words[k], 2)
            score[k], best[k] = every[0]
            if len(every) > 1:
                loss[k], following[k] = every[0][0] - every[1][0], every[1][1]
        if not plain:
            return score, loss, best, following
        # places of the words' prefixes, the empty one first, stand one after another
        joined = "".join([SPACE + words[k] for k in plain])
        size = np.array([len(words[k]) + 1 for k in plain])
        base = np.cumsum(size + 1) - (size + 1)
        letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(plain), dtype=np.int32), size)
        reached = np.arange(1, len(letters) + 1, dtype=np.int32) + word  # the place after each character
        steps = np.int16 if size.max() < 1 << 15 else np.int32
        found = np.fromiter(itertools.chain.from_iterable(self.longer.iter(joined)), np.int32).reshape(-1, 2)
        depth = (reached - base[word]).astype(steps)
        order = np.argsort(depth[found[:, 0]], kind="stable")
        # edges: longer pieces from place to place, the longest into a place first; then one of a single character into each
        to, piece = reached[found[order, 0]], found[order, 1]
        n = len(to)
        first = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(first, n)
        piece = np.concatenate([piece, self.single[letters]])
        start = np.concatenate([to - self.length[piece[:n]], reached - 1])
        gain = self.score[piece]
        top = np.full(int(base[-1] + size[-1] + 1), 0.0)
        total = np.empty(len(piece))
        by_depth = np.argsort(depth, kind="stable")
        last = int(size.max())
        deep = np.searchsorted(depth[by_depth], np.arange(1, last + 2))
        grouped = np.searchsorted(depth[found[order, 0]][first], np.arange(1, last + 2))
        for k in range(last):
            one = by_depth[deep[k] : deep[k + 1]]
            total[n + one] = alone = top[reached[one] - 1] + gain[n + one]
            top[reached[one]] = alone
            lo, hi = grouped[k], grouped[k + 1]
            if lo < hi:
                a, b = ends[lo], ends[hi]
                total[a:b] = top[start[a:b]] + gain[a:b]
                into = to[first[lo:hi]]
                top[into] = np.maximum(top[into], np.maximum.reduceat(total[a:b], first[lo:hi] - a))
        # the best edge into each place, and the next one: of equal ones the longer
        chosen, other = np.zeros(len(top), np.int64), np.full(len(top), -1)
        second = np.full(len(top), -np.inf)
        chosen[reached] = n + np.arange(len(letters))
        if n:
            place, into, width = np.arange(n), to[first], np.diff(ends)
            best_long = np.minimum.reduceat(np.where(total[:n] == top[to], place, n), first)
            has = best_long < n
            rest = total[:n].copy()
            rest[best_long[has]] = -np.inf
            next_long = np.maximum.reduceat(rest, first)
            which = np.minimum.reduceat(np.where(rest == np.repeat(next_long, width), place, n), first)
            single = chosen[into]
            by_single = has & (total[single] > next_long)  # the single character is the next best
            chosen[into] = np.where(has, best_long, single)
            second[into] = np.where(by_single, total[single], next_long)
            other[into] = np.where(by_single, single, which)

        def follow(at: np.ndarray, look=None) -> list[tuple[np.ndarray, np.ndarray]]:
            """(word, piece) of each step from the places back to the starts."""
            live, steps = np.arange(len(plain)), []
            at = at.copy()
            while len(live := live[at[live] > base[live]]):
                edge = chosen[at[live]]
                if look:
                    look(len(steps), live, at[live], edge)
                steps.append((live, piece[edge]))
                at[live] = start[edge]
            return steps

        least, turn, aside = np.full(len(plain), np.inf), np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64)
        kept = np.ones(len(plain), bool)  # at equal losses the one whose last pieces are longer stays

        def look(k: int, live: np.ndarray, at: np.ndarray, edge: np.ndarray) -> None:
            off, nth = top[at] - second[at], other[at]
            better = (off < least[live]) | ((off == least[live]) & ~kept[live] & (off < np.inf))
            who, nth = live[better], nth[better]
            least[who], turn[who], aside[who] = off[better], k, nth
            kept[who] = start[nth] < start[edge[better]]

        def texts_of(steps: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
            count = np.zeros(len(plain), np.int64)
            for who, _ in steps:
                count[who] += 1
            stop = np.cumsum(count)
            flat, left = np.empty(int(stop[-1]), "<u4"), stop.copy()
            for who, ids in steps:  # the last piece first
                left[who] -= 1
                flat[left[who]] = ids
            data, cuts = flat.tobytes(), (4 * np.append(0, stop)).tolist()
            return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

        steps = follow(base + size, look)
        score[plain], loss[plain] = top[base + size], least
        for k, ids in zip(plain, texts_of(steps), strict=True):
            best[k] = ids
        some = np.isfinite(least)
        turned = [(who[m], ids[m]) for k, (who, ids) in enumerate(steps) if (m := some[who] & (turn[who] > k)).any()]
        turned.append((np.flatnonzero(some), piece[aside[some]]))
        turned += follow(np.where(some, start[np.where(some, aside, 0)], base))
        for k, ids in zip(plain, texts_of(turned), strict=True):
            following[k] = ids
        return score, loss, best, following

    def word(self, word: str, n: int) -> tuple[float, bytes, float, list[tuple[float, bytes]]]:
        """Of a word with a space mark before it: score and ids of the best, the loss of the next (infinite if there is none), all n best."""
        known = self.known.setdefault(n, {})
        if (found := known.get(word)) is None:
            every = self.n_best(SPACE + word, n)
            found = (*every[0], every[0][0] - every[1][0] if len(every) > 1 else np.inf, every)
            if len(word) <= CACHED_CHARS:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                known[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """The text's words, without the space mark that stands before each; runs of spaces go to the word after them."""
        text = text.replace(SPACE, " ")
        if text[0] == " " or text[-1] == " " or "  " in text:
            return [spaces[1:].replace(" ", SPACE) + w for spaces, w in re.findall("( *)([^ ]*)", " " + text) if spaces or w]
        return text.split(" ")

    def encode_all(self, texts: list[str | None], n: int = 2) -> Iterator[list[tuple[float, bytes]] | None]:
        """As ``encode`` for each text; the two best of different words are searched for together, block by block.

        Of more than two, only the n - 1 words that lose least by their next choice can take part: these are searched for all of theirs.
        """
        for rows, _ in self.encode_with_changes(texts, n):
            yield rows

    def _looked_up(self, lists: list[list[str]]) -> list[int]:
        """Places of the lists' words, one after another, in what is known of words (``table``); unknown ones are searched for first."""
        different = set().union(*lists)
        new = list(different.difference(self.pairs))
        scores, losses, best, following = self.table if self.pairs else (np.zeros(0), np.zeros(0), [], [])
        if len(self.pairs) + len(new) > CACHE_ENTRIES:  # the frequent ones are here again
            kept = [w for w in different if w in self.pairs]
            at = [self.pairs[w] for w in kept]
            scores, losses, best, following = scores[at], losses[at], [best[k] for k in at], [following[k] for k in at]
            self.pairs = dict(zip(kept, range(len(kept)), strict=True))
        if new:
            a, b, c, d = self.two_best(new)
            self.pairs.update(zip(new, range(len(best), len(best) + len(new)), strict=True))
            scores, losses = np.concatenate([scores, a]), np.concatenate([losses, b])
            best += c
            following += d
        self.table = scores, losses, best, following
        return list(map(self.pairs.__getitem__, itertools.chain.from_iterable(lists)))

    def encode_with_changes(self, texts: list[str | None], n: int = 2) -> Iterator[tuple[list[tuple[float, bytes]] | None, list]]:
        """As ``encode_all``, and of each segmentation after the best where it differs: start and stop in the best one's bytes, and in its own."""
        for start, stop in chunked(texts, 1 << 20):
            lists = [self.words(t) if t else [] for t in texts[start:stop]]
            flat = self._looked_up(lists)
            scores, losses, best, following = self.table
            loss, spelled = losses[flat], list(map(best.__getitem__, flat))
            sums = np.append(0.0, np.cumsum(scores[flat]))
            a = b = 0
            for text, words in zip(texts[start:stop], lists, strict=True):
                if not text:
                    yield (None if text is None else [(0.0, b"")]), []
                    continue
                a, b = b, b + len(words)
                top, mine = float(sums[b] - sums[a]), spelled[a:b]
                rows, changes = [(top, b"".join(mine))], []
                if n > 2:
                    near = np.argpartition(loss[a:b], n - 2)[: n - 1] if b - a > n - 1 else np.arange(b - a)
                    near = near[np.lexsort((near, loss[a:b][near]))]
                    others = [(k, x, words[k]) for k, x in zip(near.tolist(), loss[a:b][near].tolist(), strict=True) if x < np.inf]
                    more, changes = self._combined(top, mine, others, n)
                    rows += more
                elif n == 2 and loss[k := a + int(loss[a:b].argmin())] < np.inf:
                    at, new = sum(map(len, spelled[a:k])), following[flat[k]]
                    rows.append((top - float(loss[k]), b"".join([*spelled[a:k], new, *spelled[k + 1 : b]])))
                    changes.append([(at, at + len(spelled[k]), at, at + len(new))])
                yield rows, changes

    def encode(self, text: str, n: int = 1) -> list[tuple[float, bytes]]:
        """Up to n segmentations of a text, best first: (score, ids)."""
        if not text:
            return [(0.0, b"")]
        words = self.words(text)
        found = list(map(self.known.setdefault(n, {}).get, words))
        parts = [p or self.word(w, n) for p, w in zip(found, words, strict=True)] if None in found else found
        scores, spelled, losses, _ = zip(*parts, strict=True)
        top, ids = sum(scores), b"".join(spelled)
        if n == 1:
            return [(top, ids)]
        # the n smallest losses against the best of all, over one or more words with another choice
        others = [losses.index(min(losses))] if n == 2 else heapq.nsmallest(n - 1, range(len(losses)), key=losses.__getitem__)
        return [(top, ids), *self._combined(top, spelled, [(i, losses[i], words[i]) for i in others], n)[0]]

    def _combined(self, top: float, spelled, others: list[tuple[int, float, str]], n: int) -> tuple[list[tuple[float, bytes]], list[list[tuple[int, int, int, int]]]]:
        """The segmentations after the best one, up to n - 1, with other choices of some words, and what changed: ``others`` has these words by what their next choice loses.

        A word whose next choice loses no less than the last of n found so far changes nothing, and isn't searched for its n best.
        """
        out: list[tuple[float, tuple]] = [(0.0, ())]
        choices: dict[int, list[tuple[float, bytes]]] = {}
        for i, least, word in others:
            last = out[-1][0] if len(out) == n else np.inf
            if least >= last:
                break
            every = choices[i] = self.word(word, n)[3]
            more = []
            for loss, chosen in out:
                for k in range(1, len(every)):
                    total = loss + every[0][0] - every[k][0]
                    if total >= last:
                        break
                    more.append((total, (*chosen, (i, k))))
            out = sorted(out + more, key=operator.itemgetter(0))[:n]
        whole, stops = b"".join(spelled), list(itertools.accumulate(map(len, spelled)))
        rows, changes = [], []
        for loss, chosen in out[1:]:
            parts, changed, at, shift = [], [], 0, 0
            for i, k in sorted(chosen):
                first, stop, new = stops[i] - len(spelled[i]), stops[i], choices[i][k][1]
                parts += (whole[at:first], new)
                changed.append((first, stop, first + shift, first + shift + len(new)))
                at, shift = stop, shift + len(new) - (stop - first)
            parts.append(whole[at:])
            rows.append((top - loss, b"".join(parts)))
            changes.append(changed)
        return rows, changes

    def alike(self, ids: bytes, other: bytes, changed: list[tuple[int, int, int, int]]) -> bool:
        """Do both spell the same bytes? Ids outside of what changed have to be equal, those inside are spelled."""
        at = to = 0
        for a, b, c, d in changed:
            one, two = (b"".join(map(self.spelled.__getitem__, memoryview(x).cast("I"))) for x in (ids[a:b], other[c:d]))
            if one != two or ids[at:a] != other[to:c]:
                return False
            at, to = b, d
        return ids[at:] == other[to:]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space put before it goes."""
        spelled = self.spelled
        return b"".join(map(spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def each_batch(path: str, batches: Iterator[pd.Series], work: Callable) -> Iterator:
    """work(model, batch) for the batches of a task. Garbage is collected between batches only: a lattice has no cycles,
    a frame may have some. What the model remembers goes at the end."""
    m = model(path)
    gc.disable()
    try:
        for batch in batches:
            yield work(m, batch)
            gc.collect(0)
    finally:
        m.known.clear()
        m.pairs.clear()
        m.table = np.zeros(0), np.zeros(0), [], []
        gc.enable()


def encode(docs: DataFrame, path: str, n: int = 2, text_col: str = "text", name: str = "encoded") -> DataFrame:
    """Add an array of up to n structs (score, ids), best first."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from each_batch(path, batches, lambda m, texts: pd.Series([best and [{"score": s, "ids": np.frombuffer(ids, "<i4")} for s, ids in best] for best in m.encode_all(texts.tolist(), n)], dtype=object))

    return docs.withColumn(name, F.pandas_udf(run, "array<struct<score: double, ids: array<int>>>")(F.col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the text of an array of ids."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for ids in batches:
            yield pd.Series([None if x is None else m.decode(np.asarray(x, "<u4").tobytes()) for x in ids], dtype=object)

    return rows.withColumn(name, F.pandas_udf(run, "string")(F.col(ids_col)))


def digest(docs: DataFrame, path: str, n: int = 2, text_col: str = "text", name: str = "found") -> DataFrame:
    """Add a struct: n_ids, ids_crc32 and score of the best segmentation, next_score and next_crc32 of the last of the n best (null if fewer), whether decoding each gives the text back, how many were found, and the crc32 of all their ids, one after another."""
    types = {"n_ids": "Int64", "ids_crc32": "Int64", "score": "float64", "next_score": "float64", "next_crc32": "Int64", "decodes": "boolean", "n_found": "Int64", "all_crc32": "Int64"}

    def row(m: PieceModel, text: str | None, best: list | None, changes: list) -> tuple:
        if text is None:
            return (None,) * len(types)
        s, ids = best[0]
        other = best[-1] if len(best) == n > 1 else (None, None)
        given = text.replace(SPACE, " ")
        decodes = m.decode(ids) == given and all(m.alike(ids, x, c) or m.decode(x) == given for (_, x), c in zip(best[1:], changes, strict=True))
        return len(ids) // 4, zlib.crc32(ids), s, other[0], other[1] and zlib.crc32(other[1]), decodes, len(best), zlib.crc32(b"".join(x for _, x in best))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from each_batch(path, batches, lambda m, texts: pd.DataFrame([row(m, t, *found) for t, found in zip(texts, m.encode_with_changes(texts.tolist(), n), strict=True)], columns=list(types)).astype(types))

    return docs.withColumn(name, F.pandas_udf(run, "n_ids long, ids_crc32 long, score double, next_score double, next_crc32 long, decodes boolean, n_found long, all_crc32 long")(F.col(text_col)))
