"""Every stage of the pipeline against brute force, on rows with nulls, copies, repeats and clashing columns; empty tables; run()."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import lines, ngram_join, secrets
from tessera.operators.graph import settled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, __key string, __lang_pred string"
VOCABULARY = {"en": ["the", "house", "and", "with", "stone", "river", "green", "walk"], "de": ["das", "haus", "und", "mit", "stein", "fluss", "weg", "baum"]}
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(rng):
    prose = lambda lang, n: " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "s", "en", "ing"]) for _ in range(n))
    texts = [(prose(lang, 60), lang) for lang in ("en", "de") for _ in range(10)]
    near = texts[0][0].split()
    near[30] = "other"
    texts += [(" ".join(near), "en"), texts[1], (texts[2][0] + "\n" + texts[3][0], "en"), ("password = abcdefgh1 " + prose("en", 30), "en"), (None, "en"), ("", "en"), ("12 34 !", "en"), ("漢字 漢字", None), ("the house", None), ("Stein.", "de")]
    rows = [(i, t, lang, "s", len(t or ""), "mine", "k", "p") for i, (t, lang) in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[5][0], "en", None, None, None, None, None), (7, texts[8][0] + " and more", "en", None, 3, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return rows_of(random.Random(11))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, none, "")
        assert found.count() == 0 and found.dtypes == none.dtypes, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0


def test_language(spark, docs, rows):
    found = STAGES["language_id"](spark, docs, "")
    assert found.columns == docs.columns
    got = counted(found)
    rejected = [r for r in rows if r[1] in (None, "", "12 34 !", "漢字 漢字")]
    assert len(rejected) == 5
    of = {r[:2]: r for r in got}
    want = collections.Counter(r for r in rows if r not in rejected)
    assert sum(got.values()) == sum(want.values())
    for r, n in want.items():
        lang = of[r[:2]][2]
        assert got[(*r[:2], lang, *r[3:])] == n and lang == ("de" if any(w in r[1].lower().split() for w in ("das", "stein.", "und", "mit", "haus")) else lang)
    assert of[(28, "the house")][2] == "en" and of[(29, "Stein.")][2] == "de"


def test_lines(spark, docs, rows):
    copies, order = set(), sorted({(r[0] is None, r[0] or 0, ngram_join_key(spark, r), n, x.strip()) for r in rows if r[1] for n, x in enumerate(r[1].split("\n")) if x.strip()})
    first = {}
    for *place, line in order:
        first.setdefault(line, tuple(place))
    names = list(first)
    for i, b in enumerate(names):
        if any(min(len(a), len(b)) >= 16 and lines.within(a, b, lines.allowed(max(len(a), len(b)))) for a in names[:i]):
            copies.add(b)
    want = collections.Counter()
    for r in rows:
        if r[1] is None:
            want[r] += 1
            continue
        here = (r[0] is None, r[0] or 0, ngram_join_key(spark, r))
        kept = [x for n, x in enumerate(r[1].split("\n")) if not x.strip() or (x.strip() not in copies and first[x.strip()] == (*here, n))]
        text = "\n".join(kept)
        if len(kept) == len(r[1].split("\n")) or text.strip():
            want[(r[0], text, r[2], r[3], len(text), *r[5:])] += 1
    got = collections.Counter()
    for r, n in counted(STAGES["line_dedup"](spark, docs, "")).items():
        got[r if r[1] is not None else (*r[:4], None, *r[5:])] += n
    want = collections.Counter({(r if r[1] is not None else (*r[:4], None, *r[5:])): n for r, n in want.items()})
    assert got == want and copies


_keys: dict = {}


def ngram_join_key(spark, row):
    """The row key, as Spark has it."""
    from tessera.llm.shared import row_key

    if row[:2] not in _keys:
        _keys[row[:2]] = bytes(spark.createDataFrame([row[:2]], "doc_id long, text string").select(row_key().alias("k")).first().k)
    return _keys[row[:2]]


def test_near_copies(spark, docs, rows):
    different = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, ngram_join_key(spark, r)))
    sets = [set(s.tolist()) for s in ngram_join.shingle_sets([r[1] for r in different])]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and len(a & b) >= 0.8 * len(a | b):
                    root[i] = min(root[i], root[j])
    want = {r[:2] for i, r in enumerate(different) if root[i] == i}
    got = counted(STAGES["ngram_join"](spark, docs, ""))
    assert set(got.values()) == {1} and {r[:2] for r in got} == want and len(want) < len(different)


def test_secrets(spark, docs, rows):
    want = collections.Counter()
    for r in rows:
        text = r[1] and secrets.redacted(r[1], secrets.base_spans(r[1]) + secrets.structural_spans(r[1]))
        want[(r[0], text, *r[2:4], None if text is None else len(text), *r[5:])] += 1
    found = STAGES["secret_scan"](spark, docs, "")
    assert counted(found) == want and found.where("text like '%SECRET%'").count() == 1


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = STAGES["best_fit_packing"](spark, docs, "").collect()
    want = collections.Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r[0], 0, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in found) == want
    ends = collections.defaultdict(list)
    for r in found:
        ends[r.sequence_id].append((r.offset, r.length))
    for places in ends.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 4096


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = settled(docs)  # someone else's table stays, those that the stages write for themselves go
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert held.count() == docs.count() and found.count() > 0
    by_hand = docs
    for name, stage in corpus_pipeline.STAGES:
        by_hand = stage(spark, by_hand, str(tmp_path))
        rows = by_hand.collect()
        by_hand = spark.createDataFrame(rows, by_hand.schema)
    pieces = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(found.collect()) == pieces(rows) and rows
