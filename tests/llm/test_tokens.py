"""Manifest (11), alignment (12) and token counts (13) against brute force: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import random
import zlib

import public_tokenizers
import pytest

from tessera.llm import alignment, lookups, manifest, queries, token_counts
from tessera.operators import graph

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "\n", "ü", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x0A>", "漢", "字", "😀", "the", " the", "\x00", "\x01", "\t", "'s", ".", ",", "  ", "é", "1", "23", "ﬁ", "​", "=", "//", "\xa0", "\x85", " word", " other"]


def texts_of(seed, n):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.choice([1, 3, 10, 50, 400])))) for i in range(n)]
    return rows + [(None, None), (5, ""), (None, "x" * 5000), (7, "ab c" * 3000), (7, "ab c" * 3000), (8, "a▁b c"), (9, " "), (10, "a  "), (11, "  a"), (12, "▁")]


@pytest.fixture(scope="module")
def rows():
    return texts_of(1, 500)


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = "doc_id", "text", "'z' AS uid", "1 AS row", "2 AS KEYS", "3 AS n_tokens", "4 AS n_a"
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(*more)


@pytest.mark.parametrize("hot", [lookups.HOT, 50, 0])
def test_token_counts(docs, rows, hot):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = token_counts.token_counts(docs, PIECE, limit=300, hot=hot)
    assert found.columns == ["doc_id", "uid", "row", "KEYS", "n_a", "n_bytes", "n_tokens", "over_limit"]
    want = collections.Counter()
    for i, t in rows:
        n = len(model.encode(t or ""))
        want[i, "z", len((t or "").encode()), n, n > 300] += 1
    assert collections.Counter((r.doc_id, r.uid, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == want
    assert token_counts.token_counts(docs.where("doc_id < 0"), PIECE, hot=hot).count() == 0


def test_pre_tokens_are_counted_once(docs, rows):
    table, _ = token_counts.pre_tokens(docs, PIECE)
    assert table.count() == table.select("key").distinct().count() > 100
    assert table.where("n > 1").count() > 20


def test_colliding_keys_take_another_seed(docs, monkeypatch):
    seen = []
    monkeypatch.setattr(lookups, "collide", lambda table, key: len(seen) < 2 and not seen.append(1))
    assert token_counts.pre_tokens(docs.limit(5), PIECE)[1] == 2


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    values, name = alignment.byte_values(), {i: t for t, i in a.get_vocab().items()}
    a_bytes = lambda i: bytes(values[c] for c in name[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for i, t in rows:
        groups = []
        if t:
            ids = [(x, a_bytes(x)) for x in a.encode(" " + t, add_special_tokens=False).ids], [(x, b_bytes(x)) for x in b.encode(t)]
            if all(b"".join(y for _, y in side) == (" " + t).encode() for side in ids):
                ends = [[sum(len(y) for _, y in side[: k + 1]) for k in range(len(side))] for side in ids] if len(t) < 2000 else None
                if ends is None:  # the same, with running sums
                    ends = []
                    for side in ids:
                        n, here = 0, []
                        for _, y in side:
                            n += len(y)
                            here.append(n)
                        ends.append(here)
                last = [0, 0]
                for end in sorted(set(ends[0]) & set(ends[1])):
                    group = []
                    for s in (0, 1):
                        at = last[s]
                        while last[s] < len(ends[s]) and ends[s][last[s]] <= end:
                            last[s] += 1
                        group.append([x for x, _ in ids[s][at : last[s]]])
                    groups.append(group)
        docs.append((i, groups))
    count = collections.Counter(p for _, groups in docs for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = collections.Counter()
    for i, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out[i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


def aligned(df, **options):
    return collections.Counter(tuple(r) for r in alignment.alignment(df, BYTE, PIECE, **options).select("doc_id", *alignment.RESULT).collect())


@pytest.mark.parametrize("hot", [lookups.HOT, 20, 0])
def test_alignment(docs, rows, hot):
    assert aligned(docs, hot=hot) == brute_alignment(rows)


def test_alignment_forms(docs, monkeypatch):
    found = alignment.alignment(docs, BYTE, PIECE)
    assert found.columns == ["doc_id", "uid", "row", "KEYS", "n_tokens", *alignment.RESULT]
    assert aligned(docs.where("doc_id < 0")) == {}
    monkeypatch.setattr(alignment, "BLOCK", 100)
    monkeypatch.setattr(alignment, "CHUNKS", 30)  # dictionaries are handed out and begun anew all the time
    some = docs.where("doc_id < 60")
    assert aligned(some) == brute_alignment([(r.doc_id, r.text) for r in some.collect()])


def test_alignment_of_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert aligned(docs) == brute_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_token_counts_of_tables(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = {r.doc_id: len(model.encode(r.text or "")) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()} == want


def of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = []
    for doc, source, lang, n, text in rows:
        leaf = of(*map(field, (doc, source, lang, n, text)))
        changed = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and text is not None
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if changed else text
        leaves.append((source, doc, leaf, of(*map(field, (doc, source, lang, n, small)))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([of(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def beside(levels, i):
        for nodes in levels[:-1]:
            low = i // 16 * 16
            yield nodes[low:i], nodes[i + 1 : low + 16]
            i //= 16

    sources = sorted({x[0] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((x for x in leaves if x[0] == s), key=lambda x: (x[1] is not None, x[1] or 0, x[2])) for s in sources}
    trees = {s: tree([x[2] for x in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = collections.Counter()
    for k, s in enumerate(sources):
        for i, (_, doc, leaf, folded) in enumerate(own[s]):
            way = [*beside(trees[s], i), *beside(top, k)]
            for before, behind in way:
                folded = of(*before, folded, *behind)
            root = top[-1][0]
            out[doc, leaf, trees[s][-1][0], root, of(*[x for a, b in way for x in a + b]), folded, folded == root] += 1
    return out


def test_manifest(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else f"s{i % 40}", rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Some Text É ÀB", "abc" * 5])) for i in range(7000)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "big", "en", 1, "X")] * 2 + [(9001, "one", None, None, "Ünï"), (9002, "zwei", "x", 1, "T"), (9003, "é", "x", 1, "T"), (9004, "", "x", 1, "T" * 100_000)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    for some in (rows, rows[:1], rows[:17], [r for r in rows if r[1] == "big"][:300], [(i, f"s{i}", None, None, "A") for i in range(40)]):
        df = spark.createDataFrame(some, schema).selectExpr("*", "1 AS tree", "2 AS index", "3 AS leaf_", "4 AS __part")
        want = brute_manifest(some)
        assert collections.Counter(tuple(r) for r in manifest.manifest(df.drop("__part")).collect()) == want
        assert len(some) < 40 or any(not r[-1] for r in want)
    assert manifest.manifest(spark.createDataFrame([], schema)).count() == 0


def test_hot_keys(spark):
    table = spark.createDataFrame([(k, 1 + k % 50, 2 * k) for k in range(-500, 500)], "key long, n long, value long")
    for most in (0, 10, 100, 5000):
        found = lookups.Hot(table, ["value"], most)
        assert len(found.columns.value[0]) <= most
        hit, (value,) = found.find(lookups.np.arange(-600, 600))
        assert all(v == 2 * k if h else v == 0 for k, h, v in zip(range(-600, 600), hit.tolist(), value.tolist(), strict=True))
        assert hit.sum() == table.where(graph.F.col("n") >= found.bound).count()
