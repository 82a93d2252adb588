"""Operators against brute force: whole results, edge cases of rows and columns."""

import base64
import collections
import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import language, packing, pieces, secrets, topk, vectors

FIRST = {"en": ["the", "house", "and", "with", "stone"], "de": ["das", "haus", "und", "mit", "stein"], "es": ["la", "casa", "y", "con", "piedra"]}


def der_key(n=300):
    body = b"\x02\x01\x00\x30\x0d\x06\x09" + b"\x2a" * 9 + b"\x05\x00\x04\x82" + n.to_bytes(2, "big") + bytes(i * 7 % 251 for i in range(n))
    return b"\x30\x82" + len(body).to_bytes(2, "big") + body


def test_top_k_rows(spark):
    """Repeated ids and columns whose names clash with the operator's own."""
    rows = [(0, [1, 2], 5, "x"), (0, [3, 0], 5, "x"), (1, [1, 1], 7, "x"), (1, [1, 1], 7, "x"), (2, None, 1, "x"), (None, [9, 9], 1, "x"), (3, [0, 0, 4], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, weights array<long>, score long, rank string")
    got = collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df.where("vec_id <= 1"), df, 2).collect())
    assert got == {(0, 1, 1, 3): 2, (0, 2, 1, 3): 2, (1, 1, 0, 3): 2, (1, 2, 0, 3): 2}


def test_top_k_other_rows(spark):
    """Rows that repeat the query's id are candidates, the query's own row is not, wherever it stands in its ranking; the largest weights stay themselves."""
    rng = np.random.default_rng(3)
    rows = [(i // 3, rng.integers(-4, 5, 5).tolist()) for i in range(180)] + [(20, [0, 0, 0, 0, 0])] * 2 + [(40, [1, 1])] * 30 + [(7, [])]
    df = spark.createDataFrame(rows, "vec_id long, weights array<long>").repartition(5)
    got = collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, 20, other_rows=True).collect())
    want = collections.Counter()
    for a, (q, w) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(w, v, strict=False)), i) for b, (i, v) in enumerate(rows) if b != a)[:20]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert got == want
    large = spark.createDataFrame([(0, [1]), (1, [-(2**63)]), (2, [3])], "vec_id long, weights array<long>")
    assert [r.score for r in topk.top_k(large.where("vec_id = 0"), large, 2).orderBy("rank").collect()] == [3, -(2**63)]


def brute_language(train, text):
    """The same rule with plain dictionaries: words, then the longest n-grams known, mean log frequencies."""
    langs = sorted({lang for _, lang in train})
    counts = {n: collections.defaultdict(collections.Counter) for n in (0, 1, 2, 3, 4)}
    for t, lang in train:
        for w in language.words(t):
            counts[0][w][lang] += 1
            for n in (1, 2, 3, 4):
                for g in language.grams(w, n):
                    counts[n][g][lang] += 1
    totals = {n: {lang: sum(c[lang] for c in counts[n].values()) for lang in langs} for n in counts}
    freq = lambda n, key: np.array([np.log((counts[n][key][lang] + 0.5) / (totals[n][lang] + 0.5 * len(counts[n]))) for lang in langs])
    total, n_words = np.zeros(len(langs)), 0
    for w in language.words(text):
        if w in counts[0]:
            total, n_words = total + freq(0, w), n_words + 1
            continue
        for n in (4, 3, 2, 1):
            if known := [freq(n, g) for g in language.grams(w, n) if g in counts[n]]:
                total, n_words = total + np.mean(known, 0), n_words + 1
                break
    if not n_words:
        return None
    mean = total / n_words
    return langs[int(mean.argmax())], float(np.exp(mean - mean.max())[mean.argmax()] / np.exp(mean - mean.max()).sum())


def test_language_against_brute_force(spark):
    rng = random.Random(4)
    train = [(" ".join(rng.choice(v) for _ in range(20)), lang) for lang, v in FIRST.items() for _ in range(10)]
    model = language.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string"))
    texts = [" ".join(rng.choice(v)[: rng.randint(1, 6)] + rng.choice(["", "n", "hou", "ied"]) for _ in range(rng.randint(1, 12))) for v in FIRST.values() for _ in range(40)] + ["x" * 100_000, "the " * 50_000]
    for t in texts:
        want = brute_language(train, t)
        got = model.predict(t)
        if want is None:
            assert got[2] == 0 and got[0] in FIRST
            continue
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9, t[:50]


def test_language_rows(spark):
    """Ties, texts of letters that were not learned, clashing columns, repeated rows."""
    model = language.LanguageModel(["de", "en"], {0: ({"a": 0}, np.log(np.array([[0.5, 0.5]])))}, np.array([1.0, 3.0]))
    assert model.predict("a a") == ("de", 0.5, 1.0) and model.predict("漢字 мир") == ("en", 0.75, 0.0)
    rows = [(1, "a", "x", "y", "z"), (1, "a", "x", "y", "z"), (2, None, None, None, None), (3, "12", "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, __lang string, lang_pred_score string")
    got = language.predict(df, model)
    assert sorted(got.columns) == sorted([*df.columns, "lang_pred_known"])
    assert collections.Counter((r.doc_id, r.lang_pred, r["__lang"]) for r in got.collect()) == {(1, "de", "y"): 2, (2, "und", None): 1, (3, "und", None): 1}


def every_segmentation(m, word):
    if not word:
        return [(0.0, b"")]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in m.pieces:
            ids, score = m.pieces[word[:k]]
            out += [(score + s, ids + rest) for s, rest in every_segmentation(m, word[k:])]
    return out


def test_n_best_of_texts():
    """Scores of whole texts' five best against all combinations of all segmentations, and both ways of search against each other."""
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("the cat", "a bad idea", "to be or", "an ox"):
        each = [every_segmentation(m, "▁" + w) for w in text.split()]
        every = sorted((sum(p[0] for p in c) for c in itertools.product(*each)), reverse=True)
        for n in (1, 2, 5):
            got = m.encode(text, n)
            assert [s for s, _ in got] == pytest.approx(every[:n]) and len({ids for _, ids in got}) == n
            assert all(m.decode(ids) == text for _, ids in got)
    rng = random.Random(3)
    texts = ["", None, "a", " two  spaces ", "tab\tand\nline", "漢字🙂é", "x" * 5000, "▁▁a ▁ b", *("".join(rng.choice("abetion THE,.\n é漢🙂▁") for _ in range(rng.randint(0, 60))) for _ in range(800))]
    for text, both in zip(texts, m.encode_all(texts), strict=True):
        if text is None:
            assert both is None
            continue
        want = m.encode(text, 2)
        assert [ids for _, ids in both] == [ids for _, ids in want] and [s for s, _ in both] == pytest.approx([s for s, _ in want])


def test_secret_forms(spark):
    """Positions of each form in a text around it, in Spark too; near misses are left alone."""
    key = der_key()
    flat, url = base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode().rstrip("=")
    wrapped = "\n".join(flat[i : i + 64] for i in range(0, len(flat), 64))
    jwt = lambda head: base64.urlsafe_b64encode(head.encode()).decode().rstrip("=") + ".eyJh.c2ln"
    armour = lambda kind, body: f"-----BEGIN {kind}-----{body}-----END {kind}-----"
    openssh = base64.b64encode(b"openssh-key-v1\0" + (4).to_bytes(4, "big") + b"none" + b"z" * 80).decode()
    public = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))).decode()
    forms = [
        ("der", flat), ("der", wrapped), ("der", url), ("der", wrapped.replace("\n", "\\n")), ("der", key.hex()),
        ("pem", armour("PRIVATE KEY", f"\n{wrapped}\n")), ("pem", armour("PRIVATE KEY", "\\n" + wrapped.replace("\n", "\\n") + "\\n")), ("pem", armour("OPENSSH PRIVATE KEY", f"\n{openssh}\n")),
        ("pem", armour("RSA PRIVATE KEY", f"\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233\n\n{base64.b64encode(b'q' * 64).decode()}\n")),
        ("jwt", jwt('{"alg":"HS256"}')), ("jwt", jwt('{ "alg": "none" }')), ("jwt", jwt('{\n"alg":"x"}')), ("ssh", openssh), ("ssh", public),
    ]
    rows = [(i, f"ünder {t} \n and on", kind, 6, 6 + len(t)) for i, (kind, t) in enumerate(forms)]
    misses = [flat[:-8], key.hex()[:-4], armour("PRIVATE KEY", "\nabcd\n"), jwt('{"typ":"x"}'), base64.b64encode(b"0" + b"z" * 60).decode(), public[:-12], "M" + "A" * 5000]
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(100 + i, t) for i, t in enumerate(misses)] + [(200, None), (201, ""), (202, "a " * 200_000 + flat)], "doc_id long, text string")
    got = {r.doc_id: r.found for r in secrets.secret_scan(df, redact=True).collect()}
    structural = lambda s: [x for x in s.split(",") if x and x.split(":")[0] not in ("assign", "access", "hex")]
    for i, _, kind, a, b in rows:
        assert structural(got[i].spans) == [f"{kind}:{a}:{b}"], forms[i]
        assert got[i].redacted == "ünder <SECRET> \n and on"
    assert not any(structural(got[100 + i].spans) for i in range(len(misses)))
    assert got[200].spans == got[201].spans == "" and got[200].redacted is None and got[201].redacted == ""
    assert got[202].spans == f"der:400000:{400_000 + len(flat)}"


def test_base_secrets_against_plain_patterns(spark):
    import re

    rng = random.Random(7)
    bits = ['password = "', "API-key: ", "apikey:'", "token=", "Secret : ", "ſecret=abcdefgh", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "deadbeef" * 4, "xyz123", "漢", "🙂", "\n", " ", '"', "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for t in texts:
        want = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(secrets.base_spans(t)) == sorted(want), t
    rows = spark.createDataFrame([(1, "password=abcdef1 x", "mine")], "doc_id long, text string, found string")
    r = secrets.secret_scan(rows, name="mine_too").collect()[0]
    assert r.found == "mine" and r.mine_too.base_sha256 == hashlib.sha256(b"assign:0:16").hexdigest()


@pytest.mark.parametrize("width", range(8, 17))
def test_recall_at_each_width(spark, width):
    """1,000 pairs just within the threshold, coded with chunks of the width."""
    rng = np.random.default_rng(width)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 1000, 64)))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    v = np.concatenate([x, 0.931 * x + np.sqrt(1 - 0.931**2) * y])
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in vectors.embedding_near_dedup(df, width=width).select("n_links").collect())
    print(f"width {width}: {found} of 2000")
    assert 0.99 * 2000 <= found <= 2000


def test_vector_rows(spark):
    """n_links, component_id and kept against brute force: chains, copies, repeated ids, null ids, clashing columns."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    chain = [base[0]]
    for _ in range(5):
        chain.append(chain[-1] + 0.3 * rng.standard_normal(16))
    x = np.concatenate([base, base[:8] + 0.1 * rng.standard_normal((8, 16)), base[:3], chain]).astype(np.float32)
    rows = [(100 - i, v.tolist(), i % 2, 0, "c", 1) for i, v in enumerate(x)] + [(100, x[0].tolist(), 0, 0, "c", 1), (None, x[1].tolist(), 1, 0, "c", 1), (200, [1e-30] * 16, 0, 0, "c", 1), (201, [1e30] * 16, 0, 0, "c", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, copies int, v string, id int")
    ids = [r[0] for r in rows]
    vec = np.array([r[1] for r in rows], np.float32).astype(float)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    root = {i: i for i in ids if i is not None}
    links = collections.defaultdict(set)
    for a, b in zip(*np.nonzero(link), strict=True):
        if ids[a] is not None and ids[b] is not None and ids[a] != ids[b]:
            links[ids[a]].add(ids[b])
    for _ in range(len(root)):
        for a, others in links.items():
            root[a] = min(root[a], *(root[b] for b in others))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.embedding_near_dedup(df).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (len(links[i]), root[i], root[i] == i) for i in root}


def test_packing_rows(spark):
    """Every piece's ids of long and repeated documents, nulls and clashing columns."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = ["", None, "word " * 3000, " ".join(str(rng.random()) for _ in range(2500)), "a" * 50_000, "x", "x"]
    rows = [(i if i < 6 else 5, t, 1, "p") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, piece string")
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.best_fit_packing(df, path, capacity=512).collect())
    want = collections.Counter()
    for doc, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            want[doc, k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())] += 1
    assert got == want and json.dumps(sum(want.values()))
