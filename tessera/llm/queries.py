"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, language, lines, manifest, ngram_join, packing, pages, pieces, secrets, substrings, token_counts, topk, vectors
from tessera.llm.shared import table

WORD_TOKENIZER, BYTE_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


#: Segmentations of each text: as many as SentencePiece's own command gives.
N_BEST = 10


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("weights"))
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows, 20, other_rows=True)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).drop("rkey", "first")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs, model).select("doc_id", "held_out", "lang_pred", F.col("lang_pred_score").alias("score"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines_removed", F.char_length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op5_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pieces.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL), N_BEST)
    return docs.select("doc_id", "found.*")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.html_extraction(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_ngram_join, op3_language_id, op4_line_dedup, op5_piece_coding, op6_html_extraction, op7_secret_scan, op8_substring_dedup, op9_embedding_near_dedup, op10_best_fit_packing, op11_merkle_manifest, op12_tokenizer_alignment, op13_token_counts)}
QUERIES["pipeline"] = corpus_pipeline.run


def _manifest_sql(depth: int = 6) -> str:
    """Levels unrolled: enough for 16 ** depth documents of a source, and as many sources. Trees with one node left stay as they are."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {field(text)})"
    small = f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda s, _: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {bits}), 4294967295)"

    def tree(name: str, of: str) -> list[str]:
        out = []
        for k in range(depth):
            out.append(f"{name}{k + 1} AS (SELECT {of}, i // 16 AS i, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (max(c) + 15) // 16 AS c FROM {name}{k} GROUP BY {of}, i // 16)")
            out.append(f"{name}s{k} AS (SELECT a.{of}, a.i, any_value(a.c) AS c, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS f, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS g FROM {name}{k} a JOIN {name}{k} b ON a.{of} = b.{of} AND a.i // 16 = b.i // 16 GROUP BY a.{of}, a.i)")
        return out

    def up(name: str, source: str, of: str, at: str) -> list[str]:
        out = []
        for k in range(depth):
            before = source if k == 0 else f"{name}{k}"
            out.append(f"{name}{k + 1} AS (SELECT w.* REPLACE (CASE WHEN x.c = 1 THEN fold ELSE sha256(f || fold || g) END AS fold, CASE WHEN x.c = 1 THEN proof ELSE proof || f || g END AS proof) FROM {before} w JOIN {of}s{k} x ON x.t = w.{'t' if of == 'n' else 'z'} AND x.i = w.{at} // {16**k})")
        return out

    return f"""WITH RECURSIVE base AS (
    SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(small)} ELSE {leaf("text")} END AS fold FROM documents
), placed AS (
    SELECT doc_id, leaf, fold, '' AS proof, CAST(0 AS BIGINT) AS z, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM base
), n0 AS (SELECT t, i, leaf AS h, c FROM placed), {", ".join(tree("n", "t"))},
m0 AS (SELECT CAST(0 AS BIGINT) AS t, t AS i, h, count(*) OVER () AS c FROM n{depth}), {", ".join(tree("m", "t"))},
{", ".join(up("p", "placed", "n", "i"))}, {", ".join(up("q", f"p{depth}", "m", "t"))}
SELECT q.doc_id, q.leaf, s.h AS subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.fold AS folded_root, q.fold = r.h AS verified
FROM q{depth} q JOIN n{depth} s ON s.t = q.t CROSS JOIN m{depth} r"""


ORACLES = {
    "op11_merkle_manifest": _manifest_sql(),
    "op1_top_k": """
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM e q JOIN e c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
    "op2_ngram_join": """
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), s AS (
    SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM t
), x AS (
    SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s
), l AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id
    GROUP BY 1, 2, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6
), r AS (
    SELECT doc_id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
), c AS (
    SELECT doc_id, min(root) AS class_id FROM r GROUP BY 1
), n AS (
    SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1
)
SELECT s.doc_id, CASE WHEN len(g) > 0 THEN min(s.doc_id) OVER (PARTITION BY g) ELSE s.doc_id END AS copy_of, CASE WHEN len(g) > 0 THEN count(*) OVER (PARTITION BY g) ELSE 1 END AS n_copies,
    coalesce(n_links, 0) AS n_links, class_id, s.doc_id = class_id AS kept
FROM s JOIN c ON c.doc_id = s.doc_id LEFT JOIN n ON n.doc_id = s.doc_id""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL
), f AS (
    SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
    SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) >= 0.93
), r AS (
    SELECT DISTINCT vec_id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id
), c AS (
    SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1
), n AS (
    SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1
)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id""",
}
