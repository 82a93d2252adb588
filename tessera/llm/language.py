"""Language ID (3): word-first backoff.

A known word scores by its log frequency in each language. An unseen word backs off to its character
n-grams: the longest length of which the model knows any n-gram, else the next shorter one, down to
single letters. Scores add up over the whole text.

The model is fitted on a bounded sample of labelled rows, the ``sample_docs`` with the smallest hashes of
their ids, and keeps at most ``max_words`` words and ``max_grams`` n-grams of each length, so that it can
be broadcast whatever the corpus. Prediction reads the text alone.

A null text, or one without letters, is ``und`` with score 0; so is every text when nothing labelled
was learned. A text of letters none of which was learned goes to the language of most words learned, with that
language's share of them. Ties go to the language first in the alphabet. Repeated rows are scored one by one; other
columns of the rows are kept, and one that bears the prediction's name is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import unused

WORD = regex.compile(r"\p{L}+")
LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word with a space at either end; single letters without."""
    if n == 1:
        return list(word)
    word = f" {word} "
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class LanguageModel:
    """Log frequencies by language of words, and of n-grams by length."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[dict[str, int], np.ndarray]], prior: np.ndarray | None = None):
        """tables: by length of n-gram (0: words) the rows of the keys and the log frequencies. prior: the languages' words learned."""
        self.languages = languages
        self.prior = np.ones(len(languages)) if prior is None else prior
        first, self.rows, all_tables = 0, {}, [np.empty((0, len(languages)))]
        for n in (0, *LENGTHS):  # one table for all, so that a text's rows are gathered at once
            rows, table = tables.get(n, ({}, all_tables[0]))
            self.rows[n] = {key: first + row for key, row in rows.items()}
            all_tables.append(table)
            first += len(table)
        self.table = np.concatenate(all_tables)

    def scores(self, text: str) -> tuple[np.ndarray, int, float]:
        """Sums of log frequencies by language; how many words have been scored; the share of words that are known, or by n-grams of three letters and more (0 without words)."""
        known, lengths = self.rows[0], [(n, self.rows[n].get) for n in LENGTHS]
        rows: list[int] = []
        weights: list[float] = []
        n_words = near = 0
        counts = Counter(words(text))
        for word, k in counts.items():
            if (row := known.get(word)) is not None:
                rows.append(row)
                weights.append(k)
                n_words += k
                near += k
                continue
            for n, row_of in lengths:  # the longest n-grams known count alike
                if found := [r for r in map(row_of, grams(word, n)) if r is not None]:
                    rows += found
                    weights += [k / len(found)] * len(found)
                    n_words += k
                    near += k * (n > 2)
                    break
        return np.array(weights) @ self.table[rows] if rows else np.zeros(len(self.languages)), n_words, near / max(1, counts.total())

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share of the words' mean likelihoods, and the share of words known (see ``scores``)."""
        if not text or not self.languages or not WORD.search(text):
            return UNKNOWN, 0.0, 0.0
        total, n, known = self.scores(text)
        share = np.exp(total / n - (total / n).max()) if n else self.prior
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()), float(known)


def fit(labelled: DataFrame, sample_docs: int = 12_000, max_words: int = 160_000, max_grams: int = 40_000) -> LanguageModel:
    """labelled: doc_id, text, lang."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    # the sample's size is bounded by a share of the hashes' range, so that no sort is needed
    share = min(1.0, sample_docs / max(1, rows.count()))
    rows = rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.lit(share))

    def count(batches):
        total: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault((lang, 0), Counter()).update(words(text))
        for (lang, _), found in list(total.items()):
            for n in LENGTHS:
                c: Counter = Counter()
                for w, k in found.items():
                    for g in grams(w, n):
                        c[g] += k
                total[lang, n] = c
        for (lang, n), c in total.items():
            keys = list(c)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array(part), pa.array([c[k] for k in part], pa.int64())], names=["lang", "n", "key", "count"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, n int, key string, count long").groupBy("n", "key", "lang").agg(F.sum("count").alias("count"))
    keys = counts.groupBy("n", "key").agg(F.sum("count").alias("all"), F.collect_list(F.struct("lang", "count")).alias("by"))
    top = keys.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("all"), "key")))
    found = top.where(F.col("r") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams)).select("n", "key", "by").toArrow()  # bounded by the parameters
    lengths, keys = found["n"].to_numpy(), found["key"].combine_chunks()
    by = found["by"].combine_chunks()
    langs = np.array(by.flatten().field("lang").to_pylist(), object)
    languages = sorted(set(langs.tolist()))
    table = np.zeros((len(keys), len(languages)))
    table[np.repeat(np.arange(len(keys)), np.diff(by.offsets.to_numpy())), np.searchsorted(np.array(languages, object), langs)] = by.flatten().field("count").to_numpy()
    tables, prior = {}, np.ones(len(languages))
    for n in (0, *LENGTHS):
        at = np.flatnonzero(lengths == n)
        own = table[at]
        if n == 0:
            prior = own.sum(0)
        tables[n] = {key: i for i, key in enumerate(keys.take(pa.array(at)).to_pylist())}, np.log((own + 0.5) / (own.sum(0) + 0.5 * max(1, len(own))))
    return LanguageModel(languages, tables, prior)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", name: str = "lang_pred") -> DataFrame:
    """Add the prediction, ``{name}_score`` and ``{name}_known`` (the share of words known) to the rows of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see fit()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "known"])

    # not deterministic, as Spark has it: a condition on the prediction then doesn't have it made twice
    found = F.pandas_udf(run, "lang string, score double, known double").asNondeterministic()(F.col(text_col))
    added = {name: "lang", f"{name}_score": "score", f"{name}_known": "known"}
    names, all_three = [c for c in docs.columns if c not in added], unused(docs, "__lang")
    return docs.select(*names, found.alias(all_three)).select(*names, *[F.col(f"{all_three}.{field}").alias(c) for c, field in added.items()])


def held_out(doc_id: str = "doc_id"):
    """Folds: crc32 of the id's digits, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
