"""Language identification with word-first backoff.

`fit` counts words per language on a bounded sample of the labelled rows of each language (about `max_rows`,
taken by a hash of doc_id, so the same rows on every run; a rare language keeps all its rows) and keeps log
frequencies of the `max_words` words and the `max_grams` character n-grams of each order of greatest share,
where a language's words count by their share in that language, however much text it has.
`predict` scores each word of the whole text: a known word by its log frequencies, an unseen one by its
longest known character n-grams, stepping down one order at a time, each step with a penalty.  The score
is the posterior of the best language.

Null text, or text without a letter, is `und` with score 0.  With no labelled row everything is `und`.
Repeated rows count and are predicted as often as they are there; extra columns are not read; a long text costs
one list of its words.
Ties go to the smaller language name.  A language is learned only from the rows that train.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.common import map_slices, pick

UNDETERMINED = "und"
#: Rows with crc32(doc_id as text) mod FOLDS = 0 are held out of training.
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Weight that is left with each order that a word steps down.
STEP = 0.6
#: What one word may say at most, in nats, for or against a language.
CLIP = 6.0
CACHE = 250_000


def held_out():
    """A null doc_id has no remainder; such rows never train, so they count as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))


class Model(dict):
    """Log frequencies per language, centred over the languages.  As a dict it maps words to rows of `table`;
    unseen words get their backed-off row on first use.  Once there are `CACHE` of them, all are forgotten."""

    def __init__(self, languages: list[str], words: list[str], table: np.ndarray, grams: dict[int, dict[str, int]],
                 gram_table: np.ndarray):
        super().__init__(zip(words, range(len(words))))
        self.languages, self.grams, self.gram_table, self.known = languages, grams, gram_table, len(words)
        self.table = np.concatenate([table, np.zeros((1024, max(1, len(languages))), dtype=np.float32)])

    def __reduce__(self):
        return Model, (self.languages, list(self)[:self.known], self.table[:self.known], self.grams, self.gram_table)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.backoff(word)
        self[word] = at
        return at

    def backoff(self, word: str) -> np.ndarray | float:
        """The mean row of the longest n-grams of the word that are known, flattened at each step down."""
        padded, weight = f" {word} ", 1.0
        for n in ORDERS:
            get = self.grams[n].get
            known = [g for i in range(len(padded) - n + 1) if (g := get(padded[i:i + n])) is not None]
            if known:
                return self.gram_table[known].sum(axis=0) * (weight / len(known))
            weight *= STEP
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text and self.languages else ()
        if not words:
            return UNDETERMINED, 0.0
        if len(self) > self.known + CACHE:
            for w in list(self)[self.known:]:
                del self[w]
        rows = list(map(self.__getitem__, words))  # may renew the table
        scores = self.table[rows].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(scores))
        return self.languages[best], float(1 / np.exp(np.clip(scores - scores[best], -700, 0)).sum())


def log_rows(counts: dict[str, Counter], languages: list[str], most: int) -> tuple[list[str], np.ndarray]:
    """The `most` most frequent keys over all languages, and their log frequencies per language, centred."""
    total = {lang: sum(counts[lang].values()) for lang in languages}
    share: Counter = Counter()
    for lang in languages:
        for k, n in counts[lang].items():
            share[k] += n / max(total[lang], 1)
    kept = sorted(share, key=lambda k: (-share[k], k))[:most]
    rows = np.zeros((len(kept), max(1, len(languages))))
    for j, lang in enumerate(languages):
        own = counts[lang]
        rows[:, j] = np.log([own[k] + 0.5 for k in kept]) - math.log(total[lang] + 0.5 * max(1, len(share)))
    return kept, np.clip(rows - rows.mean(axis=1, keepdims=True), -CLIP, CLIP).astype(np.float32)


def training_rows(docs: DataFrame, max_rows: int) -> DataFrame:
    """A sample of about `max_rows` training rows of each language: text, lang.  A language's share is set from the
    count of its labelled rows; a row is in if its doc_id's 64-bit hash lies in the language's part of the range."""
    labelled = pick(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null").filter(~held_out())
    least, span = -(1 << 63), float(1 << 64)
    limit = F.when(F.col("n") > max_rows, (F.lit(float(least)) + F.lit(max_rows * span) / F.col("n")).cast("bigint")).otherwise(F.lit((1 << 63) - 1))
    limits = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", limit.alias("limit"))
    return labelled.join(limits, "lang").filter(F.xxhash64("doc_id") <= F.col("limit")).select("text", "lang")


def most_frequent(words: DataFrame, each: int, parts: int = 64) -> DataFrame:
    """The `each` most frequent words of every language; cut by hash part first, so that no task sorts a whole
    language."""
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(parts))).orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    cut = words.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= each)
    return cut.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= each).drop("r")


def fit(docs: DataFrame, max_rows: int = 2_000, max_words: int = 40_000, max_grams: int = 20_000) -> Model:
    """Word counts by language are made on the executors and pre-aggregated before the shuffle; what reaches the driver
    is, of the bounded sample, 2 x `max_words` words over all languages, dealt evenly, and at least 1,000 of each."""
    sample = training_rows(docs, max_rows)
    words = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    )
    spoken = pick(docs, "doc_id", "lang").filter("lang is not null").filter(~held_out()).select("lang").distinct().count()
    counts: dict[str, Counter] = {}
    for lang, word, n in most_frequent(words, max(1_000, 2 * max_words // max(1, spoken))).collect():
        counts.setdefault(lang, Counter())[word] = n
    languages = sorted(counts)
    grams = {n: {lang: Counter() for lang in languages} for n in ORDERS}
    for lang in languages:
        for word, many in counts[lang].items():
            padded = f" {word} "
            for n in ORDERS:
                for i in range(len(padded) - n + 1):
                    grams[n][lang][padded[i:i + n]] += many
    known, at = {}, 0
    parts = [np.zeros((0, max(1, len(languages))), dtype=np.float32)]
    for n in ORDERS:
        keys, table = log_rows(grams[n], languages, max_grams)
        known[n] = {k: at + i for i, k in enumerate(keys)}
        at += len(keys)
        parts.append(table)
    return Model(languages, *log_rows(counts, languages, max_words), known, np.concatenate(parts))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        own = sent.value

        def each(part):
            found = [own.predict(t) for t in part.column(2).to_pylist()]
            return {"doc_id": part.column(0), "held_out": part.column(1), "lang_pred": [x for x, _ in found],
                    "score": [s for _, s in found]}

        return each

    rows = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return map_slices(rows, work, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns of documents, whose language is determined with at least this score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        own = sent.value

        def each(part):
            import pyarrow as pa

            found = [own.predict(t) for t in part.column(1).to_pylist()]
            part = part.filter(pa.array([x != UNDETERMINED and s >= least for x, s in found], type=pa.bool_()))
            return {n: part.column(i) for i, n in enumerate(("doc_id", "text", "lang", "source", "n_chars"))}

        return each

    return map_slices(pick(docs, "doc_id", "text", "lang", "source", "n_chars"), work,
                      "doc_id bigint, text string, lang string, source string, n_chars bigint")
