"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to `SYMBOLS` symbols.  Words one edit apart have reduced words at most one edit apart, so every
distinct reduced word generates its full one-edit neighbourhood (itself, all deletions, replacements, insertions)
and is joined to the reduced vocabulary; words of joined reduced words are verified on the original strings.  A
neighbour is a 64-bit polynomial hash over its symbols, derived from prefix sums, so a word of L letters costs
16 L numbers and never L strings; equal hashes of different reduced words only add candidates.  A pair is found
from both sides, and the side with the smaller hash keeps it.

Words are counted by a bounded counter in the task before they are shuffled.  `form` is the near word of largest
count (ties: the smaller in code-point order) if that has at least `RATIO` times the word's count; counts grow by
that factor along forms, so the last form of every chain is found by pointer doubling in log(log n) joins.

Null texts have no words; a null doc_id is the empty string in what is hashed; rows are counted as often as they
are repeated; a table without words gives no rows; extra columns are not read; texts and words of any length are
taken whole.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.common import Kept, pick, slices

#: Maximal runs of letters that can still be words after a deletion.
LEAST_LENGTH = 6
#: Occurrences from which a string is a word.
LEAST_COUNT = 5
#: How many times more frequent a form is than its variant.
RATIO = 5
#: Of so many runs one loses a letter, by the digest of document and run.
DAMAGE = 199
#: Letters of words, of A-Z the lower ones only.
LETTERS = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
#: Size of the reduced alphabet: neighbourhoods grow with it, false candidates shrink.
SYMBOLS = 8
#: Strings that a task counts before it hands the counts on.
COUNTED = 200_000
#: Letters of equally long words that are turned into neighbours together.
TOGETHER = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lowered(run: str, table=str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) -> str:
    return run if run.islower() else run.translate(table)


def damaged(doc_id: str, run: str) -> str:
    """The lower-cased run, without the letter that its digest names if it is one of `DAMAGE`."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n of all strings of at least `LEAST_LENGTH` code points and `least` occurrences."""
    schema = "word string, n bigint"

    def run(batches):
        find, seen = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}").findall, Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                name = "" if doc_id is None else str(doc_id)
                for raw, n in Counter(find(text)).items():
                    word = damaged(name, lowered(raw))
                    if len(word) >= LEAST_LENGTH:
                        seen[word] += n
            if len(seen) >= COUNTED:
                yield flush()
        yield flush()

    counts = pick(docs, "doc_id", "text").filter("text is not null").mapInArrow(run, schema)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def reduced_letters(symbols: int) -> str:
    """For each of `LETTERS` the symbol that stands for it."""
    return "".join(chr(ord("a") + zlib.crc32(c.encode()) % symbols) for c in LETTERS)


def digits_of(words: list[str]) -> np.ndarray:
    """Equally long reduced words as a matrix of 1 to the number of symbols."""
    flat = np.frombuffer("".join(words).encode("ascii"), dtype=np.uint8).reshape(len(words), -1)
    return flat.astype(np.uint64) - np.uint64(ord("a") - 1)


def powers(length: int) -> np.ndarray:
    out = np.ones(length + 1, dtype=np.uint64)
    out[1:] = BASE
    return np.cumprod(out, dtype=np.uint64)


def hashes(words: list[str]) -> np.ndarray:
    """Polynomial hashes (modulo 2^64) of equally long reduced words."""
    digits = digits_of(words)
    return (digits * powers(digits.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def neighbourhood(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(own hash, neighbour's hash) for all reduced words one edit away and the words themselves.  Strings that more
    than one edit gives are made once: of equal letters in a row the first is deleted, and no letter is put before
    its like."""
    digits = digits_of(words)
    rows, length = digits.shape
    weight = powers(length)
    before = np.zeros((rows, length + 1), dtype=np.uint64)
    np.cumsum(digits * weight[:-1], axis=1, dtype=np.uint64, out=before[:, 1:])
    whole = before[:, -1:]
    made = [whole]
    owners = [whole]

    def add(found: np.ndarray, keep: np.ndarray | None = None) -> None:
        own = np.broadcast_to(whole, found.shape)
        made.append(found.reshape(-1, 1) if keep is None else found[keep].reshape(-1, 1))
        owners.append(own.reshape(-1, 1) if keep is None else own[keep].reshape(-1, 1))

    fresh = np.ones((rows, length), dtype=bool)
    fresh[:, 1:] = digits[:, 1:] != digits[:, :-1]
    add(before[:, :-1] + (whole - before[:, 1:]) * INVERSE, fresh)
    size = np.uint64(symbols)
    for step in range(1, symbols):
        other = (digits - np.uint64(1) + np.uint64(step)) % size + np.uint64(1)
        add(whole + (other - digits) * weight[:-1])
        add(before[:, :-1] + other * weight[:-1] + (whole - before[:, :-1]) * BASE)
    for symbol in range(1, symbols + 1):
        add(whole + weight[-1:] * np.uint64(symbol))
    return np.concatenate(owners).ravel(), np.concatenate(made).ravel()


def by_length(words: list[str]):
    """Indices of equally long words, in groups of a bounded number of letters."""
    places: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(len(word), []).append(i)
    for length, found in places.items():
        step = max(1, TOGETHER // length)
        for start in range(0, len(found), step):
            yield found[start:start + step]


def with_hash(words: DataFrame, symbols: int) -> DataFrame:
    """word, n, reduced, k: the reduced word and its hash."""
    reduced = words.select("word", "n", F.translate("word", LETTERS, reduced_letters(symbols)).alias("reduced"))

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            k = np.zeros(len(texts), dtype=np.uint64)
            for group in by_length(texts):
                k[group] = hashes([texts[i] for i in group])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.view(np.int64))], names=["word", "n", "reduced", "k"])

    return reduced.mapInArrow(run, "word string, n bigint, reduced string, k bigint")


def reduced_pairs(keyed: DataFrame, symbols: int) -> DataFrame:
    """k, other (k <= other): hashes of reduced words of the vocabulary that are at most one edit apart."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for group in by_length(texts):
                own, made = (x.view(np.int64) for x in neighbourhood([texts[i] for i in group], symbols))
                keep = own <= made
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(made[keep])], names=["k", "other"])

    made = keyed.select("reduced").distinct().mapInArrow(run, "k bigint, other bigint")
    return made.join(keyed.select(F.col("k").alias("other")).distinct(), "other", "left_semi").select("k", "other").distinct()


def near_words(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, other, other_n: both directions of all pairs of words exactly one edit apart."""
    left = keyed.select("k", "word", "n")
    right = keyed.select(F.col("k").alias("other"), F.col("word").alias("word2"), F.col("n").alias("n2"))
    found = left.join(pairs, "k").join(right, "other").filter((F.col("k") < F.col("other")) | (F.col("word") < F.col("word2")))
    found = found.filter(F.levenshtein("word", "word2", 1) == 1)
    way = lambda a, b, n, m: F.struct(F.col(a).alias("word"), F.col(n).alias("n"), F.col(b).alias("other"), F.col(m).alias("other_n"))
    return found.select(F.explode(F.array(way("word", "word2", "n", "n2"), way("word2", "word", "n2", "n"))).alias("p")).select("p.*")


def roots(forms: DataFrame, most: int, kept: Kept) -> DataFrame:
    """word, root of the words that have a form (word, form): pointers are doubled as often as the longest chain needs
    that counts up to `most` allow."""
    chain = max(1, math.ceil(math.log(max(most, 2), RATIO)))
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(chain)) if chain > 1 else 0):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = kept(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found


def spelling_variants(docs: DataFrame, symbols: int = SYMBOLS, least: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents."""
    kept = Kept(docs.sparkSession, "spelling")
    keyed = kept(with_hash(count_words(docs, least), symbols))
    links = near_words(keyed, kept(reduced_pairs(keyed, symbols)))
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    words = keyed.select("word", "n").join(best, "word", "left")
    fits = -F.col("best.less") >= RATIO * F.col("n")
    words = kept(words.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                              F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 0
    last = roots(words.filter("form is not null").select("word", "form"), most, kept)
    return words.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
