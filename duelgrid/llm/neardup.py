"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

1. Every whole text becomes its set of five-word shingles (64-bit hashes) and a MinHash signature of
   bands x rows values, whose numbers follow from the threshold `least` (`shape`).  Documents of equal sets form a class at once; only its smallest doc_id goes on.
   A class may hold most rows, so it is gathered, and its result handed back, in `SALTS` parts.
2. Classes that share a band are candidates.  A band's bucket is not paired out: each member is tied to the
   smallest of its part of the bucket, the smallest ones of the `SALTS` parts to the smallest of all, and the
   components of these ties are the candidate groups.
3. A candidate group is cut into blocks of a bounded number of members and bytes, by hash; a task holds two
   blocks.  It compares their signatures batch by batch and drops a pair as soon as the posterior
   probability that its similarity reaches the threshold falls below `MISS`.  Survivors are verified on the
   full sets, the likeliest first; pairs that verified links already connect are not looked at again, so a
   task emits a spanning forest of its links, never all pairs.
4. Components of the links give the groups.

The chance to miss a pair is that of sharing no band, (1 - t^rows)^bands <= 1e-6 at the threshold t (36 bands
of 7 at 0.85, 46 of 6 at 0.80), plus MISS for each of the nine or ten batches.  What is linked is always verified.

Null or empty text: no shingles, its own group.  A null doc_id cannot name a group: such a row stays by
itself (component_id null, kept).  Rows that share a doc_id are one document.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.common import Kept, map_slices, pick
from duelgrid.llm.components import components

SHINGLE = 5
#: Linked if 100 x intersection >= least x union, by default this.
LEAST = 85
#: Values of a signature at most, and the chance that a pair at the threshold shares no band.
MOST_HASHES, UNSEEN = 1024, 1e-6
#: Signature values compared between two looks at the posterior, and the chance to drop a true pair at a look.
BATCH, MISS = 28, 1e-6
#: Members and shingles of a block, in the mean; a task holds two blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 384, 2_000_000
WORDS_KEPT = 300_000
#: Parts that the rows of one class of equal sets, or of one band's bucket, are dealt to.
SALTS = 16


def shape(least: int) -> tuple[int, int]:
    """(bands, rows) for a threshold in per cent: the most rows, and so the fewest chance candidates, that take
    280 values, or else as many as they need."""
    t, out = least / 100, (0, 0)
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(UNSEEN) / math.log1p(-t**rows))) if t < 1 else 1
        if out[0] and bands * rows > 280:
            break
        out = bands, rows
    if out[0] * out[1] > MOST_HASHES:
        raise ValueError(f"least = {least} is too low for signatures of {MOST_HASHES} values")
    return out


BANDS, ROWS = shape(LEAST)
HASHES = BANDS * ROWS

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_random = np.random.default_rng(20_011)
MULTIPLY = _random.integers(0, 1 << 32, MOST_HASHES, dtype=np.uint32) | np.uint32(1)
ADD = _random.integers(0, 1 << 32, MOST_HASHES, dtype=np.uint32)
MIX = [np.uint64(int(x) | 1) for x in _random.integers(1 << 62, 1 << 63, SHINGLE + 1, dtype=np.uint64)]
_FOLD = np.uint64(29)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    split = (text or "").encode().translate(LOWER).split()
    n = len(split)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(words.__getitem__, split), dtype=np.uint64, count=n)
    size = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        total = np.full(n - size + 1, size, dtype=np.uint64) * MIX[SHINGLE]
        for k in range(size):
            total = (total ^ (total >> _FOLD)) * MIX[k] + hashed[k:n - size + 1 + k]
        total = (total ^ (total >> _FOLD)) * MIX[SHINGLE]
        total ^= total >> _FOLD
    return np.unique(total)


def signature(own: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The upper halves of the smallest values under each hash."""
    least = np.full(hashes, 0xFFFFFFFF, dtype=np.uint32)
    low = (own >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(low), 2048):
        with np.errstate(over="ignore"):
            values = low[start:start + 2048, None] * MULTIPLY[:hashes]
            values += ADD[:hashes]
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint32(16)).astype(np.uint16)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sets_of(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit key, signature (null for an empty set)."""

    def work():
        words = WordHashes()

        def each(part):
            out = {"doc_id": part.column(0), "n_shingles": [], "a": [], "b": [], "signature": []}
            for text in part.column(1).to_pylist():
                own = shingles(text, words)
                key = xxhash.xxh3_128_intdigest(own.tobytes())
                out["n_shingles"].append(len(own))
                out["a"].append(signed(key >> 64))
                out["b"].append(signed(key & ((1 << 64) - 1)))
                out["signature"].append(signature(own, hashes).tobytes() if len(own) else None)
            return out

        return each

    return map_slices(pick(docs, "doc_id", "text"), work,
                      "doc_id bigint, n_shingles bigint, a bigint, b bigint, signature binary")


def band_rows(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """band, rep: one row for each band of each class."""
    columns = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def work():
        def each(part):
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, bands, rows)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(columns, values.shape[:2]).copy()
                for k in range(rows):
                    key = (key ^ (key >> _FOLD)) * MIX[k % len(MIX)] + values[:, :, k]
                key = (key ^ (key >> _FOLD)) * MIX[0]
            reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), bands)
            return {"band": pa.array(key.ravel().view(np.int64)), "rep": pa.array(reps)}

        return each

    return map_slices(classes.select("rep", "signature"), work, "band bigint, rep bigint")


@lru_cache(maxsize=8)
def least_matches(threshold: int = LEAST) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): below, the posterior of a uniform prior gives less than
    MISS to similarities at the threshold or above."""
    t, out, hashes = threshold / 100, [], math.prod(shape(threshold))
    for n in sorted({*range(BATCH, hashes + 1, BATCH), hashes}):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= MISS:
                break
            m += 1
        out.append((n, m))
    return out


def linked(x: np.ndarray, y: np.ndarray, least: int = LEAST) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= least * (len(x) + len(y) - both)


def links(ids: list[int], sets: list[np.ndarray], signatures: np.ndarray, side: np.ndarray,
          threshold: int = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the verified links between members of different sides, or of all members where
    there is one side."""
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() and not side.all() else (
        np.arange(len(ids)), np.arange(len(ids)))
    same = len(rows) == len(cols) and bool((rows == cols).all())
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    pairs, matches = [], []
    for start in range(0, len(rows), 64):
        some = rows[start:start + 64]
        a, b = np.meshgrid(some, cols, indexing="ij")
        fits = 100 * np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b])
        if same:
            fits &= a < b
        a, b = a[fits], b[fits]
        seen, done = np.zeros(len(a), dtype=np.int64), 0
        for n, least in least_matches(threshold):
            seen += (signatures[a, done:n] == signatures[b, done:n]).sum(axis=1)
            on = seen >= least
            a, b, seen, done = a[on], b[on], seen[on], n
            if not len(a):
                break
        pairs.append((a, b))
        matches.append(seen)
    if not pairs:
        return []
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in np.argsort(-np.concatenate(matches), kind="stable"):
        i, j = find(int(a[k])), find(int(b[k]))
        if i != j and linked(sets[a[k]], sets[b[k]], threshold):
            root[i] = j
            out.append((ids[a[k]], ids[b[k]]))
    return out


def verified(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """u, v: the links of each block or pair of blocks.  Rows come sorted by (grp, i, j); one such key is
    held at a time."""

    def run(batches):
        key, held, out = None, [], []

        def flush():
            if len(held) > 1:
                ids, sides, sets, signatures = zip(*held)
                out.extend(links(list(ids), [np.frombuffer(s, dtype=np.uint64) for s in sets],
                                 np.stack([np.frombuffer(s, dtype=np.uint16) for s in signatures]), np.array(sides), least))
            held.clear()

        for batch in batches:
            for grp, i, j, rep, own, shingle_set, sig in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, i, j) != key:
                    flush()
                    key = (grp, i, j)
                held.append((rep, int(own != i), shingle_set, sig))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=pa.int64()) for k in (0, 1)], ["u", "v"])
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=pa.int64()) for k in (0, 1)], ["u", "v"])

    return (blocks.select("grp", "i", "j", "rep", "own", "shingles", "signature")
            .repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
            .mapInArrow(run, "u bigint, v bigint"))


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members with the full shingle set, made anew from the text of the class's document."""

    def work():
        words = WordHashes()

        def each(part):
            out = {n: part.column(k) for k, n in enumerate(("rep", "a", "b", "grp", "blocks", "signature"))}
            sets = [shingles(t, words) for t in part.column(6).to_pylist()]
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            return out | {"shingles": [s.tobytes() for s in sets], "ka": [signed(k >> 64) for k in keys],
                          "kb": [signed(k & ((1 << 64) - 1)) for k in keys]}

        return each

    text = pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "rep")
    both = members.join(text, "rep").select("rep", "a", "b", "grp", "blocks", "signature", "text")
    made = map_slices(both, work, "rep bigint, a bigint, b bigint, grp bigint, blocks bigint, signature binary, "
                                  "shingles binary, ka bigint, kb bigint")
    return made.filter("a = ka and b = kb").drop("a", "b", "ka", "kb")


def salt(column: str) -> Column:
    """One of `SALTS` parts of a class or bucket, by the document."""
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")


def bucket_ties(bands: DataFrame) -> DataFrame:
    """u, v: edges that join the members of each bucket.  A member is tied to the smallest of its salt, and these
    at most `SALTS` to the smallest of all, so a bucket that holds most rows is spread over tasks."""
    parts = bands.groupBy("band", salt("rep")).agg(F.min("rep").alias("root"), F.count(F.lit(1)).alias("n"))
    roots = (parts.groupBy("band").agg(F.min("root").alias("v"), F.collect_list("root").alias("us")).filter("size(us) > 1")
             .select(F.explode("us").alias("u"), "v"))
    within = (bands.withColumn("salt", salt("rep")).join(parts.filter("n > 1").drop("n"), ["band", "salt"])
              .select(F.col("rep").alias("u"), F.col("root").alias("v")))
    return roots.unionByName(within).filter("u <> v")


def near_duplicates(docs: DataFrame, kept: Kept | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.  Linked are documents whose
    shingles are alike by `least` per cent or more."""
    n_bands, n_rows = shape(least)
    kept = kept or Kept(docs.sparkSession, "neardup")
    made = kept(sets_of(docs, n_bands * n_rows))
    whole = made.filter("doc_id is not null and n_shingles > 0")
    parts = whole.groupBy("a", "b", salt("doc_id")).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = kept(parts.groupBy("a", "b").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")))
    reps = kept(whole.join(classes.select("a", "b", F.col("rep").alias("doc_id")), ["a", "b", "doc_id"])
                .select(F.col("doc_id").alias("rep"), "a", "b", "n_shingles", "signature")
                .dropDuplicates(["rep", "a", "b"]))

    ties = bucket_ties(band_rows(reps, n_bands, n_rows))
    groups = kept(components(ties, kept).withColumnsRenamed({"node": "rep", "component": "grp"}))
    sizes = (reps.join(groups, "rep").groupBy("grp")
             .agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
                  .alias("blocks")))
    members = kept(reps.join(groups.join(sizes, "grp"), "rep").select("rep", "a", "b", "grp", "blocks", "signature"))
    blocks = (
        full_sets(docs, members)
        .withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    )
    found = kept(verified(blocks, least))
    joined = components(found, kept).withColumnsRenamed({"node": "rep"})
    # a document that is alone in its class and without links needs no partner here
    of_class = (classes.join(joined, "rep", "left").filter("n > 1 or component is not null")
                .select("a", "b", F.explode("salts").alias("salt"), F.coalesce("component", "rep").alias("component")))
    shown = (whole.select("doc_id", "n_shingles", "a", "b", salt("doc_id")).join(of_class, ["a", "b", "salt"], "left")
             .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    alone = made.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return shown.unionByName(alone).withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def one_of_each(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs, with all columns of documents, but those whose group has a smaller doc_id."""
    gone = near_duplicates(docs, least=least).filter(~F.col("kept")).select("doc_id").distinct()
    rows = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    return rows.join(gone, "doc_id", "left_anti").select(*rows.columns)
