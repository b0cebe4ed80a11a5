"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector is cut into `LISTS` slices of components; a slice of a query and the slices of the candidates make
one score list, and the score of a pair is the sum of its entries over the lists.

Phase 1 gathers, for each query, the head of every list (its `k` highest entries) and scores those
candidates in full; the k-th highest score found is a safe lower bound.  Phase 2 sends the bound back,
divided evenly among the lists: a candidate that is below bound / LISTS in every list cannot reach the
bound, so only pairs with an entry at or above it are collected.  Phase 3 resolves the remaining scores of
these pairs exactly, drops those below the bound and keeps the k highest, ties to the smaller vec_id.  The
slices of a pair lie in the same task, so phases 2 and 3 share a pass.

Vectors travel as packed matrices of `CHUNK` candidates and `BLOCK` queries; each matrix of candidates meets
each block of queries once.  A task holds one such pair at a time, and emits at most k rows per query and
chunk; a partial selection in the task cuts them to k per query and task.

Components are floor(256 x), x as double.  Null vectors, vectors with a null or non-finite component and
null ids take no part; shorter vectors count as padded with zeros.  vec_id is a key: of rows that share one,
the smallest vector counts.  An empty table gives no rows; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.common import Kept, pick

LISTS = 2
CHUNK, BLOCK = 2048, 512
NOTHING = -(1 << 62)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the components as whole numbers, one row for each vec_id that takes part."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.lit(256.0))
    return (
        pick(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null")
        .select("vec_id", scaled.alias("v"))
        .filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .select("vec_id", F.transform("v", lambda x: F.floor(x).cast("bigint")).alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def packed(vectors: DataFrame, size: int, rows: str) -> DataFrame:
    """ids, v (rows as little-endian long), width: matrices of at most `size` vectors."""

    def run(batches):
        ids, matrix = [], []

        def out():
            width = max(map(len, matrix), default=0)
            whole = np.zeros((len(ids), width), dtype=np.int64)
            for i, v in enumerate(matrix):
                whole[i, :len(v)] = v
            made = pa.RecordBatch.from_arrays(
                [pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([whole.tobytes()], pa.binary()),
                 pa.array([width], pa.int64())], [rows + "_ids", rows + "_v", rows + "_width"])
            ids.clear()
            matrix.clear()
            return made

        for batch in batches:
            own, values = batch.column(0).to_pylist(), batch.column(1)
            flat, ends = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy() - values.offsets[0].as_py()
            for i, v in enumerate(own):
                ids.append(v)
                matrix.append(flat[ends[i]:ends[i + 1]])
                if len(ids) == size:
                    yield out()
        if ids:
            yield out()

    return vectors.mapInArrow(run, f"{rows}_ids binary, {rows}_v binary, {rows}_width bigint")


def matrices(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, queries, candidate ids, candidates; in floats where these give exact scores."""
    ids = [np.frombuffer(row[k], dtype=np.int64) for k in ("q_ids", "c_ids")]
    width = max(row["q_width"], row["c_width"])
    both = []
    for k, own in zip("qc", ids):
        m = np.frombuffer(row[k + "_v"], dtype=np.int64).reshape(len(own), row[k + "_width"])
        both.append(np.pad(m, ((0, 0), (0, width - m.shape[1]))))
    most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in both]
    kind = np.float32 if most[0] * most[1] * width < 1 << 24 else np.float64 if most[0] * most[1] * width < 1 << 53 else np.int64
    return ids[0], both[0].astype(kind), ids[1], both[1].astype(kind)


def lists(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The entries of each list: queries x candidates."""
    edges = np.linspace(0, q.shape[1], LISTS + 1).astype(int)
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(edges, edges[1:])]


def best_rows(ids: np.ndarray, scores: np.ndarray, kept: np.ndarray, k: int):
    """(row, id, score) of the k highest kept scores of each row, ties to the smaller id.  The columns come
    in the order of their ids."""
    low = np.float64(-np.inf) if scores.dtype != np.int64 else np.iinfo(np.int64).min
    shown = np.where(kept, scores, low)
    if shown.shape[1] > k:  # ties at the k-th score stay in until the ids decide
        bound = -np.partition(-shown, k - 1, axis=1)[:, k - 1:k] if shown.dtype != np.int64 else np.sort(shown, axis=1)[:, -k][:, None]
        kept = kept & (shown >= bound)
    rows, cols = np.nonzero(kept)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, dtype=int)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    rows, cols = rows[rank < k], cols[rank < k]
    return rows, ids[cols], scores[rows, cols].astype(np.int64)


def emitted(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (query, vec, score)], ["query_id", "vec_id", "score"])


def ordered(row: dict):
    q_ids, q, c_ids, c = matrices(row)
    order = np.argsort(c_ids)
    return q_ids, q, c_ids[order], c[order]


def heads(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1 in a chunk: each list's k highest candidates, with their whole scores."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, c_ids, c = ordered(row)
                entries = lists(q, c)
                total, other = sum(entries), c_ids[None, :] != q_ids[:, None]
                head = np.zeros(total.shape, dtype=bool)
                for entry in entries:
                    rows, ids, _ = best_rows(c_ids, entry, other, k)
                    head[rows, np.searchsorted(c_ids, ids)] = True
                rows, ids, scores = best_rows(c_ids, total, head, k)
                yield emitted(q_ids[rows], ids, scores)

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def collected(pairs: DataFrame, k: int) -> DataFrame:
    """Phases 2 and 3 in a chunk: pairs with an entry at the uniform threshold or above, resolved."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, c_ids, c = ordered(row)
                bounds = dict(zip(np.frombuffer(row["b_ids"], dtype=np.int64).tolist(),
                                  np.frombuffer(row["b_v"], dtype=np.int64).tolist()))
                bound = np.array([bounds.get(i, NOTHING) for i in q_ids.tolist()], dtype=np.int64)[:, None]
                entries = lists(q, c)
                reach = np.zeros((len(q_ids), len(c_ids)), dtype=bool)
                for entry in entries:
                    reach |= entry * LISTS >= bound
                reach &= c_ids[None, :] != q_ids[:, None]
                total = sum(entries)
                rows, ids, scores = best_rows(c_ids, total, reach & (total >= bound), k)
                yield emitted(q_ids[rows], ids, scores)

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def highest(rows: DataFrame, k: int) -> DataFrame:
    """rank within the query: the k best entries of each part first, then those of all parts."""
    best = lambda r, *part: r.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id", *part).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    parts = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    return best(best(parts, "part").drop("rank", "part"))


def top_k(vectors: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest scores of each row that satisfies `is_query`, against
    all other rows."""
    spark = vectors.sparkSession
    kept = Kept(spark, "topk")
    whole = kept(whole_vectors(vectors))
    queries = whole.filter(is_query)
    n_blocks = max(1, -(-queries.count() // BLOCK))
    chunks = kept(packed(whole, CHUNK, "c"))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    blocks = kept(
        dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
        .mapInArrow(pack_blocks, "block bigint, q_ids binary, q_v binary, q_width bigint"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block")
    spread = max(1, spark.sparkContext.defaultParallelism)

    def meeting(with_blocks: DataFrame) -> DataFrame:
        met = chunks.select("*", every).join(with_blocks, "block")
        return met.repartition(max(spread, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("block", "c_ids"))

    first = highest(heads(meeting(blocks), k), k)
    bound = first.groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
    bounds = kept(
        queries.select(F.col("vec_id").alias("query_id")).join(bound, "query_id", "left")
        .select(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block"), "query_id",
                F.when(F.col("n") >= k, F.col("score")).otherwise(F.lit(NOTHING)).alias("score"))
        .groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("rows"))
        .mapInArrow(pack_bounds, "block bigint, b_ids binary, b_v binary"))
    found = highest(collected(meeting(blocks.join(bounds, "block")), k), k)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def pack_blocks(batches):
    for batch in batches:
        for row in batch.to_pylist():
            own = row["rows"]
            width = max(len(r["v"]) for r in own)
            m = np.zeros((len(own), width), dtype=np.int64)
            for i, r in enumerate(own):
                m[i, :len(r["v"])] = r["v"]
            yield pa.RecordBatch.from_pydict({
                "block": [row["block"]], "q_ids": [np.array([r["vec_id"] for r in own], dtype=np.int64).tobytes()],
                "q_v": [m.tobytes()], "q_width": [width]})


def pack_bounds(batches):
    for batch in batches:
        for row in batch.to_pylist():
            cols = [np.array([r[k] for r in row["rows"]], dtype=np.int64).tobytes() for k in ("query_id", "score")]
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "b_ids": [cols[0]], "b_v": [cols[1]]})
