import math

import numpy as np
import pytest

from duelgrid.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, is_query):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = [math.floor(256 * float(np.float32(x))) for x in v]
        best[i] = min(best.get(i, own), own)
    out = []
    for q in filter(is_query, best):
        scores = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.3, 500.0, 3e5])
def test_against_brute_force(spark, rows, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rnd = np.random.default_rng(1)
    data = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rnd.normal(0, scale, (120, 7)))]
    data += [(200, data[4][1]), (201, data[4][1]), (202, [0.0] * 7), (7, data[7][1])]
    frame = spark.createDataFrame([(*r, 0) for r in data], SCHEMA)
    assert sorted(rows(topk.top_k(frame, "vec_id % 10 = 0", 5))) == brute(data, 5, lambda i: i % 10 == 0)


def test_nulls_ties_and_few_candidates(spark, rows):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]),
            (6, [inf, 0.0]), (None, [1.0, 1.0]), (7, [-1.0, -1.0]), (8, [0.25]), (9, [])]
    frame = spark.createDataFrame([(*r, None) for r in data], SCHEMA)
    found = sorted(rows(topk.top_k(frame, "vec_id % 50 = 0", 10)))
    padded = [(i, v + [0.0] * (2 - len(v)) if v is not None and None not in v else v) for i, v in data]
    assert found == brute(padded, 10, lambda i: i % 50 == 0)
    assert [r[2] for r in found][:2] == [1, 2] and len(found) == 5


def test_a_common_vector_and_an_empty_table(spark, rows):
    data = [(i, [0.5, -0.5, 0.25]) for i in range(300)]
    frame = spark.createDataFrame([(*r, None) for r in data], SCHEMA)
    assert sorted(rows(topk.top_k(frame, "vec_id % 50 = 0", 5))) == brute(data, 5, lambda i: i % 50 == 0)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), "vec_id % 50 = 0", 5).collect() == []
    assert topk.top_k(frame, "vec_id < 0", 5).collect() == []
