"""Lines of configs: one pass over the contests for all of them, fits without a copy of the rows per fold."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from duelgrid.config import EngineConfig
from duelgrid.operators import backtest as T, sweep as S
from tests.test_sweep import AS_OF, SCHEMA, assert_same, careers, collected, plain_loop

CONFIGS = [EngineConfig(), EngineConfig(base_k=40, move_penalty=0.3), EngineConfig(retention_per_year=0.8)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(careers(90), SCHEMA)


def test_levels_share_no_competitor(frame):
    """A contest's level is one more than the last of either side, so levels fold as arrays."""
    seen = {}
    for r in S.plan(frame).rows(0).orderBy("date", "contest_id").collect():
        assert r.level == max(seen.get(r.c1, -1), seen.get(r.c2, -1)) + 1
        seen[r.c1] = seen[r.c2] = r.level


@pytest.mark.parametrize("thin, alone", [(0, False), (10 ** 9, False), (0, True)])
def test_folds_by_arrays_by_rows_and_alone_agree(frame, monkeypatch, thin, alone):
    monkeypatch.setattr(S, "THIN_LEVEL", thin)
    plan = replace(S.plan(frame, slice_rows=45), alone=alone)
    h = S.history_rows(S.run(plan, CONFIGS, AS_OF)).cache()
    for i, engine in enumerate(CONFIGS):
        assert_same(collected(h.filter(F.col("config_id") == i)), plain_loop(careers(90), engine))


def test_contests_that_come_twice_are_numbered_as_by_windows(spark):
    rows = careers(40)
    twice = spark.createDataFrame(rows + rows, SCHEMA)
    order = ["contest_id", "competitor", "nth", "prev_date", "prev_label"]
    want = S.prepare(twice, [EngineConfig()], AS_OF)
    want = sorted(tuple(r) for i in (1, 2) for r in want.select("contest_id", *[F.col(f"{c}{i}") for c in ("c", "nth", "prev_date", "prev_label")]).collect())
    got = sorted(tuple(r) for r in S.sweep(twice, EngineConfig(), AS_OF).select(*order).collect())
    assert repr(got) == repr(want) and max(r[2] for r in got) > 10


def test_prices_of_a_contest_do_not_move_it_again(spark, frame):
    plan = replace(S.plan(frame), alone=False)
    some = [r for r in plan.rows(0).orderBy("contest_id").collect()][:6]
    prices = [(i * 10 + j, r.contest_id, r.c1 if j == 0 else r.c2, 2015, True) for i, r in enumerate(some) for j in range(2)]
    asks = spark.createDataFrame(prices, "price_id bigint, contest_id bigint, competitor bigint, year int, fav_won boolean")
    wide, size = S.run_wide(S.with_asked(plan, asks), CONFIGS, AS_OF, ["year", "fav_won"], asked=True)
    got = sorted((round(r[f"own_{j}"], 9), round(r[f"opp_{j}"], 9), j) for r in wide.collect() for j in range(size))
    want = []
    for j, engine in enumerate(CONFIGS):
        h = {k: v[0] - 1500 for k, v in plain_loop(careers(90), engine).items()}
        for r in some:
            x, y = round(h[r.contest_id, r.c1], 9), round(h[r.contest_id, r.c2], 9)
            want += [(x, y, j), (y, x, j)]
    assert size == len(CONFIGS) and [v for r in got for v in r] == pytest.approx([v for r in sorted(want) for v in r], abs=1e-8)


def test_fits_of_all_folds_equal_fits_of_copied_rows(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(900):
        x, z = rnd.gauss(0, 1), rnd.gauss(0, 1)
        rows.append((rnd.randrange(2), rnd.randrange(2001, 2009), rnd.random() < 1 / (1 + math.exp(-0.2 - x + z / 2)), x, z))
    df = spark.createDataFrame(rows, "part int, year int, fav_won boolean, x_0 double, x_1 double").repartition(5)
    folds = T.default_test_years(range(2001, 2009))
    got = T.fit_folds(df, 2, folds)
    assert len(got) == 4 * len(folds)
    long = df.select("year", "fav_won", F.explode(F.array(*[F.struct((F.col("part") * 2 + j).alias("config_id"), F.col(f"x_{j}").alias("x")) for j in (0, 1)])).alias("c")).select("year", "fav_won", "c.*")
    train = T.walk_forward(long, folds).filter("role = 'train'").withColumn("unit", F.concat_ws("/", "config_id", "fold"))
    want = T.fit_logistic(train, ["x"], "fav_won", by="unit")
    assert all(got[u, f] == pytest.approx(want[f"{u}/{f}"], abs=1e-9) for u, f in got)
    test = T.walk_forward(long, folds).filter("role = 'test'").withColumn("unit", F.concat_ws("/", "config_id", "fold"))
    held = {r.config_id: r for r in T.scores(test.withColumn("p", T.predict(want, [F.col("x")], F.col("unit"))), "p", "fav_won", ["config_id"]).collect()}
    for r in T.pooled_out_of_sample(df, 2).collect():
        assert tuple(r) == pytest.approx(tuple(held[r.config_id]), abs=1e-9)


def test_the_base_is_scored_with_the_first_line():
    asked = []

    def evaluate(configs):
        asked.append([c.base_k for c in configs])
        return [abs(c.base_k - 32) for c in configs]

    best, _, first, trail = T.coordinate_search(evaluate, EngineConfig(), passes=1, grid={"base_k": (12, 24, 32)})
    assert asked == [[24.0, 12.0, 32.0]] and best.base_k == 32 and first == 8
    assert [t[2:] for t in trail] == [(12.0, 20.0, False), (24.0, 8.0, False), (32.0, 0.0, True)]
