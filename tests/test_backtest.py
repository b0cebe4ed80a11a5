"""Fits, folds, searches, timelines and the ledger against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.config import EngineConfig
from duelgrid.functions.timeline import number_timeline, positions, rolling_mean
from duelgrid.operators import backtest as T, ledger as L, market as M


def irls(x, y, steps=30):
    z = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        eta = z @ w
        mu = 1 / (1 + np.exp(-eta))
        g = np.maximum(mu * (1 - mu), 1e-9)
        w = np.linalg.solve(z.T @ (z * g[:, None]) + 1e-6 * np.eye(z.shape[1]), z.T @ (g * (eta + (y - mu) / g)))
    return w


def test_logistic_fit_per_group(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.gauss(0, 1), rnd.gauss(0, 1)) for g in ("a", "b") for _ in range(300)]
    rows = [(g, x, z, 1 if rnd.random() < 1 / (1 + math.exp(-(0.3 + x - 0.5 * z))) else 0) for g, x, z in rows]
    got = T.fit_logistic(spark.createDataFrame(rows, "g string, x double, z double, y int"), ["x", "z"], "y", by="g")
    for g in ("a", "b"):
        sub = [r for r in rows if r[0] == g]
        assert got[g] == pytest.approx(irls(np.array([[r[1], r[2]] for r in sub]), np.array([r[3] for r in sub])), abs=1e-8)


def test_default_test_years():
    assert T.default_test_years([2014, 2015, 2016]) == []
    assert T.default_test_years(range(2010, 2020)) == [2015, 2016, 2017, 2018, 2019]
    assert T.default_test_years([2014, 2015, 2016, 2017]) == [2017]


def test_coordinate_search_equals_one_by_one():
    target = {"base_k": 32, "move_penalty": 0.2, "finish_spread": 0.5}
    loss = lambda c: sum(abs(getattr(c, k) - v) for k, v in target.items())
    best, score, first, trail = T.coordinate_search(lambda cs: [loss(c) for c in cs], EngineConfig())
    assert {k: getattr(best, k) for k in target} == target and score == 0 and first == loss(EngineConfig())
    assert dict((k, b) for k, _, b in T.config_diff(EngineConfig(), best)) == {k: float(v) for k, v in target.items()}


def test_search_trail_over_the_tables_equals_one_by_one(ws):
    """Two passes over two knobs, a line per job, against one candidate per job."""
    from dataclasses import replace
    from duelgrid.plans.market_queries import score_line
    grid = {"base_k": (12, 40), "move_penalty": (0, 0.2)}
    got, got_score, first, trail = T.coordinate_search(lambda cs: score_line(ws, cs), ws.engine, passes=2, grid=grid)
    known = {}

    def one(config):
        if repr(config) not in known:
            known[repr(config)] = score_line(ws, [config])[0]
        return known[repr(config)]

    best, want = ws.engine, []
    for p in (1, 2):
        for knob, values in grid.items():
            for v in values:
                candidate = replace(best, **{knob: float(v)})
                better = one(candidate) < one(best) - 1e-6
                want.append((p, knob, float(v), better))
                best = candidate if better else best
    assert [(p, k, v, b) for p, k, v, _, b in trail] == want and got == best
    assert got_score == pytest.approx(one(best), abs=1e-9) and first == pytest.approx(one(ws.engine), abs=1e-9)


def test_scores_and_bins(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (1.0, True), (0.05, False)], "p double, won boolean")
    s = T.scores(df, "p", "won").first()
    want = (-math.log(0.9) - math.log(0.2) - math.log(1 - 1e-12) - math.log(0.95)) / 4
    assert s["log_loss"] == pytest.approx(want) and s["accuracy"] == 0.75 and s["n"] == 4
    bins = {r["bin"]: r["n"] for r in T.reliability(df, "p", "won").collect()}
    assert len(bins) == 10 and bins[9] == 2 and bins[8] == 1 and bins[0] == 1 and bins[5] == 0


def test_timeline_with_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 9), dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(900)), i, rnd.randrange(-5, 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "competitor int, date date, contest_id int, v int")
    out = number_timeline(df, running={"total": F.col("v").cast("double")})
    got = {(r["competitor"], r["contest_id"]): (r["nth"], r["rev"], r["total"]) for r in out.collect()}
    for who in {r[0] for r in rows}:
        seq = sorted((r for r in rows if r[0] == who), key=lambda r: (r[1], r[2]))
        run = 0
        for i, r in enumerate(seq):
            run += r[3]
            assert got[(who, r[2])] == (i, len(seq) - i, run)
    means = {(r["competitor"], r["nth"]): r["m"] for r in rolling_mean(out, "competitor", "v", 3, "m").collect()}
    seq = [r[3] for r in sorted((r for r in rows if r[0] == 0), key=lambda r: (r[1], r[2]))]
    for i in range(len(seq)):
        win = seq[max(0, i - 2):i + 1]
        assert means[(0, i)] == pytest.approx(sum(win) / len(win))


def test_positions_equal_row_number(spark):
    rows = [(i % 2, float((i * 37) % 50) / 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v double, competitor int")
    got = positions(df, ["g"], -F.floor("v"), [F.desc("v"), F.asc("competitor")])
    for g in (0, 1):
        order = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))]
        assert [r["competitor"] for r in got.filter(F.col("g") == g).orderBy("pos").collect()] == order


def test_nearest_day_preference(spark):
    d = dt.date(2020, 5, 10)
    idx = spark.createDataFrame([(1, 2, d + dt.timedelta(k), k) for k in (-2, -1, 1)], "competitor int, opponent int, date date, contest_id int")
    req = spark.createDataFrame([(7, 1, 2, d)], "id int, competitor int, opponent int, date date")
    assert M.nearest_day(req, idx, "id").first()["hit"]["contest_id"] == 1


def test_nearest_price_both_directions(spark):
    d = dt.date(2020, 5, 10)
    asked = spark.createDataFrame([(1, d, "a|b"), (2, d, "x|y")], "contest_id int, date date, pair string")
    prices = spark.createDataFrame([("a|b", d + dt.timedelta(k), i) for i, k in enumerate((44, -3, 3, -3, 90))] + [("x|y", d + dt.timedelta(46), 9)],
                                   "pair string, date date, price_id int")
    got = [(r["contest_id"], r["price_id"], r["gap"]) for r in M.nearest_prices(asked, prices, "contest_id").collect()]
    assert got == [(1, 1, 3)]


def test_ledger_freezes_and_settles(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    lit = lambda n: F.lit(day(n))
    preds = lambda p: spark.createDataFrame([(1, "e", day(10), 1, 2, p, None), (2, "e", day(10), 3, 4, p, None), (3, "e", day(10), 5, 6, p, None), (4, "e", day(0), 7, 8, p, None)],
                                            "slot_id bigint, event_id string, date date, c1 bigint, c2 bigint, prob1 double, form_prob1 double")
    book = L.freeze(spark.createDataFrame([], L.SCHEMA), preds(0.6), lit(0))
    assert {r["slot_id"] for r in book.collect()} == {1, 2, 3}            # same-day contests are never frozen
    book = L.freeze(book, preds(0.7), lit(5))
    assert {r["prob1"] for r in book.collect()} == {0.7}
    book = L.freeze(book, preds(0.9), lit(10))
    assert {r["prob1"] for r in book.collect()} == {0.7}                   # immutable from the day itself
    res = spark.createDataFrame([(2, 1, day(12), "L", "W"), (3, 4, day(9), "D", "D"), (5, 6, day(14), "W", "L")],
                                "c1 bigint, c2 bigint, date date, result1 string, result2 string")
    book = L.settle(book, res, lit(20))
    assert {r["slot_id"]: (r["status"], r["winner"]) for r in book.collect()} == {1: ("settled", 1), 2: ("void_draw", None), 3: ("pending", None)}
    late = L.settle(book, res, lit(30))
    assert {r["slot_id"]: r["status"] for r in late.collect()}[3] == "void_scratched"
