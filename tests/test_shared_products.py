"""Products that four findings at 6 GB share: what they no longer shuffle, and that their rows stay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duelgrid.functions.timeline import number_timeline
from duelgrid.operators import analytics as A, backtest as T, market as M, ranking as K, sweep as S


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_log_is_the_history_with_its_contests(ws):
    """It was joined to numbered sides, which were shuffled by competitor for it."""
    about = ws.sides.select("contest_id", "competitor", "method", "round", "details", "event_id", "name", "opponent_name")
    want = ws.history.join(about, ["contest_id", "competitor"])
    assert ws.log.columns == want.columns and ws.log.schema == want.schema
    assert sorted(map(repr, ws.log.collect())) == sorted(map(repr, want.collect()))
    text = plan_of(ws.logged(ws.folded))
    assert "/sides" not in text and "Window" not in text
    low = ws.log.agg(F.min("competitor")).first()[0]
    mine = sorted(map(repr, ws.log.filter(F.col("competitor") == low).collect()))
    assert mine and sorted(map(repr, ws.log_of(low).collect())) == mine


def test_products_without_numbers_read_no_numbered_sides(ws):
    keep = ws.sides.select(ws.laid_out.columns)
    assert set(ws.sides.columns) - set(keep.columns) == {"nth", "rev"} and "Exchange" not in plan_of(ws.laid_out)
    assert sorted(map(repr, ws.laid_out.collect())) == sorted(map(repr, keep.collect()))


def test_loss_streaks_are_counted_without_numbers(spark):
    rnd = random.Random(2)
    rows = [(i % 5, dt.date(2020, 1, 1) + dt.timedelta(rnd.randrange(40)), i, rnd.choice("LLLWD") if i % 5 else "L") for i in range(120)]
    rows += [(7, dt.date(2020, 1, 1), 900, "W"), (8, None, 901, "L"), (9, dt.date(2020, 1, 1), 902, None)]
    df = spark.createDataFrame(rows, "competitor int, date date, contest_id int, result string")
    got = {r.competitor: r.loss_streak for r in K.loss_streaks(df).collect()}
    want = {}
    for who in {r[0] for r in rows if r[1]}:
        run = 0
        for r in sorted((r for r in rows if r[0] == who and r[1]), key=lambda r: (r[1], r[2])):
            run = run + 1 if r[3] in ("L", None) else 0
        want[who] = run
    assert got == want and "Window" not in plan_of(K.loss_streaks(df))


def test_pace_windows_take_the_newest_rows(spark):
    cols = ["secs", "str_self", "str_opp", "td_self", "td_opp", "kd_self", "kd_opp", "sub_self", "ctrl_self"]
    rnd = random.Random(3)
    rows = [(i % 4 if i < 40 else 9, dt.date(2020, 1, 1) + dt.timedelta(rnd.randrange(30)), i, *[rnd.randrange(1, 900) for _ in cols], rnd.choice([0.0, 0.25]))
            for i in range(42)]
    df = spark.createDataFrame(rows, "competitor int, date date, contest_id int, " + ", ".join(f"{c} int" for c in cols) + ", acc_self double")
    got = {(r.competitor, r.window): (r.contests, r.minutes, r.kd_abs) for r in A.pace_windows(df).collect()}
    want = {}
    for who in {r[0] for r in rows}:
        seq = sorted((r for r in rows if r[0] == who), key=lambda r: (r[1], r[2]), reverse=True)
        for name, part in (("career", seq), ("recent", seq[:5]), ("last3", seq[:3])):
            if name == "career" or len(part) >= 3:
                want[who, name] = (len(part), int(sum(r[3] for r in part) / 60 + 0.5), None)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert A.pace_windows(number_timeline(df)).exceptAll(A.pace_windows(df)).count() == 0


@pytest.mark.parametrize("edges", [10 ** 6, 0])
def test_components_in_one_task_and_by_rounds(spark, monkeypatch, edges):
    monkeypatch.setattr(S, "ONE_TASK_EDGES", edges)
    pairs = [("b", "a"), ("c", "b"), ("x", "y"), ("z", "y"), ("q", "q")]
    got = {r.competitor: r.component for r in S.components(spark.createDataFrame(pairs * 3, "c1 string, c2 string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x", "q": "q"}


def test_nearest_day_reads_two_buckets_at_most(spark):
    """Each request was laid out on five days."""
    day = dt.date(2020, 5, 1)
    idx = spark.createDataFrame([(1, 2, day + dt.timedelta(k), k) for k in range(0, 60, 3)], "competitor int, opponent int, date date, contest_id int")
    req = spark.createDataFrame([(k, 1, 2, day + dt.timedelta(k)) for k in range(-4, 64)] + [(99, 1, 2, None)], "id int, competitor int, opponent int, date date")
    got = {r.id: r.hit.contest_id for r in M.nearest_day(req, idx, "id").collect()}
    want = {}
    for k in range(-4, 64):
        hits = [k + o for o in M.DAY_PREFERENCE if k + o in range(0, 60, 3)]
        if hits:
            want[k] = hits[0]
    assert got == want


def test_the_worst_misses_are_picked_once(spark):
    day = dt.date(2020, 1, 9)
    viewed = spark.createDataFrame([(i, day, 1, 2, i / 10) for i in range(6)], "price_id int, date date, winner int, loser int, model_winner double")
    sides = spark.createDataFrame([(1, dt.date(2020, 1, 2), 5, "W"), (2, dt.date(2020, 1, 2), 5, "L"), (1, day, 6, "L")], "competitor int, date date, contest_id int, result string")
    out = T.worst_misses(viewed, sides, 2)
    assert "TakeOrdered" not in plan_of(out)
    assert sorted((r.price_id, r.winner_form, r.loser_form) for r in out.collect()) == [(0, "W", "L"), (1, "W", "L")]
