"""The rating sweep against a plain loop, in every execution mode."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duelgrid.config import EngineConfig
from duelgrid.operators import sweep as S

AS_OF = "2022-01-01"
SCHEMA = "contest_id bigint, date date, c1 bigint, c2 bigint, result1 string, result2 string, method string, division string"
MULT = {"KO/TKO": 1.4, "SUB": 1.35, "U-DEC": 1.0, "M-DEC": 0.9, "S-DEC": 0.8}


def careers(n=160, people=24, hot=0, seed=5):
    """Random calendar with long layoffs, open-weight contests and one competitor in a third of all rows."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        a = hot if i % 3 == 0 else rnd.randrange(1, people)
        b = rnd.choice([x for x in range(1, people) if x != a])
        day = dt.date(2012, 1, 1) + dt.timedelta(days=rnd.randrange(0, 3600, 7))
        r = rnd.choice([("W", "L"), ("L", "W"), ("D", "D"), ("NC", "NC")])
        rows.append((i, day if i % 41 else None, a, b, *r, rnd.choice(list(MULT) + ["DQ", "TKO - Doctor's Stoppage"]),
                     rnd.choice(["Light", "Interim Light", "Heavy", "Catch Weight"])))
    return rows


def plain_loop(rows, engine, as_of=dt.date(2022, 1, 1)):
    state, out = {}, {}
    edge = as_of - dt.timedelta(days=int(engine.boundary_years * 365.25)) if engine.boundary_years and not engine.era_start_year else None
    for cid, day, a, b, r1, r2, method, div in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        if engine.era_start_year and day.year < engine.era_start_year:
            continue
        score = {("W", "L"): 1.0, ("L", "W"): 0.0, ("D", "D"): 0.5}.get((r1, r2))
        if score is None:
            continue
        label = None if "Catch" in div else div.replace("Interim ", "")
        fam = "KO/TKO" if method.startswith(("KO/TKO", "TKO")) else method
        k = engine.base_k * (1 + (MULT.get(fam, 1.0) - 1) * engine.finish_spread)
        pre = []
        for who in (a, b):
            s = state.setdefault(who, {"r": 1500.0, "n": 0, "d": None, "w": None, "cut": False})
            if s["d"]:
                gap = (day - s["d"]).days / 30.44
                if gap > engine.grace_months:
                    s["r"] = 1500 + (s["r"] - 1500) * engine.retention_per_year ** ((gap - engine.grace_months) / 12)
            if label and s["w"] and label != s["w"]:
                s["r"] = 1500 + (s["r"] - 1500) * (1 - engine.move_penalty)
            if edge and day >= edge and not s["cut"]:
                s["r"] = 1500 + (s["r"] - 1500) * (1 - engine.boundary_regression)
                s["cut"] = True
            pre.append(s["r"])
        e = 1 / (1 + 10 ** ((pre[1] - pre[0]) / 400))
        for who, sc, ex, p in ((a, score, e, pre[0]), (b, 1 - score, 1 - e, pre[1])):
            s = state[who]
            kk = k * (engine.provisional_multiplier if s["n"] < engine.provisional_contests else 1)
            s.update(r=p + kk * (sc - ex), n=s["n"] + 1, d=day, w=label or s["w"])
            out[(cid, who)] = (p, s["r"])
    return out


def collected(history):
    return {(r["contest_id"], r["competitor"]): (r["rating_before"], r["rating_after"]) for r in history.collect()}


def assert_same(got, want, tol=1e-9):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=tol)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(careers(), SCHEMA)


@pytest.mark.parametrize("engine", [EngineConfig(), EngineConfig(base_k=40, move_penalty=0.3, finish_spread=2.0, retention_per_year=0.8),
                                    EngineConfig(era_start_year=2016), EngineConfig(boundary_years=None, provisional_contests=2)])
def test_matches_plain_loop(frame, engine):
    assert_same(collected(S.sweep(frame, engine, AS_OF)), plain_loop(careers(), engine))


@pytest.mark.parametrize("rows", [12, 45])
def test_slices_give_the_same_history(frame, rows):
    assert_same(collected(S.sweep(frame, EngineConfig(), AS_OF, slice_rows=rows)), plain_loop(careers(), EngineConfig()))


def test_a_slice_is_folded_in_more_than_one_task(spark, frame):
    """Competitors that do not meet within a slice go to different folds."""
    work = S.prepare(frame, [EngineConfig()], AS_OF)
    first = S.plan_slices(S.rated_contests(frame), 6)[0]
    rows = work.filter(first.condition())
    labels = S.components(rows.select("c1", "c2").distinct())
    assert labels.select("component").distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny folds are joined otherwise
    try:
        assert S.fold_slice(rows, None, labels).select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_configs_are_independent(frame):
    a, b = EngineConfig(), EngineConfig(base_k=50)
    both = S.sweep(frame, [a, b], AS_OF)
    assert_same(collected(both.filter("config_id = 0")), plain_loop(careers(), a))
    assert_same(collected(both.filter("config_id = 1")), plain_loop(careers(), b))


def test_later_contests_do_not_leak(frame):
    cut = dt.date(2017, 6, 1)
    full = S.sweep(frame, EngineConfig(), AS_OF).filter(F.col("date") < F.lit(cut))
    part = S.sweep(frame.filter(F.col("date") < F.lit(cut)), EngineConfig(), AS_OF)
    assert_same(collected(full), collected(part), 0)


def test_input_partitioning_does_not_matter(frame):
    assert_same(collected(S.sweep(frame.repartition(7, "method"), EngineConfig(), AS_OF)), plain_loop(careers(), EngineConfig()))


def test_text_ids(spark):
    rows = [(f"k{r[0]:04d}", r[1], f"p{r[2]}", f"p{r[3]}", *r[4:]) for r in careers(60)]
    df = spark.createDataFrame(rows, SCHEMA.replace("bigint", "string"))
    assert_same(collected(S.sweep(df, EngineConfig(), AS_OF, slice_rows=30)), plain_loop(rows, EngineConfig()))


def test_final_state_regresses_to_as_of(spark, frame):
    s = {r["competitor"]: r for r in S.final_states(S.sweep(frame, EngineConfig(), AS_OF), AS_OF).collect()}
    last = plain_loop(careers(), EngineConfig())
    for who, r in s.items():
        gap = (dt.date(2022, 1, 1) - r["last_date"]).days / 30.44
        want = r["at_last"] if gap <= 12 else 1500 + (r["at_last"] - 1500) * 0.92 ** ((gap - 12) / 12)
        assert r["rating"] == pytest.approx(want, abs=1e-9)
        assert r["peak"] == pytest.approx(max([1500.0] + [v[1] for k, v in last.items() if k[1] == who]), abs=1e-9)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 21)] + [(30 + i, 31 + i) for i in range(40)]
    got = {r["competitor"]: r["component"] for r in S.components(spark.createDataFrame(pairs, "c1 bigint, c2 bigint")).collect()}
    assert got[4] == 1 and got[12] == 10 and got[21] == 20 and got[70] == 30 and len(set(got.values())) == 4


def test_hot_day_is_cut(spark):
    rows = [(i, dt.date(2020, 1, 1), i % 7, 7 + i % 5, "W", "L", "SUB", "Light") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    slices = S.plan_slices(S.rated_contests(df), 40)
    sizes = [S.rated_contests(df).filter(s.condition()).count() for s in slices]
    assert sum(sizes) == 200 and max(sizes) < 120
    assert_same(collected(S.sweep(df, EngineConfig(), AS_OF, slice_rows=40)), plain_loop(rows, EngineConfig()))


def test_one_plan_serves_many_sweeps(spark, frame):
    """Calendar, slices and labels are made once; each sweep over them equals one from the contests."""
    configs = [EngineConfig(), EngineConfig(base_k=40, move_penalty=0.3)]
    plan = S.plan(frame, slice_rows=40)
    assert len(plan.slices) > 2
    for engine in configs:
        assert_same(collected(S.history_rows(S.run(plan, [engine], AS_OF))), plain_loop(careers(), engine))
    slim = S.rating_rows(S.run(plan, configs, AS_OF, calendar=False)).collect()
    for i, engine in enumerate(configs):
        want = {k: v[0] for k, v in plain_loop(careers(), engine).items()}
        got = {(r["contest_id"], r["competitor"]): r["rating_before"] for r in slim if r["config_id"] == i}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    with pytest.raises(ValueError):
        S.run(plan, [EngineConfig(era_start_year=2016)], AS_OF)


def test_a_slice_is_large_enough_for_its_jobs(spark):
    """A slice is a dozen jobs: with slices of 200,000 rows a few million contests took hundreds of them."""
    days = spark.range(6_000_000).select(F.col("id").alias("contest_id"), F.date_add(F.lit("2012-01-01"), (F.col("id") % 3000).cast("int")).alias("date"))
    assert len(S.plan_slices(days, S.LEAST_SLICE_ROWS)) <= 2
