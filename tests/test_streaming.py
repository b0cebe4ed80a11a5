"""Streams against the batch job, over repeated, late and single-row deliveries."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from duelgrid.config import EngineConfig
from duelgrid.operators import sweep as S
from duelgrid.streaming import jobs as J
from tests.test_sweep import AS_OF, SCHEMA, careers

FEED = "patch_id bigint, date date, name1 string, name2 string, c1 string, c2 string"


def deliver(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_online_ratings_count_a_contest_once(spark, tmp_path):
    rows = careers(60, 12)
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    dated = sorted((r for r in rows if r[1]), key=lambda r: r[1])
    deliver(spark, src, dated[:20] + dated[:3], SCHEMA)      # repeats in a file
    deliver(spark, src, dated[:20], SCHEMA)                  # a whole file twice
    deliver(spark, src, dated[35:50] + dated[5:8], SCHEMA)
    deliver(spark, src, dated[20:35], SCHEMA)                # late
    deliver(spark, src, dated[50:-1], SCHEMA)
    like = spark.createDataFrame(rows, SCHEMA)
    stream = lambda: J.file_stream(spark, src, like, 1)
    J.online_ratings(stream(), out, cp, AS_OF)
    before = files(f"{out}/state")
    deliver(spark, src, dated[-1:], SCHEMA)
    J.online_ratings(stream(), out, cp, AS_OF)
    written = {f for f in files(f"{out}/state") if f not in before}
    assert 1 <= len({os.path.dirname(f) for f in written}) <= 2          # one contest, two competitors
    want = S.sweep(like.filter("date is not null"), EngineConfig(), AS_OF)
    key = lambda df: {(r.contest_id, r.competitor): (r.rating_before, r.rating_after) for r in df.collect()}
    got, want = key(J.online_history(spark, out)), key(want)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    seen = {r.competitor: r.seen for r in J.online_state(spark, out).collect()}
    counts = {}
    for _, who in want:
        counts[who] = counts.get(who, 0) + 1
    assert seen == counts
    size = len(files(f"{out}/history"))
    deliver(spark, src, dated[:20], SCHEMA)                              # a replay changes nothing
    J.online_ratings(stream(), out, cp, AS_OF)
    assert key(J.online_history(spark, out)) == got and len(files(f"{out}/history")) == size


def test_ingest_state_follows_the_window(spark, tmp_path):
    primary = spark.createDataFrame([(1, dt.date(2020, 1, 10), "Ann A", "Bea B")], "contest_id bigint, date date, name1 string, name2 string")
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    day = dt.date(2020, 1, 1)
    for k in range(12):  # a delivery a month, each with a repeat of itself and of the one before
        rows = [(100 * k + i, day + dt.timedelta(days=30 * (k - j)), f"P{i}", "Q", "x", "y") for i in range(5) for j in (0, 0, 1) if k >= j]
        deliver(spark, src, rows, FEED)
    deliver(spark, src, [(5000, dt.date(2019, 1, 1), "Old", "Q", "x", "y"), (5001, dt.date(2020, 1, 14), "Bea B", "Ann A", "x", "y")], FEED)
    like = spark.createDataFrame([], FEED)
    q = J.guarded_ingest(J.file_stream(spark, src, like, 1), primary, out, cp)
    got = spark.read.parquet(out).groupBy("pair", "date").agg(F.count("*").alias("n"), F.min("patch_id").alias("p")).collect()
    assert len(got) == 60 and all(r.n == 1 for r in got)
    assert sorted(r.p for r in got) == [100 * k + i for k in range(12) for i in range(5)]
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(sizes) <= 5 * 7 and sizes[-1] <= 5 * 7


def test_ingest_state_lies_by_day_and_part(spark, tmp_path):
    """Many pairs of one day, some without a name, are few states; each pair is given out once, as first delivered."""
    primary = spark.createDataFrame([(1, dt.date(2020, 1, 10), "Ann A", "Bea B")], "contest_id bigint, date date, name1 string, name2 string")
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    day = dt.date(2020, 1, 20)
    name = lambda i: None if i == 7 else "P" + "".join(chr(97 + int(c)) for c in str(i))
    deliver(spark, src, [(1000 + i - 300 * j, day, name(i), "Q", "x", "y") for i in range(400) for j in (0, 1)], FEED)
    deliver(spark, src, [(i, day, name(i), "Q", "x", "y") for i in range(500)], FEED)
    q = J.guarded_ingest(J.file_stream(spark, src, spark.createDataFrame([], FEED), 1), primary, out, cp)
    got = spark.read.parquet(out)
    assert sorted(r.patch_id for r in got.collect()) == sorted([700 + i for i in range(400)] + list(range(400, 500)))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= J.DAY_PARTS


def test_every_price_is_matched_unmatched_or_late(spark, tmp_path):
    a, b, out, cp = (str(tmp_path / n) for n in ("a", "b", "out", "cp"))
    prices, contests = "price_id bigint, pair string, price_ts timestamp", "contest_id bigint, pair string, contest_ts timestamp"
    at = lambda month, day: dt.datetime(2020, month, day)
    for m in range(1, 6):
        deliver(spark, a, [(10 * m + i, f"p{i}", at(m, 3 + i)) for i in range(4)] + ([(10 * m + 9, None, at(m, 9))] if m == 2 else []), prices)
        deliver(spark, b, [(10 * m + i, f"p{i}", at(m, 4 + i)) for i in (0, 2)], contests)
    deliver(spark, a, [(99, "p0", at(1, 4))], prices)
    deliver(spark, a, [(None, "tick", at(9, 1))], prices)
    deliver(spark, b, [(None, "tock", at(9, 1))], contests)
    read = lambda p, s: J.file_stream(spark, p, spark.createDataFrame([], s), 1)
    q = J.price_results(read(a, prices), read(b, contests), out, cp)
    given = {(r.price_id, r.contest_id) for r in spark.read.parquet(out).filter("price_id is not null").collect()}
    late = {r.price_id for r in J.late_prices(spark.read.parquet(a), out, q.lastProgress["eventTime"]["watermark"]).collect()}
    assert late == {99}
    assert given == {(10 * m + i, 10 * m + i if i in (0, 2) else None) for m in range(1, 6) for i in range(4)} | {(29, None)}


LEDGER = "slot_id bigint, event_id string, date date, c1 bigint, c2 bigint, prob1 double, form_prob1 double, run_date date"


def test_settled_rows_keep_their_files(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    results = spark.createDataFrame([(1, 2, dt.date(2020, 1, 10), "W", "L"), (3, 4, dt.date(2020, 2, 10), "D", "D")], "c1 bigint, c2 bigint, date date, result1 string, result2 string")
    slot = lambda i, day, a, b, run: (i, "e", day, a, b, 0.6, None, run)
    runs = [dt.date(2020, 1, 1), dt.date(2020, 1, 20), dt.date(2020, 2, 20), dt.date(2020, 4, 1)]
    days = {1: (dt.date(2020, 1, 10), 1, 2), 2: (dt.date(2020, 2, 9), 3, 4), 3: (dt.date(2020, 3, 1), 5, 6), 4: (dt.date(2020, 5, 1), 7, 8)}
    kept = {}
    for run in runs:
        deliver(spark, src, [slot(i, d, a, b, run) for i, (d, a, b) in days.items()], LEDGER)
        J.ledger_stream(J.file_stream(spark, src, spark.createDataFrame([], LEDGER), 1), results, out, cp)
        now = files(f"{out}/closed")
        assert all(now.get(f) == t for f, t in kept.items())
        kept = now
    got = {r.slot_id: (r.status, r.winner, r.snapshot_on, r.settled_on) for r in J.ledger_rows(spark, out).collect()}
    assert got == {1: ("settled", 1, runs[0], runs[1]), 2: ("void_draw", None, runs[1], runs[2]), 3: ("void_scratched", None, runs[2], runs[3]), 4: ("pending", None, runs[3], None)}
