"""Tables that later runs add to or read: appended keys, kept histories."""

import pytest
from pyspark.sql import functions as F

from duelgrid.config import EngineConfig, FilterParams
from duelgrid.operators import surface, sweep
from duelgrid.operators.identity_rules import ORGANISATIONS, classified_history, title_dictionary
from duelgrid.sources import sinks as K


def test_an_append_does_not_shuffle_what_is_there(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda lo, hi: spark.createDataFrame([(i, f"v{lo}") for i in range(lo, hi)], "k bigint, v string")
    for lo, hi in ((0, 50), (30, 80), (30, 80)):
        K.append_new(rows(lo, hi), path, ["k"], spark)
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert got == {i: "v0" if i < 50 else "v30" for i in range(80)} and spark.read.parquet(path).count() == 80
    name = [t.name for t in spark.catalog.listTables() if t.name.startswith("appended_")][-1]
    plan = K.unseen(rows(0, 10), spark.table(name), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    join = plan[plan.index("SortMergeJoin"):]
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    lines = join.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    way, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):  # the ancestors of the old table's scan, up to the join
        if depth(line) < at:
            way, at = [*way, line], depth(line)
    assert way and not any("Exchange" in line for line in way), plan


def test_a_second_read_sweeps_nothing(ws, monkeypatch):
    engine = FilterParams.parse({"era": "all", "finish": "0.5"}).engine(ws.engine)
    first = ws.swept(engine).count()
    monkeypatch.setattr(sweep, "sweep", lambda *a, **k: pytest.fail("swept again"))
    assert ws.swept(engine).count() == first
    with pytest.raises(BaseException):
        ws.swept(EngineConfig(base_k=41.0))


def test_event_titles_name_their_organisation(spark):
    cases = {"Bellator 301": ("Bellator", "tier2_5"), "LFA 197 - Someone vs. Other": ("LFA", "tier3"), " jungle fight 107": ("Jungle Fight", "tier3"),
             "Alash Pride 3 - Finals": ("Alash Pride", "tier4"), "Extreme Shootout": ("Extreme Shootout", "tier4"), "WECX 1": ("WECX", "tier4"),
             "2 Hot": ("2 Hot", "tier4"), "ONE on TNT 1": ("ONE Championship", "tier2_5"), "UFC 1": None, "Ultimate Fighting Night": None}
    rows = spark.createDataFrame([(t,) for t in cases], "event_name string")
    got = {r.event_name: (r.canonical, r.tier) for r in classified_history(rows).collect()}
    assert got == {t: v for t, v in cases.items() if v}
    assert {r.canonical for r in title_dictionary(rows).filter("needs_review").collect()} == {"Alash Pride", "Extreme Shootout", "WECX", "2 Hot"}
    assert len(ORGANISATIONS) == 23


def test_an_era_reads_its_own_years(ws):
    plan = ws.contests_since(1999)._jdf.queryExecution().executedPlan().toString()
    assert f"{K.YEAR}" in plan[plan.index("PartitionFilters"):].split("]")[0] and ">= 1999" in plan
    every = {r.contest_id for r in ws.contests.filter("year(date) >= 1999").select("contest_id").collect()}
    assert {r.contest_id for r in ws.contests_since(1999).select("contest_id").collect()} == every and every


def test_a_year_delivered_again_leaves_the_others_files(spark, tmp_path):
    path = str(tmp_path / "years")
    rows = spark.sql("select id, case when id % 7 <> 0 then date_add(date'1998-12-25', cast(id as int)) end as date, 'a' as what from range(20)")
    K.write_years(rows, path)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet") if "1999" not in str(f)}
    before = files()
    table = K.write_years(rows.filter("year(date) = 1999").withColumn("what", F.lit("b")), path)
    assert files() == before and len(before) >= 2
    assert {(r.id, r.what) for r in table.collect()} == {(i, "b" if i % 7 and i >= 7 else "a") for i in range(20)}
    assert K.write_years(rows.limit(0), str(tmp_path / "none")).count() == 0


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    names = ["Ann", "Annan Ann", "José Aldo", "Jo", "J", "", None, "van  Bu", "Van Buren", "Ivan Bu", "anan", "x" * 300, "Ann"]
    people = spark.createDataFrame([(i, n, "D", i % 3) for i, n in enumerate(names)], "competitor int, name string, home_division string, contests int")
    index = surface.write_name_index(people, str(tmp_path / "index"))
    for text in ("an", "ann", "jose", "JO", "j", "", "n b", "van bu", "n  b", "anan", "xxx", "zz", "o a", "é!"):
        want = [tuple(r) for r in surface.search(people, text).collect()]
        assert [tuple(r) for r in surface.search_index(index, text).collect()] == want, text
    plan = surface.search_index(index, "vanb")._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan[plan.index("PartitionFilters"):].split("]")[0] and "In(run" in plan
