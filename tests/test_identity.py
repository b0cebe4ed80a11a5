"""Identity matching verdicts, merges and patch rules on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelgrid.operators import identity as I, quality as Q


def verdict(spark, ours, foreign, own, theirs):
    o = spark.createDataFrame(ours, "competitor int, name string, division string")
    f = spark.createDataFrame(foreign, "foreign_id string, foreign_name string, foreign_division string")
    a = spark.createDataFrame(own, "competitor int, opp_key string")
    b = spark.createDataFrame(theirs, "foreign_id string, opp_key string")
    return {r["competitor"]: r for r in I.best_matches(o, f, a, b).collect()}


OWN = [(1, k) for k in ("a", "b", "c")]


def test_accent_difference_with_shared_opponents_is_verified(spark):
    r = verdict(spark, [(1, "Renato Moicaño", "L")], [("f1", "Renato Moicano", "L")], OWN, [("f1", k) for k in "abc"])[1]
    assert r["verdict"] == "verified" and r["overlap"] == 3 and r["score"] == 25 + 15 + 42


def test_namesakes_are_told_apart_by_opponents(spark):
    r = verdict(spark, [(1, "Dan Lee", "L")], [("f1", "Dan Lee", "L"), ("f2", "Dan Lee", "L")], OWN, [("f2", "a"), ("f2", "b")])[1]
    assert (r["foreign_id"], r["exact_rivals"], r["verdict"]) == ("f2", 2, "verified")


def test_no_candidates(spark):
    assert verdict(spark, [(1, "Dan Lee", "L")], [("f1", "Someone Else", "L")], OWN, [("f1", "a")]) == {}


def test_debutant_with_unique_name_is_verified(spark):
    assert verdict(spark, [(1, "Dan Lee", "L")], [("f1", "Dan Lee", "L")], [(9, "z")], [("f1", "z")])[1]["verdict"] == "verified"


def test_common_name_without_overlap_needs_review(spark):
    r = verdict(spark, [(1, "Dan Lee", "L")], [("f1", "Dan Lee", "L"), ("f2", "Dan Lee", "H")], OWN, [("f1", "z")])[1]
    assert r["verdict"] == "review"


def test_wrong_profile_is_not_verified(spark):
    r = verdict(spark, [(1, "Dan Lee", "L")], [("f1", "Rob Lee", "H")], OWN, [("f1", "z")])[1]
    assert r["verdict"] == "reject"


def test_name_cascade(spark):
    roster = spark.createDataFrame([(1, "José Aldo"), (2, "Jon Jones"), (3, "Jon Jones")], "competitor int, name string")
    names = spark.createDataFrame([("Jose Aldo",), ("Jon Jones",), ("J. Aldo",), ("Nick Name",), ("Nobody",)], "name string")
    over = spark.createDataFrame([("Nick Name", "José Aldo")], "alias string, target string")
    got = {r["name"]: (r["competitor"], r["matched_by"]) for r in I.resolve_names(names, roster, over).collect()}
    assert got == {"Jose Aldo": (1, "norm"), "Jon Jones": (3, "exact"), "J. Aldo": (1, "lf"), "Nick Name": (1, "override"), "Nobody": (None, "none")}
    strict = {r["name"]: r["competitor"] for r in I.resolve_names(names, roster, last_first=False).collect()}
    assert strict["J. Aldo"] is None


def test_ambiguous_alias_resolves_to_nothing(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 3)], "normalized_name string, canonical_id int")
    assert [tuple(r) for r in I.alias_registry(a).collect()] == [("y", 3)]


def test_patch_rules(spark):
    d = dt.date(2020, 6, 30)
    prim = spark.createDataFrame([(d, "Ann Lee", "Bo Day"), (d, "C", "D")], "date date, name1 string, name2 string")
    rows = [(1, d + dt.timedelta(7), "bo day jr", "Ann Lee"), (2, d + dt.timedelta(8), "Bo Day", "Ann Lee"),
            (3, d - dt.timedelta(61), "E", "F"), (4, d - dt.timedelta(60), "E", "F"), (5, None, "E", "F")]
    got = {r["patch_id"]: r["verdict"] for r in I.patch_verdicts(prim, spark.createDataFrame(rows, "patch_id int, date date, name1 string, name2 string")).collect()}
    assert got == {1: "duplicate", 2: "added", 3: "stale", 4: "added"}


def test_merges_drop_only_repeats_of_merged_people(spark):
    d = dt.date(2020, 1, 1)
    rows = [(1, d, 10, 5), (2, d, 11, 5), (3, d, 7, 8), (4, d, 8, 7), (5, dt.date(2020, 2, 1), 5, 11)]
    got = I.apply_merges(spark.createDataFrame(rows, "contest_id int, date date, c1 int, c2 int"),
                         spark.createDataFrame([(11, 10)], "secondary int, primary int"))
    assert sorted(r["contest_id"] for r in got.collect()) == [1, 3, 4, 5]
    assert {r["contest_id"]: r["c2"] for r in got.collect()}[5] == 10


def test_accumulating_merge(spark):
    fresh = spark.createDataFrame([("a", "b", 1, "new")], "lo string, hi string, date int, v string")
    prev = spark.createDataFrame([("a", "b", 1, "old"), ("a", "b", 2, "old2")], "lo string, hi string, date int, v string")
    got = {(r["date"], r["v"], r["origin"]) for r in I.accumulate(fresh, prev, ["lo", "hi", "date"]).collect()}
    assert got == {(1, "new", "fresh"), (2, "old2", "carried")}


@pytest.mark.parametrize("raw,code", [
    ("TKO (Doctor Stoppage)", "TKO - Doctor's Stoppage"), ("K.O. (Punch)", "KO/TKO"), ("Technical Submission (Armbar)", "SUB"), ("Technical Decision (Split)", "S-DEC"),
    ("Draw (Majority)", "M-DEC"), ("Decision", "U-DEC"), ("Disqualification", "DQ"), ("N/A", "CNC"), ("Triangle Choke", "SUB"), ("Walkover", "Other"), ("", "Other")])
def test_method_vocabulary(spark, raw, code):
    c, hit = I.map_method(F.col("x"))
    r = spark.createDataFrame([(raw,)], "x string").select(c.alias("c"), hit.alias("h")).first()
    assert r["c"] == code and r["h"] == (code != "Other")


def test_golden_gate(spark):
    s = "division string, competitor int, rank int, score double"
    g = spark.createDataFrame([("A", 1, 1, 90.0), ("A", 2, 2, 80.0)], s)
    drift = spark.createDataFrame([("A", 1, 1, 90.4), ("A", 2, 2, 81.0)], s)
    swap = spark.createDataFrame([("A", 2, 1, 90.0), ("A", 3, 2, 80.0)], s)
    ok = Q.golden_verdict(Q.golden_diff(g, drift)).first()
    bad = Q.golden_verdict(Q.golden_diff(g, swap)).first()
    assert ok["passed"] and ok["drift"] == 1
    assert not bad["passed"] and (bad["added"], bad["removed"], bad["reordered"]) == (1, 1, 1)
