"""Parsing, rounding, names, prices and filters on tiny frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from duelgrid.config import EngineConfig, FilterParams
from duelgrid.functions import core as C
from duelgrid.functions.names import last_first_key, name_pair, normalize_name
from duelgrid.operators import market as M, pages as P


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [("12.5 lbs.", 12.5), ("", 0.0), ("None", 0.0), (None, 0.0), ("abc", 0.0), ("-3e2x", -300.0), (".5", 0.5)])
def test_lenient_number(spark, text, expected):
    assert one(spark, text, C.lenient_number) == expected


@pytest.mark.parametrize("text,expected", [("9 of 38", (9, 38)), ("---", (0, 0)), ("", (0, 0)), (None, (0, 0)), ("7", (7, 0)), (" 3 of 4 ", (3, 4))])
def test_landed_of(spark, text, expected):
    assert tuple(one(spark, text, C.landed_of)) == expected


@pytest.mark.parametrize("text,expected", [("1:44", 104), ("---", 0), ("0", 0), ("12", 12), (None, 0)])
def test_clock_seconds(spark, text, expected):
    assert one(spark, text, C.clock_seconds) == expected


@pytest.mark.parametrize("text,expected", [("May 16, 2026", dt.date(2026, 5, 16)), ("Jun 7, 2026", dt.date(2026, 6, 7)), ("garbage", None), ("", None)])
def test_long_date(spark, text, expected):
    assert one(spark, text, C.long_date) == expected


@pytest.mark.parametrize("value,digits,expected", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 2, 1.0), (-0.125, 2, -0.12)])
def test_half_up(spark, value, digits, expected):
    assert one(spark, value, lambda c: C.half_up(c, digits), "double") == expected


@pytest.mark.parametrize("text,expected", [
    ("Promo Lightweight Title Bout", "Lightweight"), ("Ultimate Fighter 5 Tournament Welterweight Bout", "Welterweight"),
    ("Women's Flyweight Bout", "Women's Flyweight"), ("Catch Weight", "Catch Weight")])
def test_division_labels(spark, text, expected):
    assert one(spark, text, lambda c: C.canonical_division(c, "Promo")) == expected


@pytest.mark.parametrize("text,expected", [("Interim Lightweight", "Lightweight"), ("Catch Weight", None), ("Openweight", None), ("", None), ("Heavyweight", "Heavyweight")])
def test_move_label(spark, text, expected):
    assert one(spark, text, C.move_label) == expected


@pytest.mark.parametrize("variant,expected", [
    ("resolver", "joao oconnorsmith jr"), ("loader", "joaooconnorsmith"), ("crosswalk", "joao o connor smith"),
    ("title", "joao oconnorsmith jr"), ("birth", "joaooconnorsmith"), ("upcoming", "joao o connor smith"), ("search", "joao oconnorsmith jr")])
def test_name_variants(spark, variant, expected):
    assert one(spark, "João O'Connor-Smith Jr.", lambda c: normalize_name(c, variant)) == expected


def test_digits_kept_by_some_variants(spark):
    got = {v: one(spark, "Agent 47", lambda c: normalize_name(c, v)) for v in ("resolver", "loader", "search")}
    assert got == {"resolver": "agent", "loader": "agent47", "search": "agent 47"}


def test_name_keys(spark):
    assert one(spark, "José van Aldo", last_first_key) == "aldo_j"
    assert one(spark, "Zumbi", last_first_key) == "zumbi"
    a = one(spark, "x", lambda c: name_pair(F.lit("Kai Kamaka III"), F.lit("B. C")))
    b = one(spark, "x", lambda c: name_pair(F.lit("b c"), F.lit("kai kamaka")))
    assert a == b


def brute_devig(fo, do, method):
    a, b = 1 / fo, 1 / do
    if method == "multiplicative":
        return a / (a + b)
    if method == "power":
        lo, hi = 1.0, 100.0
        for _ in range(80):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if a ** m + b ** m > 1 else (lo, m)
        t = (lo + hi) / 2
        return a ** t / (a ** t + b ** t)
    s = a + b
    if (a + b) / math.sqrt(s) < 1:
        return a / s
    p = lambda z, q: (math.sqrt(z * z + 4 * (1 - z) * q * q / s) - z) / (2 * (1 - z))
    lo, hi = 0.0, 0.999
    for _ in range(80):
        m = (lo + hi) / 2
        lo, hi = (m, hi) if p(m, a) + p(m, b) > 1 else (lo, m)
    z = (lo + hi) / 2
    return p(z, a) / (p(z, a) + p(z, b))


@pytest.mark.parametrize("method", M.METHODS)
def test_devig_against_bisection(spark, method):
    prices = [(1.5, 2.8), (1.91, 1.91), (1.04, 11.9), (1.01, 21.0), (1.2, 5.0), (2.1, 2.1), (1.3, 3.0)]
    df = spark.createDataFrame(prices, "f double, d double").select("f", "d", M.devig(F.col("f"), F.col("d"), method).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(brute_devig(r["f"], r["d"], method), abs=1e-9)


def test_price_conversion(spark):
    for american, dec in ((150, 2.5), (-200, 1.5)):
        assert one(spark, float(american), C.american_to_decimal, "double") == dec
        assert one(spark, dec, C.decimal_to_american, "double") == american


@pytest.mark.parametrize("text,expected", [
    ("2026-06-07T18:00:00-04:00", dt.date(2026, 6, 7)), ("Jun / 07 / 2026", dt.date(2026, 6, 7)), ("June 7, 2026", dt.date(2026, 6, 7)), ("", None), ("tba", None)])
def test_page_dates(spark, text, expected):
    assert one(spark, text, P.normal_date) == expected


def test_page_links(spark):
    html = ('<a href="/person/Ann-Lee-12">x</a><a href="/person/AnnLee-12">y</a><a href="/person/list">z</a>'
            '<a href="/person/Bo-Day-7">w</a>')
    got = P.numbered_links(spark.createDataFrame([(1, html)], "page_id int, html string"), "person").orderBy("pos").collect()
    assert [(r["number"], r["slug"]) for r in got] == [("12", "Ann-Lee-12"), ("7", "Bo-Day-7")]
    assert one(spark, "Ann-Lee-12", P.slug_name) == "Ann Lee"


def test_filters():
    assert FilterParams().engine() == EngineConfig()
    assert FilterParams.parse({}) == FilterParams()
    assert FilterParams.parse({"era": "2015x", "finish": "7", "recency": "bad"}) == FilterParams(2015, 1, 0.5, 0.5)
    harsh = FilterParams(activity_weight=1.0, recency_weight=1.0).engine()
    assert harsh.retention_per_year == pytest.approx(0.72) and harsh.half_life_months == pytest.approx(7.5)
    assert FilterParams(finish_weight=0.0).engine().finish_factor("KO/TKO") == 1.0


def test_win_probability_is_symmetric(spark):
    df = spark.createDataFrame([(1500.0, 1620.0), (1400.0, 1399.5)], "a double, b double")
    for r in df.select((C.win_probability(F.col("a"), F.col("b")) + C.win_probability(F.col("b"), F.col("a"))).alias("s")).collect():
        assert r["s"] == pytest.approx(1.0, abs=1e-12)
