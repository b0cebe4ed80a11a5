"""Prices of two feeds, and the power method's early end."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from duelgrid.operators import market as M


def test_feeds_are_compared_without_a_broadcast(spark):
    """The exploded prices were taken for a small table and sent through the driver."""
    q = spark.createDataFrame([(1, "2001-02-03", "Ann Vab", "Bob Vad", 1.5, 2.5)], "quote_id bigint, date string, name1 string, name2 string, price1 double, price2 double")
    p = spark.createDataFrame([(7, "2001-02-05", "Bob Vad", "Ann Vab", 1.4, 2.7), (8, "2001-02-09", "Ann Vab", "Bob Vad", 1.4, 2.7)],
                              "price_id bigint, date string, favourite string, underdog string, fav_odds double, dog_odds double")
    gaps = M.feed_gaps(q.withColumn("date", F.to_date("date")), p.withColumn("date", F.to_date("date")))
    text = io.StringIO()
    with redirect_stdout(text):
        gaps.explain()
    assert "Broadcast" not in text.getvalue()
    row = gaps.first()
    assert row.quote_id == 1 and abs(row.gap - (2.5 / 4.0 - 1.4 / 4.1)) < 1e-12


def test_power_method_ends_early_at_the_same_value(spark):
    def plain(a, b):
        t = F.lit(1.0)
        for _ in range(3):
            x, y = F.pow(a, t), F.pow(b, t)
            t = F.least(F.greatest(t - (x + y - 1) / (x * F.ln(a) + y * F.ln(b)), F.lit(1.0)), F.lit(100.0))
        return F.pow(a, t) / (F.pow(a, t) + F.pow(b, t))

    rows = spark.createDataFrame([(0.7, 0.35), (0.5, 0.55), (0.9, 0.2), (0.5, 0.5), (None, 0.4)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    for r in rows.select(M._power(a, b, 3).alias("p"), plain(a, b).alias("q"), M._power(a, b).alias("end"), "a").collect():
        assert r.p == r.q
        if r.a is not None:
            assert 0 < r.end < 1
