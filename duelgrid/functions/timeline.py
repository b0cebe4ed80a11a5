"""Order-dependent columns over each competitor's calendar without one task per competitor.

One competitor may own a third of all rows, so nothing here partitions by competitor alone:
windows run per (key, month) and month summaries (bounded by the calendar) carry counts and
sums across months. Positions over a whole division or table use value buckets the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def number_timeline(df: DataFrame, key: str = "competitor", running: dict[str, Column] | None = None,
                    date: str = "date", tie: str = "contest_id") -> DataFrame:
    """Add `nth` (0-based, oldest first), `rev` (1 = newest) and running sums per key."""
    running = running or {}
    df = df.withColumn("_month", F.trunc(date, "month"))
    for name, value in running.items():
        df = df.withColumn(f"_v_{name}", value)
    w = W.partitionBy(key, "_month").orderBy(date, tie)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumn("_n", F.row_number().over(w))
    for name in running:
        local = local.withColumn(f"_r_{name}", F.sum(f"_v_{name}").over(upto))
    summary = df.groupBy(key, "_month").agg(
        F.count("*").alias("_c"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in running])
    wp = W.partitionBy(key).orderBy("_month").rowsBetween(W.unboundedPreceding, -1)
    wall = W.partitionBy(key)
    prior = summary.select(
        key, "_month", F.coalesce(F.sum("_c").over(wp), F.lit(0)).alias("_prior"),
        F.sum("_c").over(wall).alias("_total"),
        *[F.coalesce(F.sum(f"_s_{n}").over(wp), F.lit(0.0)).alias(f"_p_{n}") for n in running])
    out = local.join(prior, [key, "_month"])
    out = out.withColumn("nth", F.col("_prior") + F.col("_n") - 1).withColumn("rev", F.col("_total") - F.col("nth"))
    for name in running:
        out = out.withColumn(name, F.col(f"_p_{name}") + F.col(f"_r_{name}"))
    return out.drop("_month", "_n", "_prior", "_total",
                    *[f"{p}{n}" for n in running for p in ("_v_", "_r_", "_p_")])


def positions(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "pos") -> DataFrame:
    """Exact row_number per group, computed per (group, bucket) plus bucket offsets.

    `bucket` must rise monotonically with `order`, so sorting buckets sorts the rows.
    """
    df = df.withColumn("_b", bucket)
    w = W.partitionBy(*group, "_b").orderBy(*order)
    counts = df.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    wg = (W.partitionBy(*group) if group else W.partitionBy(F.lit(1))).orderBy("_b")
    offsets = counts.select(
        *group, "_b", F.coalesce(F.sum("_c").over(wg.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return (df.withColumn("_n", F.row_number().over(w)).join(offsets, [*group, "_b"])
            .withColumn(name, F.col("_o") + F.col("_n")).drop("_b", "_n", "_o"))


def rolling_mean(df: DataFrame, key: str, value: str, size: int, name: str, index: str = "nth") -> DataFrame:
    """Mean of the last `size` rows (fewer at the start): every row feeds the next ones, grouped by position."""
    fed = df.select(key, F.explode(F.sequence(F.col(index), F.col(index) + F.lit(size - 1))).alias(index), value)
    means = fed.groupBy(key, index).agg((F.sum(value) / F.count(value)).alias(name))
    return df.join(means, [key, index])
