"""Regression gate and sanity reports (ids J1-J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def golden_diff(golden: DataFrame, current: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Added, removed or reordered entries between two ranking snapshots, and whose score drifted.

    Both: division, competitor, rank, score.  An entry of both snapshots is reordered if its rank
    differs; drift is told apart from that, so a row can be both.
    """
    g = golden.select("division", "competitor", F.col("rank").alias("old_rank"), F.col("score").alias("old_score"))
    c = current.select("division", "competitor", F.col("rank").alias("new_rank"), F.col("score").alias("new_score"))
    x = g.join(c, ["division", "competitor"], "full_outer")
    kind = (F.when(F.col("old_rank").isNull(), "added").when(F.col("new_rank").isNull(), "removed")
            .when(F.col("old_rank") != F.col("new_rank"), "reordered").otherwise("same"))
    return x.withColumn("kind", kind).withColumn(
        "drift", F.coalesce(F.abs(F.col("old_score") - F.col("new_score")) > tolerance, F.lit(False)))


def golden_verdict(diff: DataFrame) -> DataFrame:
    """Structural changes fail, drift alone passes."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return diff.agg(n("added"), n("removed"), n("reordered"), F.count_if("drift").alias("drift")).withColumn(
        "passed", F.col("added") + F.col("removed") + F.col("reordered") == 0)


def load_summary(competitors: DataFrame, contests: DataFrame) -> DataFrame:
    """Volumes and plausibility counts, one aggregate per table."""
    c = contests.agg(
        F.count("*").alias("contests"), F.count_if(F.col("date").isNull()).alias("undated"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(~F.col("has_metrics")).alias("without_metrics"), F.count_distinct("event_id").alias("events"),
        F.count_if(F.col("c1") == F.col("c2")).alias("self_contests"))
    p = competitors.agg(F.count("*").alias("competitors"), F.count_if(F.col("home_division") == "").alias("without_division"),
                        F.count_if(F.col("contests") == 0).alias("without_contests"))
    one = F.lit(1)
    return c.withColumn("k", one).join(p.withColumn("k", one), "k").drop("k")


def invariants(by_organisation: DataFrame, pedigree: DataFrame, final: DataFrame, excluded: str, cap: float) -> DataFrame:
    """Each row is a rule and the number of violations (all must be 0).

    by_organisation: the product of E7, in whose nested lists the excluded organisation must not occur."""
    checks = [
        by_organisation.select(F.explode("by_organisation.organisation").alias("organisation")).agg(
            F.lit("excluded_organisation").alias("rule"), F.count_if(F.col("organisation").contains(excluded)).alias("violations")),
        pedigree.agg(F.lit("strength_cap").alias("rule"), F.count_if((F.col("strength") > cap) | (F.col("strength") < 0)).alias("violations")),
        final.agg(F.lit("nudge_cap").alias("rule"), F.count_if(F.abs("schedule_nudge") > 30).alias("violations")),
        final.groupBy("division", "rank").agg(F.count("*").alias("n")).agg(
            F.lit("unique_ranks").alias("rule"), F.count_if(F.col("n") > 1).alias("violations")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
