"""Outside record broken down by organisation (id E7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelgrid.config import RankingConfig

R = RankingConfig()


def pedigree_by_organisation(rows: DataFrame, sides: DataFrame, excluded: tuple = (), cfg: RankingConfig = R) -> DataFrame:
    """Per competitor, record and strength before the debut with the organisations nested.

    Two aggregations: (competitor, organisation), then the competitor; the nested list has one
    entry per organisation, ordered by decided contests.
    """
    debut = sides.groupBy("competitor").agg(F.min("date").alias("debut"))
    keep = ~F.greatest(*[F.col("organisation").contains(x) for x in excluded], F.lit(False)) if excluded else F.lit(True)
    r = (rows.filter(keep & F.col("result").isin("win", "loss", "draw")).join(debut, "competitor")
         .filter(F.col("date").isNull() | (F.col("date") < F.col("debut"))))
    n = lambda k: F.count_if(F.col("result") == k)
    org = r.groupBy("competitor", "organisation").agg(n("win").alias("wins"), n("loss").alias("losses"), n("draw").alias("draws"),
                                                      F.max("tier").alias("tier"), F.max("tier_multiplier").alias("multiplier"))
    item = F.struct((-(F.col("wins") + F.col("losses"))).alias("o"), "organisation", "tier", "multiplier", "wins", "losses", "draws")
    a = org.groupBy("competitor").agg(
        F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.sum("draws").alias("draws"),
        F.max("multiplier").alias("best"), F.array_sort(F.collect_list(item)).alias("by_organisation"))
    decided = F.col("wins") + F.col("losses")
    rate = F.when(decided > 0, F.col("wins") / decided).otherwise(0.0)
    confidence = F.least((decided + F.col("draws")) / cfg.pedigree_full, F.lit(1.0))
    return a.withColumn("strength", F.least(rate * confidence * F.col("best"), F.lit(cfg.pedigree_cap)))
