"""Cross-division lists and discovery (ids F1-F9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelgrid.functions import core as C
from duelgrid.functions.timeline import positions

h = C.half_up


def ranked_pool(final: DataFrame) -> DataFrame:
    """one row per competitor over all divisions, the higher-rated appearance."""
    best = final.groupBy("competitor").agg(F.min(F.struct(-F.col("final_rating"), "division"))["division"].alias("division"))
    return final.join(best, ["competitor", "division"])


def top_list(pool: DataFrame, limit: int = 30) -> DataFrame:
    """global top list (TakeOrdered, then numbering of the few rows kept)."""
    top = pool.orderBy(F.desc("final_rating"), "competitor").limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("final_rating"), "competitor")))


def leaderboards(pool: DataFrame, career: DataFrame, limit: int = 15) -> DataFrame:
    """five boards from per-contest rates with a mild sample weight."""
    u = lambda c: C.clamp(c, 0.0, 1.0)
    n = F.greatest(F.col("contests"), F.lit(1))
    weight = 0.7 + 0.3 * u(F.col("contests") / 10)
    x = pool.select("competitor", "division", "contests", "finish_rate", "ko_rate", "sub_rate").join(
        career.select("competitor", "kd_total", "td_total", "sub_total", "ctrl_total", "accuracy", "ground_share", "distance_share"),
        "competitor")
    pct = lambda c: F.when(F.col(c) > 1, F.col(c) / 100).otherwise(F.col(c))
    boards = {
        "finishers": F.col("finish_rate") * weight,
        "knockouts": (F.col("ko_rate") * 0.7 + u(F.col("kd_total") / n) * 0.3) * weight,
        "submissions": (F.col("sub_rate") * 0.7 + u(F.col("sub_total") / n / 1.5) * 0.3) * weight,
        "strikers": pct("accuracy") * 0.4 + pct("distance_share") * 0.3 + u(F.col("kd_total") / n) * 0.3,
        "grapplers": u(F.col("td_total") / n / 3) * 0.4 + pct("ground_share") * 0.3 + u(F.col("ctrl_total") / n / 300) * 0.3,
    }
    rows = x.select("competitor", "division", F.explode(F.array(*[
        F.struct(F.lit(b).alias("board"), h(e, 6).alias("score")) for b, e in boards.items()])).alias("b")).select(
        "competitor", "division", "b.*").filter("score > 0")
    w = W.partitionBy("board").orderBy(F.desc("score"), "competitor")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def upper_median_by(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Upper median per group without collecting the group: rows are numbered per value bucket."""
    n = df.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    p = positions(df.filter(F.col(value).isNotNull()).select(by, value, "competitor"), [by], F.floor(F.col(value)),
                  [F.asc(value), F.asc("competitor")], "_p")
    return p.join(n, by).filter(F.col("_p") == F.floor(F.col("_n") / 2) + 1).select(by, F.col(value).alias(name), F.col("_n").alias(f"{name}_n"))


def division_benchmarks(final: DataFrame, wide: DataFrame, least: int = 10) -> DataFrame:
    """upper-median ratio and rates among ranked competitors; absent under ten samples."""
    x = final.select("division", "competitor").join(wide.filter("ratio_career is not null").select(
        "competitor", F.col("ratio_career").alias("ratio"), F.col("career.landed15").alias("landed15"),
        F.col("career.absorbed15").alias("absorbed15")), "competitor")
    out = upper_median_by(x, "division", "ratio", "ratio")
    for c in ("landed15", "absorbed15"):
        out = out.join(upper_median_by(x, "division", c, c).drop(f"{c}_n"), "division")
    return out.filter(F.col("ratio_n") >= least).select("division", "ratio", "landed15", "absorbed15", F.col("ratio_n").alias("sample"))


def division_depth(final: DataFrame, top: int = 15) -> DataFrame:
    """upper-median rating of each division's top, on one heat scale."""
    contenders = final.filter(F.col("contender_rank") <= top)
    d = upper_median_by(contenders.withColumnRenamed("final_rating", "v"), "division", "v", "depth").drop("depth_n")
    every = W.partitionBy(F.lit(1))      # one row per division
    low, high = F.min("depth").over(every), F.max("depth").over(every)
    return d.select("division", "depth", h(F.when(high > low, F.pow((F.col("depth") - low) / (high - low), F.lit(1.35))).otherwise(
        F.lit(0.0)), 6).alias("heat"))


def prospects(log: DataFrame, states: DataFrame, final: DataFrame, booked: DataFrame, competitors: DataFrame, ages: DataFrame,
              pedigree: DataFrame, today: Column, short_method, max_contests: int = 5, active_months: float = 15.0,
              least_outside: int = 3, limit: int = 20) -> DataFrame:
    """few contests, winning record, active or booked, no champion; ordered by rating.  With age, the place among
    contenders (best division) and the record elsewhere if it has `least_outside` contests."""
    label = F.concat(F.col("result"), F.lit(" "), short_method(F.col("method"), F.col("round")), F.lit(" vs. "), F.col("opponent_name"))
    a = log.groupBy("competitor").agg(
        F.count("*").alias("n"), F.count_if(F.col("result") == "W").alias("w"), F.count_if(F.col("result") == "L").alias("l"),
        F.max("date").alias("latest"), F.max(F.when(F.col("rev") == 1, label)).alias("last1"),
        F.max(F.when(F.col("rev") == 2, label)).alias("last2"))
    placed = final.groupBy("competitor").agg(F.min("contender_rank").alias("our_rank"))
    elsewhere = pedigree.filter(F.col("contests") >= least_outside).select("competitor", F.concat_ws("-", "wins", "losses").alias("outside_record"))
    x = (a.filter((F.col("n") <= max_contests) & (F.col("w") > F.col("l"))).join(final.filter("is_champion").select("competitor"), "competitor", "left_anti")
         .join(booked.select("competitor", F.col("date").alias("next_date")), "competitor", "left")
         .filter((C.months_between_days(F.col("latest"), today) <= active_months) | F.col("next_date").isNotNull())
         .join(states.select("competitor", "rating"), "competitor").join(competitors.select("competitor", "name", "home_division"), "competitor")
         .join(ages.select("competitor", "age"), "competitor", "left").join(placed, "competitor", "left").join(elsewhere, "competitor", "left"))
    return x.orderBy(F.desc("rating"), "competitor").limit(limit).select(
        "competitor", "name", "home_division", F.concat_ws("-", "w", "l").alias("record"), "n", "age", "our_rank", "outside_record",
        h(F.col("rating")).cast("bigint").alias("elo"), h((F.col("rating") - 1500) / F.col("n"), 1).alias("climb"),
        "last1", "last2", "next_date")


def outside_prospects(outside: DataFrame, known: DataFrame, names: DataFrame, active_since: str) -> DataFrame:
    """outside opponents (not in our roster) who beat roster competitors, results inverted."""
    rows = (outside.filter(F.col("opponent_id") != "").join(known, "opponent_id", "left_anti")
            .filter("result in ('win', 'loss')").join(names.select("competitor", "name"), "competitor", "left"))
    beat = F.col("result") == "loss"
    text = F.concat(F.lit("beat "), F.coalesce("name", F.lit("?")), F.lit(" ("), F.col("date").cast("string"), F.lit(")"))
    w = W.partitionBy("opponent_id").orderBy(F.desc("date"), F.desc("outside_id"))
    wins = rows.filter(beat).withColumn("text", text).withColumn("rn", F.row_number().over(w)).filter("rn <= 4")
    notable = wins.groupBy("opponent_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda s: s["text"]), "; ").alias("notable"))
    a = rows.groupBy("opponent_id").agg(F.count_if(beat).alias("beat"), F.count_if(~beat).alias("lost_to"),
                                        F.max("tier_multiplier").alias("top_multiplier"), F.max("date").alias("last_date"),
                                        F.max_by("opponent_name", F.struct("date", "outside_id")).alias("name"))
    return a.filter("beat > 0").join(notable, "opponent_id").withColumn("active", F.col("last_date") >= F.lit(active_since).cast("date"))


def rank_difference(states: DataFrame, competitors: DataFrame, depth: int, min_contests: int = 3) -> DataFrame:
    """F8: raw-rating division order of config 1 against config 0."""
    pool = competitors.filter((F.col("contests") >= min_contests) & (F.col("home_division") != "")).select(
        "competitor", F.col("home_division").alias("division"))
    rows = pool.join(states.select("config_id", "competitor", "rating"), "competitor")
    p = positions(rows, ["config_id", "division"], -F.floor("rating"), [F.desc("rating"), F.asc("competitor")], "place")
    old = p.filter(F.col("config_id") == 0).select("division", "competitor", F.col("place").alias("was"))
    new = p.filter((F.col("config_id") == 1) & (F.col("place") <= depth)).select("division", "competitor", F.col("place").alias("now"), "rating")
    return new.join(old, ["division", "competitor"], "left").select(
        "division", "competitor", "now", "was", (F.col("was") - F.col("now")).alias("gain"), h(F.col("rating"), 4).alias("rating"))


def pedigree_coverage(competitors: DataFrame, pedigree: DataFrame, sides: DataFrame, today: Column) -> DataFrame:
    """how many active and low-sample competitors carry an outside signal."""
    latest = sides.groupBy("competitor").agg(F.max("date").alias("latest"))
    x = competitors.join(latest, "competitor", "left").join(pedigree.select("competitor", "strength"), "competitor", "left")
    active = F.coalesce(C.months_between_days(F.col("latest"), today) <= 24, F.lit(False))
    signal = F.coalesce(F.col("strength") > 0, F.lit(False))
    return x.agg(F.count("*").alias("competitors"), F.count_if(active).alias("active"),
                 F.count_if(active & signal).alias("active_with_signal"),
                 F.count_if(F.col("contests") < 6).alias("low_sample"),
                 F.count_if((F.col("contests") < 6) & signal).alias("low_sample_with_signal"),
                 h(F.avg(F.when(signal, F.col("strength"))), 6).alias("mean_strength"))
