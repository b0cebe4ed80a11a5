"""Competitor analytics queries (G ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelgrid.functions import core as C
from duelgrid.operators import analytics as A
from duelgrid.plans.register import registrar

QUERIES, query = registrar()
DIVISION_ORDER = {"AFRICA": 1, "AMERICA": 2, "ASIA": 3, "EUROPE": 4, "MIDDLE EAST": 5}


@query("G1_elapsed_minutes")
def elapsed(ws):
    return ws.contests.select("contest_id", C.half_up(C.elapsed_minutes(F.col("round"), F.col("clock")), 4).alias("minutes"))


@query("G2_metric_samples")
def samples(ws):
    return ws.samples.select("competitor", "contest_id", "secs", "nth", "rev")


@query("G3_pace_windows")
def pace(ws):
    return ws.pace


@query("G4_G9_drift_and_ratio")
def drift(ws):
    return ws.pace_wide.drop("career", "recent", "last3")


@query("G5_G6_form_timeline")
def timeline(ws):
    return A.form_timeline(ws.samples)


@query("G7_durability")
def durability(ws):
    return A.durability(ws.sides, ws.pace)


@query("G8_finish_breakdown")
def finishes(ws):
    return A.finish_breakdown(ws.sides)


@query("G10_gauntlet_points")
def points(ws):
    return A.gauntlet_view(A.gauntlet_points(ws.log))


@query("G10_gauntlet_summary")
def gauntlet(ws):
    return A.gauntlet_summary(A.gauntlet_points(ws.log))


@query("G11_trend_codes")
def trend(ws):
    out = A.trend_codes(ws.pace_wide, ws.trend_context, A.durability(ws.sides, ws.pace))
    return out.withColumn("codes", F.array_join("codes", ","))


@query("G12_form_nudge")
def nudge(ws):
    return ws.pace_wide.select("competitor", A.form_nudge(F.col("diff15_delta"), F.col("td15_delta")).alias("nudge"))


def radar_frame(ws):
    ranked = ws.final.groupBy("competitor").agg(F.max_by("schedule_quality", "final_rating").alias("sos"))
    latest = ws.log.groupBy("competitor").agg(F.max("date").alias("latest"))
    return (ws.competitors.join(ranked, "competitor", "left").join(ws.states.select("competitor", "rating"), "competitor", "left")
            .join(latest, "competitor", "left")
            .select("competitor", F.col("home_division").alias("division"),
                    F.coalesce("sos", C.display_score(F.coalesce("rating", F.lit(1500.0)))).alias("sos"),
                    F.coalesce(C.months_between_days(F.col("latest"), ws.today), F.lit(999.0)).alias("months_since"),
                    (F.col("ko_rate") + F.col("sub_rate")).alias("finish_rate"), "accuracy", "ground_share"))


@query("G13_style_radar")
def radar(ws):
    out = A.radar(ws.sides, radar_frame(ws), ws.today)
    return out.select("competitor", *[C.half_up(F.col(c), 6).alias(c) for c in out.columns[1:]])


@query("G14_age")
def age(ws):
    return ws.births.select("competitor", C.whole_years(F.col("born"), ws.today).alias("age"),
                            (F.col("precision") != "day").alias("approximate"))


@query("G15_story_facts")
def story(ws):
    return A.story_facts(ws.log, ws.final, DIVISION_ORDER, ws.today).withColumn("codes", F.array_join("codes", ","))


@query("G16_style_and_highlights")
def style(ws):
    fin = F.col("ko_rate") + F.col("sub_rate")
    return ws.competitors.select(
        "competitor", A.style_label(F.col("ko_rate"), F.col("sub_rate"), F.col("accuracy"), fin).alias("style"),
        F.array_join(A.highlights(fin, F.col("ko_rate"), F.col("accuracy"), F.col("sub_rate")), ", ").alias("highlights"))


@query("G17_hash_pick")
def pick(ws):
    return ws.competitors.select("competitor", A.hash_pick(F.col("name"), 3).alias("choice"))


@query("G18_profile")
def profile(ws):
    return ws.profile


@query("G19_tenure")
def tenure(ws):
    return ws.log.groupBy("competitor").agg(
        C.half_up(F.datediff(ws.today, F.min("date")) / F.lit(365.25), 4).alias("tenure_years"),
        C.half_up(C.months_between_days(F.max("date"), ws.today), 1).alias("months_since"))


@query("G20_strip_scale")
def strip(ws):
    return A.strip_scale(ws.samples, ws.log)


@query("G21_recent_form")
def form(ws):
    f = A.recent_form(ws.log)
    return f.select("competitor", F.array_join(F.transform("form", lambda x: F.concat_ws(" ", x["result"], x["label"])), "; ").alias("form"))
