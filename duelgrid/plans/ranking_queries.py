"""Division ranking queries (E ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelgrid.functions import core as C
from duelgrid.operators import ranking as K
from duelgrid.plans.register import registrar

QUERIES, query = registrar()


@query("E1_memberships")
def memberships(ws):
    m, _ = K.memberships(ws.external, ws.overrides)
    return m


@query("E2_eligibility")
def eligibility(ws):
    cand, div = ws._ranking_inputs(ws.engine)
    return K.eligible(ws.competitors, cand, div).select(
        "division", "competitor", "external_rank", "contests", F.coalesce("div_contests", F.lit(0)).alias("div_contests"))


@query("E3_recency_weight")
def recency(ws):
    w = C.recency_weight(F.col("date"), ws.today, 15.0)
    return ws.contests.groupBy("division").agg(F.count("*").alias("n"), C.half_up(F.sum(w), 6).alias("weight"))


@query("E4_schedule_strength")
def schedule(ws):
    _, div = ws._ranking_inputs(ws.engine)
    return K.schedule(div, ws.states, ws.as_of, 15.0).select(
        "division", "competitor", C.half_up(F.col("schedule_rating"), 6).alias("schedule_rating"))


@query("E5_metrics_composite")
def metrics(ws):
    _, div = ws._ranking_inputs(ws.engine)
    return K.metrics(div, ws.as_of, 15.0).select(
        "division", "competitor", C.half_up(F.col("composite"), 6).alias("composite"))


@query("E6_pedigree_strength")
def pedigree(ws):
    return ws.pedigree.select("competitor", "wins", "losses", "contests", "top_multiplier",
                              C.half_up(F.col("strength"), 6).alias("strength"))


@query("E8_pedigree_taper")
def taper(ws):
    """What the bonus would be after each contest."""
    h = ws.history.select("competitor", "nth")
    return h.join(ws.pedigree, "competitor").select(
        "competitor", "nth", C.half_up(K.pedigree_bonus(F.col("strength"), F.col("nth")), 6).alias("bonus"))


@query("E9_final_rating")
def scored(ws):
    return ws.ranked.drop("pos", "schedule_quality", "schedule_strength", "schedule_activity")


@query("E10_schedule_activity")
def activity(ws):
    return ws.ranked.select("division", "competitor", "schedule_quality", "schedule_strength", "schedule_activity")


@query("E11_rating_order")
def order(ws):
    return ws.ranked.select("division", "pos", "competitor", "final_rating", "schedule_rating")


@query("E12_head_to_head_edges")
def edges(ws):
    return ws.edges.withColumn("gap", C.half_up(F.col("gap"), 2))


@query("E13_head_to_head_order")
def h2h(ws):
    return K.h2h_positions(ws.moved).select("division", "pos_h2h", "competitor", "pos")


@query("E14_E15_final_order")
def final_order(ws):
    return ws.final.select("division", "rank", "competitor", "external_rank", "loss_streak", "is_champion")


@query("E16_loss_streak")
def streak(ws):
    return K.loss_streaks(ws.sides)


@query("E17_display_scores")
def display(ws):
    return ws.final.select("division", "rank", "competitor", "rank_score", "display_score")


@query("E18_division_rankings")
def rankings(ws):
    return ws.final.drop("pos", "pos_h2h")


@query("E19_contender_numbers")
def contenders(ws):
    return ws.final.select("division", "rank", "competitor", "is_champion", "contender_rank")


@query("E20_movement")
def movement(ws):
    shown = F.coalesce("contender_rank", "rank")
    return ws.final.select("division", "competitor", "external_rank", shown.alias("shown_rank"),
                           K.movement(F.col("external_rank"), shown).alias("movement"))


@query("E21_inversions")
def inversions(ws):
    return K.inversions(ws.final)
