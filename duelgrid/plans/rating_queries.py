"""Rating core queries (D ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelgrid.config import EngineConfig, FilterParams, SEARCH_GRID
from duelgrid.functions import core as C
from duelgrid.operators import sweep
from duelgrid.plans.register import registrar

QUERIES, query = registrar()
r6 = lambda c: C.half_up(F.col(c), 6).alias(c)


@query("D1_rating_history")
def rating_history(ws):
    return ws.history.select("contest_id", "date", "competitor", "opponent", "result", "nth",
                             r6("rating_before"), r6("rating_after"), r6("delta"), r6("opponent_rating"))


@query("D2_result_decision")
def result_decision(ws):
    s = C.score_of(F.col("result1"), F.col("result2"))
    return ws.contests.groupBy("result1", "result2", s.alias("score")).agg(F.count("*").alias("contests"))


@query("D3_expected_score")
def expected_score(ws):
    p = C.win_probability(F.col("rating_before"), F.col("opponent_rating"))
    return ws.history.select("contest_id", "competitor", C.half_up(p, 6).alias("expected"))


@query("D4_k_factor")
def k_factor(ws):
    k = (F.lit(24.0) * C.finish_multiplier(F.col("method"), ws.engine)
         * F.when(F.col("nth") < 5, F.lit(1.5)).otherwise(F.lit(1.0)))
    m = ws.contests.select("contest_id", "method")
    return ws.history.join(m, "contest_id").groupBy("method", (F.col("nth") < 5).alias("provisional")).agg(
        F.count("*").alias("n"), F.max(C.half_up(k, 6)).alias("k"))


@query("D5_inactivity_regression")
def inactivity(ws):
    """Ratings carried to later dates, where every competitor is inactive."""
    later = ws.states.select("competitor", "at_last", "last_date", F.explode(F.array(*[F.lit(y) for y in (0, 1, 2, 5)])).alias("years"))
    gap = C.months_between_days(F.col("last_date"), F.add_months(ws.today, F.col("years") * 12))
    return later.select("competitor", "years", C.half_up(gap, 6).alias("gap_months"),
                        C.half_up(C.regress(F.col("at_last"), gap, ws.engine), 6).alias("rating"))


@query("D6_division_moves")
def division_moves(ws):
    moved = F.col("prev_label").isNotNull() & F.col("label").isNotNull() & (F.col("prev_label") != F.col("label"))
    return ws.history.groupBy("competitor").agg(F.count("*").alias("contests"), F.count_if(moved).alias("moves"))


@query("D7_boundary_discount")
def boundary(ws):
    """The contest at which each competitor's earlier form is discounted."""
    edge = F.date_sub(ws.today, 1826)
    first = (F.col("date") >= edge) & (F.col("prev_date").isNull() | (F.col("prev_date") < edge))
    return ws.history.filter(first).select("competitor", "contest_id", "date", r6("rating_before"))


@query("D8_history_newest_first")
def newest_first(ws):
    return ws.history.select(
        "competitor", "rev", "contest_id", "date", "opponent", "result", r6("rating_after"), r6("delta"))


@query("D9_running_states")
def states(ws):
    return ws.states.select("competitor", "contests_rated", "last_date", "last_division", r6("peak"), r6("at_last"), r6("rating"))


@query("D10_default_state")
def default_state(ws):
    """Every customer id read as a competitor id: the unseen ones start at the mean."""
    ids = ws.table("customer").select(F.col("c_custkey").alias("competitor"))
    return sweep.with_rating(ids, ws.states).select("competitor", r6("rating"))


@query("D11_display_score")
def display(ws):
    return ws.states.select("competitor", C.half_up(C.display_score(F.col("rating")), 6).alias("display_score"),
                            C.half_up(C.display_score(F.col("peak") + 60), 6).alias("peak_display"))


FILTERS = FilterParams(finish_weight=0.8, recency_weight=0.7, activity_weight=0.9)


@query("D12_filtered_engine")
def filtered(ws):
    engine = FILTERS.engine(ws.engine)
    h = sweep.sweep(ws.contests, engine, ws.as_of)
    return sweep.final_states(h, ws.as_of, engine).select("competitor", "contests_rated", r6("peak"), r6("rating"))


@query("D12_era_filter")
def era(ws):
    engine = FilterParams(era_start_year=1999).engine(ws.engine)
    h = sweep.sweep(ws.contests_since(engine.era_start_year), engine, ws.as_of)
    return sweep.final_states(h, ws.as_of, engine).select("competitor", "contests_rated", r6("peak"), r6("rating"))


@query("D12_many_configs")
def many_configs(ws):
    """One sweep for a whole grid line: configs are a key next to the components."""
    line = [EngineConfig(base_k=float(k)) for k in SEARCH_GRID["base_k"][:3]]
    h = sweep.sweep(ws.contests, line, ws.as_of)
    return h.groupBy("config_id", "competitor").agg(
        F.count("*").alias("n"), C.half_up(F.max("rating_after"), 6).alias("peak"))
