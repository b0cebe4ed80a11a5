"""Market and backtest queries (H ids)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from duelgrid.config import SEARCH_GRID, EngineConfig
from duelgrid.functions import core as C
from duelgrid.functions.names import name_pair
from duelgrid.operators import backtest as T, market as M, sweep
from duelgrid.plans.register import registrar
from duelgrid.sources import bindings as B

QUERIES, query = registrar()
h = C.half_up
r6 = lambda c: h(F.col(c), 6).alias(c)


@query("H1_price_conversion")
def conversion(ws):
    american = C.decimal_to_american(F.col("fav_odds"))
    back = C.american_to_decimal(american)
    return ws.prices.select("price_id", american.alias("american"), h(back, 6).alias("decimal"),
                            h(C.implied_probability(back), 6).alias("implied"))


@query("H2_devig_methods")
def devig(ws):
    return ws.joined_prices.select("price_id", *[r6(f"p_{m}") for m in M.METHODS])


@query("H3_book_consensus")
def consensus(ws):
    return M.consensus(B.book_prices(ws.contests)).withColumn("close", h(F.col("close"), 6))


def quotes(ws):
    c = M.consensus(B.book_prices(ws.contests)).groupBy("contest_id").agg(
        F.max(F.when(F.col("side") == 1, F.col("close"))).alias("price1"),
        F.max(F.when(F.col("side") == 2, F.col("close"))).alias("price2"))
    return ws.contests.select(F.col("contest_id").alias("quote_id"), "date", "name1", "name2").join(
        c.withColumnRenamed("contest_id", "quote_id").hint("merge"), "quote_id")


@query("H4_feed_cross_validation")
def cross_validation(ws):
    return M.gap_summary(M.feed_gaps(quotes(ws), ws.prices))


@query("H4_largest_gaps")
def largest_gaps(ws):
    g = M.feed_gaps(quotes(ws), ws.prices).withColumn("gap", h(F.col("gap"), 6))
    return g.orderBy(F.desc("gap"), "quote_id").limit(6).select("quote_id", "date", "gap")


@query("H5_point_in_time")
def point_in_time(ws):
    return M.point_in_time(ws.history).select(
        "competitor", "opponent", "date", "contest_id", r6("self_rating"), r6("opponent_rating"), "nth", "provisional",
        r6("layoff_months"), "moved")


@query("H6_nearest_day")
def nearest(ws):
    asked = ws.resolved_prices.join(ws.prices.select("price_id", "date"), "price_id").filter(
        "fav_id is not null and dog_id is not null").select(
        "price_id", F.col("fav_id").alias("competitor"), F.col("dog_id").alias("opponent"), "date")
    hit = M.nearest_day(asked, M.point_in_time(ws.history), "price_id")
    return hit.select("price_id", F.col("hit.date").alias("date"), F.col("hit.contest_id").alias("contest_id"))


@query("H7_matchup_predictions")
def matchups(ws):
    j = ws.joined_prices.filter("model_p is not null")
    return j.select("price_id", r6("model_p"), r6("fav_rating"), r6("dog_rating"), "fav_no", "dog_no", "fav_provisional",
                    "dog_provisional", "both_established", r6("fav_layoff"), r6("dog_layoff"), "fav_moved", "dog_moved",
                    "division", "contest_date")


@query("H8_price_join_audit")
def price_audit(ws):
    return ws.joined_prices.groupBy("verdict").agg(F.count("*").alias("rows"), F.min("price_id").alias("first_id"))


@query("H8_unresolved_names")
def unresolved(ws):
    n = ws.price_names.filter("competitor is null")
    rows = ws.prices.select(F.explode(F.array("favourite", "underdog")).alias("name"))
    return rows.join(n.select("name"), "name", "left_semi").groupBy("name").agg(F.count("*").alias("rows"))


@query("C12_feed_name_resolution")
def feed_names(ws):
    return ws.price_names


def scored(df):
    return df.select(*[c for c in df.columns if c not in ("log_loss", "brier", "accuracy")],
                     *[r6(c) for c in ("log_loss", "brier", "accuracy")])


def long_models(ws):
    s = ws.samples_priced
    return s.select("price_id", "fav_won", "both_established", F.explode(F.array(
        F.struct(F.lit("model").alias("model"), F.col("model_p").alias("p")),
        F.struct(F.lit("market").alias("model"), F.col("market_p").alias("p")))).alias("x")).select(
        "price_id", "fav_won", "both_established", "x.*")


@query("H9_proper_scores")
def proper(ws):
    return scored(T.scores(long_models(ws), "p", "fav_won", ["model"]))


@query("H10_reliability")
def reliability(ws):
    c = T.reliability(long_models(ws), "p", "fav_won", ["model"])
    return c.select("model", "bin", "n", r6("predicted"), r6("realized"))


@query("H10_calibration_error")
def calibration(ws):
    c = T.calibration_error(T.reliability(long_models(ws), "p", "fav_won", ["model"]), ["model"])
    return c.select("model", r6("ece"))


@query("H11_logistic_fit")
def logistic(ws):
    s = ws.samples_priced.select("fav_won", T.logit(F.col("model_p")).alias("x1"), T.logit(F.col("market_p")).alias("x2"))
    w = T.fit_logistic(s, ["x1", "x2"], "fav_won")[0]
    fitted = s.withColumn("p", T.predict({0: w}, [F.col("x1"), F.col("x2")]))
    return fitted.agg(*[F.max(F.lit(round(v, 6))).alias(n) for n, v in zip(("intercept", "w_model", "w_market"), w)],
                      F.count("*").alias("n"), h(F.avg("p"), 6).alias("mean_p"))


@query("H12_best_devig_and_segments")
def segments(ws):
    """Every de-vig method and the model, overall and by segment, from one grouping-sets aggregate."""
    s = ws.samples_priced
    rows = s.select("fav_won", "both_established", F.explode(F.array(
        F.struct(F.lit("model").alias("source"), F.col("model_p").alias("p")),
        *[F.struct(F.lit(m).alias("source"), F.col(f"p_{m}").alias("p")) for m in M.METHODS])).alias("x")).select(
        "fav_won", F.when(F.col("both_established"), "established").otherwise("provisional").alias("segment"), "x.*")
    q = T.clip(F.col("p"))
    loss = F.when(F.col("fav_won"), -F.ln(q)).otherwise(-F.ln(1 - q))
    g = rows.groupingSets([[F.col("source"), F.col("segment")], [F.col("source")]], F.col("source"), F.col("segment")).agg(
        F.count("*").alias("n"), h(F.avg(loss), 6).alias("log_loss"))
    return g.select("source", F.coalesce("segment", F.lit("all")).alias("segment"), "n", "log_loss")


@query("H12_best_devig")
def best_devig(ws):
    s = ws.samples_priced
    rows = s.select("fav_won", F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(f"p_{m}").alias("p")) for m in M.METHODS])).alias("x")).select("fav_won", "x.*")
    return T.scores(rows, "p", "fav_won", ["method"]).agg(
        F.min_by("method", "log_loss").alias("best"), h(F.min("log_loss"), 6).alias("log_loss"))


@query("H13_holdout_scores")
def holdout(ws):
    s = T.chronological_split(ws.samples_priced, "price_id").withColumn("x1", T.logit(F.col("model_p"))).withColumn(
        "x2", T.logit(F.col("market_p")))
    train = s.filter("is_train")
    w1 = T.fit_logistic(train, ["x1"], "fav_won")
    w2 = T.fit_logistic(train, ["x1", "x2"], "fav_won")
    test = s.filter("not is_train")
    rows = test.select("fav_won", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in (
        ("raw", F.col("model_p")), ("calibrated", T.predict(w1, [F.col("x1")])), ("market", F.col("market_p")),
        ("blend", T.predict(w2, [F.col("x1"), F.col("x2")])))])).alias("x")).select("fav_won", "x.*")
    return scored(T.scores(rows, "p", "fav_won", ["model"]))


@query("H14_walk_forward_folds")
def folds(ws):
    s = ws.samples_priced
    years = [r[0] for r in s.select("year").distinct().collect()]
    return T.walk_forward(s, T.default_test_years(years)).groupBy("fold", "role").agg(F.count("*").alias("n"))


def evaluate_line(ws, configs):
    """Pooled out-of-sample scores of several configs: one sweep, one fit for all.

    Which contest a price belongs to does not depend on the config, so the plan holds it; neither do the calendar and the
    slices of the sweep.  The rows that are scored lie side by side, a column for each config.
    """
    rows, size = sweep.run_wide(ws.priced_plan, configs, ws.as_of, ["year", "fav_won"], asked=True)
    p = lambda j: C.win_probability(F.lit(1500.0) + F.col(f"own_{j}"), F.lit(1500.0) + F.col(f"opp_{j}"))
    return T.pooled_out_of_sample(ws.keep(f"line-{uuid4().hex[:8]}", rows.select(
        "part", "year", "fav_won", *[T.logit(p(j)).alias(f"x_{j}") for j in range(size)])), size)


@query("H15_grid_line")
def grid_line(ws):
    """The whole K line scored as one job."""
    line = T.grid_line(ws.engine, "base_k")
    out = evaluate_line(ws, line)
    values = F.create_map(*[F.lit(x) for i, v in enumerate(SEARCH_GRID["base_k"]) for x in (i, float(v))])
    return scored(out.select(values[F.col("config_id")].alias("base_k"), "n", "log_loss", "brier", "accuracy"))


def score_line(ws, configs):
    got = {r["config_id"]: r["log_loss"] for r in evaluate_line(ws, configs).collect()}
    return [got[i] for i in range(len(configs))]


def k_search(ws):
    """The search over the K line alone, from the default engine."""
    return T.coordinate_search(lambda cs: score_line(ws, cs), ws.engine, passes=1, grid={"base_k": SEARCH_GRID["base_k"]})


@query("H15_line_trail")
def line_trail(ws):
    """The trail of a search over one line: every candidate, its score, and whether it was taken."""
    rows = [(p, knob, v, s, better) for p, knob, v, s, better in k_search(ws)[3]]
    return ws.spark.createDataFrame(rows, "pass int, knob string, value double, log_loss double, taken boolean").withColumn(
        "log_loss", r6("log_loss"))


@query("H16_config_proposal")
def proposal(ws):
    """Every knob before and after the search of one line, with the scores of both."""
    best, after, before, _ = k_search(ws)
    changed = {k: (a, b) for k, a, b in T.config_diff(ws.engine, best)}
    rows = [(k, *changed.get(k, (float(getattr(ws.engine, k)),) * 2), k in changed, before, after) for k in SEARCH_GRID]
    return ws.spark.createDataFrame(rows, "knob string, now double, proposed double, changed boolean, loss_now double, loss_proposed double"
                                    ).withColumns({c: r6(c) for c in ("loss_now", "loss_proposed")})


@query("H16_rank_differences")
def rank_diff(ws):
    """Division order by raw rating under the base and a candidate config."""
    from duelgrid.operators.discovery import rank_difference
    other = EngineConfig(base_k=40.0, move_penalty=0.2)
    hist = sweep.sweep(ws.contests, [ws.engine, other], ws.as_of)
    return rank_difference(sweep.final_states(hist, ws.as_of), ws.competitors, depth=15)


@query("H17_coverage_by_year")
def cover_year(ws):
    return T.coverage(ws.joined_prices)[0]


@query("H17_coverage_by_division")
def cover_division(ws):
    return T.coverage(ws.joined_prices)[1]


def misses(ws):
    return T.for_winner(ws.samples_priced)


@query("H18_model_misses")
def model_misses(ws):
    m = misses(ws).filter((F.col("market_winner") >= 0.55) & (F.col("model_winner") < 0.4))
    out = T.worst_misses(m, ws.laid_out, 22)
    return out.select("price_id", "date", "division", "winner", "loser", r6("model_winner"), r6("market_winner"),
                      "winner_no", "loser_no", "winner_form", "loser_form", r6("loser_layoff"), "moved")


@query("H18_miss_tally")
def tally(ws):
    return T.miss_tally(T.worst_misses(misses(ws), ws.laid_out, 150))


@query("H19_model_vs_market")
def versus(ws):
    out = T.model_vs_market(ws.samples_priced.withColumn("market_p", F.col("p_multiplicative")))
    return out.select("matched", "disagreements", *[r6(c) for c in (
        "market_rate", "model_rate", "agreement", "underdog_rate", "mean_gap")])


@query("H19_value_spots")
def value_spots(ws):
    s = ws.samples_priced.withColumn("edge", h(F.col("model_p") - F.col("p_multiplicative"), 6))
    top = s.filter("fav_won and edge > 0").orderBy(F.desc("edge"), "price_id").limit(10).select(
        F.lit("favourite_edge").alias("list"), "price_id", "edge")
    dogs = s.filter("model_p < 0.5 and not fav_won").withColumn("edge", r6("model_p")).orderBy("edge", "price_id").limit(10).select(
        F.lit("live_underdog").alias("list"), "price_id", "edge")
    return top.unionByName(dogs)


@query("H20_analysis_export")
def export(ws):
    r3 = lambda c: h(c, 3)
    return ws.samples_priced.select(
        "price_id", "date", "event", "division", "favourite", "underdog", "fav_odds", "dog_odds", r3(F.col("model_p")).alias("model_p"),
        r3(F.col("market_p")).alias("market_p"), r3(F.col("model_p") - F.col("market_p")).alias("edge"), "fav_won", "both_established")


@query("H20_largest_disagreements")
def disagreements(ws):
    e = ws.samples_priced.filter("both_established").withColumn("edge", h(F.col("model_p") - F.col("market_p"), 6))
    return e.orderBy(F.desc(F.abs("edge")), "price_id").limit(40).select("price_id", "edge", "fav_won")


@query("H21_edge_verdict")
def edge(ws):
    v = M.edge_verdict(F.col("model_p"), F.col("fav_odds"), F.col("dog_odds"))
    return ws.joined_prices.filter("model_p is not null").select("price_id", v.alias("v")).select("price_id", "v.*")


@query("H22_title_candidates")
def title_cands(ws):
    c = M.title_candidates(B.title_format(ws.contests), ws.reigns, ws.as_of)
    return c.select("contest_id", "holder", "reign_id", "div_match", "established", "any_match", F.col("holders").cast("long").alias("holders"))


@query("H23_title_attribution")
def titles(ws):
    return ws.titles


def priced_titles(ws):
    names = ws.roster.select("competitor", "name")
    asked = (ws.titles.join(names.select(F.col("competitor").alias("champion"), F.col("name").alias("champion_name")), "champion")
             .join(names.select(F.col("competitor").alias("challenger"), F.col("name").alias("challenger_name")), "challenger")
             .select("contest_id", "date", "title_division", "reign_id", "champion", "challenger", "challenger_name",
                     name_pair(F.col("champion_name"), F.col("challenger_name"), "title").alias("pair")))
    p = ws.prices.select("price_id", "date", name_pair(F.col("favourite"), F.col("underdog"), "title").alias("pair"), "favourite",
                         "fav_odds", "dog_odds", "outcome")
    hit = M.nearest_prices(asked.select("contest_id", "date", "pair"), p, "contest_id")
    from duelgrid.functions.names import normalize_name
    fav = normalize_name(F.col("favourite"), "title") == normalize_name(F.col("challenger_name"), "title")
    return asked.join(hit, "contest_id", "left").select(
        "contest_id", "date", "title_division", "reign_id", "champion", "challenger", "price_id", "gap",
        F.when(F.col("price_id").isNotNull(), F.when(fav, F.col("fav_odds")).otherwise(F.col("dog_odds"))).alias("challenger_odds"),
        F.when(F.col("price_id").isNotNull(), ~fav).alias("challenger_is_underdog"), "outcome")


@query("H24_title_prices")
def title_prices(ws):
    return priced_titles(ws)


@query("H25_long_shot_challengers")
def long_shots(ws):
    return priced_titles(ws).filter("challenger_odds >= 4").select(
        "contest_id", "challenger_odds", (F.col("outcome") == "underdog").alias("won"),
        C.decimal_to_american(F.col("challenger_odds")).alias("american"))


@query("H25_reign_timelines")
def timelines(ws):
    n = ws.titles.groupBy("reign_id").agg(F.count("*").alias("title_contests"))
    return ws.reigns.join(n, "reign_id", "left").fillna(0, ["title_contests"])


@query("H25_unmatched_reigns")
def unmatched(ws):
    return ws.reigns.join(ws.titles.select("reign_id"), "reign_id", "left_anti").select("reign_id", "division", "holder", "start")


@query("H26_title_flags")
def flags(ws):
    t = ws.titles.select(C.pair_key(F.col("champion"), F.col("challenger")).alias("pair"), "date")
    rows = ws.log.select("contest_id", "competitor", "date", "label", C.pair_key(F.col("competitor"), F.col("opponent")).alias("pair"))
    return M.title_flags(rows, t).select("contest_id", "competitor", "is_title")
