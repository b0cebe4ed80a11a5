"""Division ranking: eligibility, bounded adjustments, ordering rules (ids E1-E21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelgrid.config import EXTERNAL_RANK_SCORES, EngineConfig, RankingConfig
from duelgrid.functions import core as C
from duelgrid.functions.timeline import positions
from duelgrid.session import ensure_checkpoint_dir

R = RankingConfig()
LAST = 2 ** 31 - 1


def rank_seed(rank: Column) -> Column:
    out = F.lit(0)
    for label, score in EXTERNAL_RANK_SCORES.items():
        out = F.when(rank == label, F.lit(score)).otherwise(out)
    return out


def memberships(external: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(division, competitor, external_rank, seed) with overrides first, and the removals."""
    removals = overrides.filter("remove_from is not null").select(
        F.col("remove_from").alias("division"), "competitor").distinct()
    first = overrides.select("division", "competitor", "rank", F.lit(0).alias("priority"))
    listed = external.select("division", "competitor", "rank", F.lit(1).alias("priority")).join(
        removals, ["division", "competitor"], "left_anti")
    members = first.unionByName(listed).groupBy("division", "competitor").agg(
        F.min_by("rank", F.struct("priority", "rank")).alias("external_rank"))
    return members.withColumn("seed", rank_seed(F.col("external_rank"))), removals


def in_window(sides: DataFrame, as_of: str, engine: EngineConfig, cfg: RankingConfig = R) -> DataFrame:
    age = C.months_between_days(F.col("date"), F.lit(as_of).cast("date"))
    out = sides.filter(F.col("date").isNotNull()).withColumn("age", age).filter(F.col("age") <= cfg.cutoff_months)
    return out.filter(F.year("date") >= engine.era_start_year) if engine.era_start_year else out


def candidates(competitors: DataFrame, members: DataFrame, removals: DataFrame) -> DataFrame:
    """(competitor, division) pairs that could be eligible: home division or external membership."""
    home = competitors.filter("home_division <> ''").select("competitor", F.col("home_division").alias("division"))
    return (home.unionByName(members.select("competitor", "division")).distinct()
            .join(removals, ["division", "competitor"], "left_anti")
            .join(members, ["division", "competitor"], "left"))


def division_sides(sides: DataFrame, cand: DataFrame, as_of: str, engine: EngineConfig) -> DataFrame:
    """In-window contests of each candidate, flagged when they count toward the candidate's division."""
    label = C.move_label(F.col("s.division"))
    return (
        in_window(sides, as_of, engine).alias("s").join(cand.select("competitor", "division").alias("d"), "competitor")
        .select("competitor", F.col("d.division").alias("division"), "contest_id", "date", "age", "opponent", "result",
                "has_metrics", "str_self", "str_opp", "acc_self", "acc_opp", "kd_self", "td_self", "td_opp",
                (F.coalesce(label, F.col("d.division")) == F.col("d.division")).alias("counts")))


def eligible(competitors: DataFrame, cand: DataFrame, div: DataFrame, cfg: RankingConfig = R) -> DataFrame:
    """Enough contests, and a member or active in the home division."""
    activity = div.groupBy("division", "competitor").agg(
        F.count_if("counts").alias("div_contests"),
        F.max_by("counts", F.struct("date", "contest_id")).alias("latest_counts"),
        F.max(F.when(F.col("counts"), F.col("date"))).alias("last_div_date"))
    out = (cand.join(competitors, "competitor").filter(F.col("contests") >= cfg.min_contests)
           .join(activity, ["division", "competitor"], "left"))
    at_home = (F.col("home_division") == F.col("division")) & (F.col("div_contests") >= 2) & F.col("latest_counts")
    return out.filter(F.col("external_rank").isNotNull() | F.coalesce(at_home, F.lit(False)))


def schedule(div: DataFrame, states: DataFrame, as_of: str, half_life: float, cfg: RankingConfig = R) -> DataFrame:
    """Recency-weighted mean opponent rating over the schedule window."""
    weight = C.recency_weight(F.col("date"), F.lit(as_of).cast("date"), half_life)
    rows = div.filter(F.col("counts") & (F.col("age") / 12 <= cfg.schedule_years)).withColumn("w", weight)
    opp = states.select(F.col("competitor").alias("opponent"), F.col("rating").alias("opp_rating"))
    return (rows.join(opp, "opponent", "left")
            .withColumn("opp_rating", F.coalesce("opp_rating", F.lit(EngineConfig().initial_rating)))
            .groupBy("division", "competitor")
            .agg((F.sum(F.col("opp_rating") * F.col("w")) / F.sum("w")).alias("schedule_rating")))


def metrics(div: DataFrame, as_of: str, half_life: float, cfg: RankingConfig = R) -> DataFrame:
    """E5: composite of four normalised differentials over the last metric-bearing contests.

    The rank filter is pushed below the shuffle, so a hot competitor sends at most five rows per task.
    """
    w = W.partitionBy("division", "competitor").orderBy(F.desc("date"), F.desc("contest_id"))
    weight = C.recency_weight(F.col("date"), F.lit(as_of).cast("date"), half_life)
    top = (div.filter("counts and has_metrics").withColumn("rn", F.row_number().over(w))
           .filter(F.col("rn") <= cfg.metrics_recent).withColumn("w", weight))
    mean = lambda e: F.sum(e * F.col("w")) / F.sum("w")
    a = top.groupBy("division", "competitor").agg(
        mean(F.col("str_self") - F.col("str_opp")).alias("m_str"),
        mean(F.col("acc_self") - F.col("acc_opp")).alias("m_acc"),
        mean(F.col("kd_self")).alias("m_kd"), mean(F.col("td_self") - F.col("td_opp")).alias("m_td"))
    composite = (C.clamp(F.col("m_str") / cfg.n_volume, -1.0, 1.0) * cfg.w_volume
                 + C.clamp(F.col("m_acc") / cfg.n_accuracy, -1.0, 1.0) * cfg.w_accuracy
                 + C.clamp(F.col("m_kd") / cfg.n_knockdown, 0.0, 1.0) * cfg.w_knockdown
                 + C.clamp(F.col("m_td") / cfg.n_takedown, -1.0, 1.0) * cfg.w_takedown)
    return a.select("division", "competitor", composite.alias("composite"))


def pedigree_strength(external_history: DataFrame, sides: DataFrame, cfg: RankingConfig = R) -> DataFrame:
    """Record outside the organisation before the debut; historical tiers give no current credit."""
    debut = sides.groupBy("competitor").agg(F.min("date").alias("debut"))
    res = F.lower(F.trim("result"))
    rows = (external_history.join(debut, "competitor", "left")
            .filter("tier <> 'historical'")
            .filter(F.col("debut").isNull() | F.col("date").isNull() | (F.col("date") < F.col("debut")))
            .filter(res.isin("win", "loss", "draw")))
    a = rows.groupBy("competitor").agg(
        F.count_if(res == "win").alias("wins"), F.count_if(res == "loss").alias("losses"),
        F.count("*").alias("contests"), F.max(F.greatest("tier_multiplier", F.lit(0.0))).alias("top_multiplier"))
    rate = F.when(F.col("wins") + F.col("losses") > 0, F.col("wins") / (F.col("wins") + F.col("losses"))).otherwise(0.0)
    confidence = F.least(F.col("contests") / cfg.pedigree_full, F.lit(1.0))
    return a.select("competitor", "wins", "losses", "contests", "top_multiplier",
                    F.least(rate * confidence * F.col("top_multiplier"), F.lit(cfg.pedigree_cap)).alias("strength"))


def pedigree_bonus(strength: Column, contests: Column, cfg: RankingConfig = R) -> Column:
    """Full for a debutant, gone at `pedigree_taper` contests."""
    taper = F.greatest(F.lit(0.0), F.lit(1.0) - contests / cfg.pedigree_taper)
    return F.coalesce(strength * cfg.pedigree_max * taper, F.lit(0.0))


def schedule_activity(months_since: Column, contests: Column, cfg: RankingConfig = R) -> Column:
    """How current the record is, in [0, 1]."""
    recency = C.clamp(F.lit(1.0) - (months_since - cfg.activity_grace) / (cfg.activity_decay - cfg.activity_grace),
                      0.0, 1.0)
    cadence = C.clamp(contests / (cfg.schedule_years * cfg.activity_target), 0.0, 1.0)
    return (1 - cfg.activity_cadence) * recency + cfg.activity_cadence * cadence


def score(elig: DataFrame, div: DataFrame, states: DataFrame, pedigree: DataFrame | None, as_of: str,
          engine: EngineConfig, cfg: RankingConfig = R) -> DataFrame:
    """Every eligible competitor with its named, rounded components."""
    key = ["division", "competitor"]
    st = states.select("competitor", "rating", "peak", F.col("last_date").alias("last_rated"))
    out = (elig.join(schedule(div, states, as_of, engine.half_life_months, cfg), key, "left")
           .join(metrics(div, as_of, engine.half_life_months, cfg), key, "left").join(st, "competitor", "left"))
    if pedigree is not None:
        out = out.join(pedigree.select("competitor", "strength"), "competitor", "left")
    else:
        out = out.withColumn("strength", F.lit(None).cast("double"))
    n = F.coalesce("div_contests", F.lit(0))
    base = F.lit(engine.initial_rating)
    sched = F.coalesce("schedule_rating", F.lit(cfg.schedule_anchor))
    nudge = C.clamp((sched - cfg.schedule_anchor) * cfg.schedule_slope, -cfg.schedule_cap, cfg.schedule_cap)
    met = F.coalesce(F.col("composite") * cfg.metrics_scale * F.least(n / cfg.metrics_confidence, F.lit(1.0)), F.lit(0.0))
    last = F.coalesce("last_div_date", "last_rated")
    since = F.coalesce(C.months_between_days(last, F.lit(as_of).cast("date")), F.lit(999.0))
    out = out.withColumns({
        "base_rating": F.coalesce("rating", base), "peak_rating": F.coalesce("peak", base),
        "schedule_raw": sched, "nudge_raw": nudge, "metrics_raw": met,
        "external_raw": F.coalesce("seed", F.lit(0)) * cfg.external_scale,
        "pedigree_raw": pedigree_bonus(F.col("strength"), F.col("contests"), cfg), "since_raw": since})
    activity = schedule_activity(F.col("since_raw"), n, cfg)
    total = (F.col("base_rating") + F.col("metrics_raw") + F.col("nudge_raw") + F.col("external_raw")
             + F.col("pedigree_raw"))
    quality = C.display_score(F.col("schedule_raw"))
    h = C.half_up
    return out.select(
        "division", "competitor", "name", "external_rank",
        F.concat_ws("-", "wins", "losses", "draws").alias("record"),
        h(total, 2).alias("final_rating"), h(C.display_score(total), 2).alias("rank_score"),
        h(F.col("base_rating"), 2).alias("base_rating"), h(F.col("peak_rating"), 2).alias("peak_rating"),
        h(F.col("metrics_raw"), 2).alias("metrics_bonus"), h(F.col("nudge_raw"), 2).alias("schedule_nudge"),
        h(F.col("external_raw"), 2).alias("external_bonus"), h(F.col("pedigree_raw"), 2).alias("pedigree_bonus"),
        h(F.coalesce("strength", F.lit(0.0)), 3).alias("pedigree_strength"),
        h(F.col("schedule_raw"), 2).alias("schedule_rating"), h(quality, 2).alias("schedule_quality"),
        h(quality * (cfg.activity_floor + (1 - cfg.activity_floor) * activity), 2).alias("schedule_strength"),
        h(activity, 3).alias("schedule_activity"), h(F.col("since_raw"), 1).alias("months_since"),
        n.alias("recent_contests"), "contests", "accuracy", "ko_rate", "sub_rate",
        h(F.col("ko_rate") + F.col("sub_rate"), 2).alias("finish_rate"))


def order_by_rating(scored: DataFrame) -> DataFrame:
    """Position by final rating, then schedule rating, then id (bucketed by rating point)."""
    return positions(scored, ["division"], -F.floor("final_rating"),
                     [F.desc("final_rating"), F.desc("schedule_rating"), F.asc("competitor")])


def loss_streaks(sides: DataFrame) -> DataFrame:
    """Current run of losses, from positions alone where rows are numbered.  Rows that are not (`nth`) are not numbered
    for it: one aggregate finds the last row that is no loss, another counts what came after it."""
    if "nth" in sides.columns:
        return sides.groupBy("competitor").agg(
            (F.max("nth") - F.coalesce(F.max(F.when(F.col("result") != "L", F.col("nth"))), F.lit(-1))).alias("loss_streak"))
    at = F.struct("date", "contest_id")
    held = sides.filter("date is not null").select("competitor", "date", "contest_id", "result")
    ends = held.groupBy("competitor").agg(F.max(F.when(F.col("result") != "L", at)).alias("ended"))
    later = held.join(ends, "competitor").filter(F.col("ended").isNull() | (at > F.col("ended")))
    runs = later.groupBy("competitor").agg(F.count("*").alias("loss_streak"))
    return ends.select("competitor").join(runs, "competitor", "left").select("competitor", F.coalesce("loss_streak", F.lit(0)).cast("bigint").alias("loss_streak"))


def latest_meetings(contests: DataFrame, as_of: str, engine: EngineConfig, cfg: RankingConfig = R) -> DataFrame:
    """Last decisive meeting per pair and division label, one pre-aggregated row each."""
    winner = F.when(F.col("result1") == "W", F.col("c1")).when(F.col("result2") == "W", F.col("c2"))
    return (
        in_window(contests, as_of, engine, cfg).withColumn("winner", winner)
        .filter(F.col("winner").isNotNull() & ~F.upper("method").contains("S-DEC"))
        .groupBy(F.least("c1", "c2").alias("lo"), F.greatest("c1", "c2").alias("hi"),
                 C.move_label(F.col("division")).alias("label"))
        .agg(F.max(F.struct("date", "contest_id", "winner")).alias("m")))


def head_to_head_edges(ranked: DataFrame, contests: DataFrame, sides: DataFrame, as_of: str,
                       engine: EngineConfig, cfg: RankingConfig = R) -> DataFrame:
    """Qualifying (winner, loser) edges where the winner is ranked below the loser.

    Starts from meetings, so no pair of ranked competitors is ever enumerated.
    """
    today = F.lit(as_of).cast("date")
    r = ranked.select("division", "competitor", "pos", "final_rating", "external_rank")
    view = lambda s: r.select("division", *[F.col(c).alias(f"{c}_{s}") for c in ("competitor", "pos", "final_rating")])
    met = (
        latest_meetings(contests, as_of, engine, cfg)
        .withColumnRenamed("lo", "competitor_lo").withColumnRenamed("hi", "competitor_hi")
        .join(view("lo"), "competitor_lo").join(view("hi"), ["division", "competitor_hi"])
        .filter(F.col("label").isNull() | (F.col("label") == F.col("division")))
        .withColumnRenamed("competitor_lo", "lo").withColumnRenamed("competitor_hi", "hi")
        .groupBy("division", "lo", "hi", "pos_lo", "pos_hi", "final_rating_lo", "final_rating_hi")
        .agg(F.max("m").alias("m")))
    low_won = F.col("m.winner") == F.col("lo")
    side = lambda c, won: F.when(low_won if won else ~low_won, F.col(f"{c}_lo")).otherwise(F.col(f"{c}_hi"))
    edges = met.select(
        "division", F.col("m.winner").alias("winner"), F.when(low_won, F.col("hi")).otherwise(F.col("lo")).alias("loser"),
        F.col("m.date").alias("met_on"), side("pos", True).alias("winner_pos"), side("pos", False).alias("loser_pos"),
        (side("final_rating", False) - side("final_rating", True)).alias("gap"))
    edges = edges.filter((F.col("winner_pos") > F.col("loser_pos")) & (F.col("gap") <= cfg.h2h_gap)
                         & (C.months_between_days(F.col("met_on"), today) <= cfg.h2h_months))
    # losses after the meeting: to the same opponent, or to a ranked non-champion at or below the loser
    recent = sides.filter((F.col("result") == "L") & F.col("date").isNotNull()
                          & (C.months_between_days(F.col("date"), today) <= cfg.h2h_months))
    if engine.era_start_year:
        recent = recent.filter(F.year("date") >= engine.era_start_year)
    again = recent.groupBy(F.col("competitor").alias("winner"), F.col("opponent").alias("loser")).agg(
        F.max("date").alias("lost_on"))
    by_day = (
        recent.select("competitor", "date", "opponent")
        .join(r.filter("external_rank is null or external_rank <> 'C'")
              .select("division", F.col("competitor").alias("opponent"), F.col("pos").alias("opp_pos")), "opponent")
        .groupBy("division", F.col("competitor").alias("winner"), "date").agg(F.max("opp_pos").alias("opp_pos"))
        .groupBy("division", "winner").agg(F.collect_list(F.struct("date", "opp_pos")).alias("losses")))
    return (
        edges.join(again, ["winner", "loser"], "left").join(by_day, ["division", "winner"], "left")
        .filter(F.col("lost_on").isNull() | (F.col("lost_on") <= F.col("met_on")))
        .filter(~F.coalesce(F.exists("losses", lambda x: (x["date"] > F.col("met_on"))
                                     & (x["opp_pos"] >= F.col("loser_pos"))), F.lit(False)))
        .select("division", "winner", "loser", "winner_pos", "loser_pos", "met_on", "gap"))


def apply_edges(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Each winner moves once, directly above its topmost victim.

    Victims are visited from the top and a winner starts below its victim, so a winner always
    leaves through its topmost edge and later winners land below earlier ones. The final list
    is therefore the post-order walk of the forest winner -> topmost victim: sorting by the
    path of starting positions from the root, parents after children. Paths grow by pointer
    doubling, so a chain of d leapfrogs takes log2(d) joins, over movers only.
    """
    parent = edges.groupBy("division", F.col("winner").alias("competitor")).agg(
        F.min("loser_pos").cast("int").alias("up"), F.max("winner_pos").cast("int").alias("pos"))
    ensure_checkpoint_dir(ranked.sparkSession)
    paths = parent.select("division", "competitor", "pos", F.array("up", "pos").alias("path"), "up").checkpoint()
    while True:
        above = paths.select("division", F.col("pos").alias("up"), F.col("path").alias("above"), F.col("up").alias("next"))
        joined = paths.join(above, ["division", "up"], "left").select(
            "division", "competitor", "pos",
            F.when(F.col("above").isNull(), F.col("path"))
            .otherwise(F.concat("above", F.slice("path", 2, F.size("path")))).alias("path"),
            F.col("next").alias("up")).checkpoint()
        pending = joined.filter("up is not null").limit(1).count()
        paths = joined
        if not pending:
            break
    key = paths.select("division", "competitor", "path")
    moved = ranked.join(key, ["division", "competitor"], "left").withColumn(
        "path", F.concat(F.coalesce("path", F.array(F.col("pos").cast("int"))), F.array(F.lit(LAST))))
    return moved


def h2h_positions(moved: DataFrame) -> DataFrame:
    """Numbered list after the leapfrogs (every row)."""
    return positions(moved, ["division"], F.floor(F.element_at("path", 1) / 1000), [F.asc("path")], "pos_h2h")


def finalize(moved: DataFrame, streaks: DataFrame, cfg: RankingConfig = R) -> DataFrame:
    """E14, E15, E17, E18 on the rows that can reach the top: a bounded set per division.

    Nothing below `depth` rises except externally ranked competitors (at most a ranking list
    per division), so the tie-break, floors and display pass run on depth + list rows.
    """
    by = W.partitionBy("division")
    head = moved.select("division", "path").withColumn("n", F.row_number().over(by.orderBy("path"))).filter(
        F.col("n") <= cfg.depth + 1).groupBy("division").agg(F.max("path").alias("cut"))
    inside = (F.col("path") <= F.col("cut")) | F.col("external_rank").isNotNull()
    flagged = moved.join(head, "division").withColumn("inside", inside)
    rest = flagged.filter(~F.col("inside")).groupBy("division").agg(F.max("rank_score").alias("rest_max"))
    top = (flagged.filter("inside").withColumn("pos_h2h", F.row_number().over(by.orderBy("path"))).drop("path", "cut")
           .join(streaks, "competitor", "left").join(rest, "division", "left"))
    champ = F.coalesce(F.col("external_rank") == "C", F.lit(False))
    # Champions directly below X, within the band of X, swap with it one after the other
    order = by.orderBy("pos_h2h")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    top = top.withColumns({
        "grp": F.sum((~champ).cast("int")).over(upto),
        "x_rating": F.last(F.when(~champ, F.col("final_rating")), ignorenulls=True).over(upto)})
    near = F.col("x_rating") - F.col("final_rating")
    fits = champ & (F.col("pos_h2h") <= cfg.depth + 1) & F.coalesce((near > 0) & (near <= cfg.champion_band), F.lit(False))
    run = W.partitionBy("division", "grp")
    top = top.withColumn("lifted", champ & (F.min(F.when(champ, fits.cast("int"))).over(
        run.orderBy("pos_h2h").rowsBetween(W.unboundedPreceding, 0)) == 1))
    top = top.withColumn("key", F.when(F.col("lifted"), F.col("pos_h2h") - 1).when(
        ~champ, F.col("pos_h2h") + F.sum(F.col("lifted").cast("int")).over(run)).otherwise(F.col("pos_h2h")))
    top = top.withColumn("idx", F.row_number().over(by.orderBy("key", "pos_h2h")))
    # A lifted competitor lands on the floor, pushing earlier lifted ones down
    rank_no = F.col("external_rank").try_cast("int")
    steady = F.coalesce(F.col("loss_streak"), F.lit(0)) < cfg.floor_streak
    tiers = ((rank_no.between(6, 15) & steady, cfg.floor_top15), (rank_no.between(1, 5) & steady, cfg.floor_top5),
             (champ, cfg.floor_champion))
    for member, floor in tiers:
        lift = F.coalesce(member, F.lit(False)) & (F.col("idx") > floor)
        band = F.when(F.col("idx") < floor, 0).when(lift, 1).otherwise(2)
        inner = F.when(lift, -F.col("idx")).otherwise(F.col("idx"))
        top = top.withColumn("_b", band).withColumn("_i", inner)
        top = top.withColumn("idx", F.row_number().over(by.orderBy("_b", "_i")))
    # A displayed score never rises going down the list; a champion shows at least the top score
    below = by.orderBy("idx").rowsBetween(0, W.unboundedFollowing)
    top = top.withColumn("display_score", F.greatest(F.max("rank_score").over(below), F.col("rest_max")))
    top = top.withColumn("display_score", F.when(champ, F.max("display_score").over(by)).otherwise(F.col("display_score")))
    return (top.filter(F.col("idx") <= cfg.depth).withColumnRenamed("idx", "rank")
            .withColumn("is_champion", champ)
            .drop("inside", "grp", "x_rating", "lifted", "key", "_b", "_i", "rest_max"))


def contender_rank(final: DataFrame) -> DataFrame:
    """Champions are shown apart; contenders are renumbered."""
    w = W.partitionBy("division", "is_champion").orderBy("rank")
    return final.withColumn("contender_rank", F.when(~F.col("is_champion"), F.row_number().over(w)))


def movement(external_rank: Column, shown_rank: Column) -> Column:
    """NR, =, +n or -n against the external rank; null for champions and odd labels."""
    n = external_rank.try_cast("int") - shown_rank
    return (F.when(external_rank.isNull() | (external_rank == "NR"), "NR")
            .when(external_rank == "C", F.lit(None).cast("string"))
            .when(n == 0, "=").when(n > 0, F.concat(F.lit("▲"), n.cast("string")))
            .when(n < 0, F.concat(F.lit("▼"), F.abs(n).cast("string"))))


def inversions(final: DataFrame) -> DataFrame:
    """Places where the final rating rises going down the list."""
    prev = F.lag("final_rating").over(W.partitionBy("division").orderBy("rank"))
    return final.withColumn("inv", F.col("final_rating") > prev).groupBy("division").agg(
        F.count("*").alias("ranked"), F.count_if("inv").alias("inversions"))


def rank_divisions(competitors, contests, sides, states, external, overrides, pedigree, as_of,
                   engine: EngineConfig | None = None, cfg: RankingConfig = R, depth_only: bool = True) -> DataFrame:
    """The full ranking job over all divisions at once."""
    engine = engine or EngineConfig()
    members, removals = memberships(external, overrides)
    cand = candidates(competitors, members, removals)
    div = division_sides(sides, cand, as_of, engine)
    scored = score(eligible(competitors, cand, div, cfg), div, states, pedigree, as_of, engine, cfg)
    ensure_checkpoint_dir(competitors.sparkSession)
    ranked = order_by_rating(scored.checkpoint()).checkpoint()
    edges = head_to_head_edges(ranked, contests, sides, as_of, engine, cfg)
    moved = apply_edges(ranked, edges)
    return finalize(moved, loss_streaks(sides), cfg) if depth_only else moved
