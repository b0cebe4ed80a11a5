"""Competitor analytics over sides and rating history (ids G1-G21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelgrid.functions import core as C
from duelgrid.functions.timeline import number_timeline, rolling_mean

h = C.half_up

# Fixed values: (needle in the details text, label), first hit wins.
HOLDS = (
    ("rear naked", "Rear Naked Choke"), ("d'arce", "D'Arce Choke"), ("anaconda", "Anaconda Choke"),
    ("arm triangle", "Arm Triangle"), ("triangle armbar", "Triangle Armbar"), ("triangle", "Triangle Choke"),
    ("guillotine", "Guillotine Choke"), ("armbar", "Armbar"), ("kimura", "Kimura"), ("kneebar", "Kneebar"),
    ("heel hook", "Heel Hook"), ("ankle", "Ankle Lock"), ("americana", "Americana"), ("ezekiel", "Ezekiel Choke"),
    ("von flue", "Von Flue Choke"), ("twister", "Twister"), ("neck crank", "Neck Crank"), ("choke", "Other choke"),
)
STRIKES = (
    (("punch",), "Punches"), (("elbow",), "Elbows"), (("knee",), "Knees"), (("kick", "head"), "Head kick"),
    (("kick", "body"), "Body kick"), (("kick", "leg"), "Leg kicks"), (("kick",), "Kicks"),
    (("injury",), "Injury stoppage"), (("doctor",), "Doctor stoppage"), (("retire",), "Corner stoppage"),
    (("corner",), "Corner stoppage"),
)


def is_ko(method: Column) -> Column:
    m = F.upper(F.trim(method))
    return m.startswith("KO") | m.startswith("TKO")


def is_sub(method: Column) -> Column:
    return F.upper(F.trim(method)) == "SUB"


def usable(sides: DataFrame) -> DataFrame:
    """G1: dated metric-bearing sides with usable time and some output."""
    secs = F.round(C.elapsed_minutes(F.col("round"), F.col("clock")) * 60).cast("bigint")
    return (sides.drop("nth", "rev").filter(F.col("date").isNotNull() & F.col("has_metrics"))
            .withColumn("secs", secs).filter("secs is not null and str_self + str_opp <> 0"))


def samples(sides: DataFrame) -> DataFrame:
    """Usable sides, numbered per competitor."""
    return number_timeline(usable(sides))


def pace_windows(smp: DataFrame) -> DataFrame:
    """Per-15-minute rates over career, last five (at least three) and last three samples (usable sides).

    The career is summed before the shuffle, and the newest five are picked below it, so no row is numbered.
    """
    scored = F.col("acc_self") > 0
    newest = W.partitionBy("competitor").orderBy(F.desc("date"), F.desc("contest_id"))
    last = smp.drop("nth", "rev").withColumn("rev", F.row_number().over(newest)).filter(F.col("rev") <= 5)
    belongs = F.filter(F.array(F.lit("recent"), F.when(F.col("rev") <= 3, "last3")), lambda x: x.isNotNull())
    read = ["competitor", "secs", "str_self", "str_opp", "td_self", "td_opp", "kd_self", "kd_opp", "sub_self", "ctrl_self", "acc_self"]
    sums = lambda rows: rows.groupBy("competitor", "window").agg(
        F.count("*").alias("contests"), F.sum("secs").alias("secs"), F.sum("str_self").alias("landed"),
        F.sum("str_opp").alias("absorbed"), F.sum("td_self").alias("td"), F.sum("td_opp").alias("td_abs"),
        F.sum("kd_self").alias("kd"), F.sum("kd_opp").alias("kd_abs"), F.sum("sub_self").alias("sub"),
        F.sum("ctrl_self").alias("ctrl"), F.count_if(scored).alias("n_acc"),
        F.sum(F.when(scored, F.round(F.col("acc_self") * 100))).alias("acc100"))
    a = sums(smp.select(*read, F.lit("career").alias("window"))).unionByName(
        sums(last.select(*read, F.explode(belongs).alias("window"))).filter("contests >= 3"))
    minutes = F.col("secs") / F.lit(60.0)
    per15 = lambda c, k=1: h(c / minutes * 15, k)
    return a.select(
        "competitor", "window", "contests", h(minutes).cast("bigint").alias("minutes"),
        per15(F.col("landed")).alias("landed15"), per15(F.col("absorbed")).alias("absorbed15"),
        per15(F.col("landed") - F.col("absorbed")).alias("diff15"), per15(F.col("td")).alias("td15"),
        per15(F.col("td_abs")).alias("td_absorbed15"), per15(F.col("kd"), 2).alias("kd15"),
        per15(F.col("sub")).alias("sub15"), h(F.col("ctrl") / (minutes * 60) * 100, 1).alias("ctrl_share"),
        F.when(F.col("n_acc") > 0, h(F.col("acc100") / F.col("n_acc") / 100, 3)).alias("accuracy"), "kd_abs")


def landed_ratio(landed15: Column, absorbed15: Column) -> Column:
    """Landed per absorbed, capped when hardly anything was absorbed."""
    return (F.when(landed15.isNull() | (landed15 <= 0), F.lit(None).cast("double"))
            .when(absorbed15 < 1, F.lit(9.99)).otherwise(h(landed15 / absorbed15, 2)))


def pace_wide(pace: DataFrame) -> DataFrame:
    """One row per competitor: the three windows, drift (G4) and ratios."""
    cols = ["contests", "minutes", "landed15", "absorbed15", "diff15", "td15", "accuracy", "kd_abs"]
    w = pace.groupBy("competitor").agg(*[
        F.max(F.when(F.col("window") == x, F.struct(*cols))).alias(x) for x in ("career", "recent", "last3")])
    delta = lambda c, k=1: h(F.col(f"recent.{c}") - F.col(f"career.{c}"), k)
    return w.select(
        "*", delta("landed15").alias("landed15_delta"),
        F.when(F.col("career.landed15") >= 5, h(F.col("recent.landed15") / F.col("career.landed15") - 1, 3))
        .alias("landed_pct_change"),
        delta("diff15").alias("diff15_delta"), delta("td15").alias("td15_delta"),
        delta("accuracy", 3).alias("accuracy_delta"),
        landed_ratio(F.col("career.landed15"), F.col("career.absorbed15")).alias("ratio_career"),
        landed_ratio(F.col("last3.landed15"), F.col("last3.absorbed15")).alias("ratio_last3"))


def form_nudge(diff15_delta: Column, td15_delta: Column) -> Column:
    """Bounded rating nudge from form drift."""
    score = diff15_delta * 0.7 + td15_delta * 5 * 0.3
    return F.coalesce(C.clamp(h(score * 2.2, 1), -45.0, 45.0), F.lit(0.0))


def form_timeline(smp: DataFrame) -> DataFrame:
    """Per-sample rates with the rolling mean of the last three (on rounded values)."""
    minutes = F.col("secs") / F.lit(60.0)
    per15 = lambda c: h(c / minutes * 15, 1)
    rows = smp.select(
        "competitor", "contest_id", "date", "result", "opponent", "method", "nth", h(minutes, 1).alias("minutes"),
        per15(F.col("str_self")).alias("landed15"), per15(F.col("str_opp")).alias("absorbed15"),
        per15(F.col("td_self")).alias("td15"), F.col("kd_self").alias("kd"))
    tenths = rows.withColumn("tenths", F.round(F.col("landed15") * 10).cast("bigint"))
    return (rolling_mean(tenths, "competitor", "tenths", 3, "m")
            .withColumn("rolling_landed", F.floor(F.col("m") + 0.5) / F.lit(10.0)).drop("m", "tenths"))


def durability(sides: DataFrame, pace: DataFrame) -> DataFrame:
    """Losses by kind over all dated contests, and absorbed rates from the career window."""
    lost = F.col("result") == "L"
    ko, sub = is_ko(F.col("method")), is_sub(F.col("method"))
    dec = ~ko & ~sub & F.upper("method").contains("DEC")
    a = sides.filter("date is not null").groupBy("competitor").agg(
        F.count_if(lost & ko).alias("ko_losses"), F.count_if(lost & ~ko & sub).alias("sub_losses"),
        F.count_if(lost & dec).alias("decision_losses"),
        F.max(F.when(lost & (ko | sub), F.year("date"))).alias("last_finished_year"))
    career = pace.filter("window = 'career'").select(
        "competitor", F.when(F.col("minutes") > 0, h(F.col("kd_abs") / F.col("minutes") * 15, 2)).otherwise(0.0)
        .alias("kd_absorbed15"), F.col("absorbed15").alias("strikes_absorbed15"))
    return a.join(career, "competitor").withColumn("times_finished", F.col("ko_losses") + F.col("sub_losses"))


def finish_label(method: Column, details: Column) -> Column:
    """Ordered substring rules."""
    d = F.lower(details)
    holds = C.first_match([(d.contains(n), F.lit(v)) for n, v in HOLDS], F.lit("Submission (other)"))
    def every(needles):
        cond = d.contains(needles[0])
        for n in needles[1:]:
            cond = cond & d.contains(n)
        return cond
    strikes = C.first_match([(every(n), F.lit(v)) for n, v in STRIKES], F.lit("KO/TKO (other)"))
    return F.when(is_sub(method), holds).when(is_ko(method), strikes)


def finish_breakdown(sides: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent finish labels for wins and losses; ties go to the one seen first."""
    rows = (sides.filter("date is not null and result in ('W', 'L')")
            .withColumn("label", finish_label(F.col("method"), F.col("details"))).filter("label is not null"))
    counts = rows.groupBy("competitor", F.when(F.col("result") == "W", "win").otherwise("loss").alias("side"), "label").agg(
        F.count("*").alias("n"), F.min(F.struct("date", "contest_id")).alias("first"))
    w = W.partitionBy("competitor", "side").orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).drop("first")


def gauntlet_points(log: DataFrame) -> DataFrame:
    """Expected against actual per contest, with the running over/under-performance."""
    expected = C.win_probability(F.col("rating_before"), F.col("opponent_rating"))
    rows = log.filter("opponent_rating > 0").drop("nth", "rev").withColumn("exp", expected).withColumn(
        "ou", F.col("score") - F.col("exp"))
    return number_timeline(rows, running={"cum": F.col("ou")})


def gauntlet_view(points: DataFrame) -> DataFrame:
    m = F.upper(F.trim("method"))
    return points.select(
        "competitor", "contest_id", "date", "opponent", "result",
        F.when(m.startswith("KO") | m.startswith("TKO"), "ko").when(m == "SUB", "sub").alias("finish_type"),
        h(F.col("opponent_rating")).cast("bigint").alias("opponent_elo"),
        h(F.col("rating_after")).cast("bigint").alias("own_elo"), h(F.col("delta")).cast("bigint").alias("swing"),
        h(F.col("exp"), 2).alias("expected"), h(F.col("ou"), 2).alias("over_under"), h(F.col("cum"), 2).alias("running"))


def gauntlet_summary(points: DataFrame) -> DataFrame:
    """Null unless two rated contests; total, biggest upset win and rating range."""
    won = F.when(F.col("result") == "W", F.struct("ou", -F.col("nth"), "contest_id"))
    low = F.least("opponent_rating", "rating_after")
    high = F.greatest("opponent_rating", "rating_after")
    return points.groupBy("competitor").agg(
        F.count("*").alias("contests"), h(F.max_by("cum", "nth"), 1).alias("total_overperformance"),
        F.max(won)["contest_id"].alias("upset_contest"), h(F.max(won)["ou"], 2).alias("upset_over_under"),
        h(F.min(low)).cast("bigint").alias("elo_min"), h(F.max(high)).cast("bigint").alias("elo_max")
    ).filter("contests >= 2")


def trend_context(log: DataFrame, states: DataFrame, births: DataFrame, today: Column) -> DataFrame:
    a = log.groupBy("competitor").agg(
        F.min("date").alias("debut"), F.max("date").alias("latest"),
        F.avg("opponent_rating").alias("opp_career"),
        F.avg(F.when(F.col("rev") <= 3, F.col("opponent_rating"))).alias("opp_recent"))
    return (a.join(states.select("competitor", "rating", "peak"), "competitor")
            .join(births.select("competitor", "born"), "competitor", "left")
            .select("competitor", "rating", "peak", C.whole_years(F.col("born"), today).alias("age"),
                    (F.datediff(today, "debut") / F.lit(365.25)).alias("tenure_years"),
                    C.months_between_days(F.col("latest"), today).alias("months_since"),
                    h(F.col("opp_recent") - F.col("opp_career")).alias("opp_step")))


def trend_codes(wide: DataFrame, context: DataFrame, dura: DataFrame) -> DataFrame:
    """Up to four codes from ordered predicates; prose is left to the caller."""
    x = wide.join(context, "competitor").join(
        dura.select("competitor", "times_finished", "kd_absorbed15"), "competitor", "left")
    change = F.col("ratio_last3") / F.col("ratio_career") - 1
    output = F.when(F.col("career.landed15") >= 5, F.col("last3.landed15") / F.col("career.landed15") - 1).otherwise(0.0)
    step_up = F.col("opp_step") >= 40
    age = F.coalesce("age", F.lit(0))
    deep = (age >= 34) | (F.col("tenure_years") >= 9) | (F.col("career.contests") >= 18)
    codes = F.array(
        F.when((change <= -0.15) & step_up, "margin_tight_step_up").when((change <= -0.15) & deep, "margin_tight_wear")
        .when(change <= -0.15, "margin_tight_lean"),
        F.when((change >= 0.15) & (output >= -0.05) & step_up, "margin_wide_step_up")
        .when((change >= 0.15) & (output >= -0.05), "margin_wide"),
        F.when((age >= 36) & (change > -0.15), "age_risk"),
        F.when((output <= -0.2) & (change > -0.15), "volume_down"),
        F.when((F.col("times_finished") >= 4) | ((F.col("kd_absorbed15") >= 0.3) & deep), "damage"),
        F.when(F.col("months_since") >= 12, "layoff"),
        F.when((F.col("peak") - F.col("rating") >= 120) & deep, "below_peak"))
    codes = F.slice(F.filter(codes, lambda c: c.isNotNull()), 1, 4)
    thin = F.col("last3").isNull() | F.col("ratio_career").isNull() | F.col("ratio_last3").isNull()
    return x.select("competitor", F.when(thin, F.array(F.lit("thin_sample"))).when(F.size(codes) == 0, F.array(F.lit("steady")))
                    .otherwise(codes).alias("codes"), h(change, 3).alias("ratio_change"), "opp_step", "age")


def radar(sides: DataFrame, context: DataFrame, today: Column, half_life: float = 15.0,
          same_division: bool = False) -> DataFrame:
    """Five style axes from the last five metric-bearing contests; career rates when there is none.

    `context`: competitor, division, sos (0-100), months_since, finish_rate, accuracy, ground_share.
    """
    keep = F.col("has_metrics") & F.col("date").isNotNull()
    rows = sides.filter(keep)
    if same_division:
        home = context.select("competitor", F.col("division").alias("home"))
        rows = rows.join(home, "competitor").filter(C.move_label(F.col("division")) == F.col("home"))
    w = W.partitionBy("competitor").orderBy(F.desc("date"), F.desc("contest_id"))
    top = rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").withColumn(
        "w", C.recency_weight(F.col("date"), today, half_life))
    mean = lambda e: F.sum(e * F.col("w")) / F.sum("w")
    pct = lambda c: F.when(c > 1, c / 100).otherwise(c)
    m = top.groupBy("competitor").agg(
        F.sum("w").alias("weight"), mean(F.col("str_self")).alias("vol"),
        mean(F.col("str_self") - F.col("str_opp")).alias("edge"), mean(pct(F.col("acc_self"))).alias("acc"),
        mean(F.col("kd_self")).alias("kd"), mean(F.col("td_self") - F.col("td_opp")).alias("td"),
        mean(F.col("ctrl_self")).alias("ctrl"))
    x = context.join(m, "competitor", "left")
    u = lambda c: C.clamp(c, 0.0, 1.0)
    signed = lambda c: (C.clamp(c, -1.0, 1.0) + 1) / 2
    power = u(F.col("kd") / 1.5)
    strike = u(0.30 * u(F.col("vol") / 90) + 0.30 * power + 0.25 * u(F.col("acc") / 0.6) + 0.15 * signed(F.col("edge") / 40))
    ground = u(pct(F.col("ground_share")))
    grapple = u(0.45 * signed(F.col("td") / 3) + 0.40 * u(F.col("ctrl") / 300) + 0.15 * ground)
    finish = u(0.6 * u(F.col("finish_rate")) + 0.4 * power)
    none = F.coalesce("weight", F.lit(0.0)) == 0
    return x.select(
        "competitor",
        F.when(none, u(0.6 * u(pct(F.col("accuracy")) / 0.6) + 0.4 * u(F.col("finish_rate")))).otherwise(strike).alias("strike"),
        F.when(none, ground).otherwise(grapple).alias("grappling"),
        F.when(none, u(F.col("finish_rate"))).otherwise(finish).alias("finishing"),
        u(1 - F.col("months_since") / 24).alias("activity"), u(F.col("sos") / 100).alias("opp_quality"))


def short_method(method: Column, round_no: Column) -> Column:
    """Compact label such as 'KO R2' or 'UD'."""
    m = F.upper(F.trim(method))
    return (F.when((m == "KO/TKO") | m.startswith("TKO"), F.concat(F.lit("KO R"), round_no.cast("string")))
            .when(m == "SUB", F.concat(F.lit("SUB R"), round_no.cast("string")))
            .when(m == "U-DEC", "UD").when(m == "S-DEC", "SD").when(m == "M-DEC", "MD").otherwise(F.trim(method)))


def recent_form(log: DataFrame, count: int = 5) -> DataFrame:
    """Newest results with compact labels and title flag (where the log has one), nested; the filter bounds every
    list."""
    log = log if "is_title" in log.columns else log.withColumn("is_title", F.lit(False))
    item = F.struct("rev", "result", F.concat(short_method(F.col("method"), F.col("round")), F.lit(" vs. "),
                                              F.col("opponent_name")).alias("label"), "date", "is_title")
    return log.filter(F.col("rev") <= count).groupBy("competitor").agg(F.array_sort(F.collect_list(item)).alias("form"))


def style_label(f_ko: Column, f_sub: Column, accuracy: Column, finish: Column) -> Column:
    """Style code from career rates."""
    return (
        F.when((f_ko >= 0.5) & (f_ko >= f_sub * 1.5), "knockout artist")
        .when((f_sub >= 0.4) & (f_sub >= f_ko), "submission specialist")
        .when((f_ko >= 0.35) & (f_sub >= 0.25), "all-action finisher")
        .when(finish >= 0.6, "finisher").when((accuracy >= 0.55) & (finish < 0.4), "accurate striker")
        .when(f_sub >= 0.25, "grappling technician").when(finish <= 0.3, "decision grinder").otherwise("well-rounded"))


def highlights(finish: Column, ko: Column, accuracy: Column, sub: Column) -> Column:
    """The first three non-zero headline rates, as 'label percent' texts."""
    text = lambda label, v: F.when(v > 0, F.concat(F.lit(label + " "), h(v * 100).cast("int").cast("string"), F.lit("%")))
    items = F.array(text("Finish", finish), text("KO", ko), text("Acc", accuracy), text("Sub", sub))
    return F.slice(F.filter(items, lambda t: t.isNotNull()), 1, 3)


def hash_pick(seed: Column, choices: int) -> Column:
    """Deterministic pick by the 32-bit FNV-1a hash of the seed text."""
    step = lambda acc, c: (acc.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619) % 4294967296
    return (F.aggregate(F.split(seed, ""), F.lit(2166136261).cast("bigint"), step) % choices).cast("int")


def story_facts(log: DataFrame, ranked: DataFrame, division_order: dict[str, int], today: Column) -> DataFrame:
    """Streaks, last-five record, quality wins, recent finishes and losses, signature win,
    division move, headline and supporting codes for every ranked competitor."""
    months = C.months_between_days(F.col("date"), today)
    won, lost = F.col("result") == "W", F.col("result") == "L"
    m = F.upper("method")
    finish = m.contains("SUB") | m.contains("KO")
    five = F.col("rev") <= 5
    order = F.create_map(*[F.lit(v) for kv in division_order.items() for v in kv])
    a = log.groupBy("competitor").agg(
        (F.max("nth") - F.coalesce(F.max(F.when(~won, F.col("nth"))), F.lit(-1))).alias("win_streak"),
        (F.max("nth") - F.coalesce(F.max(F.when(~lost, F.col("nth"))), F.lit(-1))).alias("skid"),
        F.count_if(five & won).alias("wins5"), F.count_if(five & lost).alias("losses5"), F.count_if(five).alias("n5"),
        F.count_if(won & (months <= 48) & (F.col("opponent_rating") >= 1520)).alias("quality_wins"),
        F.max_by("opponent_name", F.when(won & (months <= 48) & (F.col("opponent_rating") >= 1520),
                                         F.struct("opponent_rating", "nth"))).alias("best_win"),
        F.count_if(won & (months <= 30) & finish).alias("recent_finishes"),
        F.count_if(lost & (months <= 36)).alias("recent_losses"),
        F.max(F.when(won, F.struct("delta", "nth", "contest_id"))).alias("sig"),
        F.max(F.when(F.col("rev") == 1, F.col("label"))).alias("now_in"), F.count("*").alias("n"),
        F.collect_list(F.when(F.col("rev").between(2, 5), F.struct("rev", "label"))).alias("before"))
    prior = F.element_at(F.array_sort(F.filter("before", lambda x: x["label"] != F.col("now_in"))), 1)["label"]
    moved = F.when((F.col("n") >= 3) & (order[F.col("now_in")] > order[F.col("prior")]), "up").when(
        (F.col("n") >= 3) & (order[F.col("now_in")] < order[F.col("prior")]), "down")
    r = ranked.select("division", "competitor", "is_champion", "months_since", "schedule_nudge", "metrics_bonus",
                      "external_bonus", "external_rank")
    x = (a.withColumn("prior", F.when(F.size(F.filter("before", lambda x: x["label"] != F.col("now_in"))) > 0, prior))
         .withColumn("move", moved).join(r, "competitor"))
    skidding = (F.col("skid") >= 2) | ((F.col("losses5") > F.col("wins5")) & (F.col("n5") >= 4))
    x = x.withColumn("headline", F.when(F.col("is_champion"), "champion").when(skidding, "skid")
                     .when((F.col("win_streak") >= 3) & (F.col("recent_finishes") >= 2), "red_hot")
                     .when(F.col("win_streak") >= 3, "streak").when(F.col("quality_wins") >= 1, "quality")
                     .when(F.col("months_since") >= 14, "inactive").otherwise("steady"))
    used = lambda *names: F.col("headline").isin(*names)
    sig = F.col("sig.delta")
    codes = F.array(
        F.when(~used("quality") & (F.col("quality_wins") >= 1), "quality"),
        F.when(~used("red_hot") & (F.col("recent_finishes") >= 1), "finishes"),
        F.when(~used("red_hot", "streak") & (F.col("win_streak") >= 2), "streak"),
        F.when(~used("skid") & (F.col("skid") >= 1) & (F.col("recent_losses") >= 1),
               F.when(F.col("skid") >= 2, "skid").otherwise("recent_loss")),
        F.concat(F.lit("moved_"), F.col("move")),
        F.when(~used("inactive") & (F.col("months_since") >= 14), "inactive")
        .when((F.col("months_since") <= 6) & ~used("red_hot", "streak", "skid"), "active"),
        F.when(F.col("schedule_nudge") >= 2, "schedule_tough").when(F.col("schedule_nudge") <= -2, "schedule_soft"),
        F.when(F.col("metrics_bonus") >= 3, "metrics_strong").when(F.col("metrics_bonus") <= -3, "metrics_soft"),
        F.when(~used("quality") & (sig >= 25), "signature"),
        F.when(~F.col("is_champion") & (F.col("external_bonus") > 0) & F.col("external_rank").isNotNull(), "external"))
    return x.select(
        "division", "competitor", "win_streak", "skid", "wins5", "losses5", "quality_wins", "best_win", "recent_finishes",
        "recent_losses", F.col("sig.contest_id").alias("signature_contest"), h(sig, 2).alias("signature_delta"), "move",
        "headline", F.slice(F.filter(codes, lambda c: c.isNotNull()), 1, 5).alias("codes"))


def strip_scale(smp: DataFrame, log: DataFrame, shown: int = 12, floor: float = 20.0) -> DataFrame:
    """Bar scale of the newest contests shown on a profile."""
    minutes = F.col("secs") / F.lit(60.0)
    rates = smp.select("competitor", "contest_id", h(F.col("str_self") / minutes * 15, 1).alias("l"),
                       h(F.col("str_opp") / minutes * 15, 1).alias("a"))
    view = log.filter(F.col("rev") <= shown).select("competitor", "contest_id").join(rates, ["competitor", "contest_id"], "left")
    return view.groupBy("competitor").agg(F.greatest(F.lit(floor), F.max(F.greatest("l", "a"))).alias("scale"))
