"""Reads a user calls: rankings, dashboard, profile, search, upcoming, comparison (ids I1-I11)."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelgrid.functions import core as C
from duelgrid.functions.names import normalize_name

h = C.half_up


def division_ranking(final: DataFrame, division: str, known: set[str] | None = None) -> DataFrame:
    """One division's list; an unknown division is a user error."""
    if known is not None and division not in known:
        raise ValueError(f"unknown division {division!r}; one of {sorted(known)}")
    return final.filter(F.col("division") == division)


def dashboard(final: DataFrame, top: int = 5) -> DataFrame:
    """Champion, first contenders and the depth list of every division, nested."""
    item = F.struct("contender_rank", "competitor", "name", "final_rating")
    return final.groupBy("division").agg(
        F.max(F.when(F.col("is_champion"), F.col("name"))).alias("champion"),
        F.array_sort(F.collect_list(F.when(F.col("contender_rank") <= top, item))).alias("contenders"),
        F.sort_array(F.collect_list(F.when(F.col("contender_rank") <= 15, F.col("final_rating"))), asc=False).alias("depth"))


def competitor(profile: DataFrame, final: DataFrame, upcoming_next: DataFrame, form: DataFrame, who, hint: str | None = None) -> DataFrame:
    """One competitor's profile with its rank in the hinted division (else in its best one), its
    last contests and its next one.  An unknown id gives no row."""
    mine = F.col("competitor") == F.lit(who)
    hinted = (F.col("division") == F.lit(hint)).cast("int") if hint else F.lit(0)
    rank = final.filter(mine).groupBy("competitor").agg(F.max_by(
        F.struct("division", "rank", "contender_rank", "final_rating"), F.struct(hinted, "final_rating")).alias("r"))
    following = upcoming_next.filter(mine).select("competitor", F.col("date").alias("next_date"), F.col("opponent_name").alias("next_opponent"))
    return (profile.filter(mine).join(rank, "competitor", "left").join(following, "competitor", "left").join(form, "competitor", "left")
            .select("competitor", "name", "record", "age", "rating", "peak", F.col("r.division").alias("division"), F.col("r.rank").alias("rank"),
                    F.col("r.contender_rank").alias("contender_rank"), "form", "next_date", "next_opponent"))


def nested_profile(profile: DataFrame, radar: DataFrame, trends: DataFrame, gauntlet: DataFrame, benchmarks: DataFrame,
                   media: DataFrame, reach: DataFrame, following: DataFrame) -> DataFrame:
    """The profile as it is read: with style radar, trend codes, contest-by-contest verdict, the benchmark of the
    ranked (else the home) division, pictures, reach and the next contest, each a struct or null."""
    part = lambda df, name, key="competitor": df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    pictures = media.withColumnRenamed("canonical_id", "who")
    return (profile.join(part(radar, "radar"), "competitor", "left").join(part(trends, "trend"), "competitor", "left")
            .join(part(gauntlet, "gauntlet"), "competitor", "left").join(reach.select("competitor", "reach"), "competitor", "left")
            .join(part(following, "next_contest"), "competitor", "left")
            .withColumn("peer_division", F.coalesce("ranked_division", "home_division"))
            .join(part(benchmarks.withColumnRenamed("division", "peer_division"), "benchmark", "peer_division"), "peer_division", "left")
            .withColumn("who", F.col("competitor").cast("string")).join(part(pictures, "media", "who"), "who", "left").drop("who"))


def search(competitors: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """I4: exact 3 > prefix 2 > word prefix 1.5 > substring 1, then contest count; two letters at least."""
    return _best_names(competitors.withColumn("folded", normalize_name(F.col("name"), "search")),
                       normalize_name(F.lit(text), "search"), limit)


def _best_names(names: DataFrame, q: Column, limit: int) -> DataFrame:
    name = F.col("folded")
    score = (F.when(name == q, 3.0).when(name.startswith(q), 2.0)
             .when(F.exists(F.split(name, " "), lambda w: w.startswith(q)), 1.5).when(name.contains(q), 1.0))
    return (names.withColumn("score", score).filter((F.length(q) >= 2) & F.col("score").isNotNull())
            .select("competitor", "name", "home_division", "contests", "score")
            .orderBy(F.desc("score"), F.desc("contests"), "competitor").limit(limit))


#: Folders of the name index.
INDEX_FOLDERS = 64


def write_name_index(competitors: DataFrame, path: str) -> DataFrame:
    """I4: one row per name and run of two or three characters in it, by a hash of the run.  Every rule of `search` needs the
    searched text somewhere in the name, so all its hits have all its runs.  A run that many names hold goes into several
    files (rows are ranged by run and competitor).  Names without two characters left can match nothing and have no row."""
    folded = competitors.select("competitor", "name", "home_division", "contests",
                                normalize_name(F.col("name"), "search").alias("folded"))
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("folded") - (n - 1))
        return F.when(F.length("folded") >= n, F.transform(starts, lambda i: F.substring(F.col("folded"), i, F.lit(n)))
                      ).otherwise(F.array().cast("array<string>"))

    rows = folded.withColumn("run", F.explode(F.array_distinct(F.concat(runs(2), runs(3))))).withColumn(
        "folder", F.pmod(F.crc32(F.encode("run", "UTF-8")), F.lit(INDEX_FOLDERS)).cast("int"))
    rows.repartitionByRange("folder", "run", "competitor").sortWithinPartitions("folder", "run").write.mode("overwrite").partitionBy("folder").parquet(path)
    return competitors.sparkSession.read.schema(rows.schema).parquet(path)


def search_index(index: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """I4 by the index: what `search` gives, from the rows of the searched text's own runs."""
    q = index.sparkSession.range(1).select(normalize_name(F.lit(text), "search")).first()[0]
    n = min(len(q), 3)
    runs = sorted({q[i:i + n] for i in range(len(q) - n + 1)}) if n >= 2 else []
    folders = sorted({zlib.crc32(run.encode()) % INDEX_FOLDERS for run in runs})
    hits = index.filter(F.col("folder").isin(folders) & F.col("run").isin(runs))
    whole = hits.groupBy("competitor", "name", "home_division", "contests", "folded").agg(F.count("*").alias("runs"))
    return _best_names(whole.filter(F.col("runs") == len(runs)), F.lit(q), limit)


def upcoming_events(slots: DataFrame, today: Column) -> DataFrame:
    """Future events with their contests nested in card order."""
    bout = F.struct("bout_order", "slot_id", "division", "c1", "name1", "c2", "name2", "main_event")
    return slots.filter(F.col("date") >= today).groupBy("event_id").agg(
        F.min("date").alias("date"), F.min_by("event_name", "bout_order").alias("event_name"),
        F.array_sort(F.collect_list(bout)).alias("bouts"))


def next_contests(slots: DataFrame, today: Column) -> DataFrame:
    """Earliest future contest per known competitor."""
    side = lambda i, j: F.struct(F.col(f"c{i}").alias("competitor"), F.col(f"c{j}").alias("opponent"), F.col(f"name{j}").alias("opponent_name"))
    s = (slots.filter(F.col("date") >= today).select("slot_id", "event_id", "date", "division", "main_event", F.explode(F.array(side(1, 2), side(2, 1))).alias("s"))
         .select("slot_id", "event_id", "date", "division", "main_event", "s.*").filter("competitor is not null"))
    first = s.groupBy("competitor").agg(F.min(F.struct("date", "slot_id", "event_id", "division", "main_event", "opponent", "opponent_name")).alias("x"))
    return first.select("competitor", "x.*")


def form_probability(r1: Column, n1: Column, r2: Column, n2: Column) -> Column:
    return F.when((n1 != 0) | (n2 != 0), C.win_probability(r1 + n1, r2 + n2))


def enrich_upcoming(slots: DataFrame, profile: DataFrame, today: Column, form: DataFrame | None = None) -> DataFrame:
    """Both corners' rank, style, age, record, last contests and rates, with plain and form-adjusted probability.

    form: competitor and its last contests as text."""
    cols = ["competitor", "age", "rating", "form_nudge", "is_champion", "shown_rank", "ranked_division", "style", "finish_rate", "schedule_quality", "record"]
    cols = [*cols, *(c for c in ("reach",) if c in profile.columns)]
    if form is not None:
        profile, cols = profile.join(form.select("competitor", "form"), "competitor", "left"), [*cols, "form"]
    out = slots.filter(F.col("date") >= today)
    for i in (1, 2):
        p = profile.select(*[F.col(c).alias(f"c{i}" if c == "competitor" else f"{c}{i}") for c in cols])
        out = out.join(p, f"c{i}", "left")
        out = out.withColumn(f"rank_label{i}", F.when(F.col(f"is_champion{i}"), "C").when(
            F.col(f"shown_rank{i}").isNotNull(), F.concat(F.lit("#"), F.col(f"shown_rank{i}").cast("string"), F.lit(" "), F.col(f"ranked_division{i}"))))
    known = F.col("rating1").isNotNull() & F.col("rating2").isNotNull()
    r1, r2, n1, n2 = (F.col(c) for c in ("rating1", "rating2", "form_nudge1", "form_nudge2"))
    return out.withColumn("prob1", F.when(known, C.win_probability(r1, r2))).withColumn(
        "form_prob1", F.when(known, form_probability(r1, n1, r2, n2)))


def card_view(enriched: DataFrame, today: Column) -> DataFrame:
    """Whole percentages that sum to 100, form only when it differs by two points, tape rows, days left."""
    p1 = h(F.col("prob1") * 100).cast("int")
    fp = h(F.col("form_prob1") * 100).cast("int")
    both = lambda c: F.col(f"{c}1").isNotNull() & F.col(f"{c}2").isNotNull()
    rows = both("schedule_quality").cast("int") + both("finish_rate").cast("int") + both("age").cast("int")
    return enriched.select(
        "slot_id", p1.alias("percent1"), (F.lit(100) - p1).alias("percent2"),
        F.when(F.abs(fp - p1) >= 2, fp).alias("form_percent1"), rows.alias("tape_rows"), (rows >= 2).alias("show_tape"),
        F.datediff("date", today).alias("days_until"),
        F.element_at(F.split("event_name", " - ", 2), 1).alias("title"),
        F.when(F.size(F.split("event_name", " - ", 2)) > 1, F.element_at(F.split("event_name", " - ", 2), 2)).alias("subtitle"))


def event_list(slots: DataFrame, today: Column) -> DataFrame:
    """I8: future events with contest count and the main event."""
    text = F.concat("name1", F.lit(" vs. "), "name2")
    return slots.filter(F.col("date") >= today).groupBy("event_id").agg(
        F.min("date").alias("date"), F.count("*").alias("contests"),
        F.min_by(text, F.struct((~F.col("main_event")).cast("int"), "bout_order")).alias("main_event"))


def find_event(slots: DataFrame, text: str, today: Column) -> DataFrame:
    """I8: exact name, else containing the text, else contained in it; the earliest wins."""
    q = F.lower(F.trim(F.lit(text)))
    name = F.lower(F.col("event_name"))
    kind = F.when(name == q, 1).when(name.contains(q), 2).when(q.contains(name), 3)
    names = slots.filter(F.col("date") >= today).groupBy("event_id").agg(
        F.min("date").alias("date"), F.min_by("event_name", "bout_order").alias("event_name"))
    return names.withColumn("matched", kind).filter("matched is not null").orderBy("matched", "date", "event_id").limit(1)


COMPARED = ("rating", "age", "finish_rate", "schedule_quality", "ratio_career", "ratio_last3", "accuracy", "reach", "diff15")


def compare(profile: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probabilities and thin-sample flag per pair, and one row per compared statistic with its leader.

    pairs: pair_id, a, b; profile with reach and the career differential per 15 minutes (`diff15`).
    """
    cols = ["competitor", "form_nudge", "contests", *COMPARED]
    view = lambda s: profile.select(*[F.col(c).alias(s if c == "competitor" else f"{c}_{s}") for c in cols])
    x = pairs.join(view("a"), "a").join(view("b"), "b")
    head = x.select(
        "pair_id", h(C.win_probability(F.col("rating_a"), F.col("rating_b")) * 100).cast("int").alias("percent_a"),
        h(form_probability(F.col("rating_a"), F.col("form_nudge_a"), F.col("rating_b"), F.col("form_nudge_b")) * 100).cast("int").alias("form_percent_a"),
        ((F.col("contests_a") <= 5) | (F.col("contests_b") <= 5)).alias("thin_sample"))
    rows = x.select("pair_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("statistic"), F.col(f"{c}_a").cast("double").alias("value_a"), F.col(f"{c}_b").cast("double").alias("value_b")) for c in COMPARED])).alias("r")).select("pair_id", "r.*")
    lower_better = F.col("statistic") == "age"
    a, b = F.col("value_a"), F.col("value_b")
    leader = F.when(a.isNull() | b.isNull() | (a == b), "none").when((a > b) != lower_better, "a").otherwise("b")
    return head, rows.withColumn("leader", leader)


def summary(profile: DataFrame, final: DataFrame, log: DataFrame, contests: int = 8) -> DataFrame:
    """Compact projection with the rating decomposition and the last contests."""
    parts = final.groupBy("competitor").agg(F.max_by(F.struct(
        "base_rating", "metrics_bonus", "schedule_nudge", "external_bonus", "final_rating", "external_rank"), "final_rating").alias("p"))
    last = log.filter(F.col("rev") <= contests).groupBy("competitor").agg(F.array_sort(F.collect_list(F.struct(
        "rev", "date", "opponent_name", "result", "method", "round", h(F.col("delta"), 1).alias("swing"),
        h(F.col("opponent_rating")).cast("int").alias("opponent_rating")))).alias("last_contests"))
    return (profile.join(parts, "competitor", "left").join(last, "competitor", "left").select(
        "competitor", "name", "record", F.coalesce("ranked_division", "home_division").alias("division"), "age",
        (F.col("contests") <= 5).alias("provisional"), "is_champion", "shown_rank", F.col("p.external_rank").alias("external_rank"),
        h(F.col("rating")).cast("int").alias("rating"), h(F.col("peak")).cast("int").alias("peak"),
        h(F.col("p.base_rating")).cast("int").alias("core"), h(F.col("p.metrics_bonus"), 1).alias("metrics"),
        h(F.col("p.schedule_nudge"), 1).alias("schedule"), h(F.col("p.external_bonus"), 1).alias("external"),
        h(F.col("p.final_rating")).cast("int").alias("final"), "months_since", "last_contests"))
