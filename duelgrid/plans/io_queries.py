"""Source, sink and streaming queries (A and S ids)."""

from __future__ import annotations

import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from duelgrid.config import EngineConfig
from duelgrid.functions import core as C
from duelgrid.functions.names import name_pair
from duelgrid.operators import backtest as T, etl, ledger as L, sweep
from duelgrid.plans.register import registrar
from duelgrid.sources import bindings as B, readers as R, sinks as K
from duelgrid.streaming import jobs as J

QUERIES, query = registrar()
h = C.half_up
r6 = lambda c: h(F.col(c), 6).alias(c)


def place(ws, name):
    """A fresh folder per run, inside the session's shared folder."""
    return f"{ws.root}/{name}-{uuid4().hex[:8]}"


def through_text(ws, df, name, columns, optional=False):
    """Write the frame as headered text and read it back: half of the rows in files of the true header, half in files
    of the reverse order with one more column.  Columns that the frame lacks are in no file."""
    path = place(ws, name)
    there = [c for c in columns if c in df.columns]
    rows = df.select(*[F.col(f"`{c}`") for c in there])
    half = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in there]), F.lit(2))
    K.write_text_table(rows.filter(half == 0), path)
    K.write_text_table(rows.filter(half == 1).select(F.lit("later").alias("Added, later"), *[F.col(f"`{c}`") for c in reversed(there)]), path, "append")
    return (R.read_optional if optional else R.read_text_table)(ws.spark, path, columns)


text = lambda c: F.col(c).cast("string")


@query("A1_A21_csv_round_trip")
def csv(ws):
    """Text with commas, quotes and blanks survives writing and reading."""
    raw = ws.contests.select(
        F.col("contest_id").cast("string").alias("contest_id"),
        F.concat(F.lit('"'), F.col("name1"), F.lit('", aka '), F.col("name2")).alias("title"), F.col("details"))
    path = place(ws, "csv")
    K.write_text_table(raw, path)
    back = R.read_text_table(ws.spark, path, ("contest_id", "title", "details"))
    return back.select(F.col("contest_id").cast("long").alias("contest_id"), "title", F.coalesce("details", F.lit("")).alias("details"))


@query("A21_year_partitions")
def year_partitions(ws):
    """All contests by years, then one year delivered again with other details; the rest stays as it was."""
    path = place(ws, "years")
    K.write_years(ws.contests, path)
    table = K.write_years(K.years_between(ws.contest_years, 1998, 1998).withColumn("details", F.lit("again")), path)
    return table.groupBy(K.YEAR).agg(F.count("*").alias("contests"), F.count_if(F.col("details") == "again").alias("again"),
                                     F.sum("contest_id").alias("ids"))


@query("A2_A3_competitor_source")
def competitor_source(ws):
    c = ws.competitors
    txt = lambda x: F.col(x).cast("string")
    raw = c.select(
        txt("competitor").alias("Fighter_Id"), F.col("name").alias("Full Name"), F.lit(None).cast("string").alias("Nickname"), F.lit("5' 11\"").alias("Ht."),
        F.when(F.col("nation") == 3, "None").otherwise(F.concat((F.col("competitor") % 90 + 115).cast("string"), F.lit(".5 lbs."))).alias("Wt."),
        F.lit("Orthodox").alias("Stance"), txt("wins").alias("W"), txt("losses").alias("L"), F.when(F.col("draws") > 3, txt("draws")).alias("D"),
        F.when(F.col("balance") > 9000, "TRUE").otherwise("no").alias("Belt"), F.col("home_division").alias("Weight_Class"), F.col("gender").alias("Gender"),
        F.lit("Boxer").alias("Fighting Style"), *[F.when(F.col("competitor") % (i + 2) == 0, F.lit("--")).otherwise(
            F.concat((F.col("competitor") % (i + 7)).cast("string"), F.lit(".5%"))).alias(c) for i, c in enumerate(R.COMPETITOR_NUMBERS)])
    return R.competitor_source(through_text(ws, raw, "competitors", R.COMPETITOR_TEXT))


@query("A4_A5_contest_source")
def contest_source(ws):
    events = ws.contests.select("event_id", F.col("event_id").alias("name"), F.date_format("date", "MMMM d, yyyy").alias("date"),
                                F.lit("Arena").alias("location"), F.col("contest_id").alias("ordinal"))
    raw = ws.contests.select(
        F.when(F.col("result1") != "NC", F.col("contest_id").cast("string")).alias("contest_id"), F.col("c1").cast("string").alias("c1"),
        F.col("c2").cast("string").alias("c2"), F.when(F.col("round") == 2, F.lit("unknown")).otherwise(F.col("event_id")).alias("event_id"))
    out = R.contest_source(raw, R.event_source(events))
    return out.select("contest_id", "c1", "c2", "event_id", "date")


@query("A6_A7_optional_sources")
def optional(ws):
    """A present feed is read, an absent one is empty."""
    p = B.recency_patch(ws.contests).select(
        F.col("c1").alias("fighter1_ourId"), F.col("name1").alias("fighter1_name"), F.col("c2").alias("fighter2_ourId"), F.col("name2").alias("fighter2_name"),
        text("date").alias("date"), "result1", "result2", "method", F.lit("2").alias("round"), F.col("division").alias("weightClass"),
        F.lit("e").alias("eventName"), F.lit("feed").alias("source"))
    here = R.patch_source(through_text(ws, p, "patch", R.PATCH_TEXT, True))
    gone = R.patch_source(R.read_optional(ws.spark, place(ws, "absent"), R.PATCH_TEXT))
    return here.unionByName(gone).select("c1", "c2", "date", "result1", "round", "has_metrics", "kd1")


@query("A8_outside_named_source")
def outside_named(ws):
    o = ws.outside.select(
        F.when(F.col("outside_id") % 11 == 0, "").otherwise(F.col("organisation")).alias("organisation"),
        F.when(F.col("outside_id") % 7 == 0, "n/a").otherwise(text("date")).alias("date"), F.concat(F.lit(" "), text("competitor")).alias("fighter1_name"),
        F.col("opponent_id").alias("fighter2_name"), F.upper("result").alias("fighter1_result"), F.lit("x").alias("fighter2_result"))
    return R.outside_named_source(through_text(ws, o, "outside", R.OUTSIDE_NAMED_TEXT)).groupBy("name", "organisation", "date", "result").agg(
        F.count("*").alias("n"), F.max("opponent").alias("opponent"))


@query("A8_outside_linked_source")
def outside_linked(ws):
    o = ws.outside.select(
        F.when(F.col("outside_id") % 11 == 0, "").otherwise(text("competitor")).alias("ourFighterId"), "organisation", "tier",
        text("tier_multiplier").alias("tierMultiplier"), text("date").alias("date"), F.concat(F.lit("Rival "), "opponent_id").alias("opponentName"),
        F.col("opponent_id").alias("opponentSherdogId"), F.initcap("result").alias("result"))
    return R.outside_linked_source(through_text(ws, o, "outside", R.OUTSIDE_LINKED_TEXT)).groupBy("competitor", "tier", "result").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("opponent_id").alias("rival"), F.max("tier_multiplier").alias("multiplier"))


@query("A9_A11_price_source")
def price_source(ws):
    p = ws.prices.select(
        text("price_id").alias("price_id"), text("date").alias("date"), "event", F.when(F.col("outcome") == "unknown", "").otherwise(F.col("favourite")).alias("favourite"), "underdog",
        text("fav_odds").alias("favourite_odds"),
        F.when(F.col("dog_odds") > 10, "n/a").otherwise(text("dog_odds")).alias("underdog_odds"), F.upper("outcome").alias("outcome"))
    return R.price_source(through_text(ws, p, "prices", ("price_id", *R.PRICE_TEXT)))


@query("A7_merge_source")
def merge_rows(ws):
    """Rows with a blank id go; an absent file is no merge at all."""
    m = ws.roster.select(text("competitor").alias("secondary_id"), F.when(F.col("competitor") % 4 == 1, "").otherwise(
        (F.col("competitor") + 1).cast("string")).alias("primary_id"), F.lit('a "note", quoted').alias("reason"))
    here = through_text(ws, m, "merges", R.MERGE_TEXT, optional=True)
    gone = R.read_optional(ws.spark, place(ws, "absent"), R.MERGE_TEXT)
    return R.merge_source(here.unionByName(gone))


@query("A10_book_source")
def book_rows(ws):
    i = F.col("contest_id")
    b = B.side_prices(ws.contests).select(
        F.when(i % 13 == 0, "").otherwise(text("date")).alias("date"), F.col("event_id").alias("event_slug"), F.col("name1").alias("fighter1"), F.col("name2").alias("fighter2"),
        F.when(i % 5 == 0, "").otherwise(text("price1")).alias("open1"), F.when(i % 17 == 0, "-").otherwise(text("price1")).alias("close1"),
        F.lit("0").alias("open2"), text("price2").alias("close2"))
    return R.book_source(through_text(ws, b, "books", R.BOOK_TEXT))


@query("A11_upcoming_source")
def upcoming_rows(ws):
    u = B.upcoming(ws.contests).select(
        F.when(F.col("slot_id") % 3 == 0, " ").otherwise(F.col("event_id")).alias("event_id"), "event_name",
        F.when(F.col("slot_id") % 5 == 0, "soon").otherwise(text("date")).alias("event_date"), text("bout_order").alias("bout_order"),
        F.col("division").alias("weight_class"), F.when(F.col("main_event"), "1").otherwise("0").alias("is_main_event"),
        F.concat(F.lit(" "), text("c1")).alias("fighter1_ourId"), F.col("name1").alias("fighter1_name"), F.concat(F.lit("x"), text("c1")).alias("fighter1_sherdogId"),
        F.coalesce(text("c2"), F.lit("")).alias("fighter2_ourId"), F.col("name2").alias("fighter2_name"))
    return R.upcoming_source(through_text(ws, u, "upcoming", R.UPCOMING_TEXT, optional=True))


@query("A12_A13_birth_and_reach_sources")
def side_tables(ws):
    b = ws.competitors.select("competitor", F.when(F.col("gender") == "Male", "1970-02-03").otherwise("Feb 1970").alias("dob"), F.lit("year").alias("precision"))
    r = B.reach_text(ws.competitors)
    return R.birth_source(b).join(R.reach_source(r), "competitor", "full_outer")


@query("A14_media_source")
def media_rows(ws):
    m, p, codes = B.media_tables(ws.roster, ws.table("nation"))
    return R.media_source(through_text(ws, m, "media", R.MEDIA_TEXT, True), through_text(ws, p, "photos", R.PHOTO_TEXT, True), codes)


@query("A16_alias_source")
def alias_rows(ws):
    a = B.aliases(ws.roster).select("normalized_name", "source", F.when(F.col("canonical_id") % 6 == 0, "").otherwise(text("canonical_id")).alias("canonical_id"))
    return R.alias_source(through_text(ws, a, "aliases", R.ALIAS_TEXT, True))


@query("A15_title_pair_dates")
def title_pairs(ws):
    t = ws.titles.select(C.pair_key(F.col("champion"), F.col("challenger")).alias("pair"), "date")
    return R.title_source(t).select("pair", F.size("dates").alias("titles"), F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"))


@query("A17_reign_ledger")
def ledger_json(ws):
    """The ledger as one JSON text per division group, parsed back."""
    reign = F.struct(F.col("holder").cast("string").alias("champion"), F.col("start").cast("string").alias("start"),
                     F.col("end").cast("string").alias("end"), "interim")
    per = ws.reigns.groupBy("division").agg(F.sort_array(F.collect_list(F.struct("reign_id", reign.alias("r")))).alias("x"))
    text = per.select(F.to_json(F.map_from_arrays(F.array("division"), F.array(F.transform("x", lambda s: s["r"])))).alias("value"))
    rows, _ = R.reign_ledger(text)
    return rows


@query("A18_external_ranking_json")
def ranking_json(ws):
    e = ws.external.withColumn("k", F.coalesce(F.col("rank").try_cast("int"), F.lit(0)))
    one = e.groupBy("division").agg(
        F.max(F.when(F.col("k") == 0, F.col("name"))).alias("champ"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("k", "name")))), lambda s: F.struct(s["k"].cast("string").alias("id"), s["name"].alias("name"))).alias("fighters"))
    both = one.select("division", "champ", "fighters").unionByName(one.withColumn("division", F.concat(F.lit("Pound-for-Pound "), "division")))
    text = both.select(F.to_json(F.array(F.struct(F.col("division").alias("id"), F.col("division").alias("categoryName"),
                       F.struct(F.lit("c").alias("id"), F.col("champ").alias("championName")).alias("champion"), "fighters"))).alias("value"))
    return R.external_rankings(text)


@query("A19_A22_json_analysis")
def analysis(ws):
    out = ws.samples_priced.select("price_id", h(F.col("model_p"), 3).alias("model_p"), "fav_won")
    path = place(ws, "analysis")
    K.write_json(out, path)
    return R.read_analysis(ws.spark, path, "price_id bigint, model_p double, fav_won boolean")


@query("A20_raw_result_source")
def raw_result_rows(ws):
    rows = B.raw_results(ws.contests).withColumn("EVENT", F.when(F.col("contest_id") % 19 == 0, "").otherwise(F.col("EVENT")))
    return R.raw_source(through_text(ws, rows, "results", R.RAW_RESULT_TEXT)).groupBy("WEIGHTCLASS", "METHOD", "OUTCOME").agg(
        F.count("*").alias("n"), F.min("EVENT").alias("first"), F.max("BOUT").alias("last"))


@query("A20_raw_event_and_physical_sources")
def raw_event_rows(ws):
    e = ws.contests.select(F.concat(F.col("event_id"), F.lit(" ")).alias("EVENT"), F.date_format("date", "MMMM d, yyyy").alias("DATE"), F.lit("Rio, Brazil").alias("LOCATION"))
    p = ws.roster.select(F.when(F.col("competitor") % 9 == 0, "").otherwise(F.col("name")).alias("FIGHTER"), F.lit("5' 11\"").alias("HEIGHT"),
                         F.lit("--").alias("WEIGHT"), F.lit('72"').alias("REACH"), F.lit(" Southpaw").alias("STANCE"))
    events = R.raw_source(through_text(ws, e, "events", R.RAW_EVENT_TEXT)).groupBy("EVENT", "DATE", "LOCATION").agg(F.count("*").alias("n"))
    people = R.raw_source(through_text(ws, p, "physical", R.RAW_PHYSICAL_TEXT), "FIGHTER")
    return events.select("EVENT", "DATE", "LOCATION", "n").unionByName(people.groupBy(
        F.col("FIGHTER").alias("EVENT"), F.col("HEIGHT").alias("DATE"), F.col("STANCE").alias("LOCATION")).agg(F.count("*").alias("n")))


@query("A20_raw_round_source")
def raw_round_rows(ws):
    """Per-round text rows through files, then summed per side of a contest."""
    back = {"COMPETITOR": "FIGHTER", "SIG_STR": "SIG.STR.", "TOTAL_STR": "TOTAL STR.", "SUB_ATT": "SUB.ATT", "REV": "REV."}
    rows = ws.raw_rounds.toDF(*[back.get(c, c) for c in ws.raw_rounds.columns])
    return etl.aggregate_rounds(R.round_source(through_text(ws, rows, "rounds", R.RAW_ROUND_TEXT))).select(
        "event", "bout", "name", "kd", "sub_att", "rev", "ctrl", "head_landed", "ground_attempted")


@query("A23_append_only_sink")
def append(ws):
    """Three overlapping appends leave one row per key."""
    path = place(ws, "append")
    rows = B.crosswalk(ws.competitors).select("competitor", "foreign_id")
    for part in (rows.filter("foreign_id < 'F5'"), rows, rows):
        K.append_new(part, path, ["competitor"], ws.spark)
    return ws.spark.read.parquet(path)


@query("A24_report_tables")
def report(ws):
    y = F.year("date").alias("year")
    return ws.contests.rollup("division", y).agg(F.count("*").alias("contests"), F.count_if("has_metrics").alias("with_metrics")).select(
        F.coalesce("division", F.lit("all")).alias("division"), F.coalesce("year", F.lit(0)).alias("year"), "contests", "with_metrics")


# ── streams ───────────────────────────────────────────────────────────────

@query("S1_guarded_ingest")
def ingest(ws):
    src, out = place(ws, "s1-in"), place(ws, "s1-out")
    patch = B.recency_patch(ws.contests)
    pair = name_pair(F.col("name1"), F.col("name2"))
    for part in (0, 1, 2, 2, 0):  # in five deliveries, two of them repeats
        patch.filter(F.col("patch_id") % 3 == part).repartition(2, pair).write.mode("append").parquet(src)
    J.guarded_ingest(J.file_stream(ws.spark, src, patch, 1), ws.contests, out, place(ws, "s1-cp"))
    return ws.spark.read.parquet(out).select("patch_id", "date", "c1", "c2")


def yearly(ws, df, name, years):
    """One delivery per span of years, in the given order, each of two files."""
    src = place(ws, name)
    for lo, hi in years:
        df.filter(F.year("date").between(lo, hi)).repartition(2, "contest_id").write.mode("append").parquet(src)
    return src


@query("S2_online_ratings")
def online(ws):
    df = ws.contests.select("contest_id", "date", "c1", "c2", "result1", "result2", "method", "division")
    src, out = yearly(ws, df, "s2-in", ((0, 1995), (1998, 1998), (1996, 1997), (1998, 1998), (1999, 9999), (0, 1996))), place(ws, "s2-out")
    J.online_ratings(J.file_stream(ws.spark, src, df, 2), out, place(ws, "s2-cp"), ws.as_of)
    s = J.online_state(ws.spark, out)
    return s.select("competitor", "seen", "last_date", "last_label", h(F.col("dev") + 1500, 6).alias("rating"))


@query("S3_price_result_join")
def price_join(ws):
    # names that resolve to nobody have no pair and match nothing
    # tables, as every delivery reads them; a delivery is one file, but only its own rows go through one task
    p = ws.keep("s3-prices", ws.prices.join(ws.resolved_prices, "price_id").select("price_id", C.pair_key(F.col("fav_id"), F.col("dog_id")).alias("pair"), F.col("date").cast("timestamp").alias("price_ts")))
    c = ws.keep("s3-contests", ws.contests.select("contest_id", C.pair_key(F.col("c1"), F.col("c2")).alias("pair"), F.col("date").cast("timestamp").alias("contest_ts")))
    # a file a year and side, then prices of the first year that come too late, then rows that only move time on
    a, b, out = place(ws, "s3-p"), place(ws, "s3-c"), place(ws, "s3-out")
    first, final = c.agg(F.min(F.year("contest_ts")), F.max(F.year("contest_ts"))).first()
    late = (F.year("price_ts") == first) & (F.col("price_id") % 50 == 0)
    for year in range(first, final + 1):
        edge = lambda ts: (F.year(ts) == year) if first < year < final else (F.year(ts) <= year if year == first else F.year(ts) >= year)
        p.filter(edge("price_ts") & ~late).repartition(1).write.mode("append").parquet(a)
        c.filter(edge("contest_ts")).repartition(1).write.mode("append").parquet(b)
    p.filter(late).repartition(1).write.mode("append").parquet(a)
    tick = lambda df, ts: df.limit(1).select(*[{ts: F.lit(f"{final + 1}-06-01").cast("timestamp"), "pair": F.lit(ts)}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema])
    for side, ts, path in ((p, "price_ts", a), (c, "contest_ts", b)):
        tick(side, ts).coalesce(1).write.mode("append").parquet(path)
    q = J.price_results(J.file_stream(ws.spark, a, p, 1), J.file_stream(ws.spark, b, c, 1), out, place(ws, "s3-cp"))
    given = ws.spark.read.parquet(out).filter("price_id is not null").select("price_id", "contest_id", F.when(F.col("contest_id").isNull(), "unmatched").otherwise("matched").alias("kind"))
    behind = J.late_prices(ws.spark.read.parquet(a), out, q.lastProgress["eventTime"]["watermark"])
    return given.unionByName(behind.select("price_id", F.lit(None).cast("bigint").alias("contest_id"), F.lit("late").alias("kind")))


def run_dates(rows, n=4):
    """n + 1 days, evenly spread from before the first to after the last contest."""
    lo, hi = rows.agg(F.date_sub(F.min("date"), 1), F.date_add(F.max("date"), 1)).first()
    return [lo + datetime.timedelta(days=(hi - lo).days * k // n) for k in range(n + 1)]


@query("S4_ledger_stream")
def ledger(ws):
    pre = ws.history.filter(F.col("side") == 1).select("contest_id", C.win_probability(F.col("rating_before"), F.col("opponent_rating")).alias("prob1"))
    rows = ws.contests.join(pre, "contest_id", "left").select(
        F.col("contest_id").alias("slot_id"), "event_id", "date", "c1", "c2", F.coalesce("prob1", F.lit(0.5)).alias("prob1"),
        F.lit(None).cast("double").alias("form_prob1"))
    src, out = place(ws, "s4-in"), place(ws, "s4-out")
    runs = run_dates(rows)
    for day, following in zip(runs, [*runs[1:], None]):
        d = F.lit(day)
        batch = rows.filter((F.col("date") > d) & (F.col("date") <= F.lit(following))) if following else \
            rows.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        batch.withColumn("run_date", d).repartition(2, "slot_id").write.mode("append").parquet(src)
    like = rows.withColumn("run_date", F.current_date())
    J.ledger_stream(J.file_stream(ws.spark, src, like, 1), ws.contests.select("c1", "c2", "date", "result1", "result2"), out, place(ws, "s4-cp"))
    return J.ledger_rows(ws.spark, out).select("slot_id", "date", "snapshot_on", "status", "winner", "settled_on", r6("prob1"))


@query("S5_running_scores")
def running(ws):
    g = ws.samples_priced.select("date", F.explode(F.array(
        F.struct(F.lit("model").alias("model"), F.col("model_p").alias("p")), F.struct(F.lit("market").alias("model"), F.col("market_p").alias("p")))).alias("x"),
        F.col("fav_won").alias("won1")).select("date", "x.*", "won1")
    src, out = place(ws, "s5-in"), place(ws, "s5-out")
    g.write.parquet(src)
    J.running_scores(J.file_stream(ws.spark, src, g), out, place(ws, "s5-cp"))
    return J.latest_version(ws.spark, out).select("month", "model", "n", "hits", r6("loss"), r6("brier"))


@query("S6_activity_rates")
def activity(ws):
    src = ws.table("events").select("event_id", "ts", "user_id", "value")
    path, out = place(ws, "s6-in"), place(ws, "s6-out")
    src.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts").write.parquet(path)
    J.activity_rates(J.file_stream(ws.spark, path, ws.spark.read.parquet(path)), out, place(ws, "s6-cp"))
    return J.latest_windows(ws.spark, out).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n", h(F.col("value"), 4).alias("value"))


# ── rows-only: iterative jobs without a practical SQL counterpart ──────────

@query("H15_parameter_search")
def search(ws):
    """The whole grid in two passes of the coordinate search (each line is one sweep)."""
    from duelgrid.plans.market_queries import score_line
    _, _, _, trail = T.coordinate_search(lambda cs: score_line(ws, cs), ws.engine, passes=2)
    return ws.spark.createDataFrame([(p, k, v, round(s, 6), b) for p, k, v, s, b in trail], "pass int, knob string, value double, log_loss double, improved boolean")


@query("D1_sliced_sweep")
def sliced(ws):
    """The same history from at least four time slices with carried state."""
    hist = sweep.sweep(ws.contests, ws.engine, ws.as_of, slice_rows=max(1, ws.contests.count() // 4))
    return hist.select("contest_id", "competitor", r6("rating_before"), r6("rating_after"))
