"""Discovery, query surface, quality, pages and ledger queries (E7, F, H27, I, J, K ids)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from duelgrid.config import FilterParams
from duelgrid.functions import core as C
from duelgrid.operators import analytics as A, backtest as T, discovery as D, ledger as L, market as M, pages as P, pedigree as PD, quality as Q, surface as S
from duelgrid.plans.analytics_queries import radar_frame
from duelgrid.plans.register import registrar
from duelgrid.sources import bindings as B, readers as R

QUERIES, query = registrar()
h = C.half_up
r6 = lambda c: h(F.col(c), 6).alias(c)
flat = lambda items, *fields: F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "; ")


@query("E7_pedigree_by_organisation")
def by_organisation(ws):
    p = PD.pedigree_by_organisation(ws.outside, ws.sides, excluded=("HOUSEHOLD",))
    return p.select("competitor", "wins", "losses", "draws", r6("strength"), flat("by_organisation", "organisation", "wins", "losses", "draws").alias("by_organisation"))


@query("F1_ranked_pool")
def pool(ws):
    return D.ranked_pool(ws.final).select("competitor", "division", "final_rating", "is_champion")


@query("F2_top_list")
def top(ws):
    return D.top_list(D.ranked_pool(ws.final)).select("place", "competitor", "division", "final_rating", "schedule_quality")


@query("F3_leaderboards")
def boards(ws):
    return D.leaderboards(D.ranked_pool(ws.final), ws.competitors)


@query("F4_division_benchmarks")
def benchmarks(ws):
    return D.division_benchmarks(ws.final, ws.pace_wide)


@query("F5_division_depth")
def depth(ws):
    return D.division_depth(ws.final)


@query("F6_prospects")
def prospects(ws):
    """Over test ids with short careers; what is known of a competitor holds for all careers under its name."""
    booked = S.next_contests(B.upcoming(ws.contests), ws.today)
    log = B.short_careers(ws.log, ws.today)
    careers = log.select("competitor", "holder").distinct()
    of = lambda df: careers.join(df.withColumnRenamed("competitor", "holder"), "holder").drop("holder")
    ages = ws.births.select("competitor", C.whole_years(F.col("born"), ws.today).alias("age"))
    return D.prospects(log, of(ws.states), ws.final, booked, of(ws.competitors), of(ages), of(ws.pedigree), ws.today, A.short_method)


@query("F7_outside_prospects")
def outside_prospects(ws):
    known = ws.table("nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("opponent_id"))
    outside = ws.outside.withColumn("opponent_name", F.concat(F.lit("Rival "), "opponent_id"))
    return D.outside_prospects(outside, known, ws.roster, "1995-01-01")


@query("F9_pedigree_coverage")
def pedigree_coverage(ws):
    return D.pedigree_coverage(ws.competitors, ws.pedigree, ws.sides, ws.today)


# ── query surface ─────────────────────────────────────────────────────────

@query("I1_division_ranking")
def division(ws):
    known = {r[0] for r in ws.competitors.select("home_division").distinct().collect()} - {""}
    return S.division_ranking(ws.rankings(FilterParams.parse({"era": "all", "finish": "0.5"})), "EUROPE", known).select(
        "rank", "competitor", "name", "final_rating", "display_score")


@query("I2_dashboard")
def dashboard(ws):
    d = S.dashboard(ws.final)
    return d.select("division", "champion", flat("contenders", "contender_rank", "name").alias("contenders"), F.size("depth").alias("depth_size"),
                    F.col("depth")[0].alias("deepest"))


@query("I3_competitor_profile")
def profile(ws):
    """The profile of the best-rated competitor."""
    best = ws.profile.orderBy(F.desc("rating"), "competitor").limit(1).select("competitor")
    return ws.profile.join(best, "competitor", "left_semi")


def reaches(ws):
    return R.reach_source(B.reach_text(ws.competitors))


def form_text(log):
    return A.recent_form(log).select("competitor", F.array_join(F.transform("form", lambda x: F.concat_ws(" ", x["result"], x["label"])), "; ").alias("form"))


@query("I3_competitor_with_hint")
def hinted(ws):
    """Two reads: the smallest ranked id with its last division as the hint, and the largest ranked id without one."""
    low, high = ws.final.agg(F.min("competitor"), F.max("competitor")).first()
    hint = ws.final.filter(F.col("competitor") == low).agg(F.max("division")).first()[0]
    following = S.next_contests(B.upcoming(ws.contests), ws.today)
    form = form_text(ws.log_of(low, high))
    read = lambda who, h=None: S.competitor(ws.profile, ws.final, following, form, who, h)
    return read(low, hint).unionByName(read(high))


@query("G18_I3_nested_profile")
def nested(ws):
    """Every competitor's profile with its nested parts, laid flat."""
    trends = A.trend_codes(ws.pace_wide, ws.trend_context, A.durability(ws.sides, ws.pace))
    radar = A.radar(ws.sides, radar_frame(ws), ws.today)
    n = S.nested_profile(
        ws.profile, radar, trends, A.gauntlet_summary(A.gauntlet_points(ws.log)), D.division_benchmarks(ws.final, ws.pace_wide),
        R.media_source(*B.media_tables(ws.roster, ws.table("nation"))), reaches(ws), S.next_contests(B.upcoming(ws.contests), ws.today))
    return n.select("competitor", "name", "rating", "reach", r6("radar.strike").alias("strike"), r6("radar.activity").alias("activity"), F.array_join("trend.codes", ",").alias("codes"),
                    F.col("gauntlet.total_overperformance").alias("total_overperformance"), F.col("gauntlet.upset_contest").alias("upset_contest"),
                    F.col("benchmark.ratio").alias("peer_ratio"), F.col("benchmark.sample").alias("peer_sample"), F.col("media.avatar").alias("avatar"),
                    F.col("media.nationality").alias("nationality"), F.col("next_contest.date").alias("next_date"), F.col("next_contest.opponent_name").alias("next_opponent"))


@query("I4_name_search")
def search(ws):
    return S.search(ws.competitors, "vanb")


@query("I4_index_search")
def index_search(ws):
    """The same search from the index of name runs, for texts of several kinds."""
    asked = ("vanb", "AN", "3", "zzzz", "vanbu")
    found = [S.search_index(ws.name_index, t).withColumn("asked", F.lit(t)) for t in asked]
    return reduce(DataFrame.unionByName, found)


@query("I5_upcoming_events")
def events(ws):
    e = S.upcoming_events(B.upcoming(ws.contests), ws.today)
    return e.select("event_id", "date", "event_name", flat("bouts", "bout_order", "name1", "name2").alias("bouts"))


@query("I6_next_contest")
def next_contest(ws):
    return S.next_contests(B.upcoming(ws.contests), ws.today)


@query("I7_upcoming_cards")
def cards(ws):
    titles = ws.titles.select(C.pair_key(F.col("champion"), F.col("challenger")).alias("pair"), "date")
    log = M.title_flags(ws.log.withColumn("pair", C.pair_key(F.col("competitor"), F.col("opponent"))), titles)
    form = A.recent_form(log).select("competitor", F.array_join(F.transform("form", lambda x: F.concat_ws(
        " ", x["result"], x["label"], F.when(x["is_title"], "(title)"))), "; ").alias("form"))
    e = S.enrich_upcoming(B.upcoming(ws.contests), ws.profile.join(reaches(ws), "competitor", "left"), ws.today, form)
    return e.select("slot_id", "c1", "c2", "reach1", "reach2", "rank_label1", "rank_label2", "style1", "style2", "age1", "age2", "record1", "record2", "form1", "form2",
                    r6("prob1"), r6("form_prob1"))


@query("I8_event_list")
def event_list(ws):
    return S.event_list(B.upcoming(ws.contests), ws.today)


@query("I8_find_event")
def find_event(ws):
    return S.find_event(B.upcoming(ws.contests), "hugo van", ws.today)


def rivals(ws):
    """Each division's two best-rated competitors."""
    return ws.ranked.filter("pos <= 2").groupBy(F.col("division").alias("pair_id")).agg(
        F.max(F.when(F.col("pos") == 1, F.col("competitor"))).alias("a"), F.max(F.when(F.col("pos") == 2, F.col("competitor"))).alias("b"))


def compared(ws):
    career = ws.pace_wide.select("competitor", F.col("career.diff15").alias("diff15"))
    return ws.profile.join(reaches(ws), "competitor", "left").join(career, "competitor", "left")


@query("I9_compare_probabilities")
def compare(ws):
    return S.compare(compared(ws), rivals(ws))[0]


@query("I9_compare_statistics")
def compare_rows(ws):
    return S.compare(compared(ws), rivals(ws))[1]


@query("I10_summary")
def summary(ws):
    s = S.summary(ws.profile, ws.final, ws.log)
    return s.withColumn("last_contests", flat("last_contests", "rev", "result", "opponent_name", "swing"))


@query("I11_card_view")
def card_view(ws):
    return S.card_view(S.enrich_upcoming(B.upcoming(ws.contests), ws.profile, ws.today), ws.today)


# ── quality ───────────────────────────────────────────────────────────────

def snapshot_pair(ws):
    """The pure rating order against the final list with its reorder rules."""
    old = ws.ranked.filter("pos <= 15").select("division", "competitor", F.col("pos").alias("rank"), F.col("rank_score").alias("score"))
    return old, ws.final.filter("rank <= 15").select("division", "competitor", "rank", F.col("display_score").alias("score"))


@query("J1_golden_diff")
def golden(ws):
    d = Q.golden_diff(*snapshot_pair(ws))
    return d.select("division", "competitor", "old_rank", "new_rank", "kind", "drift")


@query("J1_golden_verdict")
def golden_verdict(ws):
    return Q.golden_verdict(Q.golden_diff(*snapshot_pair(ws)))


@query("J2_load_summary")
def load_summary(ws):
    return Q.load_summary(ws.competitors, ws.contests)


@query("J3_invariants")
def invariants(ws):
    return Q.invariants(PD.pedigree_by_organisation(ws.outside, ws.sides, excluded=("HOUSEHOLD",)), ws.pedigree, ws.final, "HOUSEHOLD", 0.75)


# ── pages ─────────────────────────────────────────────────────────────────

@query("K1_page_links")
def page_links(ws):
    return P.links(ws.table("pages"))


@query("K1_numbered_links")
def numbered(ws):
    return P.trailing_ids(ws.table("pages"))


@query("K1_slug_ids")
def slug_ids(ws):
    return P.numbered_links(slug_pages(ws), "competitor")


def slug_pages(ws):
    """Contest pages: links to both competitors in two spellings, price cells and a date."""
    c = B.side_prices(ws.contests)
    tag = lambda n, i: F.concat(F.lit('<a href="/competitor/'), F.regexp_replace(n, " ", "-"), F.lit("-"), i.cast("string"), F.lit('">x</a>'))
    am = lambda p: C.decimal_to_american(p).cast("int").cast("string")
    cell = lambda b, s, p: F.concat(F.lit(f'<td data-li="[{b},{s},'), F.col("contest_id").cast("string"), F.lit(']" class="x"> <span>'), am(p), F.lit("</span></td>"))
    row = F.concat(F.lit('<tr id="mu-'), F.col("contest_id").cast("string"), F.lit('">'))
    side_bet = F.concat(F.lit('<td data-li="[28,1,9'), F.col("contest_id").cast("string"), F.lit('7]" class="x"> <span>+150</span></td>'))
    html = F.concat(row, side_bet, tag(F.col("name1"), F.col("c1")), tag(F.upper("name1"), F.col("c1")), tag(F.col("name2"), F.col("c2")),
                    F.lit('<a href="/competitor/list">all</a>'), *[cell(b, s, F.col(f"price{s}")) for b in (28, 1) for s in (1, 2)])
    return c.select(F.col("contest_id").alias("page_id"), html.alias("html"))


@query("K2_date_shapes")
def date_shapes(ws):
    d = F.col("date")
    shapes = F.array(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T18:00:00-04:00")), F.date_format(d, "MMM / dd / yyyy"),
                     F.date_format(d, "MMMM d, yyyy"), F.lit("to be announced"))
    return ws.contests.select("contest_id", F.posexplode(shapes).alias("shape", "raw")).select(
        "contest_id", "shape", P.normal_date(F.col("raw")).alias("date"))


@query("K3_price_cells")
def price_cells(ws):
    return P.attribute_cells(slug_pages(ws)).withColumn("price", h(F.col("price"), 6)).drop("page_id")


@query("K4_slug_names")
def slug_names(ws):
    n = P.numbered_links(slug_pages(ws), "competitor")
    return n.groupBy(P.slug_name(F.col("slug")).alias("name")).agg(F.count("*").alias("pages"))


@query("K4_event_titles")
def event_titles(ws):
    title, subtitle = P.split_title(F.col("event_name"))
    u = B.upcoming(ws.contests).withColumn("event_name", F.when(F.col("slot_id") % 4 == 0, F.col("event_id")).otherwise(F.col("event_name")))
    return u.select("slot_id", title.alias("title"), subtitle.alias("subtitle"))


@query("K5_search_queries")
def search_queries(ws):
    name = F.when(F.col("contest_id") % 3 == 0, F.concat(F.lit("Promo "), (F.col("contest_id") % 400).cast("string"), F.lit(" - x"))).otherwise(
        F.concat(F.lit("Promo Night: "), "name1", F.lit(" vs. "), "name2"))
    return P.search_queries(ws.contests.select(name.alias("name")), "Promo")


# ── ledger ────────────────────────────────────────────────────────────────

def ledger_run(ws):
    """Freeze every contest before the first one from its pre-contest ratings, settle at as_of."""
    pre = ws.history.filter(F.col("side") == 1).select(
        "contest_id", C.win_probability(F.col("rating_before"), F.col("opponent_rating")).alias("prob1"))
    preds = ws.contests.join(pre, "contest_id", "left").select(
        F.col("contest_id").alias("slot_id"), "event_id", F.date_add("date", (F.col("contest_id") % 5 - 2).cast("int")).alias("date"),
        F.when(F.col("contest_id") % 23 == 0, F.col("c1") + 500000).otherwise(F.col("c1")).alias("c1"), "c2",
        F.coalesce("prob1", F.lit(0.5)).alias("prob1"), F.when(F.col("contest_id") % 2 == 0, F.coalesce("prob1", F.lit(0.5)) * 0.9).alias("form_prob1"))
    empty = ws.spark.createDataFrame([], L.SCHEMA)
    frozen = L.freeze(empty, preds, F.lit("1994-12-01").cast("date"))
    return L.settle(frozen, ws.contests.select("c1", "c2", "date", "result1", "result2"), ws.today)


@query("H27_prediction_ledger")
def ledger(ws):
    l = ledger_run(ws)
    return l.select("slot_id", "date", "status", "winner", "settled_on", r6("prob1"))


@query("H27_ledger_scores")
def ledger_scores(ws):
    s = T.scores(L.graded(ledger_run(ws)), "p", "won1", ["model"])
    return s.select("model", "n", *[r6(c) for c in ("log_loss", "brier", "accuracy")])
