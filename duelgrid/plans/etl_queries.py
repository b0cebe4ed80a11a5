"""ETL and identity queries (B and C ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelgrid.functions import core as C
from duelgrid.functions.names import VARIANTS, last_first_key, name_pair, normalize_name, surname
from duelgrid.operators import attributes as AT, etl, identity as I
from duelgrid.operators.identity_rules import ORGANISATIONS, organisation_dictionary, tier_of, title_dictionary
from duelgrid.plans.register import registrar
from duelgrid.sources import bindings as B

QUERIES, query = registrar()
h = C.half_up


@query("B1_B2_cell_parsing")
def cells(ws):
    r = ws.raw_rounds
    return r.groupBy("EVENT", "COMPETITOR").agg(
        F.sum(C.landed_of(F.col("TD"))["landed"]).alias("td_landed"), F.sum(C.landed_of(F.col("TD"))["attempted"]).alias("td_attempted"),
        F.sum(C.landed_of(F.col("GROUND"))["landed"]).alias("ground_landed"), F.sum(C.clock_seconds(F.col("CTRL"))).alias("ctrl"))


@query("B3_long_dates")
def dates(ws):
    return B.raw_events(ws.contests).select("EVENT", C.long_date(F.col("DATE")).alias("date"))


@query("B4_B17_division_labels")
def divisions(ws):
    d = C.canonical_division(F.col("WEIGHTCLASS"), "Promo")
    return B.raw_results(ws.contests).groupBy(d.alias("division"), C.gender_of(F.concat(F.lit("Women's "), d)).alias("gender")).agg(F.count("*").alias("n"))


@query("B5_B6_outcomes_and_methods")
def outcomes(ws):
    return B.raw_results(ws.contests).groupBy(
        C.outcome_side(F.col("OUTCOME"), 1).alias("result1"), C.outcome_side(F.col("OUTCOME"), 2).alias("result2"),
        C.canonical_method(F.col("METHOD")).alias("method")).agg(F.count("*").alias("n"))


@query("B7_surrogate_keys")
def keys(ws):
    return B.raw_results(ws.contests).select("contest_id", C.hash_key(F.trim("EVENT"), F.trim("BOUT")).alias("contest_key"),
                                             C.hash_key(F.trim("EVENT")).alias("event_key"))


@query("B8_round_aggregation")
def rounds(ws):
    return ws.side_stats


@query("B9_B10_contest_assembly")
def assembly(ws):
    events = B.raw_events(ws.contests).select(F.col("EVENT").alias("event"), C.long_date(F.col("DATE")).alias("date"))
    return etl.assemble_contests(B.raw_results(ws.contests), ws.side_stats, events, "Promo")


@query("B11_B16_career_totals")
def career(ws):
    return etl.career_totals(ws.side_stats)


@query("B12_B15_records_and_rates")
def records(ws):
    return etl.records(ws.sides)


@query("B13_B14_home_division")
def home(ws):
    return etl.home_division(ws.sides, ws.as_of)


@query("B18_physical_lookup")
def physical(ws):
    return etl.physical_lookup(B.raw_physical(ws.spark, ws.dir))


# ── identity ──────────────────────────────────────────────────────────────

@query("C1_reresolved_participants")
def reresolved(ws):
    out = I.reresolve_contests(B.foreign_named_contests(ws.contests), I.alias_registry(B.aliases(ws.roster)), ws.roster)
    return out.select("contest_id", "c1", "c2")


def patched(ws):
    return I.resolve_synthetic(I.patch_verdicts(ws.contests, B.recency_patch(ws.contests)), ws.roster)


@query("C2_C3_patch_verdicts")
def verdicts(ws):
    return I.patch_verdicts(ws.contests, B.recency_patch(ws.contests)).select("patch_id", "date", "verdict")


@query("C4_synthetic_ids")
def synthetic(ws):
    return patched(ws).select("patch_id", "c1", "c2", "resolved1", "resolved2")


@query("C5_patch_counters")
def counters(ws):
    return I.patch_counters(patched(ws))


@query("C6_identity_merges")
def merged(ws):
    return I.apply_merges(ws.contests, B.merges(ws.spark, ws.dir)).select("contest_id", "date", "c1", "c2")


@query("C6_roster_after_merges")
def merged_roster(ws):
    return I.roster_without(ws.roster, B.merges(ws.spark, ws.dir)).select("competitor", "name")


@query("C7_sides")
def sides(ws):
    return ws.sides.select("contest_id", "side", "competitor", "opponent", "result", "nth", "rev", "str_self", "str_opp")


@query("C8_name_variants")
def variants(ws):
    n = B.feed_name(F.col("name"), F.col("competitor"))
    return ws.roster.select("competitor", *[normalize_name(n, v).alias(v) for v in VARIANTS],
                            last_first_key(n).alias("last_first"), surname(n).alias("surname"))


@query("C9_pair_keys")
def pairs(ws):
    return ws.contests.groupBy(name_pair(F.col("name1"), F.col("name2")).alias("pair")).agg(F.count("*").alias("meetings"))


@query("C10_name_cascade")
def cascade(ws):
    asked = ws.roster.select(F.explode(F.array(
        B.feed_name(F.col("name"), F.col("competitor")), F.concat(F.substring("name", 1, 1), F.lit(". "), F.element_at(F.split("name", " "), -1)))).alias("name"))
    return I.resolve_names(asked, ws.roster, B.feed_overrides(ws.roster))


@query("C11_alias_registry")
def registry(ws):
    return I.alias_registry(B.aliases(ws.roster))


@query("C13_known_opponents")
def opponents(ws):
    return I.known_opponents(ws.sides).groupBy("competitor").agg(F.count("*").alias("opponents"))


def matching(ws):
    ours = ws.competitors.select("competitor", "name", F.col("home_division").alias("division"))
    return (ours, ws.profiles.select("foreign_id", "foreign_name", "foreign_division"), I.known_opponents(ws.sides),
            B.foreign_opponents(ws.profiles, ws.sides))


@query("C14_match_candidates")
def blocks(ws):
    return I.candidate_counts(*matching(ws)[:2])


@query("C15_candidate_scores")
def scores(ws):
    return I.evidence_pairs(*matching(ws))


@query("C16_C17_best_and_verdict")
def best(ws):
    return I.best_matches(*matching(ws))


@query("C18_unmapped_ids")
def unmapped(ws):
    c = B.crosswalk(ws.competitors)
    return I.unmapped(ws.roster, c.filter("confidence >= 60"), c.filter("confidence < 60")).select("competitor", "name")


@query("C19_duplicate_audit")
def duplicates(ws):
    return I.duplicate_audit(B.shared_name_roster(ws.roster), ws.sides)


@query("C19_duplicate_pairs")
def duplicate_pairs(ws):
    return I.duplicate_pairs(B.shared_name_roster(ws.roster), B.repeated_sides(ws.sides))


@query("C20_claimed_edges")
def claimed(ws):
    return I.claimed_edges(ws.sides)


@query("C20_edge_audit")
def edges(ws):
    return I.edge_audit(ws.sides)


@query("C21_split_identities")
def splits(ws):
    return I.split_identities(B.crosswalk(ws.competitors))


@query("C22_weak_links")
def weak(ws):
    return I.weak_links(B.crosswalk(ws.competitors), ws.roster)


@query("C23_feed_links")
def links(ws):
    feed = ws.prices.select(F.col("favourite").alias("feed_name"), F.col("underdog").alias("opponent_name"), "date")
    return I.link_feed(feed, ws.roster, ws.sides)


@query("C23_record_gaps")
def gaps(ws):
    return I.record_gaps(ws.competitors)


@query("C23_registry")
def registry_out(ws):
    return I.registry_output(ws.roster.select("competitor", "name"), B.aliases(ws.roster))


@query("C24_media_cascade")
def media(ws):
    return AT.attach_media(ws.competitors, B.crosswalk(ws.competitors), B.media(ws.competitors), B.COUNTRY_CODES)


def spans(ws):
    return ws.sides.groupBy("competitor").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def births(ws):
    return AT.fill_births(ws.competitors, B.crosswalk(ws.competitors), B.birth_claims(ws.competitors), spans(ws), ws.today)


@query("C25_birth_dates")
def birth_dates(ws):
    return births(ws)[0]


@query("C26_birth_rejects")
def rejects(ws):
    return births(ws)[1]


@query("C27_birth_coverage")
def coverage(ws):
    return AT.coverage_report(ws.competitors, births(ws)[0], spans(ws), ws.today)


@query("C28_upcoming_ids")
def upcoming_ids(ws):
    u = B.upcoming(ws.contests)
    asked = u.select("slot_id", F.concat(F.lit("F"), F.col("c1").cast("string")).alias("foreign_id"), B.feed_name(F.col("name1"), F.col("c1")).alias("name"))
    return I.resolve_upcoming(asked, B.crosswalk(ws.competitors), ws.roster, ws.sides)


@query("C29_fresh_contests")
def fresh(ws):
    return I.fresh_contests(B.foreign_results(ws.outside, ws.competitors), ws.sides)


@query("C30_accumulating_merge")
def accumulate(ws):
    f = I.fresh_contests(B.foreign_results(ws.outside, ws.competitors), ws.sides)
    keys = f.select(F.least("c1", "c2").alias("lo"), F.greatest("c1", "c2").alias("hi"), "date", "row_id")
    prev = ws.contests.select(
        F.least("c1", "c2").alias("lo"), F.greatest("c1", "c2").alias("hi"), "date", F.col("contest_id").alias("row_id"))
    prev = prev.unionByName(keys.withColumn("row_id", F.col("row_id") + 1000000))
    return I.accumulate(keys, prev, ["lo", "hi", "date"])


@query("C31_method_audit")
def methods(ws):
    return I.method_audit(B.raw_methods(ws.contests))


@query("C31_method_verdict")
def method_verdict(ws):
    return I.method_verdict(I.method_audit(B.raw_methods(ws.contests)))


@query("C32_organisation_dictionary")
def organisations(ws):
    rules = (("tier2", ("AUTO", "XX")), ("tier2_5", ("BUILD",)), ("historical", ("HOUSE",)), ("tier3", ("FURN",)))
    return organisation_dictionary(ws.outside, rules)


def titled_history(ws):
    """Outside contests under event titles as feeds spell them: every known way to start, in several cases, and others."""
    starts = [p for _, _, prefixes in ORGANISATIONS for p in prefixes] + ["Alash Pride", "Extreme Shootout", "Local Night", "2 Hot"]
    i = F.col("outside_id")
    start = F.element_at(F.array(*[F.lit(x) for x in starts]), (i % len(starts) + 1).cast("int"))
    start = F.when(i % 3 == 1, F.upper(start)).otherwise(start)
    title = F.concat(F.lit(" "), start, F.when(F.substring(start, -1, 1) == " ", "").otherwise(" "), (i % 90).cast("string"), F.when(i % 2 == 0, " - A City").otherwise(""))
    return ws.outside.withColumn("event_name", title)


@query("C32_titles_to_organisations")
def title_organisations(ws):
    return title_dictionary(titled_history(ws))


@query("C33_external_match_audit")
def external_audit(ws):
    ext = ws.external.withColumn("name", B.feed_name(F.col("name"), F.col("competitor"))).drop("competitor")
    return I.name_match_audit(ext, I.resolve_names(ext, ws.roster))


@query("C33_must_match")
def must_match(ws):
    """Title-holders under their feed spelling that did not resolve."""
    ext = ws.external.withColumn("name", B.feed_name(F.col("name"), F.col("competitor"))).drop("competitor")
    audit = I.name_match_audit(ext, I.resolve_names(ext, ws.roster))
    return I.must_match(audit, ext.filter("rank = 'C' or rank in ('1', '2', '3')").select("division", "name", "rank"))


@query("C34_resolver_diff")
def resolver_diff(ws):
    names = ws.prices.select(F.col("favourite").alias("name"))
    old = I.resolve_names(names, ws.roster, last_first=False)
    reg = I.alias_registry(B.aliases(ws.roster))
    new = names.select("name").distinct().withColumn("norm", normalize_name(F.col("name"))).join(reg, "norm", "left").select(
        "name", F.col("canonical_id").alias("competitor"))
    return I.resolver_diff(names, old, new)


@query("C35_stale_champions")
def stale(ws):
    return I.stale_champions(ws.external, ws.sides)
