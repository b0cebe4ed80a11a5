"""Competitor identity across sources (ids C1-C6, C10-C23, C28-C35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelgrid.functions import core as C
from duelgrid.functions.names import last_first_key, name_pair, normalize_name, surname


def name_index(roster: DataFrame, key: Column, column: str) -> DataFrame:
    """One id per key; on duplicates the last roster row wins."""
    return roster.groupBy(key.alias(column)).agg(F.max("competitor").alias(f"by_{column}"))


def resolve_names(names: DataFrame, roster: DataFrame, overrides: DataFrame | None = None,
                  last_first: bool = True) -> DataFrame:
    """Override -> exact -> normalised -> last name and first initial (bulk callers opt out).

    Works on distinct names, so a name on a third of all rows is looked up once.
    """
    asked = names.select("name").distinct()
    exact = name_index(roster, F.col("name"), "exact")
    out = asked
    if overrides is not None:
        out = out.join(overrides.select(F.col("alias").alias("name"), "target"), "name", "left")
        out = out.join(exact.select(F.col("exact").alias("target"), F.col("by_exact").alias("by_override")), "target", "left")
    else:
        out = out.withColumn("by_override", F.lit(None).cast(roster.schema["competitor"].dataType))
    out = (out.withColumn("norm", normalize_name(F.col("name")))
           .join(exact.withColumnRenamed("exact", "name"), "name", "left")
           .join(name_index(roster, normalize_name(F.col("name")), "norm"), "norm", "left"))
    steps = ["by_override", "by_exact", "by_norm"]
    if last_first:
        out = out.withColumn("lf", last_first_key(F.col("name"))).join(
            name_index(roster, last_first_key(F.col("name")), "lf"), "lf", "left")
        steps.append("by_lf")
    how = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s[3:])) for s in steps], F.lit("none"))
    return out.select("name", F.coalesce(*steps).alias("competitor"), how.alias("matched_by"))


def alias_registry(aliases: DataFrame) -> DataFrame:
    """C11: normalised name -> id; names pointing at more than one id resolve to nothing."""
    return (aliases.filter("normalized_name <> '' and canonical_id is not null")
            .groupBy(F.col("normalized_name").alias("norm"))
            .agg(F.min("canonical_id").alias("low"), F.max("canonical_id").alias("high"))
            .filter("low = high").select("norm", F.col("low").alias("canonical_id")))


def reresolve_contests(contests: DataFrame, registry: DataFrame, roster: DataFrame) -> DataFrame:
    """Participant ids from names: registry, else exact roster name, else the id as it was."""
    exact = name_index(roster, F.col("name"), "exact")
    out = contests
    for i in (1, 2):
        out = (out.withColumn("norm", normalize_name(F.col(f"name{i}"))).join(registry, "norm", "left")
               .join(exact.withColumnRenamed("exact", f"name{i}"), f"name{i}", "left")
               .withColumn(f"c{i}", F.coalesce("canonical_id", "by_exact", f"c{i}")).drop("norm", "canonical_id", "by_exact"))
    return out


def patch_verdicts(primary: DataFrame, patch: DataFrame, grace_days: int = 60, window_days: int = 7) -> DataFrame:
    """Stale, duplicate (same unordered name pair within the window) or added.

    The window is exploded into candidate days on the patch side: the match is an equi-join
    and a pair that met thousands of times cannot fan out.
    """
    floor = primary.agg(F.date_sub(F.max("date"), grace_days).alias("floor"))
    floor_date = floor.first()["floor"]
    # only contests that a row behind the floor can reach need their names normalised
    recent = primary.filter(F.col("date") >= F.date_sub(F.lit(floor_date), window_days))
    known = recent.select(name_pair(F.col("name1"), F.col("name2")).alias("pair"), "date").distinct()
    dated = patch.filter(F.col("date").isNotNull()).withColumn("pair", name_pair(F.col("name1"), F.col("name2")))
    days = dated.filter(F.col("date") >= F.lit(floor_date)).select(
        "patch_id", "pair", F.explode(F.sequence(F.date_sub("date", window_days), F.date_add("date", window_days))).alias("date"))
    dup = days.join(known, ["pair", "date"]).select("patch_id").distinct().withColumn("dup", F.lit(True))
    verdict = F.when(F.col("date") < F.lit(floor_date), "stale").when(F.col("dup"), "duplicate").otherwise("added")
    return dated.join(dup, "patch_id", "left").withColumn("verdict", verdict).drop("dup", "pair")


def resolve_synthetic(rows: DataFrame, roster: DataFrame, prefix: str = "sd:") -> DataFrame:
    """C4: synthetic text ids are replaced only through names unique in the roster."""
    unique = roster.groupBy("name").agg(F.count("*").alias("n"), F.max("competitor").cast("string").alias("rid")).filter("n = 1")
    out = rows
    for i in (1, 2):
        u = unique.select(F.col("name").alias(f"name{i}"), F.col("rid").alias(f"rid{i}"))
        hit = F.col(f"c{i}").startswith(prefix) & F.col(f"rid{i}").isNotNull()
        out = (out.join(u, f"name{i}", "left").withColumn(f"resolved{i}", hit)
               .withColumn(f"c{i}", F.when(hit, F.col(f"rid{i}")).otherwise(F.col(f"c{i}"))).drop(f"rid{i}"))
    return out


def patch_counters(verdicts: DataFrame) -> DataFrame:
    """The integration report in one pass."""
    n = (F.col("verdict") == "added").cast("int")
    return verdicts.agg(
        F.count_if(F.col("verdict") == "added").alias("added"), F.count_if(F.col("verdict") == "duplicate").alias("duplicates"),
        F.count_if(F.col("verdict") == "stale").alias("stale"),
        F.sum(n * (F.col("resolved1").cast("int") + F.col("resolved2").cast("int"))).alias("ids_resolved"))


def apply_merges(contests: DataFrame, merges: DataFrame) -> DataFrame:
    """Remap secondary ids, then drop repeated (pair, date) contests of merged primaries only."""
    out = contests
    for i in (1, 2):
        m = merges.select(F.col("secondary").alias(f"c{i}"), F.col("primary").alias(f"to{i}"))
        out = out.join(m, f"c{i}", "left").withColumn(f"c{i}", F.coalesce(f"to{i}", f"c{i}")).drop(f"to{i}")
    touched = merges.select(F.col("primary").alias("p")).distinct()
    for i in (1, 2):
        out = out.join(touched.withColumnRenamed("p", f"c{i}").withColumn(f"m{i}", F.lit(True)), f"c{i}", "left")
    scope = F.coalesce("m1", F.lit(False)) | F.coalesce("m2", F.lit(False))
    out = out.withColumn("scope", scope).drop("m1", "m2")
    pair = [F.least("c1", "c2"), F.greatest("c1", "c2"), F.coalesce(F.col("date").cast("string"), F.col("contest_id").cast("string"))]
    first = (out.filter("scope").groupBy(*[p.alias(n) for p, n in zip(pair, ("_a", "_b", "_d"))])
             .agg(F.min("contest_id").alias("contest_id")).select("contest_id").withColumn("first", F.lit(True)))
    return out.join(first, "contest_id", "left").filter("not scope or first").drop("scope", "first")


def roster_without(roster: DataFrame, merges: DataFrame) -> DataFrame:
    return roster.join(merges.select(F.col("secondary").alias("competitor")), "competitor", "left_anti")


def known_opponents(sides: DataFrame, dated: bool = False) -> DataFrame:
    """Distinct normalised opponents (optionally with the day) per competitor, long form."""
    norm = normalize_name(F.col("opponent_name"), "crosswalk")
    key = F.concat_ws("@", norm, F.col("date").cast("string")) if dated else norm
    return sides.select("competitor", key.alias("opp_key")).distinct()


def _blocks(ours: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C14: both sides with their block: the exact normalised name when the other site knows it, else the surname.

    A foreign profile sits in both blocks; ours in exactly one. Nothing is paired here.
    """
    norm = lambda c: normalize_name(F.col(c), "crosswalk")
    b = foreign.select("foreign_id", F.explode(F.array(
        F.struct(F.lit("name").alias("block"), norm("foreign_name").alias("key")),
        F.struct(F.lit("surname").alias("block"), surname(F.col("foreign_name")).alias("key")))).alias("x"),
        norm("foreign_division").alias("div")).select("foreign_id", "x.*", "div")
    known = b.filter("block = 'name'").select(F.col("key").alias("norm")).distinct().withColumn("exact", F.lit(True))
    a = (ours.select("competitor", norm("name").alias("norm"), surname(F.col("name")).alias("last"), norm("division").alias("div"))
         .join(known, "norm", "left").select(
             "competitor", F.when(F.col("exact"), "name").otherwise("surname").alias("block"),
             F.when(F.col("exact"), F.col("norm")).otherwise(F.col("last")).alias("key"), "div")
         .filter("block = 'name' or length(key) >= 3"))
    return a, b


def candidate_counts(ours: DataFrame, foreign: DataFrame) -> DataFrame:
    """C14: how many profiles each competitor's block holds."""
    a, b = _blocks(ours, foreign)
    sizes = b.groupBy("block", "key").agg(F.count_distinct("foreign_id").alias("candidates"))
    return a.join(sizes, ["block", "key"]).select("competitor", "block", "candidates")


def _points(exact: Column, div: Column, overlap: Column) -> Column:
    """25 for the exact name, 15 for the division, 14 per shared opponent up to five."""
    return F.when(exact, 25).otherwise(0) + F.when(div, 15).otherwise(0) + F.least(overlap, F.lit(5)) * 14


def evidence_pairs(ours: DataFrame, foreign: DataFrame, our_opponents: DataFrame, foreign_opponents: DataFrame) -> DataFrame:
    """Scored pairs of one block that share at least one opponent.

    The join key holds the block and the opponent, so a block is never paired with itself in
    full.  our_opponents: competitor, opp_key; foreign_opponents: foreign_id, opp_key (both distinct).
    """
    a, b = _blocks(ours, foreign)
    mine = a.join(our_opponents, "competitor").withColumnRenamed("div", "our_div")
    theirs = b.join(foreign_opponents, "foreign_id").withColumnRenamed("div", "their_div")
    exact = F.col("block") == "name"
    div = F.col("our_div") != ""
    div = div & (F.col("our_div") == F.col("their_div"))
    return (mine.join(theirs, ["block", "key", "opp_key"]).groupBy("competitor", "foreign_id", "block", "our_div", "their_div")
            .agg(F.count("*").alias("overlap")).select(
                "competitor", "foreign_id", exact.alias("name_exact"), div.alias("division_match"), "overlap",
                _points(exact, div, F.col("overlap")).alias("score")))


def best_matches(ours: DataFrame, foreign: DataFrame, our_opponents: DataFrame, foreign_opponents: DataFrame) -> DataFrame:
    """Best candidate by overlap then score, rivals with the exact name, and the verdict.

    Without a shared opponent all candidates of a block score alike up to the division, so the
    first id of the (block, division), else of the block, stands for them: two aggregates
    instead of the pairs.
    """
    a, b = _blocks(ours, foreign)
    pairs = evidence_pairs(ours, foreign, our_opponents, foreign_opponents)
    best = pairs.groupBy("competitor").agg(F.min(F.struct(
        (-F.col("overlap")).alias("o"), (-F.col("score")).alias("s"), "foreign_id", "name_exact", "division_match", "overlap", "score")).alias("x"))
    in_block = b.groupBy("block", "key").agg(F.min("foreign_id").alias("any_id"), F.count("*").alias("n"))
    in_division = b.filter("div <> ''").groupBy("block", "key", "div").agg(F.min("foreign_id").alias("div_id"))
    own = our_opponents.groupBy("competitor").agg(F.count("*").alias("own_opponents"))
    x = (a.join(in_block, ["block", "key"]).join(in_division, ["block", "key", "div"], "left")
         .join(best, "competitor", "left").join(own, "competitor", "left"))
    exact, div = F.col("block") == "name", F.col("div_id").isNotNull()
    got = F.col("x").isNotNull()
    pick = lambda field, other: F.when(got, F.col(f"x.{field}")).otherwise(other)
    return x.select(
        "competitor", pick("foreign_id", F.coalesce("div_id", "any_id")).alias("foreign_id"),
        F.when(exact, F.col("n")).otherwise(F.lit(0)).cast("long").alias("exact_rivals"),
        pick("name_exact", exact).alias("name_exact"), pick("division_match", div).alias("division_match"),
        pick("overlap", F.lit(0)).cast("long").alias("overlap"), F.coalesce("own_opponents", F.lit(0)).alias("own_opponents"),
        pick("score", _points(exact, div, F.lit(0))).cast("long").alias("score")).withColumn("verdict", match_verdict())


def match_verdict() -> Column:
    ov, own = F.col("overlap"), F.col("own_opponents")
    exact, div, unique = F.col("name_exact"), F.col("division_match"), F.col("exact_rivals") == 1
    sure = ((ov >= 3) | ((ov >= 2) & ((ov >= own * 0.5) | (exact & unique)))
            | ((ov >= 1) & exact & div & unique) | ((own == 0) & exact & div & unique))
    maybe = (ov >= 1) | (exact & (div | (own == 0)))
    return F.when(sure, "verified").when(maybe, "review").otherwise("reject")


def unmapped(ours: DataFrame, *outputs: DataFrame) -> DataFrame:
    """Ids not yet routed to any output table."""
    for o in outputs:
        ours = ours.join(o.select("competitor"), "competitor", "left_anti")
    return ours


def duplicate_audit(roster: DataFrame, sides: DataFrame) -> DataFrame:
    """Same-name ids sharing an opponent on the same day are one person, others are namesakes.

    Ids of a name are linked through shared (name, opponent@day) keys, never paired up.
    """
    named = roster.select("competitor", normalize_name(F.col("name"), "crosswalk").alias("norm"))
    many = named.groupBy("norm").agg(F.count("*").alias("ids")).filter("ids > 1")
    keys = known_opponents(sides, dated=True).join(named, "competitor").join(many.select("norm"), "norm", "left_semi")
    shared = keys.groupBy("norm", "opp_key").agg(F.count("*").alias("c")).filter("c > 1").groupBy("norm").agg(
        F.count("*").alias("shared_contests"))
    return many.join(shared, "norm", "left").select(
        "norm", "ids", F.coalesce("shared_contests", F.lit(0)).alias("shared_contests"),
        F.when(F.col("shared_contests") > 0, "duplicate").otherwise("namesakes").alias("verdict"))


def duplicate_pairs(roster: DataFrame, sides: DataFrame) -> DataFrame:
    """The id pairs to merge: every id that shares a (name, opponent@day) key goes to the key's smallest id."""
    named = roster.select("competitor", normalize_name(F.col("name"), "crosswalk").alias("norm"))
    keys = known_opponents(sides, dated=True).join(named, "competitor")
    least = keys.groupBy("norm", "opp_key").agg(F.min("competitor").alias("primary"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return (keys.join(least, ["norm", "opp_key"]).filter("competitor <> primary")
            .groupBy("norm", "primary", F.col("competitor").alias("secondary")).agg(F.count("*").alias("shared_contests")))


def claimed_edges(sides: DataFrame) -> DataFrame:
    """C20: the opponent@day keys that more than one id claims, one row per claiming id."""
    keys = sides.select(normalize_name(F.col("opponent_name"), "crosswalk").alias("opponent_norm"), "date", "competitor").distinct()
    many = keys.groupBy("opponent_norm", "date").agg(F.count("*").alias("ids")).filter("ids > 1")
    return keys.join(many, ["opponent_norm", "date"])


def edge_audit(sides: DataFrame, split_year: int = 2001) -> DataFrame:
    """C20: opponent@day keys claimed by more than one id, before and after the year records got reliable."""
    k = sides.groupBy(normalize_name(F.col("opponent_name"), "crosswalk").alias("opponent_norm"), "date").agg(
        F.count_distinct("competitor").alias("ids")).filter("ids > 1")
    return k.groupBy(F.when(F.year("date") < split_year, "early").otherwise("modern").alias("era")).agg(
        F.count("*").alias("keys"), F.max("ids").alias("most_ids"))


def split_identities(crosswalk: DataFrame) -> DataFrame:
    """Several of our ids mapped to one foreign id."""
    return crosswalk.groupBy("foreign_id").agg(
        F.count_distinct("competitor").alias("ids"), F.min("competitor").alias("first_id"),
        F.max("competitor").alias("last_id")).filter("ids > 1")


def weak_links(crosswalk: DataFrame, roster: DataFrame, floor: int = 60, share: float = 0.6) -> DataFrame:
    """Links under the confidence floor stay when the notes show enough overlap, or a matching
    name that is unique in the roster; the others are queued."""
    pattern = r"overlap (\d+)/(\d+)"
    got, of = (F.regexp_extract("notes", pattern, i).try_cast("int") for i in (1, 2))
    norm = roster.select("competitor", normalize_name(F.col("name")).alias("norm"))
    unique = norm.groupBy("norm").agg(F.count("*").alias("n"), F.max("competitor").alias("competitor")).filter("n = 1")
    named = F.col("notes").rlike(r"name=true|exactName=[1-9]") & F.col("n").isNotNull()
    keep = F.coalesce(got / of >= share, F.lit(False)) | named
    return (crosswalk.filter(F.col("confidence") < floor).join(unique.select("competitor", "n"), "competitor", "left")
            .withColumn("decision", F.when(keep, "corroborated").otherwise("queue")).drop("n"))


def link_feed(feed: DataFrame, roster: DataFrame, sides: DataFrame) -> DataFrame:
    """A feed name links to the one same-name id that fought the listed opponent that day.

    feed: feed_name, opponent_name, date.
    """
    norm = lambda c: normalize_name(F.col(c), "crosswalk")
    names = feed.select("feed_name", norm("feed_name").alias("norm")).distinct()
    cands = names.join(roster.select("competitor", norm("name").alias("norm")), "norm")
    evidence = feed.select("feed_name", norm("feed_name").alias("norm"), F.concat_ws(
        "@", norm("opponent_name"), F.col("date").cast("string")).alias("opp_key")).distinct()
    # name and opponent together: a common name does not multiply with its evidence
    fought = known_opponents(sides, True).join(roster.select("competitor", norm("name").alias("norm")), "competitor")
    proof = evidence.join(fought, ["norm", "opp_key"]).groupBy("feed_name", "competitor").agg(F.count("*").alias("shared"))
    found = cands.join(proof, ["feed_name", "competitor"], "left").groupBy("feed_name").agg(
        F.count("*").alias("candidates"), F.count("shared").alias("corroborated"),
        F.max(F.when(F.col("shared").isNotNull(), F.col("competitor"))).alias("linked_id"))
    return names.select("feed_name").join(found, "feed_name", "left").select(
        "feed_name", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("corroborated", F.lit(0)).alias("corroborated"),
        F.when(F.col("corroborated") == 1, F.col("linked_id")).alias("linked_id"),
        F.when(F.col("corroborated") == 1, "linked").when(F.coalesce("candidates", F.lit(0)) == 0, "unknown")
        .when(F.col("corroborated") > 1, "ambiguous").otherwise("review").alias("verdict"))


def record_gaps(competitors: DataFrame, limit: int = 5) -> DataFrame:
    """Totals on file that disagree with the contests seen."""
    total = F.col("wins") + F.col("losses") + F.col("draws")
    return competitors.select("competitor", total.alias("on_file"), "contests", F.abs(total - F.col("contests")).alias("gap")).filter(
        F.col("gap") > limit)


def registry_output(roster: DataFrame, aliases: DataFrame) -> DataFrame:
    """Roster with its folded alias list (aliases per id are few)."""
    a = aliases.groupBy(F.col("canonical_id").alias("competitor")).agg(
        F.array_join(F.array_sort(F.collect_set("normalized_name")), "|").alias("aliases"))
    return roster.join(a, "competitor", "left").fillna("", ["aliases"])


def fresh_contests(foreign: DataFrame, sides: DataFrame) -> DataFrame:
    """Foreign contests newer than the competitor's latest, one per unordered pair and date.

    foreign: row_id, competitor, opponent, date, result.
    """
    latest = sides.groupBy("competitor").agg(F.max("date").alias("latest"))
    rows = (foreign.filter("result in ('win', 'loss', 'draw')").join(latest, "competitor", "left")
            .filter(F.col("latest").isNull() | (F.col("date") > F.col("latest"))))
    keyed = rows.withColumn("lo", F.least("competitor", "opponent")).withColumn("hi", F.greatest("competitor", "opponent"))
    first = keyed.groupBy("lo", "hi", "date").agg(F.min_by(F.struct("row_id", "competitor", "opponent", "result"), "row_id").alias("x"))
    own = F.when(F.col("x.result") == "win", "W").when(F.col("x.result") == "loss", "L").otherwise("D")
    return first.select("x.row_id", F.col("x.competitor").alias("c1"), F.col("x.opponent").alias("c2"), "date", own.alias("result1"),
                        F.when(own == "W", "L").when(own == "L", "W").otherwise("D").alias("result2"))


def accumulate(fresh: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows win; earlier rows are carried when their key is unseen."""
    carried = previous.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(carried.withColumn("origin", F.lit("carried")))


# Fixed values: (pattern, method code), first hit wins.
METHOD_PATTERNS = (
    (r"(?i)doctor.*(tko|stoppage)|(tko|stoppage).*doctor", "TKO - Doctor's Stoppage"),
    (r"(?i)^k\.?o\b|^tko\b|knockout", "KO/TKO"),
    (r"(?i)submission", "SUB"),
    (r"(?i)split", "S-DEC"),
    (r"(?i)majority", "M-DEC"),
    (r"(?i)decision|unanimous", "U-DEC"),
    (r"(?i)^draw", "U-DEC"),
    (r"(?i)disqualif|^dq\b", "DQ"),
    (r"(?i)no contest|^nc\b|^n/a\b", "CNC"),
    (r"(?i)choke|armbar|kimura|guillotine|triangle|omoplata|heel hook|knee ?bar|ankle lock|americana|anaconda|"
     r"d.?arce|ezekiel|twister|crank|crucifix|necktie|gogoplata|suloev|von flue", "SUB"),
)


def map_method(raw: Column) -> tuple[Column, Column]:
    """Target code and whether any pattern matched; unmatched text becomes 'Other'."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    code = C.first_match([(t.rlike(p), F.lit(v)) for p, v in METHOD_PATTERNS], F.lit(None).cast("string"))
    return F.coalesce(code, F.lit("Other")), code.isNotNull()


def method_audit(rows: DataFrame, column: str = "raw_method") -> DataFrame:
    """Distribution of targets with shares.

    The total is a second small aggregate over the few distinct targets.
    """
    code, hit = map_method(F.col(column))
    counts = rows.groupBy(code.alias("target"), hit.alias("matched")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("share", C.half_up(F.col("n") / total * 100, 4))


def method_verdict(audit: DataFrame, limit: float = 1.0) -> DataFrame:
    """More than one per cent unmatched is a failure."""
    missed = F.coalesce(F.sum(F.when(~F.col("matched"), F.col("n"))), F.lit(0))
    return audit.agg(F.sum("n").alias("rows"), missed.alias("unmatched")).withColumn(
        "passed", F.col("unmatched") * 100 <= F.col("rows") * limit)


def name_match_audit(external: DataFrame, resolved: DataFrame) -> DataFrame:
    """MATCHED or UNMATCHED per external rank."""
    return external.join(resolved.select("name", F.col("competitor").alias("resolved_id"), "matched_by"), "name", "left").withColumn(
        "status", F.when(F.col("resolved_id").isNotNull(), "MATCHED").otherwise("UNMATCHED"))


def must_match(audit: DataFrame, required: DataFrame) -> DataFrame:
    """Required names that did not match; an empty result is a pass."""
    return required.join(audit.filter("status = 'MATCHED'").select("name"), "name", "left_anti")


def resolver_diff(names: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Every distinct name under two resolvers."""
    x = (names.select("name").distinct().join(before.select("name", F.col("competitor").alias("old_id")), "name", "full_outer")
         .join(after.select("name", F.col("competitor").alias("new_id")), "name", "full_outer"))
    kind = (F.when(F.col("old_id").eqNullSafe(F.col("new_id")), F.when(F.col("old_id").isNull(), "both_missing").otherwise("same"))
            .when(F.col("old_id").isNull(), "gained").when(F.col("new_id").isNull(), "lost").otherwise("changed"))
    return x.withColumn("kind", kind)


def stale_champions(external: DataFrame, sides: DataFrame) -> DataFrame:
    """Title-holders whose latest contest is a loss."""
    latest = sides.groupBy("competitor").agg(F.max_by(F.struct("contest_id", "date", "result", "opponent"), F.struct("date", "contest_id")).alias("x"))
    return external.filter("rank = 'C'").join(latest, "competitor").filter("x.result = 'L'").select(
        "division", "competitor", F.col("x.contest_id").alias("contest_id"), F.col("x.date").alias("date"),
        F.col("x.opponent").alias("lost_to"))


def resolve_upcoming(upcoming: DataFrame, crosswalk: DataFrame, roster: DataFrame, sides: DataFrame) -> DataFrame:
    """Foreign id through the crosswalk, else the one roster namesake that has competed.

    upcoming: slot_id, foreign_id, name.  Returns the id and whether the crosswalk can be healed.
    """
    active = roster.join(sides.select("competitor").distinct(), "competitor", "left_semi")
    unique = (active.groupBy(normalize_name(F.col("name"), "upcoming").alias("norm"))
              .agg(F.count("*").alias("n"), F.max("competitor").alias("by_name")).filter("n = 1 and norm <> ''"))
    x = (upcoming.withColumn("norm", normalize_name(F.col("name"), "upcoming"))
         .join(crosswalk.select("foreign_id", F.col("competitor").alias("by_link")), "foreign_id", "left")
         .join(unique.select("norm", "by_name"), "norm", "left"))
    return x.select("slot_id", "foreign_id", "name", F.coalesce("by_link", "by_name").alias("competitor"),
                    (F.col("by_link").isNull() & F.col("by_name").isNotNull()).alias("heals"))
