"""Ordered vocabularies: organisation tiers and finish methods (ids C31, C32)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelgrid.config import TIER_MULTIPLIERS
from duelgrid.functions.core import first_match

# Fixed values: (canonical organisation, tier, how its event titles start); the first that fits counts.
ORGANISATIONS = (
    ("UFC", "tier1", ("UFC", "Ultimate Fighting")),
    ("Dana White's Contender Series", "tier2", ("Dana White", "DWCS", "Contender Series")),
    ("Bellator", "tier2_5", ("Bellator",)),
    ("ONE Championship", "tier2_5", ("ONE ", "ONE Championship", "ONE FC", "ONE on", "ONE Fight", "One Championship")),
    ("PFL", "tier2_5", ("PFL", "Professional Fighters League", "World Series of Fighting", "WSOF")),
    ("RIZIN", "tier2_5", ("RIZIN", "Rizin")),
    ("Invicta FC", "tier2_5", ("Invicta",)),
    ("Pride", "historical", ("Pride", "PRIDE")),
    ("Strikeforce", "historical", ("Strikeforce",)),
    ("WEC", "historical", ("World Extreme Cagefighting", "WEC ")),
    ("Cage Warriors", "tier3", ("Cage Warriors",)),
    ("LFA", "tier3", ("LFA", "Legacy Fighting Alliance", "Resurrection Fighting", "Legacy FC")),
    ("KSW", "tier3", ("KSW",)),
    ("M-1", "tier3", ("M-1 ",)),
    ("Pancrase", "tier3", ("Pancrase",)),
    ("Shooto", "tier3", ("Shooto",)),
    ("Deep", "tier3", ("Deep ",)),
    ("Titan FC", "tier3", ("Titan",)),
    ("CFFC", "tier3", ("CFFC", "Cage Fury")),
    ("MFC", "tier3", ("Maximum Fighting",)),
    ("Brave CF", "tier3", ("Brave CF", "Brave Combat")),
    ("Jungle Fight", "tier3", ("Jungle Fight",)),
    ("King of the Cage", "tier3", ("KOTC", "King of the Cage")),
)
DEFAULT_TIER = "tier4"
#: The organisation whose own contests are not outside history.
PRIMARY = "UFC"


def tier_of(label: Column, rules, default: str = DEFAULT_TIER) -> Column:
    """Ordered substring rules."""
    return first_match([(label.contains(needle), F.lit(tier)) for tier, needles in rules for needle in needles], F.lit(default))


def promotion_label(title: Column) -> Column:
    """An event title up to its first dash between blanks, without a trailing number; the title if nothing is left."""
    head = F.trim(F.regexp_replace(F.trim(F.element_at(F.split(title, r"\s+[-\u2013]\s+", 2), 1)), r"\s+\d.*$", ""))
    return F.when(head == "", F.trim(title)).otherwise(head)


def organisation_of(title: Column, rules=ORGANISATIONS) -> Column:
    """(canonical, tier, matched) by how the title starts, whatever its case; else its label and the last tier."""
    start = F.lower(F.trim(title))
    found = [(start.startswith(p.lower()), F.struct(F.lit(name).alias("canonical"), F.lit(tier).alias("tier"), F.lit(True).alias("matched")))
             for name, tier, prefixes in rules for p in prefixes]
    return first_match(found, F.struct(promotion_label(title).alias("canonical"), F.lit(DEFAULT_TIER).alias("tier"), F.lit(False).alias("matched")))


def classified_history(rows: DataFrame, title: str = "event_name", primary: str = PRIMARY, rules=ORGANISATIONS) -> DataFrame:
    """Outside history with canonical organisation, tier and multiplier; the primary organisation's rows go."""
    known = rows.withColumn("org", organisation_of(F.col(title), rules)).filter(~F.col("org.canonical").contains(primary))
    return known.select(*[c for c in rows.columns if c not in ("canonical", "tier", "matched", "multiplier")], "org.canonical", "org.tier", "org.matched",
                        tier_multiplier(F.col("org.tier")).alias("multiplier"))


def title_dictionary(rows: DataFrame, title: str = "event_name", **rules) -> DataFrame:
    """One row per canonical organisation: tier, volume, a sample title and whether a person should look."""
    return classified_history(rows, title, **rules).groupBy("canonical", "tier", "multiplier", "matched").agg(
        F.count("*").alias("contests"), F.min(title).alias("sample")).withColumn("needs_review", ~F.col("matched")).drop("matched")


def tier_multiplier(tier: Column) -> Column:
    return first_match([(tier == t, F.lit(m)) for t, m in TIER_MULTIPLIERS.items()], F.lit(0.0))


def organisation_dictionary(rows: DataFrame, rules, default: str = DEFAULT_TIER) -> DataFrame:
    """One row per label with its tier, volume, a sample event and whether a person should look."""
    d = rows.groupBy("organisation").agg(F.count("*").alias("contests"), F.min("event_name").alias("sample"))
    tier = tier_of(F.col("organisation"), rules, default)
    return d.select("organisation", "contests", "sample", tier.alias("tier"), tier_multiplier(tier).alias("multiplier"),
                    (tier == default).alias("needs_review"))
