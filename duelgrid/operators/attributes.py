"""Side attributes merged from several sources (ids C24-C27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelgrid.functions import core as C
from duelgrid.functions.names import normalize_name


def first_filled(rows: DataFrame, key: str, columns: list[str], ordinal: str) -> DataFrame:
    """Per key, the first non-empty value of every column."""
    value = lambda c: F.min(F.when(F.col(c) != "", F.struct(ordinal, c)))[c].alias(c)
    return rows.groupBy(key).agg(*[value(c) for c in columns])


def attach_media(competitors: DataFrame, links: DataFrame, media: DataFrame, country_codes: dict[str, str]) -> DataFrame:
    """Headshot, else portrait, else full body; country to ISO code and flag letters."""
    iso = F.create_map(*[F.lit(x) for kv in country_codes.items() for x in kv])
    m = first_filled(media, "foreign_id", ["headshot", "portrait", "full_body", "country"], "ordinal")
    x = competitors.select("competitor").join(links.select("competitor", "foreign_id"), "competitor", "left").join(m, "foreign_id", "left")
    best = F.coalesce("headshot", "portrait", "full_body")
    kind = F.when(F.col("headshot").isNotNull(), "headshot").when(F.col("portrait").isNotNull(), "portrait").when(
        F.col("full_body").isNotNull(), "full_body")
    return x.select("competitor", best.alias("picture"), kind.alias("picture_kind"), "country", iso[F.col("country")].alias("iso"))


def birth_problem(born: Column, first: Column, last: Column, today: Column) -> Column:
    """Why a claimed birth date is implausible (null when it is fine)."""
    years = lambda to: F.datediff(to, born) / F.lit(365.25)
    return (F.when(born.isNull(), "unparseable")
            .when(first.isNotNull() & ((years(first) < 16) | (years(first) > 47)), "debut_age")
            .when(first.isNotNull() & (years(last) > 55), "last_age")
            .when(first.isNull() & ((years(today) < 16) | (years(today) > 80)), "age_today"))


def fill_births(competitors: DataFrame, links: DataFrame, claims: DataFrame, spans: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Register by foreign id, register by unambiguous name, then profiles; implausible ones rejected.

    claims: source (register/profile), foreign_id, label, born, precision.
    Returns (accepted, rejected) with the route that produced each row.
    """
    span = competitors.select("competitor", "name").join(spans, "competitor", "left")
    problem = birth_problem(F.col("born"), F.col("first"), F.col("last"), today)
    best = lambda rows, key: rows.groupBy(key).agg(
        F.max(F.struct("precision", -F.datediff("born", F.lit("1970-01-01").cast("date")), "born"))["born"].alias("born"),
        F.max("precision").alias("precision"))
    by_id = claims.filter("foreign_id is not null")
    reg, prof = by_id.filter("source = 'register'"), by_id.filter("source = 'profile'")

    def judge(hit: DataFrame, route: str) -> DataFrame:
        return hit.join(span.drop("name"), "competitor").withColumn("route", F.lit(route)).withColumn("problem", problem)

    one = judge(links.select("competitor", "foreign_id").join(best(reg, "foreign_id"), "foreign_id").drop("foreign_id"), "register_id")
    ok1 = one.filter("problem is null")
    # names must be unambiguous on both sides
    names = (claims.filter("source = 'register'").groupBy(normalize_name(F.col("label"), "birth").alias("norm"))
             .agg(F.min("born").alias("born"), F.max("born").alias("born_hi"), F.max("precision").alias("precision"))
             .filter("born = born_hi and norm <> ''").drop("born_hi"))
    own = (competitors.groupBy(normalize_name(F.col("name"), "birth").alias("norm"))
           .agg(F.count("*").alias("n"), F.max("competitor").alias("competitor")).filter("n = 1").drop("n"))
    two = judge(own.join(ok1.select("competitor"), "competitor", "left_anti").join(names, "norm").drop("norm"), "register_name")
    ok2 = two.filter("problem is null")
    three = judge(links.select("competitor", "foreign_id").join(ok1.select("competitor").unionByName(ok2.select("competitor")),
                                                               "competitor", "left_anti")
                  .join(best(prof, "foreign_id"), "foreign_id").drop("foreign_id").withColumn("precision", F.lit(11)), "profile_id")
    cols = ["competitor", "born", "precision", "route", "problem"]
    every = one.select(*cols).unionByName(two.select(*cols)).unionByName(three.select(*cols))
    label = F.when(F.col("precision") >= 11, "day").when(F.col("precision") == 10, "month").otherwise("year")
    return (every.filter("problem is null").select("competitor", "born", label.alias("precision"), "route"),
            every.filter("problem is not null").select("competitor", "born", "route", "problem"))


def coverage_report(competitors: DataFrame, filled: DataFrame, spans: DataFrame, today: Column, active_months: float = 24.0) -> DataFrame:
    """Totals, sources and the active subset; one rollup gives divisions and the grand total."""
    x = (competitors.select("competitor", "home_division").join(filled.select("competitor", "route"), "competitor", "left")
         .join(spans, "competitor", "left"))
    has = F.col("route").isNotNull()
    active = F.coalesce(C.months_between_days(F.col("last"), today) <= active_months, F.lit(False))
    return x.rollup("home_division").agg(
        F.count("*").alias("competitors"), F.count_if(has).alias("covered"),
        F.count_if(F.col("route").startswith("register")).alias("from_register"), F.count_if(F.col("route") == "profile_id").alias("from_profile"),
        F.count_if(active).alias("active"), F.count_if(active & has).alias("active_covered")
    ).withColumn("home_division", F.coalesce("home_division", F.lit("TOTAL")))
