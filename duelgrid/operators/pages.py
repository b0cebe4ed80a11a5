"""Generic extraction from a table of pages (ids K1-K5); the whole text of each page is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelgrid.functions import core as C


def links(pages: DataFrame) -> DataFrame:
    """K1: every href in document order."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def numbered_links(pages: DataFrame, segment: str) -> DataFrame:
    """K1: ids '/segment/slug-123' whose slug ends in a number, first spelling per (page, number).

    Duplicates are settled by a minimum with map-side combine, not by sorting pages.
    """
    slug = F.regexp_extract("href", rf'/{segment}/([^/?#"]+)', 1)
    rows = links(pages).withColumn("slug", slug).withColumn("number", F.regexp_extract("slug", r"-(\d+)$", 1)).filter("number <> ''")
    return rows.groupBy("page_id", "number").agg(F.min(F.struct("pos", "slug")).alias("x")).select("page_id", "number", "x.pos", "x.slug")


def trailing_ids(pages: DataFrame) -> DataFrame:
    """K1 on plain sites: numeric last path element of the page address (pos -1) and of each link."""
    own = pages.select("page_id", F.lit(-1).alias("pos"), F.col("url").alias("href"))
    rows = links(pages).unionByName(own).withColumn("number", F.regexp_extract("href", r"(\d+)(?:[?#].*)?$", 1)).filter("number <> ''")
    return rows.groupBy("page_id", "number").agg(F.min(F.struct("pos", "href")).alias("x")).select("page_id", "number", "x.pos", "x.href")


def normal_date(raw: Column) -> Column:
    """K2: ISO prefix, 'Jun / 07 / 2026' or 'Jun 7, 2026' (month names by their first three letters)."""
    t = F.trim(raw)
    iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    flat = F.trim(F.regexp_replace(F.regexp_replace(t, "[/,]", " "), r"\s+", " "))
    pattern = r"^([A-Za-z]{3})[A-Za-z]*\s+(\d{1,2})\s+(\d{4})$"
    text = F.concat_ws(" ", F.initcap(F.regexp_extract(flat, pattern, 1)), F.regexp_extract(flat, pattern, 2), F.regexp_extract(flat, pattern, 3))
    return F.coalesce(iso, F.when(flat.rlike(pattern), F.try_to_date(text, "MMM d yyyy")))


# The format of price pages.
CELL = r'\[(\d+),(\d+),(\d+)\]"[^>]*>\s*<span[^>]*>([+-]?\d+)</span>'
COMPETITOR_ROW = r'id="mu-(\d+)"'


def attribute_cells(pages: DataFrame, attribute: str = "data-li") -> DataFrame:
    """K3: cells that carry [book,side,contest] and an American price, as a long table.

    Cells of a contest without a competitor row on the page are side bets and go.  A cell is cut
    out once and then split.
    """
    cells = F.regexp_extract_all("html", F.lit(rf'{attribute}="{CELL}'), 0)
    one = lambda i: F.regexp_extract("c", CELL, i)
    x = pages.select("page_id", F.array_distinct(F.regexp_extract_all("html", F.lit(COMPETITOR_ROW), 1)).alias("contests"),
                     F.explode(cells).alias("c"))
    x = x.filter(F.array_contains("contests", one(3))).select(
        "page_id", one(1).cast("int").alias("book"), one(2).cast("int").alias("side"),
        one(3).cast("bigint").alias("contest_id"), one(4).cast("int").alias("american"))
    return x.withColumn("price", C.american_to_decimal(F.col("american")))


def slug_name(slug: Column) -> Column:
    """K4: 'Alex-Smith-224511' -> 'Alex Smith'."""
    return F.trim(F.regexp_replace(F.regexp_replace(slug, r"-\d+$", ""), "-", " "))


def split_title(title: Column) -> tuple[Column, Column]:
    """K4: 'Card 12 - A vs. B' -> title and optional subtitle."""
    parts = F.split(title, " - ", 2)
    return F.element_at(parts, 1), F.when(F.size(parts) > 1, F.element_at(parts, 2))


def search_queries(names: DataFrame, promoter: str) -> DataFrame:
    """K5: 'PROMOTER 12' for numbered events, else 'PROMOTER X Y' from '… : X vs. Y'; distinct."""
    number = F.regexp_extract("name", rf"(?i){promoter}\s+(\d+)", 1)
    tail = F.element_at(F.split("name", ":"), -1)
    vs = r"(?i)([A-Za-z'’-]+)\s+vs\.?\s+([A-Za-z'’-]+)"
    text = F.when(number != "", F.concat_ws(" ", F.lit(promoter), number)).when(
        tail.rlike(vs), F.concat_ws(" ", F.lit(promoter), F.regexp_extract(tail, vs, 1), F.regexp_extract(tail, vs, 2)))
    return names.filter(F.col("name").rlike(rf"(?i){promoter}")).select(text.alias("query")).filter("query is not null").distinct()
