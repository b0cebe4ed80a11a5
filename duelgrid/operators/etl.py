"""Raw per-round statistics to contest and competitor tables (ids B1-B18, C7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from duelgrid.functions import core as C

# Raw "x of y" columns and the names they get.
PAIR_COLUMNS = {
    "SIG_STR": "sig", "TOTAL_STR": "total", "TD": "td", "HEAD": "head", "BODY": "body", "LEG": "leg",
    "DISTANCE": "distance", "CLINCH": "clinch", "GROUND": "ground",
}


def to_sides(contests: DataFrame) -> DataFrame:
    """Two rows per contest, each from one competitor's perspective (one pass, no shuffle)."""
    both = lambda i, j: F.struct(
        F.lit(i).alias("side"), F.col(f"c{i}").alias("competitor"), F.col(f"c{j}").alias("opponent"),
        F.col(f"name{i}").alias("name"), F.col(f"name{j}").alias("opponent_name"),
        F.col(f"result{i}").alias("result"),
        F.col(f"kd{i}").alias("kd_self"), F.col(f"kd{j}").alias("kd_opp"),
        F.col(f"str{i}").alias("str_self"), F.col(f"str{j}").alias("str_opp"),
        F.col(f"td{i}").alias("td_self"), F.col(f"td{j}").alias("td_opp"),
        F.col(f"sub{i}").alias("sub_self"), F.col(f"acc{i}").alias("acc_self"),
        F.col(f"acc{j}").alias("acc_opp"), F.col(f"ctrl{i}").alias("ctrl_self"))
    shared = ["contest_id", "date", "event_id", "division", "method", "details", "round", "clock", "has_metrics"]
    return (contests.select(*shared, F.explode(F.array(both(1, 2), both(2, 1))).alias("s"))
            .select(*shared, "s.*"))


def home_division(sides: DataFrame, as_of: str, years: int = 2) -> DataFrame:
    """Most frequent division of the last two years, else of all time; ties to the first seen."""
    since = F.add_months(F.lit(as_of).cast("date"), -12 * years)
    recent = F.col("date") >= since
    counts = (
        sides.filter(~F.col("division").isin("Catch Weight", "Open Weight"))
        .groupBy("competitor", "division")
        .agg(F.count("*").alias("n"), F.min("contest_id").alias("first"),
             F.count_if(recent).alias("nr"), F.min(F.when(recent, F.col("contest_id"))).alias("first_r")))
    return counts.groupBy("competitor").agg(
        F.coalesce(
            F.min(F.when(F.col("nr") > 0, F.struct(-F.col("nr"), "first_r", "division")))["division"],
            F.min(F.struct(-F.col("n"), "first", "division"))["division"]).alias("home_division"))


def aggregate_rounds(rounds: DataFrame) -> DataFrame:
    """Round rows to one row per (event, bout, competitor) with summed statistics."""
    parsed = rounds.select(
        F.trim("EVENT").alias("event"), F.trim("BOUT").alias("bout"), F.trim("COMPETITOR").alias("name"),
        C.leading_int(F.col("KD")).alias("kd"), C.leading_int(F.col("SUB_ATT")).alias("sub_att"),
        C.leading_int(F.col("REV")).alias("rev"), C.clock_seconds(F.col("CTRL")).alias("ctrl"),
        *[C.landed_of(F.col(raw)).alias(short) for raw, short in PAIR_COLUMNS.items()])
    return parsed.groupBy("event", "bout", "name").agg(
        *[F.sum(c).alias(c) for c in ("kd", "sub_att", "rev", "ctrl")],
        *[F.sum(f"{s}.{part}").alias(f"{s}_{part}") for s in PAIR_COLUMNS.values()
          for part in ("landed", "attempted")])


def split_bout(bout):
    """B9: 'A vs. B' -> two names ('' when the text does not match)."""
    pattern = r"^(.+?)\s+vs\.\s+(.+)$"
    return F.trim(F.regexp_extract(bout, pattern, 1)), F.trim(F.regexp_extract(bout, pattern, 2))


def assemble_contests(results: DataFrame, side_stats: DataFrame, events: DataFrame,
                      promoter: str | None = None) -> DataFrame:
    """Result rows joined to both sides' statistics; missing statistics are 0."""
    n1, n2 = split_bout(F.trim("BOUT"))
    base = (
        results.withColumn("name1", n1).withColumn("name2", n2).filter("name1 <> '' and name2 <> ''")
        .select(
            F.trim("EVENT").alias("event"), F.trim("BOUT").alias("bout"), "name1", "name2",
            C.hash_key(F.trim("EVENT"), F.trim("BOUT")).alias("contest_id"),
            C.hash_key(F.col("name1")).alias("c1"), C.hash_key(F.col("name2")).alias("c2"),
            C.hash_key(F.trim("EVENT")).alias("event_id"),
            C.canonical_division(F.col("WEIGHTCLASS"), promoter).alias("division"),
            C.canonical_method(F.col("METHOD")).alias("method"), F.trim("DETAILS").alias("details"),
            C.outcome_side(F.col("OUTCOME"), 1).alias("result1"), C.outcome_side(F.col("OUTCOME"), 2).alias("result2"),
            F.coalesce(F.trim("ROUND").try_cast("int"), F.lit(0)).alias("round"), F.trim("TIME").alias("clock")))
    stats = [c for c in side_stats.columns if c not in ("event", "bout", "name")]
    out = base.join(events.select(F.col("event"), "date"), "event", "left")
    for i in (1, 2):
        s = side_stats.select("event", "bout", F.col("name").alias(f"name{i}"),
                              *[F.col(c).alias(f"{c}{i}") for c in stats])
        out = out.join(s, ["event", "bout", f"name{i}"], "left")
    out = out.fillna(0, subset=[f"{c}{i}" for c in stats for i in (1, 2)])
    for i in (1, 2):
        for s in PAIR_COLUMNS.values():
            if s != "td":
                out = out.withColumn(f"{s}_pct{i}", C.safe_ratio(F.col(f"{s}_landed{i}"), F.col(f"{s}_attempted{i}")))
    return out


def career_totals(side_stats: DataFrame) -> DataFrame:
    """Career sums and accuracies per competitor, one aggregation instead of a rescan each."""
    pct = ("sig", "head", "body", "leg", "distance", "clinch", "ground")
    sums = side_stats.groupBy("name").agg(
        *[F.sum(c).alias(c) for c in ("kd", "td_landed", "sub_att", "ctrl")],
        *[F.sum(f"{s}_{p}").alias(f"{s}_{p}") for s in pct for p in ("landed", "attempted")])
    return sums.select(
        "name", "kd", "td_landed", "sub_att", "ctrl",
        *[C.safe_ratio(F.col(f"{s}_landed"), F.col(f"{s}_attempted")).alias(f"{s}_pct") for s in pct])


def records(sides: DataFrame) -> DataFrame:
    """win/loss/draw tallies and finish rates over wins."""
    win = F.col("result") == "W"
    t = sides.groupBy("competitor").agg(
        F.count_if(win).alias("wins"), F.count_if(F.col("result") == "L").alias("losses"),
        F.count_if(F.col("result") == "D").alias("draws"),
        F.count_if(win & F.col("method").startswith("KO/TKO")).alias("ko"),
        F.count_if(win & (F.col("method") == "SUB")).alias("sub"),
        F.count_if(win & F.col("method").endswith("-DEC")).alias("dec"))
    return t.select(
        "competitor", "wins", "losses", "draws",
        *[C.safe_ratio(F.col(c), F.col("wins")).alias(f"{c}_rate") for c in ("ko", "sub", "dec")])


def physical_lookup(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Last row per name wins; units are stripped."""
    last = raw.groupBy(F.trim("COMPETITOR").alias("name")).agg(
        F.max_by(F.struct("HEIGHT", "WEIGHT", "REACH", "STANCE"), F.col(ordinal)).alias("p"))
    return last.select(
        "name", F.trim("p.HEIGHT").alias("height"),
        F.trim(F.regexp_replace("p.WEIGHT", r"lbs\.", "")).alias("weight"),
        F.trim(F.regexp_replace("p.REACH", '"', "")).alias("reach"), F.trim("p.STANCE").alias("stance"))


def same_key_window(key: str) -> W:
    return W.partitionBy(key).orderBy("date", "contest_id")
