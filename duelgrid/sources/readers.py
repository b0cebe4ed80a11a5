"""File sources: headered text tables, nested JSON ledgers, optional inputs (ids A1-A20)."""

from __future__ import annotations

import csv
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from duelgrid.functions import core as C

# The headers of the text files, as the files have them.
COMPETITOR_TEXT = ("Fighter_Id", "Full Name", "Nickname", "Ht.", "Wt.", "Stance", "W", "L", "D", "Belt", "Weight_Class", "Gender",
                   "KD", "Sig. Str. %", "TD", "Sub. Att", "Ctrl", "Head_%", "Body_%", "Leg_%", "Distance_%", "Clinch_%", "Ground_%",
                   "KO Rate", "SUB Rate", "DEC Rate", "Fighting Style", "Striker_Membership", "Wrestler_Membership", "Hybrid_Membership")
PATCH_TEXT = ("fighter1_ourId", "fighter1_name", "fighter2_ourId", "fighter2_name", "date", "result1", "result2", "method", "round", "weightClass", "eventName", "source")
MERGE_TEXT = ("secondary_id", "primary_id", "secondary_name", "primary_name", "reason")
OUTSIDE_NAMED_TEXT = ("organisation", "date", "fighter1_name", "fighter2_name", "fighter1_result", "fighter2_result")
OUTSIDE_LINKED_TEXT = ("ourFighterId", "sherdogId", "fullName", "date", "organisation", "canonicalOrg", "tier", "tierMultiplier", "opponentName", "opponentSherdogId",
                       "result", "method", "round", "eventName")
BOOK_TEXT = ("date", "event_slug", "fighter1", "fighter2", "open1", "open2", "close1", "close2", "n_books")
UPCOMING_TEXT = ("event_id", "event_name", "event_date", "bout_order", "is_main_event", "weight_class", "fighter1_ourId", "fighter1_name", "fighter1_sherdogId",
                 "fighter2_ourId", "fighter2_name", "fighter2_sherdogId", "fetched_at")
MEDIA_TEXT = ("canonical_id", "fullName", "nationality", "photo_url", "photo_license", "ufc_id")
PHOTO_TEXT = ("canonical_id", "headshot_url", "full_body_url")
ALIAS_TEXT = ("normalized_name", "source", "canonical_id")
RAW_RESULT_TEXT = ("EVENT", "BOUT", "OUTCOME", "WEIGHTCLASS", "METHOD", "ROUND", "TIME", "TIME FORMAT", "REFEREE", "DETAILS")
RAW_ROUND_TEXT = ("EVENT", "BOUT", "FIGHTER", "KD", "SIG.STR.", "TOTAL STR.", "TD", "SUB.ATT", "REV.", "CTRL", "HEAD", "BODY", "LEG", "DISTANCE", "CLINCH", "GROUND")
RAW_EVENT_TEXT = ("EVENT", "DATE", "LOCATION")
RAW_PHYSICAL_TEXT = ("FIGHTER", "HEIGHT", "WEIGHT", "REACH", "STANCE")
PRICE_TEXT = ("date", "event", "favourite", "underdog", "favourite_odds", "underdog_odds", "outcome")

#: What the numbers of the competitor file are called here.
COMPETITOR_NUMBERS = {"KD": "knockdowns", "Sig. Str. %": "strike_accuracy", "Head_%": "head_share", "Body_%": "body_share", "Leg_%": "leg_share",
                      "Distance_%": "distance_share", "Clinch_%": "clinch_share", "Ground_%": "ground_share", "Sub. Att": "submission_attempts",
                      "Ctrl": "control_time", "TD": "takedowns", "KO Rate": "ko_rate", "SUB Rate": "sub_rate", "DEC Rate": "dec_rate",
                      "Striker_Membership": "striker", "Wrestler_Membership": "wrestler", "Hybrid_Membership": "hybrid"}
#: First lines read at a time.
OPENED_AT_ONCE = 16


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Files under a file, folder or pattern of any store Spark reads; hidden ones (`_`, `.`) are none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs, found = place.getFileSystem(conf), []
    for status in fs.globStatus(place) or []:
        root = status.getPath().toString()
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            name = files.next().getPath().toString()
            if not any(part[:1] in ("_", ".") for part in name[len(root):].split("/") if part):
                found.append(name)
    return sorted(found)


def header_of(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The column names in the first line of a file, which may be compressed; empty if the file is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(file)
    raw = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        stream = codec.createInputStream(raw) if codec is not None else raw
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        raw.close()
    return tuple(c.strip() for c in next(csv.reader([(line or "").lstrip("\ufeff")]), ()))


def read_text_table(spark: SparkSession, path: str, columns) -> DataFrame:
    """A1: headered CSV, every column text, quoted fields with doubled quotes and line breaks.

    Each file's own header says where its columns are: files of one header are one scan, columns come by name in any
    order, unknown ones are not read, and those that a file does not have are null in its rows.  Of a repeated name
    the first column counts.  Only first lines reach the driver."""
    files = data_files(spark, path)
    with ThreadPool(OPENED_AT_ONCE) as pool:
        headers = pool.map(lambda f: header_of(spark, f), files)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers):
        if any(header):
            by_header.setdefault(header, []).append(file)
    out = None
    for header, same in by_header.items():
        place = {name: i for i, name in reversed(list(enumerate(header)))}
        scan = (spark.read.schema(text_schema(f"c{i}" for i in range(len(header)))).option("header", True).option("quote", '"')
                .option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(same))
        part = scan.select(*[(F.col(f"c{place[c]}") if c in place else F.lit(None).cast("string")).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], text_schema(columns)) if out is None else out


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right under a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return [f.getPath().toString() for f in found if f.isDirectory()]


def read_optional(spark: SparkSession, path: str, columns) -> DataFrame:
    """An absent file is an empty table, a no-op for everything downstream."""
    if path_exists(spark, path):
        return read_text_table(spark, path, columns)
    return spark.createDataFrame([], text_schema(columns))


def competitor_source(raw: DataFrame) -> DataFrame:
    """A2, A3: typed competitors; a missing number is 0."""
    num = lambda c: C.lenient_number(F.col(f"`{c}`"))
    return raw.select(
        F.col("Fighter_Id").alias("competitor"), F.coalesce("Full Name", F.lit("")).alias("name"), F.coalesce("Nickname", F.lit("")).alias("nickname"),
        F.coalesce(F.col("`Ht.`"), F.lit("")).alias("height"), num("Wt.").alias("weight"), F.coalesce("Stance", F.lit("")).alias("stance"),
        num("W").alias("wins"), num("L").alias("losses"), num("D").alias("draws"), C.lenient_bool(F.col("Belt")).alias("belt"),
        F.coalesce("Weight_Class", F.lit("")).alias("division"), F.coalesce("Gender", F.lit("")).alias("gender"),
        *[num(c).alias(n) for c, n in COMPETITOR_NUMBERS.items()], F.coalesce("Fighting Style", F.lit("")).alias("style"))


def present(*names: str) -> Column:
    """All of these text columns hold something."""
    out = F.lit(True)
    for n in names:
        out = out & (F.coalesce(F.col(n), F.lit("")) != "")
    return out


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def merge_source(raw: DataFrame) -> DataFrame:
    """Confirmed merges, both ids required; of rows on one secondary id the largest primary id counts."""
    return raw.filter(present("secondary_id", "primary_id")).groupBy(F.col("secondary_id").alias("secondary")).agg(
        F.max("primary_id").alias("primary"))


def outside_named_source(raw: DataFrame) -> DataFrame:
    """Contests elsewhere by both names, as one row per side; results lower-cased, undated rows kept."""
    side = lambda i, j: F.struct(F.trim(f"fighter{i}_name").alias("name"), F.trim(f"fighter{j}_name").alias("opponent"), F.lower(F.trim(f"fighter{i}_result")).alias("result"))
    return raw.filter(present("organisation", "fighter1_name", "fighter2_name")).select(
        "organisation", F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.explode(F.array(side(1, 2), side(2, 1))).alias("s")
    ).select("organisation", "date", "s.*")


def outside_linked_source(raw: DataFrame, skip_tiers: tuple = ("historical",)) -> DataFrame:
    """Contests elsewhere that carry our id and a tier, with their multiplier and the opponent's id there; skipped
    tiers and rows without an id go."""
    result = F.lower(F.trim("result"))
    return raw.filter(present("ourFighterId") & ~F.coalesce(F.col("tier"), F.lit("")).isin(*skip_tiers)).select(
        F.col("ourFighterId").alias("competitor"), F.coalesce(blank_to_null(F.col("canonicalOrg")), F.col("organisation"), F.lit("")).alias("organisation"),
        "tier", C.lenient_number(F.col("tierMultiplier")).alias("tier_multiplier"), F.try_to_date("date", "yyyy-MM-dd").alias("date"),
        F.col("opponentName").alias("opponent"), blank_to_null(F.col("opponentSherdogId")).alias("opponent_id"),
        F.when(result.isin("win", "loss", "draw"), result).otherwise("nc").alias("result"))


def book_source(raw: DataFrame) -> DataFrame:
    """A10: two-way closing prices of the second feed: a date and both closes required, openers optional."""
    n = lambda c: C.lenient_number(F.col(c))
    opener = lambda c: F.when(n(c) > 0, n(c)).alias(c)
    return raw.filter(present("date", "fighter1", "fighter2") & (n("close1") > 0) & (n("close2") > 0)).select(
        F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.col("event_slug").alias("event"), F.col("fighter1").alias("name1"),
        F.col("fighter2").alias("name2"), opener("open1"), n("close1").alias("close1"), opener("open2"), n("close2").alias("close2"),
        F.col("n_books").try_cast("int").alias("n_books"))


def upcoming_source(raw: DataFrame) -> DataFrame:
    """Scheduled contests in card order; a blank id is an unknown competitor, a blank event id falls back to the name."""
    return raw.select(
        F.coalesce(blank_to_null(F.col("event_id")), blank_to_null(F.col("event_name")), F.lit("unknown")).alias("event"),
        F.coalesce("event_name", F.lit("")).alias("event_name"), F.try_to_date("event_date", "yyyy-MM-dd").alias("date"),
        C.lenient_number(F.col("bout_order")).cast("int").alias("bout_order"), F.coalesce("weight_class", F.lit("")).alias("division"),
        (F.coalesce(F.col("is_main_event"), F.lit("")) == "1").alias("main_event"), *[c for i in (1, 2) for c in (
            blank_to_null(F.col(f"fighter{i}_ourId")).alias(f"c{i}"), F.coalesce(f"fighter{i}_name", F.lit("")).alias(f"name{i}"),
            blank_to_null(F.col(f"fighter{i}_sherdogId")).alias(f"foreign{i}"))])


def media_source(media: DataFrame, photos: DataFrame, codes: DataFrame) -> DataFrame:
    """One row per id of either file.  The headshot wins, else the portrait, else the full body;
    the flag is the two regional letters of the nationality's code.  codes: nationality, iso."""
    text = lambda c: F.coalesce(F.max(c), F.lit("")).alias(c)
    m = media.filter(present("canonical_id")).groupBy("canonical_id").agg(text("nationality"), text("photo_url"))
    p = photos.filter(present("canonical_id")).groupBy("canonical_id").agg(text("headshot_url"), text("full_body_url"))
    letter = lambda i: F.expr(f"decode(unhex(concat('0001F1', hex(ascii(substring(upper(iso), {i}, 1)) + 165))), 'UTF-32')")
    x = (m.join(p, "canonical_id", "full_outer").join(codes, "nationality", "left")
         .fillna("", ["nationality", "photo_url", "headshot_url", "full_body_url"]))
    return x.select(
        "canonical_id", "nationality", F.when(F.length("iso") == 2, F.concat(letter(1), letter(2))).otherwise("").alias("flag"),
        F.coalesce(blank_to_null(F.col("headshot_url")), blank_to_null(F.col("photo_url")), F.col("full_body_url")).alias("avatar"), "full_body_url")


def alias_source(raw: DataFrame) -> DataFrame:
    """Alias rows with a name and an id."""
    return raw.filter(present("normalized_name", "canonical_id")).select("normalized_name", "source", "canonical_id")


def raw_source(raw: DataFrame, *required: str) -> DataFrame:
    """Scraped rows (results, rounds, events, physical): all text, trimmed, rows without the required cells go."""
    return raw.filter(present(*(required or ("EVENT",)))).select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def round_source(raw: DataFrame) -> DataFrame:
    """Per-round rows under the names that the aggregation reads."""
    names = {"FIGHTER": "COMPETITOR", "SIG.STR.": "SIG_STR", "TOTAL STR.": "TOTAL_STR", "SUB.ATT": "SUB_ATT", "REV.": "REV"}
    rows = raw_source(raw, "EVENT", "BOUT", "FIGHTER")
    return rows.toDF(*[names.get(c, c) for c in rows.columns])


def event_source(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """A4: one row per event id, the last row wins.  raw: event_id, name, date, location, ordinal."""
    last = raw.filter(F.col("event_id") != "").groupBy("event_id").agg(F.max_by(F.struct("name", "date", "location"), ordinal).alias("x"))
    return last.select("event_id", "x.name", C.long_date(F.col("x.date")).alias("date"), "x.location")


def contest_source(raw: DataFrame, events: DataFrame) -> DataFrame:
    """A5: rows without ids are dropped; the date comes from the event (null when unknown)."""
    kept = raw.filter((F.coalesce("contest_id", F.lit("")) != "") & (F.coalesce("c1", F.lit("")) != "") & (F.coalesce("c2", F.lit("")) != ""))
    return kept.join(events.select("event_id", "date"), "event_id", "left")


def patch_source(raw: DataFrame) -> DataFrame:
    """Rows of the recency feed: ids and date required, no metrics, synthetic contest id."""
    ok = raw.select(*[F.col(f"fighter{i}_{c}").alias(f"{n}{i}") for i in (1, 2) for c, n in (("ourId", "c"), ("name", "name"))], "date", "result1",
                    "result2", "method", "round", F.col("weightClass").alias("division")).filter(present("c1", "c2", "date"))
    return ok.select(
        F.concat(F.lit("patch-"), C.hash_key(F.least("c1", "c2"), F.greatest("c1", "c2"), F.col("date"))).alias("contest_id"),
        "c1", "c2", "name1", "name2", F.try_to_date("date", "yyyy-MM-dd").alias("date"), "result1", "result2", "method",
        C.lenient_number(F.col("round")).cast("int").alias("round"), "division", F.lit(False).alias("has_metrics"),
        *[F.lit(0).alias(f"{c}{i}") for c in ("kd", "str", "td", "sub", "ctrl") for i in (1, 2)])


def price_source(raw: DataFrame) -> DataFrame:
    """Names and both prices required; any other outcome word is 'unknown'.  A file's own `price_id` is kept."""
    a, b = C.lenient_number(F.col("favourite_odds")), C.lenient_number(F.col("underdog_odds"))
    word = F.lower(F.trim("outcome"))
    own = [F.col("price_id").try_cast("bigint").alias("price_id")] if "price_id" in raw.columns else []
    return raw.filter((F.coalesce("favourite", F.lit("")) != "") & (F.coalesce("underdog", F.lit("")) != "") & (a > 0) & (b > 0)).select(
        *own, F.try_to_date("date", "yyyy-MM-dd").alias("date"), "event", "favourite", "underdog",
        a.alias("fav_odds"), b.alias("dog_odds"), F.when(word.isin("favourite", "underdog"), word).otherwise("unknown").alias("outcome"))


def birth_source(raw: DataFrame) -> DataFrame:
    """Only full ISO dates; precision below a day is approximate."""
    return raw.filter(F.col("dob").rlike(r"^\d{4}-\d{2}-\d{2}$")).select(
        "competitor", F.try_to_date("dob", "yyyy-MM-dd").alias("born"), (F.col("precision") != "day").alias("approximate"))


def reach_source(raw: DataFrame) -> DataFrame:
    """Positive whole numbers only."""
    n = F.regexp_extract("reach", r"^\s*(\d+)", 1).try_cast("int")
    return raw.select("competitor", n.alias("reach")).filter("reach > 0")


def title_source(raw: DataFrame) -> DataFrame:
    """Pair key -> sorted title dates (one entry per title contest of the pair)."""
    return raw.groupBy("pair").agg(F.sort_array(F.collect_set("date")).alias("dates"))


REIGN = "array<struct<champion:string,start:string,end:string,interim:boolean,note:string>>"


def reign_ledger(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON map division -> reigns, with settings under `_meta`; (reigns, settings)."""
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("division", "body"))
    meta = pairs.filter("division = '_meta'").select(
        F.coalesce(F.get_json_object("body", "$.padDays").try_cast("int"), F.lit(21)).alias("pad_days"))
    rows = pairs.filter("division <> '_meta'").select("division", F.posexplode(F.from_json("body", REIGN)).alias("ordinal", "r"))
    return rows.select("division", "ordinal", F.col("r.champion").alias("champion"), F.to_date("r.start").alias("start"),
                       F.to_date("r.end").alias("end"), F.coalesce("r.interim", F.lit(False)).alias("interim")), meta


RANKING = ("array<struct<id:string,categoryName:string,champion:struct<id:string,championName:string>,"
           "fighters:array<struct<id:string,name:string>>>>")


def external_rankings(text: DataFrame, skip: str = "(?i)pound-for-pound") -> DataFrame:
    """Ranking lists to (division, name, rank): champion is C, list position is the rank."""
    lists = text.select(F.explode(F.from_json("value", RANKING)).alias("l")).filter(~F.col("l.categoryName").rlike(skip))
    champ = lists.filter("coalesce(l.champion.championName, '') <> ''").select(
        F.col("l.categoryName").alias("division"), F.col("l.champion.championName").alias("name"), F.lit("C").alias("rank"))
    rest = lists.select(F.col("l.categoryName").alias("division"), F.posexplode("l.fighters").alias("pos", "f")).select(
        "division", F.col("f.name").alias("name"), (F.col("pos") + 1).cast("string").alias("rank"))
    return champ.unionByName(rest)


def read_analysis(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Precomputed analysis rows; absent files give an empty table, corrupt rows are dropped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
