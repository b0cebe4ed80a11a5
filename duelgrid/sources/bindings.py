"""Competition tables derived from the provided star-schema tables.

The column sets are the library's own input schemas, so every operator can equally be
fed from `sources.readers`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from duelgrid.functions.core import half_up
from duelgrid.operators import etl
from duelgrid.operators.identity_rules import tier_multiplier

AS_OF = "2001-08-02"

FIRST_NAMES = ["Adam", "Bruno", "Carlos", "Diego", "Erik", "Felix", "Goran", "Hugo", "Ivan", "Jose"]
KO_DETAILS = ["Punch to Head At Distance", "Elbows to Head On Ground", "Knee to Body",
              "Kick to Head At Distance", "Kick to Leg At Distance", "Kick to Body", "Injury",
              "Corner Stoppage"]
SUB_DETAILS = ["Rear Naked Choke", "Arm Triangle From Mount", "Triangle Armbar", "Guillotine Choke",
               "Kimura", "Heel Hook", "Anaconda Choke", "Unknown hold"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(items: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (index + 1).cast("int"))


def spell(key: Column) -> Column:
    """A letters-only surname, so name normalisers that drop digits keep it unique."""
    return F.concat(F.lit("Van"), F.translate(key.cast("string"), "0123456789", "abdefgiklm"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("competitor"),
        F.concat_ws(" ", _pick(FIRST_NAMES, F.col("s_suppkey") % 10), spell(F.col("s_suppkey"))).alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contest, both sides wide.

    Lines are pre-aggregated per (order, competitor) before the shuffle, and the rank filter
    lets Spark cut each order to two rows on the map side, so a hot order stays small.  Every aggregate
    is of numbers, which Spark hashes; one text or struct among them and all lines are sorted, three times.
    Orders get their division before they meet the wide sides, which so are not shuffled by customer.
    """
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")    # where it stands in the order of texts: 1 is "A", 3 is "N"
    flag_rank = (F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "N", 2).when(flag == "N", 3)
                 .when(flag.isNotNull(), 4))
    side = li.groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").alias("ln"), F.sum("l_quantity").alias("str"),
        F.max("l_discount").alias("acc"), F.count_if(F.col("l_returnflag") == "R").alias("kd"),
        F.count("*").alias("td"), half_up(F.sum("l_extendedprice"), 2).alias("amount"),
        F.min(flag_rank).alias("rf"), (F.sum("l_linenumber") * 30).alias("ctrl"),
        F.count_if(F.col("l_linestatus") == "O").alias("sub"))
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy("ln", "l_suppkey"))
    fields = ["l_suppkey", "kd", "str", "td", "sub", "acc", "ctrl", "amount", "rf"]
    pair = (
        side.withColumn("rn", rn).filter("rn <= 2")
        .groupBy("l_orderkey").agg(F.count("*").alias("sides"), *[
            F.max(F.when(F.col("rn") == i, F.col(f))).alias(f"{f}{i}") for i in (1, 2) for f in fields])
        .filter("sides = 2"))
    regions = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("division")))
    cust = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            .join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "division"))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("date")).join(
        cust, F.col("o_custkey") == F.col("c_custkey"))
    a1, a2 = F.col("amount1"), F.col("amount2")
    key = F.col("o_orderkey")
    secs = key % 300
    method = (
        F.when(F.col("rf1") == 1, "KO/TKO")
        .when((F.col("rf1") == 3) & (F.col("td1") > 1), "SUB")
        .when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "U-DEC")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "M-DEC").otherwise("S-DEC"))
    result1 = (
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "NC")
        .when(F.abs(a1 - a2) < F.lit(0.01) * (a1 + a2), "D")
        .when(a1 > a2, "W").otherwise("L"))
    names = roster(spark, sf_dir).select("competitor", "name")
    base = (
        pair.join(o, pair.l_orderkey == o.o_orderkey)
        .select(
            key.alias("contest_id"), "date", F.date_format("date", "'E'yyyyMMdd").alias("event_id"), "division",
            *[F.col(f"{f}{i}").alias(f"{'c' if f == 'l_suppkey' else f}{i}")
              for f in fields if f != "rf" for i in (1, 2)],
            result1.alias("result1"), method.alias("method"), (1 + key % 3).alias("round"),
            F.when(secs == 0, "--").otherwise(F.concat(
                F.floor(secs / 60).cast("string"), F.lit(":"), F.lpad((secs % 60).cast("string"), 2, "0"))
            ).alias("clock"),
            (key % 11 != 0).alias("has_metrics")))
    return (
        base
        .withColumn("result2", F.when(F.col("result1") == "W", "L").when(F.col("result1") == "L", "W")
                    .otherwise(F.col("result1")))
        .withColumn("details", F.when(F.col("method") == "KO/TKO", _pick(KO_DETAILS, F.col("contest_id") % 8))
                    .when(F.col("method") == "SUB", _pick(SUB_DETAILS, F.col("contest_id") % 8)).otherwise(""))
        .join(names.select(F.col("competitor").alias("c1"), F.col("name").alias("name1")), "c1")
        .join(names.select(F.col("competitor").alias("c2"), F.col("name").alias("name2")), "c2"))


def competitors(spark: SparkSession, sf_dir: str, sides: DataFrame) -> DataFrame:
    """Roster with home division, record, rates and career totals."""
    home = etl.home_division(sides, AS_OF)
    win = F.col("result") == "W"
    tally = sides.groupBy("competitor").agg(
        F.count_if(win).alias("wins"), F.count_if(F.col("result") == "L").alias("losses"),
        F.count_if(F.col("result") == "D").alias("draws"), F.count("*").alias("contests"),
        F.count_if(win & (F.col("method") == "KO/TKO")).alias("ko"),
        F.count_if(win & (F.col("method") == "SUB")).alias("sb"),
        F.count_if(win & F.col("method").endswith("DEC")).alias("dc"),
        F.sum("kd_self").alias("kd"), F.sum("td_self").alias("td"), F.sum("sub_self").alias("sub"),
        F.sum("ctrl_self").alias("ctrl"), F.sum(F.round(F.col("acc_self") * 100)).alias("acc100"))
    per = lambda n, d, k: F.when(F.col(d) > 0, half_up(F.col(n) / F.col(d), k)).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        roster(spark, sf_dir).join(home, "competitor", "left").join(tally, "competitor", "left")
        .select(
            "competitor", "name", "gender", "balance", "nation",
            F.coalesce("home_division", F.lit("")).alias("home_division"),
            *[zero(c).alias(c) for c in ("wins", "losses", "draws", "contests")],
            per("ko", "wins", 2).alias("ko_rate"), per("sb", "wins", 2).alias("sub_rate"),
            per("dc", "wins", 2).alias("dec_rate"),
            zero("kd").alias("kd_total"), zero("td").alias("td_total"), zero("sub").alias("sub_total"),
            zero("ctrl").alias("ctrl_total"),
            F.when(F.col("contests") > 0, half_up(F.col("acc100") / F.col("contests") / 100, 4))
            .otherwise(F.lit(0.0)).alias("accuracy"),
            per("sub", "td", 2).alias("ground_share"), per("kd", "td", 2).alias("distance_share")))


def external_ranking(competitors: DataFrame) -> DataFrame:
    """Per division: first by balance is the champion, the next fifteen are ranked."""
    w = W.partitionBy("home_division").orderBy(F.desc("balance"), "competitor")
    return (
        competitors.filter("home_division <> ''").withColumn("rn", F.row_number().over(w)).filter("rn <= 16")
        .select(F.col("home_division").alias("division"), "competitor", "name",
                F.when(F.col("rn") == 1, "C").otherwise((F.col("rn") - 1).cast("string")).alias("rank")))


def overrides(external: DataFrame) -> DataFrame:
    """Manual corrections: each division's #5 becomes #1; its #9 moves to the next division unranked."""
    divisions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    following = F.create_map(*[F.lit(x) for a, b in zip(divisions, divisions[1:] + divisions[:1]) for x in (a, b)])
    five = external.filter("rank = '5'").select(
        "competitor", "division", F.lit("1").alias("rank"), F.lit(None).cast("string").alias("remove_from"))
    nine = external.filter("rank = '9'").select(
        "competitor", following[F.col("division")].alias("division"), F.lit("NR").alias("rank"),
        F.col("division").alias("remove_from"))
    return five.unionByName(nine)


# Tier of each outside organisation in the test tables.
SEGMENT_TIERS = {"AUTOMOBILE": "tier2", "BUILDING": "tier2_5", "FURNITURE": "tier3", "HOUSEHOLD": "historical",
                 "MACHINERY": "tier4"}


def outside_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as contests in other organisations, dated six years earlier."""
    rows = (
        table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("d"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
              F.col("o_custkey") == F.col("c_custkey")))
    tier = F.create_map(*[F.lit(x) for kv in SEGMENT_TIERS.items() for x in kv])[F.col("c_mktsegment")]
    result = (F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss")
              .when(F.col("o_orderpriority") == "1-URGENT", "draw").otherwise("nc"))
    comp = F.floor(F.col("o_custkey") / 15)
    return rows.select(
        F.col("o_orderkey").alias("outside_id"), comp.alias("competitor"),
        F.date_sub("d", 2192).alias("date"), F.col("c_mktsegment").alias("organisation"),
        F.coalesce(tier, F.lit("tier4")).alias("tier"),
        tier_multiplier(F.coalesce(tier, F.lit("tier4"))).alias("tier_multiplier"),
        F.concat(F.lit("X"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % 400).cast("string")).alias("opponent_id"),
        result.alias("result"), F.date_format("d", "'Night 'yyyyMM").alias("event_name"))


def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter("s_nationkey <> 13").select(
        key.alias("competitor"), F.date_add(F.lit("1955-01-01").cast("date"), (key * 97 % 9000).cast("int")).alias("born"),
        F.when(key % 4 == 3, "year").otherwise("day").alias("precision"))


def media_tables(roster: DataFrame, nations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Media rows, photo rows and nationality codes, as text; some competitors are in one file only or in none."""
    i, text = F.col("competitor"), F.col("competitor").cast("string").alias("canonical_id")
    m = roster.filter(i % 3 != 0).select(text, F.concat(F.lit("Nation_"), (i % 40).cast("string")).alias("nationality"),
                                         F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("p"), i.cast("string"))).alias("photo_url"))
    p = roster.filter(i % 5 != 0).select(text, F.when(i % 7 == 0, "h").otherwise("").alias("headshot_url"),
                                         F.when(i % 2 == 0, "b").otherwise("").alias("full_body_url"))
    n = F.col("n_nationkey")
    return m, p, nations.select(F.initcap("n_name").alias("nationality"), F.concat(F.char(n % 26 + 97), F.char(n * 7 % 26 + 65)).alias("iso"))


def reach_text(competitors: DataFrame) -> DataFrame:
    return competitors.select("competitor", F.when(F.col("nation") < 5, "--").otherwise(F.concat((F.col("nation") + 55).cast("string"), F.lit('"'))).alias("reach"))


def career_ids(competitor, date, as_of):
    """Test ids with short careers: what a competitor of an odd id did in each 30 days before the last 30 is a namesake's
    own career.  No row is left out."""
    span = F.when(competitor % 2 == 1, F.floor(F.datediff(as_of, date) / 30)).otherwise(0)
    return competitor + span * 1_000_000


def short_careers(log: DataFrame, as_of) -> DataFrame:
    """The whole log under career ids, renumbered from the end of each; `holder` is the competitor it was."""
    rows = log.withColumnsRenamed({"competitor": "holder"}).withColumn("competitor", career_ids(F.col("holder"), F.col("date"), as_of))
    newest = rows.filter("competitor <> holder").groupBy("competitor").agg((F.min("rev") - 1).alias("later"))
    moved = rows.filter("competitor <> holder").join(newest, "competitor").withColumn("rev", F.col("rev") - F.col("later")).select(rows.columns)
    return rows.filter("competitor = holder").unionByName(moved)


def title_format(contests: DataFrame) -> DataFrame:
    """scheduled_rounds and label: every third contest is scheduled for three rounds, every ninth is an interim one."""
    i = F.col("contest_id")
    return contests.withColumn("scheduled_rounds", F.when(i % 3 == 0, 3).otherwise(5)).withColumn(
        "label", F.when(i % 9 == 0, F.concat(F.lit("Interim "), "division")).otherwise(F.col("division")))


# ── market feeds ──────────────────────────────────────────────────────────

def feed_name(name: Column, key: Column) -> Column:
    """How a foreign feed spells a name: plain, upper case, suffixed, accented (composed and decomposed) or punctuated."""
    v = key % 5
    return (F.when(v == 0, name).when(v == 1, F.upper(name)).when(v == 2, F.concat(name, F.lit(" Jr")))
            .when(v == 3, F.translate(F.regexp_replace(name, "e", "e\u0300"), "aiostu", "ăịơșțễ")).otherwise(F.regexp_replace(name, "Van", "Va'n")))


def feed_overrides(roster: DataFrame) -> DataFrame:
    """Curated feed spelling -> roster name, for half of the suffixed names."""
    return roster.filter("competitor % 10 = 2").select(
        feed_name(F.col("name"), F.col("competitor")).alias("alias"), F.col("name").alias("target"))


def side_prices(contests: DataFrame) -> DataFrame:
    share = F.col("amount1") / (F.col("amount1") + F.col("amount2"))
    noise = (F.col("contest_id") * 7919 % 1000) / F.lit(1000.0) - 0.5
    p1 = F.least(F.greatest(F.lit(0.5) + F.lit(0.8) * (share - 0.5) + F.lit(0.5) * noise, F.lit(0.08)), F.lit(0.92))
    price = lambda p: half_up(F.lit(1.0) / (F.lit(1.05) * p), 4)
    return contests.withColumn("p1", p1).withColumn("price1", price(F.col("p1"))).withColumn("price2", price(1 - F.col("p1")))


def closing_prices(contests: DataFrame) -> DataFrame:
    """Favourite/underdog rows under feed spellings, dated within two days of the contest."""
    s = side_prices(contests)
    first = F.col("price1") <= F.col("price2")
    pick = lambda a, b: F.when(first, a).otherwise(b)
    n1, n2 = feed_name(F.col("name1"), F.col("c1")), feed_name(F.col("name2"), F.col("c2"))
    res = pick(F.col("result1"), F.col("result2"))
    return s.select(
        F.col("contest_id").alias("price_id"), F.date_add("date", ((F.col("contest_id") % 5) - 2).cast("int")).alias("date"),
        F.col("event_id").alias("event"), pick(n1, n2).alias("favourite"), pick(n2, n1).alias("underdog"),
        F.least("price1", "price2").alias("fav_odds"), F.greatest("price1", "price2").alias("dog_odds"),
        F.when(res == "W", "favourite").when(res == "L", "underdog").otherwise("unknown").alias("outcome"))


def book_prices(contests: DataFrame) -> DataFrame:
    """Long form: five books per side; book 28 is the opener."""
    books = F.array(*[F.struct(F.lit(b).alias("book"), F.lit(i).alias("i")) for i, b in enumerate((28, 1, 2, 3, 4))])
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("price1").alias("base")),
                    F.struct(F.lit(2).alias("side"), F.col("price2").alias("base")))
    return (side_prices(contests).select("contest_id", F.explode(sides).alias("s"))
            .select("contest_id", "s.*", F.explode(books).alias("b"))
            .select("contest_id", "side", F.col("b.book").alias("book"),
                    half_up(F.col("base") * (F.lit(1.0) + F.lit(0.01) * F.col("b.i")), 4).alias("price")))


EPOCH = "1995-01-01"
REIGN_DAYS = 180


def reigns(contests: DataFrame) -> DataFrame:
    """Belt ledger: per division, the holder of each 180-day interval won most in the one before."""
    epoch = F.lit(EPOCH).cast("date")
    sides = contests.select("division", F.floor(F.datediff("date", epoch) / REIGN_DAYS).cast("int").alias("k"), F.explode(F.array(
        F.struct(F.col("c1").alias("holder"), F.col("result1").alias("r")),
        F.struct(F.col("c2").alias("holder"), F.col("result2").alias("r")))).alias("s")).filter("s.r = 'W'")
    wins = sides.groupBy("division", "k", "s.holder").agg(F.count("*").alias("w"))
    best = wins.groupBy("division", "k").agg(F.min(F.struct(-F.col("w"), "holder"))["holder"].alias("holder"))
    last = F.max("k").over(W.partitionBy("division"))
    start = F.date_add(epoch, (F.col("k") + 1) * REIGN_DAYS)
    return best.withColumn("final", F.col("k") == last).select(
        F.concat_ws("#", "division", F.lpad((F.col("k") + 1).cast("string"), 3, "0")).alias("reign_id"), "division", "holder",
        start.alias("start"), F.when(~F.col("final"), F.date_add(start, REIGN_DAYS - 1)).alias("end"),
        ((F.col("k") + 1) % 4 == 3).alias("interim"))




# ── raw feeds (text cells) ────────────────────────────────────────────────

def raw_results(contests: DataFrame) -> DataFrame:
    """Result rows as a scraped feed would hold them: everything is text."""
    key = F.col("contest_id")
    kind = key % 4
    label = (F.when(kind == 0, F.concat(F.lit("Promo "), "division", F.lit(" Title Bout")))
             .when(kind == 1, F.concat("division", F.lit(" Bout")))
             .when(kind == 2, F.concat(F.lit("Ultimate Fighter 3 Tournament "), "division", F.lit(" Bout")))
             .otherwise(F.concat(F.lit("Interim "), "division", F.lit(" Title Bout"))))
    method = (F.when(F.col("result1") == "NC", F.lit("Could Not Continue")).when(F.col("method") == "KO/TKO", "KO/TKO")
              .when(F.col("method") == "SUB", "Submission").when(F.col("method") == "U-DEC", "Decision - Unanimous")
              .when(F.col("method") == "M-DEC", "Decision - Majority").otherwise("Decision - Split"))
    return contests.select(
        "contest_id", F.concat(F.lit(" Card "), key.cast("string")).alias("EVENT"),
        F.concat("name1", F.lit(" vs. "), "name2", F.when(key % 29 == 0, F.lit(" (x)")).otherwise("")).alias("BOUT"),
        F.concat("result1", F.lit("/"), "result2").alias("OUTCOME"), label.alias("WEIGHTCLASS"), method.alias("METHOD"),
        F.col("round").cast("string").alias("ROUND"), F.col("clock").alias("TIME"), F.col("details").alias("DETAILS"))


def raw_events(contests: DataFrame) -> DataFrame:
    return contests.select(F.concat(F.lit("Card "), F.col("contest_id").cast("string")).alias("EVENT"),
                           F.date_format("date", "MMMM d, yyyy").alias("DATE"))


def raw_rounds(spark: SparkSession, sf_dir: str, contests: DataFrame) -> DataFrame:
    """One text row per line item of a participant: 'x of y' cells and an m:ss control cell."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag", "l_linestatus", "l_partkey")
    sides = contests.select("contest_id", "name1", "name2", F.explode(F.array(
        F.struct(F.col("c1").alias("competitor"), F.col("name1").alias("name")),
        F.struct(F.col("c2").alias("competitor"), F.col("name2").alias("name")))).alias("s")).select(
        "contest_id", "name1", "name2", "s.*")
    x = li.join(sides, (li.l_orderkey == sides.contest_id) & (li.l_suppkey == sides.competitor))
    n = F.col("l_linenumber")
    of = lambda a, b: F.concat(a.cast("string"), F.lit(" of "), b.cast("string"))
    half = F.floor(F.col("q") / 2)
    return x.select(
        F.concat(F.lit("Card "), F.col("contest_id").cast("string")).alias("EVENT"),
        F.concat("name1", F.lit(" vs. "), "name2").alias("BOUT"), F.col("name").alias("COMPETITOR"),
        F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "N", "---").otherwise("0").alias("KD"),
        of(F.col("q"), F.col("q") + n).alias("SIG_STR"), of(F.col("q") * 2, F.col("q") * 2 + n).alias("TOTAL_STR"),
        F.when(F.col("l_partkey") % 9 == 0, "---").otherwise(of(n, n + 1)).alias("TD"),
        of(half, F.col("q")).alias("HEAD"), of(n, F.col("q")).alias("BODY"), of(n - 1, n).alias("LEG"),
        of(half, half + n).alias("DISTANCE"), of(n, n * 2).alias("CLINCH"), F.lit("").alias("GROUND"),
        F.when(F.col("l_linestatus") == "O", "1").otherwise("").alias("SUB_ATT"), F.lit("0").alias("REV"),
        F.when(F.col("l_partkey") % 17 == 0, "---").otherwise(F.concat(
            n.cast("string"), F.lit(":"), F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0"))).alias("CTRL"))


def raw_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical rows; every third competitor appears twice, the later row wins."""
    r = roster(spark, sf_dir)
    key = F.col("competitor")
    row = lambda o, extra: F.struct(F.lit(o).alias("ordinal"), (F.lit(60) + key % 20 + extra).alias("inch"))
    rows = r.withColumn("x", F.explode(F.when(key % 3 == 0, F.array(row(1, F.lit(0)), row(2, F.lit(1)))).otherwise(F.array(row(1, F.lit(0))))))
    return rows.select(
        F.col("x.ordinal").alias("ordinal"), F.col("name").alias("COMPETITOR"),
        F.concat(F.floor(F.col("x.inch") / 12).cast("string"), F.lit("' "), (F.col("x.inch") % 12).cast("string"), F.lit('"')).alias("HEIGHT"),
        F.concat((F.lit(115) + key % 10 * 10).cast("string"), F.lit(" lbs.")).alias("WEIGHT"),
        F.when(key % 6 == 5, "--").otherwise(F.concat((F.col("x.inch") + 2).cast("string"), F.lit('"'))).alias("REACH"),
        _pick(["Orthodox", "Southpaw", "Switch"], key % 3).alias("STANCE"))


# ── identity feeds ────────────────────────────────────────────────────────

def aliases(roster: DataFrame) -> DataFrame:
    """Alias table: own names, two suffixed spellings in five, and nicknames shared by ten people."""
    from duelgrid.functions.names import normalize_name
    own = roster.select(normalize_name(F.col("name")).alias("normalized_name"), F.lit("roster").alias("source"),
                        F.col("competitor").alias("canonical_id"))
    jr = roster.filter("competitor % 5 = 2").select(normalize_name(F.concat("name", F.lit(" Jr"))), F.lit("feed"), "competitor")
    nick = roster.filter("competitor % 10 < 3").select(
        F.concat(F.lit("the "), F.lower(spell(F.floor(F.col("competitor") / 10)))), F.lit("nickname"), "competitor")
    return own.union(jr).union(nick)


def foreign_named_contests(contests: DataFrame) -> DataFrame:
    """Contests whose ids are unreliable and whose names come in feed spellings."""
    cols = [c for c in contests.columns if c not in ("c1", "c2", "name1", "name2")]
    return contests.select(
        *cols, (F.col("c1") + 100000).alias("c1"), (F.col("c2") + 100000).alias("c2"),
        feed_name(F.col("name1"), F.col("c1")).alias("name1"), feed_name(F.col("name2"), F.col("c2")).alias("name2"))


def recency_patch(contests: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Late contests re-emitted by another feed: shifted dates, no metrics, some synthetic ids."""
    recent = contests.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), 90))
    sid = lambda c, m: F.when(F.col("contest_id") % 6 == m, F.concat(F.lit("sd:"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string"))
    return recent.select(
        F.col("contest_id").alias("patch_id"), F.date_add("date", (F.col("contest_id") % 31 - 3).cast("int")).alias("date"),
        sid("c1", 0).alias("c1"), sid("c2", 1).alias("c2"), feed_name(F.col("name1"), F.col("c1") % 2 * 2).alias("name1"), F.col("name2"),
        "result1", "result2", "method", "division", F.lit(False).alias("has_metrics"))


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed merges: every 1st id of ten into the 0th, every 3rd into the 2nd."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 in (1, 3)")
    return s.select(F.col("s_suppkey").alias("secondary"), (F.col("s_suppkey") - 1).alias("primary"))


def foreign_profiles(competitors: DataFrame) -> DataFrame:
    """Another site's profiles: F = the person (one nation is missing), G = a namesake in four nations."""
    base = competitors.filter("nation <> 7")
    f = base.select(
        F.concat(F.lit("F"), "competitor").alias("foreign_id"), "competitor", feed_name(F.col("name"), F.col("competitor")).alias("foreign_name"),
        F.when(F.col("competitor") % 8 == 1, "").otherwise(F.col("home_division")).alias("foreign_division"), F.lit(0).alias("shift"))
    g = base.filter("nation < 4").select(
        F.concat(F.lit("G"), "competitor"), "competitor", "name", "home_division", F.lit(1))
    return f.union(g)


def foreign_opponents(profiles: DataFrame, sides: DataFrame) -> DataFrame:
    """Each profile's listed opponents: the person's (or, for G, a neighbour's) drawn contests."""
    from duelgrid.functions.names import normalize_name
    owner = profiles.select("foreign_id", (F.col("competitor") + F.col("shift")).alias("competitor"))
    part = sides.filter("result = 'D'").select("competitor", "opponent_name")
    return owner.join(part, "competitor").select(
        "foreign_id", normalize_name(F.col("opponent_name"), "crosswalk").alias("opp_key")).distinct()


def crosswalk(competitors: DataFrame) -> DataFrame:
    """A mapping table as an earlier run left it: confidences, notes, some ids sharing a foreign id."""
    c = F.col("competitor")
    return competitors.filter("balance >= 0").select(
        "competitor", F.when(c % 10 < 4, F.concat(F.lit("F"), F.floor(c / 2).cast("string"))).otherwise(
            F.concat(F.lit("F"), c.cast("string"))).alias("foreign_id"),
        (c * 37 % 100).cast("int").alias("confidence"),
        F.concat(F.lit("overlap "), (c % 6).cast("string"), F.lit("/5, name="), F.when(c % 3 == 0, "true").otherwise("false")).alias("notes"))


def shared_name_roster(roster: DataFrame) -> DataFrame:
    """Roster where every 25th pair of neighbours carries one name."""
    k = F.when(F.col("competitor") % 25 == 1, F.col("competitor") - 1).otherwise(F.col("competitor"))
    return roster.select("competitor", F.concat_ws(" ", _pick(FIRST_NAMES, k % 10), spell(k)).alias("name"))


def repeated_sides(sides: DataFrame) -> DataFrame:
    """Every 20th contest of a doubled id is on file under both ids."""
    twin = sides.filter((F.col("competitor") % 25 == 0) & (F.col("contest_id") % 20 == 0)).withColumn("competitor", F.col("competitor") + 1)
    return sides.unionByName(twin)


def raw_methods(contests: DataFrame) -> DataFrame:
    texts = ["TKO (Punches)", "KO (Head Kick)", "Submission (Armbar)", "Technical Submission (Triangle)", "Decision (Unanimous)",
             "Decision (Split)", "Decision (Majority)", "Draw (Split)", "TKO (Doctor Stoppage)", "DQ (Illegal Knee)", "NC",
             "Guillotine Choke", "No Contest (Overturned)"]
    odd = F.when(F.col("contest_id") % 211 == 0, F.lit("Walkover")).otherwise(_pick(texts, F.col("contest_id") % len(texts)))
    return contests.select("contest_id", odd.alias("raw_method"))


def foreign_results(outside: DataFrame, competitors: DataFrame) -> DataFrame:
    """Another feed's contests seen from each competitor, dated around the end of our data."""
    return outside.select(
        F.col("outside_id").alias("row_id"), "competitor", ((F.col("competitor") * 3 + F.col("outside_id")) % 50).alias("opponent"),
        F.date_add("date", 2192 + 30).alias("date"), "result")


def media(competitors: DataFrame) -> DataFrame:
    """Side table keyed by foreign id: several rows each, any cell may be empty."""
    c = F.col("competitor")
    copies = competitors.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    some = lambda cond, text: F.when(cond, F.concat(F.lit(text), c.cast("string"), F.lit("-"), F.col("copy").cast("string"))).otherwise("")
    countries = ["Brazil", "France", "Japan", "Poland", "Georgia"]
    return copies.select(
        F.concat(F.lit("F"), c.cast("string")).alias("foreign_id"), F.col("copy").alias("ordinal"),
        some((c + F.col("copy")) % 3 == 0, "head").alias("headshot"), some((c + F.col("copy")) % 5 < 2, "port").alias("portrait"),
        some(c % 2 == 0, "body").alias("full_body"), F.when((c + F.col("copy")) % 4 != 0, _pick(countries, c % 5)).otherwise("").alias("country"))


# Country -> ISO code.
COUNTRY_CODES = {"Brazil": "BR", "France": "FR", "Japan": "JP", "Poland": "PL"}


def birth_claims(competitors: DataFrame) -> DataFrame:
    """Birth dates claimed by two sources, with precision (9 year, 10 month, 11 day)."""
    c = F.col("competitor")
    copies = competitors.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return copies.select(
        F.when(F.col("copy") < 3, "register").otherwise("profile").alias("source"),
        F.when(c % 6 != 0, F.concat(F.lit("F"), c.cast("string"))).alias("foreign_id"), feed_name(F.col("name"), c).alias("label"),
        F.date_add(F.lit("1938-01-01").cast("date"), (c * 97 % 17000 + F.col("copy")).cast("int")).alias("born"),
        (F.lit(9) + (c + F.col("copy")) % 3).cast("int").alias("precision"))


def upcoming(contests: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Scheduled contests: the last fortnight moved ahead thirty days, results removed."""
    recent = contests.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), 14))
    unknown = F.col("contest_id") % 7 == 0
    w = W.partitionBy("event_id").orderBy(F.desc("contest_id"))
    moved = recent.withColumn("date", F.date_add("date", 16)).withColumn("bout_order", F.row_number().over(w))
    return moved.select(
        F.col("contest_id").alias("slot_id"), F.concat(F.lit("Card "), F.col("event_id"), F.lit(" - "), F.col("name1")).alias("event_name"),
        "event_id", "date", "bout_order", (F.col("bout_order") == 1).alias("main_event"), "division", "c1", "name1",
        F.when(~unknown, F.col("c2")).alias("c2"), F.when(unknown, F.lit("Debut Newcomer")).otherwise(F.col("name2")).alias("name2"))
