"""Market prices: de-vig, consensus, matching to contests, title attribution (ids H1-H8, H21-H26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelgrid.functions import core as C
from duelgrid.functions.names import name_pair, normalize_name

OPENER_BOOK = 28
DAY_PREFERENCE = (0, 1, -1, 2, -2)     # fixed value: search order of the date tolerance
METHODS = ("multiplicative", "power", "shin")


def devig(fav_odds: Column, dog_odds: Column, method: str) -> Column:
    """H2: favourite's probability with the margin removed."""
    a, b = F.lit(1.0) / fav_odds, F.lit(1.0) / dog_odds
    total = a + b
    if method == "multiplicative":
        return a / total
    if method == "power":
        return _power(a, b)
    return _shin(a, b)


def _power(a: Column, b: Column, steps: int = 20) -> Column:
    """a^t / (a^t + b^t) with a^t + b^t = 1, t in [1, 100].

    The sum is convex and falling in t, so Newton steps from t = 1 approach the root from below;
    they run inside one expression, evaluated once per row.  A step that stays where it is ends them:
    the ones that are left would all give the same t.
    """
    return _power_steps(a, b, F.lit(1.0), F.lit(-1.0), steps, lambda s: F.pow(a, s["t"]) / (F.pow(a, s["t"]) + F.pow(b, s["t"])))


def _newton(a: Column, b: Column, t: Column) -> Column:
    x, y = F.pow(a, t), F.pow(b, t)
    return F.least(F.greatest(t - (x + y - 1) / (x * F.ln(a) + y * F.ln(b)), F.lit(1.0)), F.lit(100.0))


def _power_steps(a: Column, b: Column, t: Column, before: Column, steps: int, finish) -> Column:
    """What `finish` makes of the exponent after `steps` more steps from `t`, which came of `before`."""
    def step(s, _):
        return F.when(s["before"] == s["t"], s).otherwise(F.struct(_newton(a, b, s["t"]).alias("t"), s["t"].alias("before")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(t.alias("t"), before.alias("before")), step, finish)


def with_devig(df: DataFrame, fav_odds: str = "fav_odds", dog_odds: str = "dog_odds", compiled: int = 8, steps: int = 20) -> DataFrame:
    """H2 for a whole table: a column p_<method> for each method, of the same values as `devig`.

    A loop inside an expression is interpreted for every row and step.  Here the first steps of the power method are a
    projection each, which is compiled; the loop takes up the rows that still move after them.
    """
    fav, dog = F.col(fav_odds), F.col(dog_odds)
    out = df.withColumns({"_a": F.lit(1.0) / fav, "_b": F.lit(1.0) / dog, "_t0": F.lit(1.0)})
    a, b = F.col("_a"), F.col("_b")
    out = out.withColumn("_t1", _newton(a, b, F.lit(1.0)))
    for k in range(1, compiled):
        t, before = F.col(f"_t{k}"), F.col(f"_t{k - 1}")
        out = out.withColumn(f"_t{k + 1}", F.when(before == t, t).otherwise(_newton(a, b, t)))
    t, before = F.col(f"_t{compiled}"), F.col(f"_t{compiled - 1}")
    out = out.withColumn("_t", F.when(before == t, t).otherwise(_power_steps(a, b, t, before, steps - compiled, lambda s: s["t"])))
    power = F.pow(a, F.col("_t")) / (F.pow(a, F.col("_t")) + F.pow(b, F.col("_t")))
    return out.withColumns({f"p_{m}": power if m == "power" else devig(fav, dog, m) for m in METHODS}).drop(
        "_a", "_b", "_t", *[f"_t{k}" for k in range(compiled + 1)])


def _shin(a: Column, b: Column) -> Column:
    """Insider-share model; with two prices the share has a closed form. No margin, no insiders."""
    total, spread = a + b, (a - b) * (a - b)
    z = F.least((total - 1) / total * (total - spread) / (1 - spread), F.lit(0.999))
    part = lambda p: (F.sqrt(z * z + F.lit(4.0) * (1 - z) * p * p / total) - z) / (F.lit(2.0) * (1 - z))
    return F.when(total < 1, a / total).otherwise(part(a) / (part(a) + part(b)))


def consensus(book_prices: DataFrame) -> DataFrame:
    """H3: opener and median close per contest side, and the number of books."""
    opener = F.col("book") == OPENER_BOOK
    return book_prices.groupBy("contest_id", "side").agg(
        F.max(F.when(opener, F.col("price"))).alias("open"),
        F.percentile(F.when(~opener, F.col("price")), F.lit(0.5)).alias("close"), F.count("*").alias("books"))


def feed_gaps(quotes: DataFrame, prices: DataFrame, tolerance: int = 3) -> DataFrame:
    """H4: two feeds compared on pair key and nearby date; probabilities oriented to side 1.

    quotes: quote_id, date, name1, name2, price1, price2. The date tolerance is exploded on
    the price side, so the match is an equi-join on (pair, day).  Both sides grow with the feeds and the
    optimizer takes the exploded one for small, so the join is sorted: nothing of it is sent to the driver.
    """
    implied = lambda x, y: (F.lit(1.0) / x) / (F.lit(1.0) / x + F.lit(1.0) / y)
    days = prices.select(
        "price_id", name_pair(F.col("favourite"), F.col("underdog"), "resolver").alias("pair"),
        F.explode(F.sequence(F.date_sub("date", tolerance), F.date_add("date", tolerance))).alias("date"),
        normalize_name(F.col("favourite")).alias("fav_norm"), implied(F.col("fav_odds"), F.col("dog_odds")).alias("fav_p"))
    first = days.groupBy("pair", "date").agg(F.min(F.struct("price_id", "fav_norm", "fav_p")).alias("hit"))
    q = quotes.select("quote_id", "date", name_pair(F.col("name1"), F.col("name2"), "resolver").alias("pair"),
                      normalize_name(F.col("name1")).alias("norm1"), implied(F.col("price1"), F.col("price2")).alias("p1"))
    p = F.when(F.col("hit.fav_norm") == F.col("norm1"), F.col("hit.fav_p")).otherwise(1 - F.col("hit.fav_p"))
    return q.hint("merge").join(first, ["pair", "date"]).select(
        "quote_id", "date", "p1", p.alias("consensus_p1"), F.abs(F.col("p1") - p).alias("gap"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    flip = (F.col("p1") >= 0.5) != (F.col("consensus_p1") >= 0.5)
    return gaps.agg(F.count("*").alias("matched"), C.half_up(F.avg("gap") * 100, 4).alias("mean_gap_points"),
                    F.count_if(F.col("gap") <= 0.03).alias("within_3_points"), F.count_if(flip).alias("favourite_flips"))


def point_in_time(history: DataFrame, provisional: Column | int = 5, per: tuple = ()) -> DataFrame:
    """H5: what was known before each contest, one row per (competitor, opponent, day).

    `per` names extra key columns (a config id) kept through the lookups.
    """
    rows = history.select(
        *per, "competitor", "opponent", "date", "contest_id", "label", F.col("rating_before").alias("self_rating"), "opponent_rating",
        "nth", (F.col("nth") < provisional).alias("provisional"),
        F.coalesce(C.months_between_days(F.col("prev_date"), F.col("date")), F.lit(0.0)).alias("layoff_months"),
        F.coalesce(F.col("prev_label") != F.col("label"), F.lit(False)).alias("moved"))
    keys = [*per, "competitor", "opponent", "date"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "contest_id").alias("x")).select(
        *keys, "x.*")


def contest_days(rated: DataFrame) -> DataFrame:
    """(competitor, opponent, day) -> contest, both orientations; the last contest of a day wins."""
    both = F.explode(F.array(F.struct(F.col("c1").alias("competitor"), F.col("c2").alias("opponent")),
                             F.struct(F.col("c2").alias("competitor"), F.col("c1").alias("opponent"))))
    return rated.select("contest_id", "date", both.alias("x")).groupBy("x.competitor", "x.opponent", "date").agg(
        F.max("contest_id").alias("contest_id"))


def nearest_day(requests: DataFrame, index: DataFrame, key: str, per: tuple = ()) -> DataFrame:
    """H6: first index row at the preferred day offsets.

    An equi-join on the pair and a bucket of as many days as there are offsets: a request reads one or two buckets, each of
    which holds at most one index row a day.
    """
    days, reach = len(DAY_PREFERENCE), max(DAY_PREFERENCE)
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    cand = requests.select(key, "competitor", "opponent", F.col("date").alias("asked"), F.explode(
        F.sequence(bucket(F.date_sub("date", reach)), bucket(F.date_add("date", reach)))).alias("bucket"))
    found = cand.join(index.withColumn("bucket", bucket(F.col("date"))), ["competitor", "opponent", "bucket"])
    off = F.datediff("date", "asked")
    pref = F.coalesce(*[F.when(off == d, F.lit(i)) for i, d in enumerate(DAY_PREFERENCE)])
    value = F.struct("date", *[c for c in index.columns if c not in ("competitor", "opponent", "date", *per)])
    return found.withColumn("pref", pref).filter("pref is not null").groupBy(key, *per).agg(F.min_by(value, "pref").alias("hit"))


def predict_matchups(requests: DataFrame, index: DataFrame, key: str, per: tuple = ()) -> DataFrame:
    """H7: own view required, reverse view optional (defaults when missing).

    A contest is indexed under both orientations on the same day, so the reverse view is read
    at the day the own view was found: one date search instead of two.
    """
    own = nearest_day(requests, index, key, per).withColumnRenamed("hit", "a")
    at = requests.select(key, F.col("opponent").alias("competitor"), F.col("competitor").alias("opponent")).join(
        own.select(key, *per, F.col("a.date").alias("date")), key)
    view = [c for c in index.columns if c not in ("competitor", "opponent", "date", *per)]
    rev = at.join(index, [*per, "competitor", "opponent", "date"]).select(key, *per, F.struct(*view).alias("b"))
    dog_prov = F.coalesce("b.provisional", F.lit(True))
    return own.join(rev, [key, *per], "left").select(
        key, *per, C.win_probability(F.col("a.self_rating"), F.col("a.opponent_rating")).alias("model_p"),
        F.col("a.self_rating").alias("fav_rating"), F.col("a.opponent_rating").alias("dog_rating"),
        F.col("a.nth").alias("fav_no"), F.coalesce("b.nth", F.lit(-1)).alias("dog_no"),
        F.col("a.provisional").alias("fav_provisional"), dog_prov.alias("dog_provisional"),
        (~F.col("a.provisional") & ~dog_prov).alias("both_established"),
        F.col("a.layoff_months").alias("fav_layoff"), F.coalesce("b.layoff_months", F.lit(0.0)).alias("dog_layoff"),
        F.col("a.moved").alias("fav_moved"), F.coalesce("b.moved", F.lit(False)).alias("dog_moved"),
        F.col("a.label").alias("division"), F.col("a.date").alias("contest_date"))


def join_prices(prices: DataFrame, resolved: DataFrame, index: DataFrame) -> DataFrame:
    """H8: every price row with a verdict; `ok` rows carry the point-in-time prediction.

    resolved: price_id, fav_id, dog_id (null when a name did not resolve).
    """
    r = prices.join(resolved, "price_id")
    asked = r.filter("fav_id is not null and dog_id is not null").select(
        "price_id", F.col("fav_id").alias("competitor"), F.col("dog_id").alias("opponent"), "date")
    out = r.join(predict_matchups(asked, index, "price_id"), "price_id", "left")
    verdict = (F.when(F.col("fav_id").isNull() | F.col("dog_id").isNull(), "unresolved_name")
               .when(F.col("model_p").isNull(), "no_contest")
               .when(F.col("outcome") == "unknown", "unknown_outcome").otherwise("ok"))
    return out.withColumn("verdict", verdict).withColumn("year", F.year("date")).withColumn(
        "fav_won", F.col("outcome") == "favourite")


def edge_verdict(win_p: Column, price: Column, other_price: Column, threshold: float = 0.03) -> Column:
    """Value / fair / against for a supplied two-way price, with the margin."""
    a, b = F.lit(1.0) / price, F.lit(1.0) / other_price
    edge = win_p - a / (a + b)
    return F.struct(C.half_up(edge, 4).alias("edge"), C.half_up(a + b - 1, 4).alias("overround"),
                    F.when(edge > threshold, "value").when(edge < -threshold, "against").otherwise("fair").alias("verdict"))


def title_candidates(contests: DataFrame, reigns: DataFrame, as_of: str, pad: int = 21) -> DataFrame:
    """Contests of title format whose participant holds a belt within the padded reign.

    Title format: scheduled for five rounds, or called an interim or championship contest.
    contests also has scheduled_rounds and label.  reigns: reign_id, division, holder, start,
    end (null = current), interim.  A holder's contests meet his reigns by half-year buckets.
    """
    titled = contests.filter((F.col("scheduled_rounds") == 5) | F.col("label").rlike("Interim|Championship"))
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / 180)
    sides = titled.select("contest_id", "date", "division", "c1", "c2", "result1", "result2",
                          F.explode(F.array("c1", "c2")).alias("holder"), bucket(F.col("date")).alias("bucket"))
    first = F.date_sub("start", pad)
    last = F.date_add(F.coalesce("end", F.lit(as_of).cast("date")), pad)
    r = reigns.filter(first <= last).select(
        "reign_id", F.col("division").alias("reign_division"), "holder", "start", "interim", first.alias("first"), last.alias("last"),
        F.explode(F.sequence(bucket(first), bucket(last))).alias("bucket"))
    c = (sides.join(r, ["holder", "bucket"]).filter(F.col("date").between(F.col("first"), F.col("last"))).drop("bucket", "first", "last")
         .withColumn("div_match", F.col("reign_division") == F.col("division"))
         .withColumn("established", F.col("start") < F.col("date")))
    w = W.partitionBy("contest_id")    # at most two holders and a few reigns each
    return (c.withColumn("any_match", F.max("div_match").over(w))
            .withColumn("holders", F.size(F.collect_set("holder").over(w)))
            .filter("any_match or holders >= 2"))


def attribute_titles(cands: DataFrame) -> DataFrame:
    """Established undisputed latest reign first, else the winner's reign, else ledger order."""
    winner = F.when(F.col("result1") == "W", F.col("c1")).when(F.col("result2") == "W", F.col("c2"))
    pool = cands.filter("div_match or not any_match").withColumn("winner", winner)
    order = [
        F.desc("established"),
        F.asc(F.when(F.col("established"), F.col("interim").cast("int")).otherwise(0)),
        F.desc(F.when(F.col("established"), F.col("start"))),
        F.desc(F.when(~F.col("established"), F.coalesce(F.col("holder") == F.col("winner"), F.lit(False)))),
        F.asc("reign_id")]
    best = pool.withColumn("rn", F.row_number().over(W.partitionBy("contest_id").orderBy(*order))).filter("rn = 1")
    return best.select(
        "contest_id", "date", "reign_id", F.col("reign_division").alias("title_division"), "interim",
        F.col("holder").alias("champion"),
        F.when(F.col("holder") == F.col("c1"), F.col("c2")).otherwise(F.col("c1")).alias("challenger"), "winner")


def nearest_prices(asked: DataFrame, prices: DataFrame, key: str, within: int = 45) -> DataFrame:
    """Nearest price row of the pair, both directions.

    One price per (pair, day) is kept before the join and days are bucketed, so a pair with
    many rows cannot fan out.  asked: key, pair, date.  prices: pair, date, price_id, ....
    """
    daily = prices.groupBy("pair", "date").agg(F.min(F.struct("price_id", *[
        c for c in prices.columns if c not in ("pair", "date", "price_id")])).alias("p"))
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    daily = daily.select("pair", F.col("date").alias("price_date"), "p", F.floor(day("date") / within).alias("bucket"))
    b = F.floor(day("date") / within)
    x = asked.withColumn("bucket", F.explode(F.array(b - 1, b, b + 1))).join(daily, ["pair", "bucket"])
    gap = F.abs(F.datediff("date", "price_date"))
    return (x.filter(gap <= within).groupBy(key)
            .agg(F.min(F.struct(gap.alias("gap"), F.col("p.price_id").alias("price_id"), "p", "price_date")).alias("best"))
            .select(key, "best.gap", "best.price_date", "best.p.*"))


def title_flags(rows: DataFrame, titles: DataFrame, label: str = "label", within: int = 3) -> DataFrame:
    """Is the contest in the title list (same pair within days), else by its label."""
    listed = titles.select("pair", F.explode(F.sequence(F.date_sub("date", within), F.date_add("date", within))).alias("date")
                           ).distinct().withColumn("listed", F.lit(True))
    return rows.join(listed, ["pair", "date"], "left").withColumn(
        "is_title", F.coalesce("listed", F.col(label).rlike("(?i)interim|championship|title"), F.lit(False))).drop("listed")
