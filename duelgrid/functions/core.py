"""Column helpers shared by every operator (all JVM-side expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from duelgrid.config import DAYS_PER_MONTH, DISPLAY_ANCHORS, FINISH_MULTIPLIERS, EngineConfig

DECISIVE = ("W", "L", "D")


def half_up(c: Column, digits: int = 0) -> Column:
    """Round half toward +infinity (Spark's round() sends negative halves the other way)."""
    scale = float(10 ** digits)
    return F.floor(c * scale + F.lit(0.5)) / F.lit(scale)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def months_between_days(start: Column, end: Column) -> Column:
    """Elapsed months of 30.44 days; not calendar months."""
    return F.datediff(end, start) / F.lit(DAYS_PER_MONTH)


def lenient_number(c: Column) -> Column:
    """Numeric prefix of a text cell; missing or unparsable is 0."""
    prefix = F.regexp_extract(c, r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1)
    return F.when(prefix != "", prefix.try_cast("double")).otherwise(F.lit(0.0))


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def leading_int(c: Column) -> Column:
    """Integer prefix of a text, else 0.

    A failing try_cast raises and catches inside the row loop, so blank and dashed cells are
    turned away by their first character before any cast.
    """
    t = F.trim(c)
    number = F.coalesce(t.try_cast("int"), F.regexp_extract(t, r"^(\d+)", 1).try_cast("int"))
    return F.when(F.substring(t, 1, 1).between("0", "9"), number).otherwise(F.lit(0))


def landed_of(c: Column) -> Column:
    """'9 of 38' -> struct(landed, attempted); blanks and dashes are 0/0."""
    second = F.when(c.contains(" of "), F.substring_index(F.substring_index(c, " of ", 2), " of ", -1))
    return F.struct(leading_int(F.substring_index(c, " of ", 1)).alias("landed"), leading_int(second).alias("attempted"))


def clock_seconds(c: Column) -> Column:
    """'m:ss' -> seconds; a bare integer passes through; anything else is 0."""
    t = F.trim(c)
    mmss = F.substring_index(t, ":", 1).try_cast("int") * 60 + F.substring_index(t, ":", -1).try_cast("int")
    return F.when(t.contains(":"), F.coalesce(mmss, leading_int(t))).otherwise(leading_int(t))


def long_date(c: Column) -> Column:
    """'May 16, 2026' or 'Sept 1, 2020'-like text, or an ISO date, to DATE (null when unparsable)."""
    t = F.trim(c)
    return F.coalesce(F.try_to_date(t, "MMMM d, yyyy"), F.try_to_date(t, "MMM d, yyyy"),
                      F.try_to_date(t, "yyyy-MM-dd"))


def canonical_division(c: Column, promoter: str | None = None) -> Column:
    """Strip bout/title/tournament affixes; `promoter` is the organisation word some feeds prefix."""
    out = F.regexp_replace(F.trim(c), r"(?i)\s*Bout\s*$", "")
    if promoter:
        out = F.regexp_replace(out, rf"(?i)^{promoter}\s+", "")
    out = F.regexp_replace(out, r"(?i)\s+Title$", "")
    out = F.regexp_replace(out, r"(?i)^Ultimate Fighter.*?Tournament\s+", "")
    return F.trim(out)


def canonical_method(c: Column) -> Column:
    m = F.trim(c)
    return (
        F.when(m.startswith("KO/TKO"), "KO/TKO")
        .when(m.startswith("Submission"), "SUB")
        .when(m == "Decision - Unanimous", "U-DEC")
        .when(m == "Decision - Majority", "M-DEC")
        .when(m == "Decision - Split", "S-DEC")
        .when(m.startswith("Could Not Continue"), "CNC")
        .when(m.startswith("Overturned"), "OVERTURNED")
        .when(m.startswith("DQ"), "DQ")
        .otherwise(m)
    )


def outcome_side(c: Column, side: int) -> Column:
    """'W/L' -> this side's letter; unknown letters become ''."""
    letter = F.trim(F.element_at(F.split(c, "/"), F.lit(side)))
    letter = F.when(F.size(F.split(c, "/")) >= side, letter)
    return F.coalesce(F.when(letter.isin("W", "L", "D", "NC"), letter), F.lit(""))


def hash_key(*cols: Column) -> Column:
    """16-hex-digit surrogate key."""
    joined = cols[0] if len(cols) == 1 else F.concat_ws("|", *cols)
    return F.substring(F.md5(joined), 1, 16)


def gender_of(division: Column) -> Column:
    return F.when(F.lower(division).contains("women"), "Female").otherwise("Male")


def safe_ratio(num: Column, den: Column, digits: int = 2) -> Column:
    return F.when(den > 0, half_up(num / den, digits)).otherwise(F.lit(0.0))


def move_label(division: Column) -> Column:
    """Division label for move detection: null for catch/open/tournament, interim prefix dropped."""
    t = F.trim(division)
    open_weight = t.rlike(r"(?i)catch ?weight|open ?weight|tournament|superfight")
    return F.when(division.isNull() | (division == "") | open_weight, F.lit(None).cast("string")) \
        .otherwise(F.trim(F.regexp_replace(t, r"(?i)^Interim\s+", "")))


def finish_family(method: Column) -> Column:
    """Multiplier family of a method, or null for neutral."""
    m = F.trim(method)
    return (
        F.when(m.startswith("KO/TKO") | m.startswith("TKO"), "KO/TKO")
        .when((m == "SUB") | (m == "Submission"), "SUB")
        .when(m == "U-DEC", "U-DEC").when(m == "M-DEC", "M-DEC").when(m == "S-DEC", "S-DEC")
    )


def finish_multiplier(method: Column, engine: EngineConfig) -> Column:
    fam = finish_family(method)
    out = F.lit(1.0)
    for name in FINISH_MULTIPLIERS:
        out = F.when(fam == name, F.lit(float(engine.finish_factor(name)))).otherwise(out)
    return out


def score_of(result1: Column, result2: Column) -> Column:
    """Side-1 score of a rated contest; null when it does not move ratings."""
    return (
        F.when((result1 == "W") & (result2 == "L"), F.lit(1.0))
        .when((result1 == "L") & (result2 == "W"), F.lit(0.0))
        .when((result1 == "D") & (result2 == "D"), F.lit(0.5))
    )


def win_probability(own: Column, other: Column, denominator: float = 400.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (other - own) / F.lit(denominator)))


def regress(rating: Column, gap_months: Column, engine: EngineConfig) -> Column:
    """Pull a rating toward the mean for the part of a layoff beyond the grace period."""
    years = (gap_months - F.lit(engine.grace_months)) / F.lit(12.0)
    mean = F.lit(engine.initial_rating)
    return F.when(
        gap_months > engine.grace_months,
        mean + (rating - mean) * F.pow(F.lit(engine.retention_per_year), years),
    ).otherwise(rating)


def display_score(rating: Column) -> Column:
    """Piecewise-linear display scale over the anchors, clamped at both ends."""
    pairs = list(zip(DISPLAY_ANCHORS, DISPLAY_ANCHORS[1:]))
    out = F.lit(float(DISPLAY_ANCHORS[-1][1]))
    for (x0, y0), (x1, y1) in reversed(pairs):
        line = F.lit(float(y0)) + (rating - F.lit(float(x0))) / F.lit(float(x1 - x0)) * F.lit(float(y1 - y0))
        out = F.when(rating <= x1, line).otherwise(out)
    return F.when(rating <= DISPLAY_ANCHORS[0][0], F.lit(float(DISPLAY_ANCHORS[0][1]))).otherwise(out)


def recency_weight(date: Column, as_of: Column, half_life: float) -> Column:
    months = months_between_days(date, as_of)
    return (F.when(date.isNull(), F.lit(0.0)).when(months < 0, F.lit(1.0))
            .otherwise(F.pow(F.lit(0.5), months / F.lit(half_life))))


def pair_key(a: Column, b: Column) -> Column:
    """Unordered pair as one text key."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def upper_median(values: Column) -> Column:
    """Middle element of a sorted array, the upper one when the count is even."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


def first_match(rules, default: Column) -> Column:
    """Ordered rules [(condition, value)], first hit wins."""
    return reduce(lambda acc, r: F.when(r[0], r[1]).otherwise(acc), reversed(list(rules)), default)


def elapsed_minutes(round_no: Column, clock: Column) -> Column:
    """Contest length from final round and clock; null unless within (0, 60] minutes."""
    t = F.trim(clock)
    mins = ((round_no - 1) * 5 + F.regexp_extract(t, r"^(\d+):(\d{1,2})$", 1).try_cast("int")
            + F.regexp_extract(t, r"^(\d+):(\d{1,2})$", 2).try_cast("int") / F.lit(60.0))
    return F.when(t.rlike(r"^\d+:\d{1,2}$") & (round_no >= 1) & (mins > 0) & (mins <= 60), mins)


def whole_years(born: Column, on: Column) -> Column:
    before = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(on) - F.year(born) - before.cast("int")


def american_to_decimal(c: Column) -> Column:
    return F.when(c > 0, F.lit(1.0) + c / 100.0).when(c < 0, F.lit(1.0) + F.lit(100.0) / F.abs(c))


def decimal_to_american(c: Column) -> Column:
    return F.when(c >= 2, half_up((c - 1) * 100)).when(c > 1, half_up(F.lit(-100.0) / (c - 1)))


def implied_probability(decimal_price: Column) -> Column:
    return F.lit(1.0) / decimal_price
