"""Name normalisers of the different feeds, and the derived match keys (ids C8, C9)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F



def folding() -> tuple[str, str]:
    """All lower-case letters that decompose to a letter a-z with marks, and these letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(128, 0x2000)]
    kept = [(c, d[0]) for c, d in pairs if "a" <= d[0] <= "z" and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in kept), "".join(p for _, p in kept)


ACCENTED, PLAIN = folding()
#: Combining marks of decomposed text; they go before anything is replaced by a filler.
MARKS = r"[\u0300-\u036f]"

# variant: (characters kept, replacement of the others, suffix words dropped, spaces kept)
VARIANTS = {
    "resolver": (r"[^a-z\s]", "", None, True),
    "loader": (r"[^a-z0-9]", "", "jr|sr|ii|iii|iv", False),
    "crosswalk": (r"[^a-z\s]", " ", "jr|sr|ii|iii|iv", True),
    "title": (r"[^a-z ]", "", None, True),
    "birth": (r"[^a-z0-9]", "", r"jr|sr|junior|senior", False),
    "upcoming": (r"[^a-z ]", " ", "jr|sr|ii|iii|iv", True),
    "search": (r"[^a-z0-9 ]", "", None, True),
}
SUFFIX_FIRST = ("loader", "birth")     # these drop suffix words before stripping punctuation
KEEP_RUNS = ("search",)                # inner runs of spaces stay


def fold_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), MARKS, "")


def normalize_name(c: Column, variant: str = "resolver") -> Column:
    strip, filler, suffixes, spaced = VARIANTS[variant]
    out = fold_accents(F.coalesce(c, F.lit("")))
    drop = lambda x: F.regexp_replace(x, rf"\b({suffixes})\b" + (r"\.?" if variant == "birth" else ""), "")
    if suffixes and variant in SUFFIX_FIRST:
        out = drop(out)
    out = F.regexp_replace(out, strip, filler)
    if suffixes and variant not in SUFFIX_FIRST:
        out = drop(out)
    if spaced and variant not in KEEP_RUNS:
        out = F.regexp_replace(out, r"\s+", " ")
    return F.trim(out)


def last_first_key(c: Column) -> Column:
    """'last_f' key; a one-word name is its own key."""
    parts = F.split(F.trim(c), r"\s+")
    key = F.concat(normalize_name(F.element_at(parts, -1)), F.lit("_"),
                   F.substring(normalize_name(F.element_at(parts, 1)), 1, 1))
    return F.when(F.size(parts) < 2, normalize_name(c)).otherwise(key)


def surname(c: Column, variant: str = "crosswalk") -> Column:
    return F.element_at(F.split(normalize_name(c, variant), " "), -1)


def name_pair(a: Column, b: Column, variant: str = "loader") -> Column:
    x, y = normalize_name(a, variant), normalize_name(b, variant)
    return F.concat_ws("|", F.least(x, y), F.greatest(x, y))
