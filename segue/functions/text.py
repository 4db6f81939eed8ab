"""Title text: normalisation and n-grams as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a title that is null or blank, so that untitled lists meet each other only.
UNTITLED = "\x00"


def strip(c: Column) -> Column:
    """All white space at both ends goes (trim() knows blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _grams_of(c: Column, n: int) -> Column:
    # sequence() runs backwards when its end is below its start, so short texts are kept out.
    at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(c, i, F.lit(n)))


def char_grams(c: Column, lo: int, hi: int) -> Column:
    """All n-grams of lo..hi characters, repeats included."""
    return F.concat(*[_grams_of(c, n) for n in range(lo, hi + 1)])


def char_wb_grams(c: Column, lo: int, hi: int) -> Column:
    """n-grams inside words, each padded by a blank on both sides; a padded word shorter than lo counts once, whole."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: _padded(F.concat(F.lit(" "), w, F.lit(" ")), lo, hi)))


def _padded(w: Column, lo: int, hi: int) -> Column:
    return F.when(F.length(w) < lo, F.array(w)).otherwise(char_grams(w, lo, hi))


def word_grams(c: Column) -> Column:
    """Words of two or more word characters."""
    return F.regexp_extract_all(c, F.lit(r"(\b\w\w+\b)"), F.lit(1))


def grams(c: Column, analyzer: str = "char_wb", lo: int = 2, hi: int = 5) -> Column:
    if analyzer == "char_wb":
        return char_wb_grams(c, lo, hi)
    if analyzer == "char":
        return char_grams(F.regexp_replace(c, r"\s\s+", " "), lo, hi)
    if analyzer == "word":
        return word_grams(c)
    raise ValueError(f"unknown analyzer {analyzer!r}")
