"""Name normalisers.  They differ on purpose: each join that uses one was built with it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NAME_SUFFIXES

_TAIL = "|".join(NAME_SUFFIXES)


def plain(s: str) -> str:
    """Compatibility forms decomposed, marks dropped."""
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def fold(x: Column) -> Column:
    """Letters without their marks.  Spark has no normal forms, so this is done in Arrow batches."""

    @F.pandas_udf("string")
    def folded(v: pd.Series) -> pd.Series:
        return v.map(plain, na_action="ignore")

    return folded(x)


def _squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def identity_name(x: Column) -> Column:
    """1: folded, lower case, all suffixes (after a comma or space) and then dots gone; null if nothing is left."""
    y = F.regexp_replace(F.trim(F.regexp_replace(F.lower(fold(x)), r"\s+", " ")), rf"((,\s*|\s+)({_TAIL})\.?)+$", "")
    return F.nullif(_squeeze(F.regexp_replace(y, r"\.", "")), F.lit(""))


def compact_name(x: Column) -> Column:
    """2: folded, one suffix gone, only letters and digits."""
    y = F.regexp_replace(F.trim(F.lower(fold(x))), rf"\s+({_TAIL})\.?$", "")
    return F.regexp_replace(y, "[^a-z0-9]", "")


def prospect_name(x: Column) -> Column:
    """3: lower case, each suffix tried once in a fixed order."""
    y = F.trim(F.lower(x))
    for s in NAME_SUFFIXES:
        y = F.regexp_replace(y, rf" {s}\.?$", "")
    return y


def bridge_name(x: Column) -> Column:
    """4: punctuation to space first, then one suffix."""
    y = _squeeze(F.regexp_replace(F.lower(x), r"[.,'`-]", " "))
    return F.regexp_replace(y, rf" ({_TAIL})$", "")


def draft_name(x: Column) -> Column:
    """5: punctuation and dashes to space; a suffix stays."""
    return _squeeze(F.regexp_replace(F.lower(x), r"[.,'`-]", " "))


def college_name(x: Column) -> Column:
    """6: one suffix gone, then punctuation."""
    y = F.regexp_replace(F.lower(F.trim(x)), rf" ({_TAIL})\.?$", "")
    return F.regexp_replace(y, r"[^a-z0-9 ]", "")


def first_and_last(x: Column) -> Column:
    """7: a struct of the first word and of all the others."""
    y = _squeeze(x)
    return F.struct(F.element_at(F.split(y, " "), 1).alias("first"), F.regexp_replace(y, r"^\S+ ?", "").alias("last"))


def slug(name: Column, key: Column) -> Column:
    """Other than letters and digits to dashes, and the last six of the key."""
    return F.concat_ws("-", F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", ""), F.right(key.cast("string"), F.lit(6)))
