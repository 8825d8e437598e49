"""Company names against host names."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..rules import POSITION_SPAN, POSITION_STEP


def slug(text: Column) -> Column:
    """lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


@F.pandas_udf(DoubleType())
def _gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64"
    )


def host_label(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def common_letters(a: Column, b: Column) -> Column:
    """Letters and digits that two slugs share, each as often as both have it: no matching of the
    two can be longer."""
    def times(s: Column, letter: str) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))

    shared = [F.least(times(a, x), times(b, x)) for x in "abcdefghijklmnopqrstuvwxyz0123456789"]
    return reduce(Column.__add__, shared)


def similarity_bound(a: Column, b: Column) -> Column:
    """What the similarity of two slugs is at most; exact for equal ones and those that share nothing."""
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(2.0) * common_letters(a, b) / F.greatest(total, F.lit(1)))


def slug_similarity(a: Column, b: Column) -> Column:
    """F14 for slugs: the Ratcliff-Obershelp ratio. The only Python on executors: Spark has no such
    measure, so callers ask for it once for each pair that nothing else decides."""
    return _gestalt(a, b)


def name_similarity(name: Column, host: Column) -> Column:
    """the similarity of a name and a host's first label, both as slugs."""
    return slug_similarity(slug(name), slug(host_label(host)))


def position_nudge(position: Column) -> Column:
    """earlier look-up results score slightly higher; 0-based position."""
    return F.greatest(F.lit(0.0), (F.lit(POSITION_SPAN) - position).cast("double")) * POSITION_STEP
