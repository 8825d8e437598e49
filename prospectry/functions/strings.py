"""Small string helpers shared by the column functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# every character a Unicode-aware strip removes
WHITESPACE = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(c: Column) -> Column:
    """Both ends trimmed of any Unicode white space."""
    return F.btrim(c, F.lit(WHITESPACE))


def drop_www(c: Column) -> Column:
    return F.when(c.startswith("www."), F.substr(c, F.lit(5))).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of conditions (false for none), short-circuiting from the left."""
    out = None
    for cond in conditions:
        out = cond if out is None else out | cond
    return F.lit(False) if out is None else out


def alternation(words: Iterable[str]) -> str:
    """Regex alternatives of literal words, in the given order."""
    return "|".join(re.sub(r"([!-/:-@\[-^`{-~])", r"\\\1", w) for w in words)


def one_of(words: Iterable[str], flags: str = "") -> str:
    """Regex for one of the words, behind a look at the first character that spares most positions
    the alternatives."""
    words = list(words)
    if not words:
        return r"(?!)"
    firsts = "".join(sorted({re.sub(r"([\[\]^&\\-])", r"\\\1", w[0]) for w in words}))
    return f"(?{flags}:(?=[{firsts}])(?:{alternation(words)}))" if flags else (
        f"(?=[{firsts}])(?:{alternation(words)})")


def words_array(words: Iterable[str]) -> Column:
    """A constant array of words, as one literal however many there are."""
    words = list(words)
    if not words:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x01".join(words)), "\x01")


def contains_some(text: Column, words: Iterable[str]) -> Column:
    """The text holds one of the words. ``text`` should be a plain column or a bound value: it is
    looked at once for each word."""
    return F.exists(words_array(words), lambda w: F.contains(text, w))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
