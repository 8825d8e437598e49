"""Rule-based text classification.

All functions take the text of one site or document as a column. The ``*_between`` variants serve
text that is judged in pieces (see ``operators.site_text``): they also say where a match starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import DEFAULT_RULES, US_MENTION, ZIP_WINDOW, RuleSet
from .strings import alternation, contains_some, let, one_of, strip, words_array


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """The text holds one of the words, whatever the case."""
    return let(F.lower(text), lambda low: contains_some(low, [w.lower() for w in words]))


MASK_BITS = 62


def signal_mask(lowered: Column, signals: tuple[str, ...]) -> list[Column]:
    """Which signals occur, as bit masks of up to 62 signals each (they combine with ``bit_or``)."""
    def bit(w: Column, i: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
        return F.when(F.contains(lowered, w), one).otherwise(F.lit(0).cast("bigint"))

    return [
        F.aggregate(
            F.transform(words_array(signals[start:start + MASK_BITS]), bit),
            F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))
        for start in range(0, len(signals), MASK_BITS)
    ]


def masks_total(masks: list[Column]) -> Column:
    total = F.lit(0)
    for m in masks:
        total = total + F.bit_count(m)
    return total


def count_signals(text: Column, signals: tuple[str, ...]) -> Column:
    """A10: how many distinct signal phrases occur."""
    return let(
        F.lower(text),
        lambda low: F.size(F.filter(words_array(signals), lambda w: F.contains(low, w))))


def sells_direct(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """F9."""
    return count_signals(text, rules.commerce_signals) >= rules.signal_minimum


def is_content_site(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """F11."""
    return count_signals(text, rules.content_signals) >= rules.signal_minimum


def unnegated_in(
    lowered: Column, signals: tuple[str, ...], rules: RuleSet, cut_left: Column | None = None
) -> Column:
    """F8 on lower-cased text (a plain column or bound value).

    The window before a hit depends only on where a signal starts, so one zero-width pattern finds
    the windows of all signals, overlapping ones too, in one pass over texts that hold any. With
    ``cut_left`` true the text does not begin at its real start, and hits with less than a full
    window before them are left to the piece before.
    """
    n = rules.negation_window
    pattern = rf"(?s)(?={alternation(signals)})(?<=(\A.{{0,{n - 1}}}|.{{{n}}}))"
    negation = rf"(?U)\b(?:{alternation(rules.negation_words)})\b"

    def clean(w: Column) -> Column:
        ok = ~w.rlike(negation)
        return ok if cut_left is None else ok & (~cut_left | (F.length(w) >= n))

    if not signals:
        return F.lit(False)
    windows = F.regexp_extract_all(lowered, F.lit(pattern), 1)
    return contains_some(lowered, signals) & F.exists(windows, clean)


def unnegated_signal(
    text: Column, signals: tuple[str, ...], rules: RuleSet = DEFAULT_RULES
) -> Column:
    """F8: a signal occurs at least once without a negation word in the characters before it."""
    return let(F.lower(text), lambda low: unnegated_in(low, signals, rules))


def manufactures(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """F10."""
    return unnegated_signal(text, rules.manufacturing_signals, rules)


def _evidence_place(lowered: Column, rules: RuleSet, lo: Column | None = None,
                    hi: Column | None = None) -> Column:
    """``(rank, at, n)`` of the first phrase in list order that starts in ``[lo, hi)``; 1-based."""
    def place(phrase: Column, rank: Column) -> Column:
        if lo is None:
            at = F.call_function("locate", phrase, lowered)
        else:
            at = F.call_function("locate", phrase, lowered, lo + 1)
        return F.struct(rank.alias("rank"), at.alias("at"), F.length(phrase).alias("n"))

    def fits(p: Column) -> Column:
        return p["at"] > 0 if hi is None else (p["at"] > 0) & (p["at"] <= hi)

    places = F.transform(words_array(rules.evidence_phrases), place)
    return F.get(F.filter(places, fits), F.lit(0))


def around(text: Column, place: Column, margin: int) -> Column:
    """The match with ``margin`` characters on either side, trimmed."""
    start = F.greatest(F.lit(1), place["at"] - margin)
    return strip(F.substr(text, start, place["at"] + place["n"] + margin - start))


def evidence(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """text around the first evidence phrase found, phrases tried in list order."""
    found = let(F.lower(text), lambda low: _evidence_place(low, rules))
    return let(found, lambda p: around(text, p, rules.evidence_margin))


_US_WORDS = ("united states", "u.s.", "usa")


def mentions_us_in(text: Column, lowered: Column) -> Column:
    """The pattern is tried only on texts that hold one of its words at all."""
    return contains_some(lowered, _US_WORDS) & text.rlike(rf"(?iU)\b(?:{US_MENTION})\b")


def mentions_us(text: Column) -> Column:
    return let(F.lower(text), lambda low: mentions_us_in(text, low))


def _first(text: Column, pattern: str, found: Callable[[Column, Column, Column], Column]) -> Column:
    """``found(start, value, after)`` of the first match, null without one. ``start`` is 0-based.

    One pass of the pattern, counted in characters whatever the text holds.
    """
    def of_halves(h: Column) -> Column:
        before, after = h[0], F.get(h, F.lit(1))
        n = F.length(text) - F.length(before) - F.length(after)
        value = F.substr(text, F.length(before) + 1, n)
        return F.when(F.size(h) > 1, found(F.length(before), value, after))

    return let(F.split(text, pattern, 2), of_halves)


def state_name_pattern(rules: RuleSet) -> str:
    return one_of(rules.state_names, "i")


def state_code_pattern(rules: RuleSet) -> str:
    words = sorted(rules.state_abbreviations)
    firsts = "".join(sorted({w[0] for w in words}))
    return rf"(?U)(?=[{firsts}])\b(?:{alternation(words)})\b" if words else "(?!)"


def _names_in(lowered: Column, rules: RuleSet) -> Column:
    return contains_some(lowered, [n.lower() for n in rules.state_names])


def has_zip(text: Column) -> Column:
    return text.rlike(r"(?U)\b\d{5}(?:-\d{4})?\b")


def us_state(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """leftmost state name as written, else the first abbreviation if a zip code follows."""
    name = F.when(
        let(F.lower(text), lambda low: _names_in(low, rules)),
        F.regexp_extract(text, f"({state_name_pattern(rules)})", 1))
    code = _first(
        text, state_code_pattern(rules),
        lambda start, value, after: F.when(has_zip(F.left(after, F.lit(ZIP_WINDOW))), value))
    return F.coalesce(name, code)


def us_presence(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """``struct(is_us, state)``."""
    state = us_state(text, rules)
    return F.struct((mentions_us(text) | state.isNotNull()).alias("is_us"), state.alias("state"))


def _match(rank: Column, at: Column, value: Column, zipped: Column | None = None) -> Column:
    return F.struct(
        rank.cast("int").alias("rank"), at.cast("bigint").alias("at"), value.alias("value"),
        (F.lit(None).cast("boolean") if zipped is None else zipped).alias("zipped"))


def evidence_between(
    text: Column, lowered: Column, lo: Column, hi: Column, rules: RuleSet
) -> Column:
    """Best evidence that starts in ``[lo, hi)`` (0-based): ``(rank of phrase, at, snippet)``."""
    def match(p: Column) -> Column:
        return F.when(p.isNotNull(), _match(
            p["rank"], p["at"] - 1, around(text, p, rules.evidence_margin)))

    return let(_evidence_place(lowered, rules, lo, hi), match)


def _first_between(
    text: Column, pattern: str, lo: Column, hi: Column, zip_after: bool
) -> Column:
    # a stand-in for the character before ``lo`` keeps word boundaries as they are
    before = F.substr(F.concat(F.lit(" "), text), lo + 1, F.lit(1))
    mark = F.when(before.rlike(r"(?U)\w"), F.lit("_")).otherwise(F.lit(" "))

    def first(view: Column) -> Column:
        def match(start: Column, value: Column, after: Column) -> Column:
            zipped = has_zip(F.left(after, F.lit(ZIP_WINDOW))) if zip_after else None
            at = lo + start - 1
            return F.when(at < hi, _match(F.lit(0), at, value, zipped))

        return _first(view, pattern, match)

    return let(F.concat(mark, F.substr(text, lo + 1)), first)


def state_name_between(
    text: Column, lowered: Column, lo: Column, hi: Column, rules: RuleSet
) -> Column:
    """First state name that starts in ``[lo, hi)``."""
    return F.when(
        _names_in(lowered, rules),
        _first_between(text, state_name_pattern(rules), lo, hi, False))


def state_code_between(text: Column, lo: Column, hi: Column, rules: RuleSet) -> Column:
    """First state abbreviation that starts in ``[lo, hi)``, and whether a zip code follows."""
    return _first_between(text, state_code_pattern(rules), lo, hi, True)


def company_type(
    relevant: Column, compounding: Column, manufacturing: Column, evidence_text: Column
) -> Column:
    """the type by priority; null for texts that hold no keyword."""
    return F.when(
        relevant,
        F.when(compounding, "compounding_pharmacy")
        .when(manufacturing, "manufacturing_lab")
        .when(F.coalesce(evidence_text, F.lit("")) != "", "research_only")
        .otherwise("consumer_and_research"),
    )


def text_company_type(
    text: Column, evidence_text: Column, rules: RuleSet = DEFAULT_RULES
) -> Column:
    return company_type(
        contains_any(text, rules.keywords),
        unnegated_signal(text, rules.compounding_signals, rules),
        unnegated_signal(text, rules.manufacturing_signals, rules),
        evidence_text,
    )
