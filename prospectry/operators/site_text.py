"""Rules over the text of a site, which is never built in one place (A2, F6-F12 per site).

A site's text is its pages' texts in page order, joined by one space. For a site with a great
share of all pages that text fits no row and no task, and moving page texts between machines is
the dearest thing a plan can do. So each page is judged where it is read, and only findings and
the two ends of its text travel:

1. *page*: what the rules find well inside the page (``reach`` characters away from its ends), or
   what needs no surroundings at all;
2. *merge*: consecutive pages become one segment: the findings of all, those at the seams where two
   of them meet (the ends of the texts around a seam are judged like a small text), and the two ends
   of the joined text. Merging is associative, so segments merge like pages, in rounds of up to
   ``2**RUN_BITS`` at a time, until each site is one;
3. the first characters of the site are judged once more as its start.

Pages are merged by their dense position within their site, whatever their ids are. A site with no
more pages than a round takes needs one round and no positions, which is nearly all of them.

A seam answers for matches that begin within ``reach`` of it and sees twice that on both sides, so
every match is judged with its full surroundings at least once. "First match" rules take the
minimum over (page before the seam, round, offset), which is the first match in the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.strings import contains_some
from ..rules import RuleSet
from ..sources.tables import written
from .ordering import places_within

RUN_BITS = 10
PIECE_BITS = 6

_ANY = ("relevant", "compounding", "manufacturing", "us_mention")
_FIRST = ("evidence", "state_name", "state_code")


def site_pieces(pages: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """A2: ``(domain, piece, n_pages, text)`` from ``(domain, ord, text)``.

    The texts of at most ``2**bits`` consecutive page positions, joined by one space. ``ord`` is
    unique in its domain, so no piece grows beyond that; a site visited on its candidate pages
    only is always one piece.
    """
    grouped = pages.groupBy("domain", F.shiftright("ord", bits).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return grouped.select(
        "domain", "piece", F.size("p").cast("bigint").alias("n_pages"),
        F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


@dataclass(frozen=True)
class _Piece:
    """A stretch of site text, and which matches in it count as its own.

    First-match rules take matches that start in ``[lo, hi)`` (0-based); ``from_start`` and
    ``to_end`` say whether the stretch begins and ends where the site text does (or at a space).
    """

    text: Column
    lowered: Column
    lo: Column
    hi: Column
    from_start: Column
    to_end: Column


def _judge(piece: _Piece, rules: RuleSet) -> Column:
    """Everything the rules find in a piece, as one struct."""
    t, lowered, lo, hi = piece.text, piece.lowered, piece.lo, piece.hi
    # a word character at a cut keeps a word boundary from being seen where the text goes on
    framed = F.concat(
        F.when(piece.from_start, F.lit(" ")).otherwise(F.lit("_")), t,
        F.when(piece.to_end, F.lit(" ")).otherwise(F.lit("_")))
    cut = ~piece.from_start
    masks = {f"commerce_{i}": m for i, m in enumerate(
        tx.signal_mask(lowered, rules.commerce_signals))}
    masks |= {f"content_{i}": m for i, m in enumerate(
        tx.signal_mask(lowered, rules.content_signals))}
    return F.struct(
        *[m.alias(k) for k, m in masks.items()],
        contains_some(lowered, [w.lower() for w in rules.keywords]).alias("relevant"),
        tx.unnegated_in(lowered, rules.compounding_signals, rules, cut).alias("compounding"),
        tx.unnegated_in(lowered, rules.manufacturing_signals, rules, cut).alias("manufacturing"),
        tx.mentions_us_in(framed, lowered).alias("us_mention"),
        tx.evidence_between(t, lowered, lo, hi, rules).alias("evidence"),
        tx.state_name_between(t, lowered, lo, hi, rules).alias("state_name"),
        tx.state_code_between(t, lo, hi, rules).alias("state_code"),
    )


def _with_ends(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``left``, the text up to and including a row, and ``right``, the text after it, ``n``
    characters each at most.

    Frames are ranges of characters, not of rows: rows beyond the ``n`` characters are not looked at,
    which leaves one or two neighbours where texts are not tiny.
    """
    order = Window.partitionBy(*keys).orderBy("ord")
    earlier = F.sum(F.length("head")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_start", F.coalesce(earlier, F.lit(0)))
    near = Window.partitionBy(*keys).orderBy("_start")
    before = F.array_join(F.collect_list("tail").over(near.rangeBetween(-2 * n, 0)), "")
    after = F.array_join(F.collect_list("head").over(near.rangeBetween(1, 2 * n)), "")
    return rows.withColumns(
        {"left": F.right(before, F.lit(n)), "right": F.left(after, F.lit(n))}).drop("_start")


def page_findings(
    pages: DataFrame, rules: RuleSet, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Step 1: ``(domain, ord, *keep, found, head, tail)`` from ``(domain, ord, text, *keep)``.

    A narrow step: page texts end here.
    """
    reach = rules.reach()
    text = pages.select("domain", "ord", *keep, F.concat("text", F.lit(" ")).alias("t"))
    text = text.withColumn("lowered", F.lower("t"))
    t = F.col("t")
    page = _Piece(
        t, F.col("lowered"), F.lit(reach), F.length(t) - reach, F.lit(False), F.lit(False))
    judged = _judge(page, rules)
    # a page is bounded by spaces, so words at its very ends are whole
    return text.select(
        "domain", "ord", *keep,
        judged.withField("us_mention", tx.mentions_us_in(t, F.col("lowered"))).alias("found"),
        F.left(t, F.lit(2 * reach)).alias("head"), F.right(t, F.lit(2 * reach)).alias("tail"))


def _merged(name: str, parts: dict[str, str]) -> Column:
    """One finding out of several structs of the same row, combined over the rows of a group.

    ``parts`` maps each struct column to the place of what it found: a list of named fields
    that, compared in order, put first matches in the order of the whole site text. An empty place
    means that the struct's matches carry theirs already.
    """
    if name in _FIRST:
        keyed = [
            f"{c}.{name}" if not place else
            f"if({c}.{name} IS NULL, NULL, named_struct('rank', {c}.{name}.rank, {place}, "
            f"'at', {c}.{name}.at, 'value', {c}.{name}.value, 'zipped', {c}.{name}.zipped))"
            for c, place in parts.items()]
        value = f"least({', '.join(keyed)})" if len(keyed) > 1 else keyed[0]
        return F.expr(f"min({value})").alias(name)
    if name in _ANY:
        value = " OR ".join(f"coalesce({c}.{name}, false)" for c in parts)
        return F.expr(f"bool_or({value})").alias(name)
    value = " | ".join(f"coalesce({c}.{name}, 0L)" for c in parts)
    return F.expr(f"bit_or({value})").alias(name)


def _place(ord_: str, level: int) -> str:
    return f"'ord', {ord_}, 'level', {level}"


def _merge(
    rows: DataFrame, keys: list[str], rules: RuleSet, aggs: dict[str, Column], level: int, last: bool,
) -> DataFrame:
    """One segment for each of ``keys`` out of its pages (``level`` 0) or segments, in the order of
    ``ord``, which of a segment is that of its last page. ``last``: a site's end is known as such."""
    reach = rules.reach()
    n = 2 * reach
    names = [f.name for f in rows.schema["found"].dataType]
    rows = _with_ends(rows, keys, n).withColumn("whole", F.concat("left", "right")).withColumn(
        "lowered", F.lower("whole")).withColumns({"level": F.lit(1), "run": F.col("ord")})
    whole, before = F.col("whole"), F.length("left")
    if last:
        seam = _Piece(whole, F.col("lowered"), F.greatest(before - reach, F.lit(0)), before + reach,
                      before < n, F.length("right") < n)
    else:
        seam = _Piece(whole, F.col("lowered"), F.greatest(before - reach, F.lit(reach)),
                      F.least(before + reach, F.length(whole) - reach), F.lit(False), F.lit(False))
    rows = rows.withColumn("seam", _judge(seam, rules))
    places = {"found": "" if level else _place("ord", 0), "seam": _place("ord", level + 1)}
    return rows.groupBy(*keys).agg(
        F.struct(*[_merged(x, places) for x in names]).alias("found"),
        F.expr(f"min(struct(ord, left(concat(head, right), {n}) AS v)).v AS head"),
        F.expr("max(struct(ord, left AS v)).v AS tail"),
        F.max("ord").alias("ord"), F.min("first_ord" if level else "ord").alias("first_ord"),
        *[agg.alias(k) for k, agg in aggs.items()])


def _with_start(sites: DataFrame, rules: RuleSet) -> DataFrame:
    """``found`` with what begins in the first characters of the site."""
    reach = rules.reach()
    sites = sites.withColumn("lowered", F.lower("head"))
    start = _Piece(F.col("head"), F.col("lowered"), F.lit(0), F.lit(reach), F.lit(True), F.length("head") < 2 * reach)
    sites = sites.withColumn("start", _judge(start, rules))

    def both(name: str) -> str:
        found, begin = f"found.{name}", f"start.{name}"
        if name in _FIRST:
            return (f"least({found}, if({begin} IS NULL, NULL, named_struct('rank', {begin}.rank, "
                    f"{_place('first_ord', -1)}, 'at', {begin}.at, 'value', {begin}.value, 'zipped', {begin}.zipped)))")
        if name in _ANY:
            return f"coalesce({found}, false) OR coalesce({begin}, false)"
        return f"coalesce({found}, 0L) | coalesce({begin}, 0L)"

    names = [f.name for f in sites.schema["found"].dataType]
    rest = [c for c in sites.columns if c not in ("found", "start", "head", "tail", "lowered", "ord", "first_ord")]
    return sites.select(*rest, *[F.expr(both(x)).alias(x) for x in names])


def site_findings(
    findings: DataFrame, rules: RuleSet, run_aggs: dict[str, Column], site_aggs: dict[str, Column],
    run_bits: int = RUN_BITS, most_pages: int | None = None,
) -> DataFrame:
    """Steps 2 and 3: one row per domain with the findings of its whole text.

    ``run_aggs`` are further aggregates over the rows of ``findings``, ``site_aggs`` aggregates over
    those of partial results: they must give the same in whatever groups rows are merged. No window
    and no group has more than ``2**run_bits`` rows. ``most_pages``, where it is known, bounds the
    pages of a site; otherwise ``findings`` are written down and counted, which starts jobs.
    """
    bits = max(run_bits, 1)
    rows = findings
    if most_pages is None:
        rows = written(findings)
        most_pages = rows.groupBy("domain").count().agg(F.max("count")).first()[0] or 0
    level, aggs = 0, run_aggs
    if most_pages > 1 << bits:
        places = places_within(rows, "domain", "ord", 1 << bits)
        rows = rows.join(places, ["domain", "ord"], "left").withColumn("place", F.coalesce("place", F.lit(0)))
    while most_pages > 1 << bits:
        # dealt out by group even where the rows already lie by domain
        grouped = rows.withColumn("group", F.shiftright("place", bits)).repartition("domain", "group")
        rows = _merge(grouped, ["domain", "group"], rules, aggs, level, False).withColumnRenamed("group", "place")
        most_pages, level, aggs = (most_pages - 1 >> bits) + 1, level + 1, site_aggs
    return _with_start(_merge(rows, ["domain"], rules, aggs, level, True), rules)


def conclusions(found: DataFrame, rules: RuleSet) -> dict[str, Column]:
    """The profile columns that follow from a site's findings."""
    state = F.coalesce(
        F.col("state_name.value"), F.when(F.col("state_code.zipped"), F.col("state_code.value")))
    evidence = F.col("evidence.value")

    def enough(prefix: str) -> Column:
        masks = [F.col(c) for c in found.columns if c.startswith(prefix)]
        return tx.masks_total(masks) >= rules.signal_minimum

    return {
        "research_only_evidence": evidence,
        "company_type": tx.company_type(
            F.col("relevant"), F.col("compounding"), F.col("manufacturing"), evidence),
        "sells_direct": enough("commerce_"), "manufactures": F.col("manufacturing"),
        "is_content_site": enough("content_"),
        "us_based": F.col("us_mention") | state.isNotNull(), "state": state,
    }
