"""Text and contact fields out of raw HTML with built-in expressions.

``live_markup`` removes comments and script/style/template bodies in one left-to-right pass;
everything but address search runs on its result, so compute it once and keep it as a column.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import blank_to_null, strip

_CUT = "\x01"
_NOT_TEXT = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script\b[^>]*>.*?(?:</script[^>]*>|\z)"
    r"|style\b[^>]*>.*?(?:</style[^>]*>|\z)"
    r"|template\b[^>]*>.*?(?:</template[^>]*>|\z))"
)
# quote-aware tag first; a tag with an unbalanced quote ends at its first '>'
_TAG_BODY = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TAG = rf"<[a-zA-Z/!?](?:{_TAG_BODY}>|[^>]*>)"
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
_ATTRIBUTE = r"(?is)[\s\"']%s\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def live_markup(html: Column) -> Column:
    """Markup without comments and non-text element bodies; blanks written as entities decoded."""
    out = F.regexp_replace(html, _NOT_TEXT, _CUT)
    for blank in ("&nbsp;", "&#160;", "&#xa0;", "&#xA0;"):
        out = F.replace(out, F.lit(blank), F.lit("\xa0"))
    return out


def _code_point(cp: Column) -> Column:
    ok = cp.between(1, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))


def _named() -> Column:
    """Entity names (HTML 4, from the standard library) to characters, as one constant."""
    names = {k: chr(v) for k, v in name2codepoint.items() if k != "amp"} | {"apos": "'"}
    pairs = "\x02".join(f"{k}\x03{v}" for k, v in sorted(names.items()))
    return F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x03"))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references decoded exactly once."""
    named = _named()

    def value(body: Column) -> Column:
        number = F.when(
            body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10).cast("bigint")
        ).when(body.startswith("#"), F.substr(body, F.lit(2)).cast("bigint"))
        return (
            F.when(number == ord("&"), F.lit("&amp;"))
            .when(body.startswith("#"), _code_point(number))
            .otherwise(F.element_at(named, body)))

    def one(acc: Column, body: Column) -> Column:
        ref = F.concat(F.lit("&"), body, F.lit(";"))
        return F.replace(acc, ref, F.coalesce(value(body), ref))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_ENTITY), 1))
    decoded = F.replace(F.aggregate(found, text, one), F.lit("&amp;"), F.lit("&"))
    return F.when(F.instr(text, "&") > 0, decoded).otherwise(text)


def joined_nodes(live: Column) -> Column:
    """Text nodes trimmed, empty ones dropped, joined by one space; references not yet decoded."""
    nodes = F.split(live, f"{_CUT}|{_TAG}")
    return F.array_join(F.filter(F.transform(nodes, strip), lambda x: x != ""), " ")


def visible_text(live: Column) -> Column:
    """F19. Over tables, keep ``joined_nodes`` as a column of its own and decode that."""
    return decode_entities(joined_nodes(live))


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE % name
    values = [blank_to_null(F.regexp_extract(tag, pattern, g)) for g in (1, 2, 3)]
    return F.when(tag != "", F.coalesce(*values))


def meta_tags(live: Column) -> Column:
    """All ``<meta>`` tags, in order; keep them as a column where several values are wanted."""
    return F.regexp_extract_all(live, F.lit(rf"(<[mM][eE][tT][aA][\s/]{_TAG_BODY}>)"), 1)


def meta_content(tags: Column, attribute: str, value: str) -> Column:
    """Content of the first of the tags whose attribute has the value; null if absent or empty."""
    mark = rf"[\s\"'](?i:{attribute})\s*=\s*(?:\"{value}\"|'{value}'|{value}(?=[\s/>]))"
    tag = F.get(F.filter(tags, lambda t: t.rlike(mark)), F.lit(0))
    return decode_entities(_attribute(tag, "content"))


def page_title(live: Column) -> Column:
    """Text of the first ``<title>``; null if absent or empty."""
    raw = F.regexp_extract(live, r"<[tT][iI][tT][lL][eE]\b[^>]*>([^<]*)", 1)
    return decode_entities(blank_to_null(raw))


def company_name(live: Column, tags: Column | None = None) -> Column:
    """F16: site name from the meta tag, else the title up to its first ``|`` and `` - ``."""
    tags = meta_tags(live) if tags is None else tags
    site_name = strip(meta_content(tags, "property", "og:site_name"))
    title = strip(page_title(live))
    title = F.substring_index(F.substring_index(title, "|", 1), " - ", 1)
    return F.coalesce(site_name, strip(title))


def meta_description(live: Column, tags: Column | None = None) -> Column:
    """F17."""
    return strip(meta_content(meta_tags(live) if tags is None else tags, "name", "description"))


def mailto_addresses(live: Column) -> Column:
    """targets of ``mailto:`` links in page order, cut at ``?``."""
    links = F.regexp_extract_all(
        live,
        F.lit(
            r"(?is)<a\b[^>]*?\shref\s*=\s*"
            r"(\"mailto:[^\"]*|'mailto:[^']*|mailto:[^\s\"'>]*)"
        ),
        1,
    )
    cleaned = F.transform(
        links,
        lambda x: F.substring_index(
            F.replace(decode_entities(F.ltrim(x, F.lit("\"'"))), F.lit("mailto:"), F.lit("")),
            "?", 1,
        ),
    )
    return F.when(live.rlike("(?i)mailto:"), cleaned).otherwise(F.array().cast("array<string>"))


__all__ = [
    "company_name", "decode_entities", "joined_nodes", "live_markup", "mailto_addresses",
    "meta_content", "meta_description", "meta_tags", "page_title", "visible_text",
]
