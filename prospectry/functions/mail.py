"""Message text: opt-out wording, sender addresses, templates, completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import OPT_OUT_PATTERN
from .strings import blank_to_null, strip

TEMPLATE_FIELDS = (
    "sender_name", "sender_email", "sender_company", "sender_postal_address", "unsubscribe_line",
)


def wants_out(subject: Column, body: Column, pattern: str = OPT_OUT_PATTERN) -> Column:
    """opt-out wording anywhere in subject or body."""
    text = F.concat_ws("\n", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")))
    return text.rlike(rf"(?iU)\b(?:{pattern})\b")


def sender_address(header: Column) -> Column:
    """the address out of ``Name <a@b>`` or a bare address."""
    inside = blank_to_null(F.regexp_extract(header, r"<\s*([^<>]+?)\s*>", 1))
    return F.coalesce(inside, strip(header), F.lit(""))


def fill_template(body: Column, values: dict[str, str | Column]) -> Column:
    """named fields filled in; ``{{`` and ``}}`` are literal braces.

    A field the template names but ``values`` lacks is an error, raised when the row is read.
    """
    out = F.replace(F.replace(body, F.lit("{{"), F.lit("\x02")), F.lit("}}"), F.lit("\x03"))
    known = "|".join(values)
    stray = F.regexp_extract(out, rf"\{{(?!(?:{known})\}})[^{{}}]*\}}", 0)
    # fields become marks first, so that braces inside a value are never taken for a field
    for i, name in enumerate(values):
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(f"\x04{i}\x05"))
    out = F.replace(F.replace(out, F.lit("\x02"), F.lit("{")), F.lit("\x03"), F.lit("}"))
    for i, value in enumerate(values.values()):
        filled = value if isinstance(value, Column) else F.lit(value)
        out = F.replace(out, F.lit(f"\x04{i}\x05"), F.coalesce(filled, F.lit("")))
    return F.when(stray == "", out).when(body.isNull(), F.lit(None)).otherwise(
        F.raise_error(F.concat(F.lit("unknown template field "), stray))
    )


def step_label(step: Column) -> Column:
    """``first`` or ``follow-up #n``."""
    return F.when(step == 1, F.lit("first")).otherwise(
        F.concat(F.lit("follow-up #"), (step - 1).cast("string"))
    )


def sender_problems(email: Column, postal_address: Column, unsubscribe_line: Column) -> Column:
    """names of the sender settings that are empty; nothing may be sent unless empty."""
    checks = (
        ("sender_email", email), ("sender_postal_address", postal_address),
        ("unsubscribe_line", unsubscribe_line),
    )
    found = F.array(
        *[F.when(F.coalesce(c, F.lit("")) == "", F.lit(name)) for name, c in checks]
    )
    return F.filter(found, lambda x: x.isNotNull())
