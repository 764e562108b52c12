"""Text and number expressions with the feed format's exact acceptance rules.

Every parser returns null for what it doesn't accept and never fails, so the
expressions are safe under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
#: Fixed value: the characters that Unicode calls white space.
_SPACES = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def utrim(c: Column) -> Column:
    """Trim all Unicode white space (``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(_SPACES))


def utrimmed(column: Column) -> Column:
    """:func:`utrim` of a column: nearly all cells begin and end with a visible ASCII character and are left alone."""
    first, last = F.ascii(column), F.ascii(F.substring(column, -1, 1))
    return F.when((first > 32) & (first < 127) & (last > 32) & (last < 127), column).otherwise(utrim(column))


def clip(c: Column, limit: int = 120) -> Column:
    """At most ``limit`` characters, with an ellipsis for the rest."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def as_int(c: Column) -> Column:
    """64-bit integer: an optional sign and digits, nothing around them."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def as_float(c: Column) -> Column:
    """Double: decimal or scientific notation, inf or nan; nothing around it."""
    return F.when(c.rlike(_FLOAT), F.coalesce(c.try_cast("double"), F.lit(float("nan"))))  # the cast knows inf and nan, but no signed nan


def finite(c: Column) -> Column:
    """The value, or null if it is nan or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def first_non_empty(*columns: Column) -> Column:
    """The first that is neither null nor empty; else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def md_escape(c: Column, limit: int = 200) -> Column:
    """One Markdown table cell: clipped, on one line, with its marks escaped."""
    flat = F.regexp_replace(clip(c, limit), r"[\r\n]+", " ")
    return F.regexp_replace(flat, r"([\\`*_\[\]<>|])", r"\\$1")


def html_escape(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_id(c: Column) -> Column:
    """True for ids that may name a file."""
    return c.rlike(r"^[A-Za-z0-9_\-][A-Za-z0-9._\-]*$")


def safe_member(c: Column) -> Column:
    """True for archive members that stay inside the archive's folder."""
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    return (c != "") & ~c.startswith("/") & ~c.rlike("^[A-Za-z]:") & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def slug(c: Column) -> Column:
    """Lower-case words joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
