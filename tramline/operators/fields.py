"""Field-format rules: one pass over each table, no joins."""

from __future__ import annotations

from functools import lru_cache, reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import notices as N
from .. import spec
from ..feed import Feed
from ..functions import text, times

#: Names of all zones, one literal that is split once.
_ZONES = " ".join(sorted(available_timezones()))


def _read(c: spec.ColumnSpec, trimmed: Column) -> Column | None:
    """What a trimmed cell of this kind says, null if it says nothing; None: any text will do."""
    if c.kind == "zone":
        return F.when(F.array_contains(F.split(F.lit(_ZONES), " "), trimmed), trimmed)
    parse = {"date": times.as_date, "time": times.as_seconds, "int": text.as_int, "enum": text.as_int, "float": text.as_float, "lat": text.as_float, "lon": text.as_float}.get(c.kind)
    return parse(trimmed) if parse else None


def broken(c: spec.ColumnSpec, read: Column | None) -> list[tuple[Column, str, str]]:
    """(condition, code, severity) of the rules for a trimmed, non-empty value that was read so."""
    if read is None:
        return []
    code = {"date": "invalid_date", "time": "invalid_time", "zone": "invalid_timezone", "int": "invalid_integer", "enum": "invalid_integer"}.get(c.kind, "invalid_float")
    wrong = [(read.isNull(), code, N.ERROR)]
    if c.kind == "enum":
        return [*wrong, (~read.isin(*c.values), "unexpected_enum_value", N.WARNING)]
    if c.kind == "int":
        out = [read < int(c.least)] if c.least is not None else []
        out += [read > int(c.most)] if c.most is not None else []
        return wrong + ([(reduce(Column.__or__, out), "number_out_of_range", N.ERROR)] if out else [])
    if c.kind in ("float", "lat", "lon"):
        least, most = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0)}.get(c.kind, (c.least, c.most))
        # NaN is above all numbers, so it and the infinities fail the upper or the lower bound.
        inside = (read >= least if least is not None else read > float("-inf")) & (read <= most if most is not None else read < float("inf"))
        return [*wrong, (~inside, "number_out_of_range", N.ERROR)]
    return wrong


def cell_rules(c: spec.ColumnSpec, place: int) -> list[Column]:
    """One cell's rules: a struct of code, severity, place, field and value for each that is broken, else null."""
    value, trimmed = F.col(f"cell {place}"), F.col(f"trimmed {place}")

    def found(condition: Column, code: str, severity: str, k: int) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(place * 8 + k).alias("place"), F.lit(c.name).alias("field"), value.alias("value")))

    out = [found(value == "", "missing_required_field", N.ERROR, 0)] if c.required else []
    out += [found(trimmed != value, "leading_or_trailing_whitespaces", N.WARNING, 1), found(value.contains("\n") | value.contains("\r"), "new_line_in_value", N.WARNING, 2)]
    read = F.col(f"read {place}") if _read(c, trimmed) is not None else None
    return out + [found((trimmed != "") & cond, code, sev, 3 + k) for k, (cond, code, sev) in enumerate(broken(c, read))]


@lru_cache(maxsize=256)
def _rules(application: str, columns: tuple[spec.ColumnSpec, ...], cells: tuple[tuple[int, str], ...]) -> tuple[list[Column], list[Column], list[Column], Column]:
    """Projections of the cells, of them trimmed and of what they say, and the list of their broken rules; made
    once a session: expressions name columns, not tables, and making them is what costs."""
    raw = [F.col(f"`{column}`").alias(f"cell {place}") for place, column in cells]
    trimmed = [text.utrimmed(F.col(f"cell {place}")).alias(f"trimmed {place}") for place, _ in cells]
    said = [(place, _read(c, F.col(f"trimmed {place}"))) for c, (place, _) in zip(columns, cells, strict=True)]
    rules = [rule for c, (place, _) in zip(columns, cells, strict=True) for rule in cell_rules(c, place)]
    return raw, trimmed, [r.alias(f"read {place}") for place, r in said if r is not None], F.array(*rules)


def emit_cells(rows: DataFrame, cells: list[tuple[int, str, spec.ColumnSpec]], file: str) -> DataFrame:
    """The notices of broken rules of the cells (place, column, kind), in one pass.

    Each cell is trimmed and read in a projection of its own and its rules are
    listed over those, so no parser stands in the code more than once: methods
    of over 8000 bytes would be interpreted for every row.
    """
    application = rows.sparkSession.sparkContext.applicationId
    raw, trimmed, read, rules = _rules(application, tuple(c for *_, c in cells), tuple((place, column) for place, column, _ in cells))
    each = rows.select("csv_row", *raw).select("*", *trimmed).select("*", *read).select("csv_row", F.explode(rules).alias("n")).where("n is not null")
    context = N.context(filename=file, csvRowNumber=F.col("csv_row"), fieldName=F.col("n.field"), fieldValue=text.clip(F.col("n.value")))
    return each.select(F.lit("rules").alias("stage"), F.lit(file).alias("file"), "n.code", "n.severity", F.lit(0).alias("pass"), "csv_row", "n.place", context.alias("context"))


def field_notices(feed: Feed, name: str) -> list[DataFrame]:
    """All field rules of one table."""
    known = {c.name: c for c in spec.COLUMNS.get(name, ())}
    table = feed.tables[name]
    stored = [c for c in table.columns if c != "csv_row"]
    cells = [(place, column, known[header]) for place, (header, column) in enumerate(zip(feed.names(name), stored, strict=False)) if header in known]
    return [emit_cells(table, cells, name)] if cells else []


def unknown_columns(feed: Feed, name: str, spark: SparkSession) -> list[DataFrame]:
    """Headers outside the vocabulary of a file that has one."""
    if name not in spec.COLUMNS:
        return []
    known = {c.name for c in spec.COLUMNS[name]}
    odd = [h for h in feed.names(name) if h not in known and h and h.strip() == h]
    return [N.constant(spark, [(name, "unknown_column", N.INFO, None, {"filename": name, "fieldName": h}) for h in odd], stage="rules")] if odd else []
