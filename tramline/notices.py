"""Notices: what a rule found, where, and how a file's flood is cut.

A notice has the file whose quota it counts against, which its context need
not name, and sort keys (pass, csv_row, place) that give the order inside a
stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "stage string, file string, code string, severity string, pass int, csv_row bigint, place int, context map<string,string>"
COLUMNS = ("stage", "file", "code", "severity", "pass", "csv_row", "place", "context")
#: Stages in order; each has quotas of its own.
STAGES = ("read", "keys", "rules", "semantics")
ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
LIMIT = "notice_limit_reached"


def context(**values: Column | str) -> Column:
    """A context map; :func:`emit` leaves out its null values."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")


def notice(code: str, severity: str, *, place: int = 0, **values: Column | str) -> Column:
    """One notice as a struct, to be collected by :func:`emit`."""
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(place).alias("place"), context(**values).alias("context"))


def emit(rows: DataFrame, found: list[Column], *, stage: str, file: str, number: int, csv_row: Column | str = "csv_row") -> DataFrame:
    """One pass over ``rows``: the notices among ``found`` that aren't null."""
    at = F.col(csv_row) if isinstance(csv_row, str) else csv_row
    if len(found) == 1:  # no list to make
        each = rows.select(at.cast("bigint").alias("csv_row"), found[0].alias("n")).where("n is not null")
    else:
        each = rows.select(at.cast("bigint").alias("csv_row"), F.explode(F.array(*found)).alias("n")).where("n is not null")
    said = F.map_filter("n.context", lambda _, v: v.isNotNull())
    return each.select(F.lit(stage).alias("stage"), F.lit(file).alias("file"), "n.code", "n.severity", F.lit(number).alias("pass"), "csv_row", "n.place", said.alias("context"))


def constant(spark: SparkSession, rows: list[tuple[str, str, str, int | None, dict[str, str]]], *, stage: str = "read", number: int = 0) -> DataFrame:
    """Notices that the driver knows: (file, code, severity, csv_row, context)."""
    return spark.createDataFrame([(stage, f, c, s, number, r, k, x) for k, (f, c, s, r, x) in enumerate(rows)], SCHEMA)


def union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    parts = [p.select(*COLUMNS) for p in parts]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], SCHEMA)


#: Notices that no quota holds: facts about headers, files and the feed.
UNSAMPLED = (
    "duplicate_zip_entry", "invalid_input_files_in_subfolder", "unknown_file", "unreadable_file", "empty_file", "empty_column_name", "duplicated_column", "missing_required_column",
    "too_many_rows", "missing_required_file", "missing_calendar_and_calendar_date_files", "missing_recommended_file", "more_than_one_entity", LIMIT,
)


SALTS = 256


def sampled(notices: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` errors and ``cap`` others a stage and file; a summary for the rest.

    Counts come first, pre-aggregated; only the groups over their cap are
    ranked, so a feed without floods never shuffles its notices.
    """
    group = ["stage", "file", "grave"]
    marked = notices.withColumn("grave", F.col("severity") == ERROR).withColumn("free", F.col("code").isin(*UNSAMPLED))
    counted = marked.where("not free").groupBy(*group).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > cap)
    over = marked.join(F.broadcast(counted.select(*group, F.lit(True).alias("over"))), group, "left")
    calm = over.where("free or over is null").select(*COLUMNS)
    order = ["pass", "csv_row", "place", "code"]
    kept = over.where("not free and over").withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    for by in ([*group, "salt"], group):  # a flood is cut in many tasks before one ranks what is left
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= cap)
    kept = kept.select(*COLUMNS)
    lost = F.col("total") - cap
    summary = counted.groupBy("stage", "file").agg(F.sum(lost).alias("lost"), F.max("grave").alias("grave"))
    summary = summary.select(
        "stage", "file", F.lit(LIMIT).alias("code"), F.when(F.col("grave"), ERROR).otherwise(WARNING).alias("severity"), F.lit(99).alias("pass"), F.lit(None).cast("bigint").alias("csv_row"), F.lit(0).alias("place"),
        context(filename=F.col("file"), suppressedCount=F.col("lost")).alias("context"),
    )
    return calm.unionAll(kept).unionAll(summary)


def ordered(notices: DataFrame) -> DataFrame:
    """Notices in the order of stages, passes and records."""
    stage = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return notices.orderBy(stage, "pass", "file", "csv_row", "place", "code")


def by_code(notices: DataFrame, samples: int = 50) -> DataFrame:
    """(code, severity, total, samples): the first severity and at most ``samples`` contexts.

    The samples are a bounded report feature; totals count every notice.
    """
    stage = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    key = F.struct(stage.alias("stage"), "pass", "file", F.coalesce("csv_row", F.lit(0)).alias("csv_row"), "place")
    rank = Window.partitionBy("code").orderBy(key)
    first = notices.withColumn("key", key).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= samples)
    shown = first.groupBy("code").agg(F.min_by("severity", "key").alias("severity"), F.transform(F.array_sort(F.collect_list(F.struct("rank", F.to_json("context").alias("context")))), lambda x: x["context"]).alias("samples"))
    totals = notices.groupBy("code").agg(F.count(F.lit(1)).alias("total"))
    return totals.join(shown, "code").select("code", "severity", "total", "samples")
