"""Reports: local notices merged with a hosted validator's, and how they agree."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import notices as N
from ..functions import text
from .validate import Result

SAMPLES = 50
HOSTED = "code string, severity string, total bigint, samples array<string>"
# Severities in order of gravity.
GRAVITY = ("ERROR", "WARNING", "INFO")


def hosted_groups(spark: SparkSession, report: dict[str, Any]) -> DataFrame:
    """(code, severity, total, samples) of a hosted validator's report."""
    rows = [(g["code"], str(g.get("severity", "INFO")).upper(), int(g.get("totalNotices", 0)), [json.dumps(s, sort_keys=True) for s in g.get("sampleNotices", [])[:SAMPLES]]) for g in report.get("notices", []) if g.get("code") is not None]
    return spark.createDataFrame(rows, HOSTED)


def merged(local: DataFrame, hosted: DataFrame) -> DataFrame:
    """Full outer join of groups(code, severity, total[, samples]) on the code.

    A group that only the hosted side has keeps the hosted total, and a local one of 0.
    """
    a = local.select("code", F.col("severity").alias("severity_a"), F.col("total").alias("total_a"), *([F.col("samples").alias("samples_a")] if "samples" in local.columns else []))
    b = hosted.select("code", F.col("severity").alias("severity_b"), F.col("total").alias("hosted_total"), *([F.col("samples").alias("hosted_samples")] if "samples" in hosted.columns else []))
    source = F.when(F.col("total_a").isNull(), "hosted").when(F.col("hosted_total").isNull(), "local").otherwise("both")
    out = a.join(b, "code", "full_outer").select(
        "code", F.coalesce("severity_a", "severity_b").alias("severity"), source.alias("source"), F.coalesce("total_a", "hosted_total").alias("total"), F.coalesce("total_a", F.lit(0)).alias("local_total"), "hosted_total",
        *([F.coalesce("samples_a", "hosted_samples").alias("samples")] if "samples" in local.columns and "samples" in hosted.columns else []),
    )
    return out


def in_order(groups: DataFrame) -> DataFrame:
    """By severity, then the larger sum of both totals (a hosted-only total counts twice), then code."""
    gravity = F.array_position(F.array(*map(F.lit, GRAVITY)), F.col("severity"))
    return groups.orderBy(F.when(gravity == 0, 4).otherwise(gravity), (F.col("total") + F.coalesce("hosted_total", F.lit(0))).desc(), "code")


def severity_totals(groups: DataFrame) -> DataFrame:
    """(errors, warnings, infos): local totals; groups that only the hosted side has don't count."""
    own = F.col("source") != "hosted"
    return groups.agg(*[F.coalesce(F.sum(F.when(own & (F.col("severity") == s), F.col("total"))), F.lit(0)).alias(n) for s, n in zip(GRAVITY, ("errors", "warnings", "infos"), strict=True)])


def suppressed(notices: DataFrame) -> DataFrame:
    """(suppressed): the sum of what the quotas left out."""
    n = F.coalesce(F.element_at("context", "suppressedCount").try_cast("bigint"), F.lit(0))
    return notices.where(F.col("code") == N.LIMIT).agg(F.coalesce(F.sum(n), F.lit(0)).alias("suppressed"))


def parity(groups: DataFrame) -> DataFrame:
    """(code, bucket, local_total, hosted_total): how far both sides agree on each code."""
    bucket = F.when(F.col("source") == "local", "local_only").when(F.col("source") == "hosted", "hosted_only").when(F.col("local_total") == F.col("hosted_total"), "agreeing").otherwise("count_disagreement")
    return groups.select("code", bucket.alias("bucket"), "local_total", F.coalesce("hosted_total", F.lit(0)).alias("hosted_total"))


def build_report(result: Result, *, hosted: dict[str, Any] | None = None, provenance: dict[str, Any] | None = None) -> dict[str, Any]:
    """The merged report as plain data; groups and samples are small by construction."""
    spark = result.notices.sparkSession
    local = N.by_code(result.notices, SAMPLES)
    groups = merged(local, hosted_groups(spark, hosted or {})).persist()
    counts = severity_totals(groups).first().asDict()
    lost = suppressed(result.notices).first()[0]
    out = []
    for g in in_order(groups).collect():
        row = {"code": g.code, "severity": g.severity, "source": g.source, "totalNotices": g.total, "sampleNotices": [json.loads(s) for s in g.samples or []]}
        row |= {"hostedTotalNotices": g.hosted_total} if g.hosted_total is not None else {}
        row |= {"localTotalNotices": 0} if g.source == "hosted" else {}
        out.append(row)
    summary = {
        "generatedAt": dt.datetime.now(dt.UTC).isoformat(), "counts": counts, "suppressedNotices": lost, "countsAreLowerBounds": lost > 0, "serviceWindow": list(result.service_window) if result.service_window else None,
        "rowCounts": result.row_counts, "provenance": provenance, "hostedReportIncluded": hosted is not None,
    }
    return {"summary": summary, "notices": out}


def parity_summary(report: dict[str, Any], spark: SparkSession) -> dict[str, Any]:
    """Codes by how far the two sides agree; an error without a hosted side."""
    if not report["summary"]["hostedReportIncluded"]:
        raise ValueError("parity needs a report with a hosted side")
    rows = [(g["code"], g["source"], g.get("localTotalNotices", g["totalNotices"]), g.get("hostedTotalNotices")) for g in report["notices"]]
    found = parity(spark.createDataFrame(rows, "code string, source string, local_total bigint, hosted_total bigint")).orderBy("code").collect()
    out: dict[str, Any] = {b: [r.code for r in found if r.bucket == b] for b in ("agreeing", "local_only", "hosted_only")}
    out["count_disagreements"] = [{"code": r.code, "local": r.local_total, "hosted": r.hosted_total} for r in found if r.bucket == "count_disagreement"]
    return out | {"countsAreLowerBounds": report["summary"]["countsAreLowerBounds"]}


def _cells(spark: SparkSession, report: dict[str, Any], escape: Any) -> list[tuple]:
    rows = [(k, g["code"], g["severity"], g["source"], str(g["totalNotices"]), json.dumps(g["sampleNotices"][:1], ensure_ascii=False)) for k, g in enumerate(report["notices"])]
    frame = spark.createDataFrame(rows, "k int, code string, severity string, source string, total string, sample string")
    return [tuple(r)[1:] for r in frame.select("k", *[escape(F.col(c)).alias(c) for c in frame.columns[1:]]).orderBy("k").collect()]


def render_markdown(report: dict[str, Any], spark: SparkSession) -> str:
    """The groups as a Markdown table; cells are escaped and clipped."""
    lines = ["# Feed report", "", *[f"- {k}: {v}" for k, v in report["summary"]["counts"].items()], f"- service window: {report['summary']['serviceWindow']}", "", "| code | severity | source | total | sample |", "| --- | --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {' | '.join(r)} |" for r in _cells(spark, report, text.md_escape)]) + "\n"


def render_html(report: dict[str, Any], spark: SparkSession) -> str:
    """The groups as an HTML table; cells are escaped and clipped."""
    head = "".join(f"<th>{c}</th>" for c in ("code", "severity", "source", "total", "sample"))
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in _cells(spark, report, lambda c: text.html_escape(text.clip(c, 200))))
    counts = ", ".join(f"{k}: {v}" for k, v in report["summary"]["counts"].items())
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Feed report</title></head><body><h1>Feed report</h1><p>{counts}</p><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></body></html>'
