"""URL filters with redirect equivalence, in DataFrame functions only.

A url's rule is the longest of those that fit its host (or a parent domain)
and the start of its path.  Urls without a rule take the decision of their
aliases: redirect (meta refresh) and canonical-link edges in the pages' HTML
join urls into components, and a component with a blocked member and no
explicitly allowed one is blocked.  An explicit allow therefore always goes
before a block that only propagates.  Everything else is allowed.

Aliases are told apart by host, path and query; scheme and fragment don't
count.  Relative targets are resolved against the page's url.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule and no aliases, and is allowed; very long urls and pages count whole; null or empty html has no edges; equal
urls on several rows share their decision; rules of equal length: allow goes
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, shared


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """Host, path and query; null where there is no ``://``."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), _query_of(url)))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "allow")):  # the last that fits wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _targets(html: Column) -> Column:
    """Canonical and refresh targets as they stand in the tags."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    href = F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    into = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.filter(F.transform(F.concat(href, into), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&"))), lambda t: t != "")


def _resolved(target: Column, url: Column) -> Column:
    """An absolute url for a target found on the page at ``url``."""
    folder = F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host_of(url), target))
        .when(target.startswith("?"), F.concat(F.lit("http://"), host_of(url), path_of(url), target))
        .when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .otherwise(F.concat(F.lit("http://"), host_of(url), folder, target))
    )


def alias_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): alias keys joined by a redirect or canonical link."""
    hits = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).where(F.col("h").rlike("(?i)canonical|http-equiv") & (F.instr("u", "://") > 0))
    found = hits.select("u", F.explode(_targets(F.col("h"))).alias("t"))
    return found.select(alias_key(F.col("u")).alias("a"), alias_key(_resolved(F.col("t"), F.col("u"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every page."""
    u = F.col("u")
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("u"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"host": host_of(u), "path": path_of(u), "key": alias_key(u)}).withColumns({"rule": rule, "own_verdict": verdict})
    nodes = shared.written(components.connected(alias_edges(pages, url=url, html=html)), "aliases")
    # The targets that are no page themselves are judged by the rules as well.
    _, member_verdict = rule_for(F.col("host"), F.col("path"), rules)
    members = nodes.withColumns({"host": F.regexp_extract("node", r"(?s)^([^/?]*)", 1), "path": F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)})
    members = members.select("component", member_verdict.alias("v"))
    decided = members.groupBy("component").agg(F.max(F.col("v") == "block").alias("blocks"), F.max(F.col("v") == "allow").alias("allows"))
    # Written, so that one component's nodes can be split between tasks in the join.
    decided = shared.written(decided, "decided")
    aliases = nodes.join(decided, "component").select(F.col("node").alias("key"), "component", (F.coalesce("blocks", F.lit(False)) & ~F.coalesce("allows", F.lit(False))).alias("spread"))
    without = own.where("key is null").withColumns({"component": F.lit(None).cast("string"), "spread": F.lit(False)})
    judged = own.where("key is not null").join(aliases, "key", "left").unionByName(without)
    final = F.coalesce("own_verdict", F.when(F.col("spread"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", final.alias("verdict"), "component")
