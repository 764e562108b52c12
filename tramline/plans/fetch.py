"""From an area to validated feeds: search, download, repair, crop, filter, check, report."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import modes as modes_fn
from ..sources import archive, catalog
from . import report, transform
from .validate import validate_feed


@dataclass
class FetchResult:
    feeds: dict[str, str] = field(default_factory=dict)
    reports: dict[str, dict[str, Any]] = field(default_factory=dict)
    repairs: dict[str, DataFrame] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)


def feed_modes(spark: SparkSession, path: str) -> set[str]:
    """Modes that an archive's routes serve."""
    feed = archive.read(spark, path)
    return {r.mode for r in modes_fn.served(feed.select("routes.txt", "route_type")).collect()} if feed.has("routes.txt") else set()


def covers(window: tuple[str, str] | None, day: str | None) -> bool:
    """True if the window has the day; an unknown window has every day."""
    return window is None or day is None or window[0] <= day <= window[1]


def fetch(
    spark: SparkSession, client: catalog.Client, area: Any, when: str | dt.date | None = None, *, modes: Sequence[str] | None = None, repair: bool = False, crop: bool = True, country_code: str | None = None, directory: str = ".", **budgets: Any,
) -> FetchResult:
    """Every matching feed, best first; one that fails is skipped with its reason.

    Without a token the catalogue's CSV is searched, and the latest hosted
    archive of each feed is taken as it stands.
    """
    box = catalog.bounds(area)
    if modes is not None and (odd := set(modes) - set(modes_fn.MODES)):
        raise ValueError(f"unknown modes {sorted(odd)}")
    day = dt.date.fromisoformat(str(when)) if when is not None else None
    if day is not None:
        budgets.setdefault("reference_date", day.isoformat())
    tag = hashlib.sha256(json.dumps([box, str(day), sorted(modes or ()), repair, crop, sorted(budgets.items())], default=str).encode()).hexdigest()[:8]
    out = FetchResult()
    if client.refresh_token is not None:
        matching = client.feeds(spark, area=box, country_code=country_code)
    else:
        matching = catalog.search(catalog.read_csv(spark, client.catalogue(directory)), area=box, country_code=country_code)
    found = catalog.ranked(matching)
    for feed in found.collect():  # a page of a catalogue, not data
        try:
            path = _one(spark, client, feed, box, day, modes, repair, crop, directory, tag, budgets, out)
            if path:
                out.feeds[feed.id] = path
        except (OSError, ValueError, RuntimeError) as e:
            out.skipped[feed.id] = f"{type(e).__name__}: {e}"
    return out


def _one(spark, client, feed, box, day, modes, repair, crop, directory, tag, budgets, out) -> str | None:  # noqa: ANN001, PLR0913
    name = catalog.safe_id(feed.id)
    hosted = provenance = None
    if client.refresh_token is not None and day is not None:
        chosen = catalog.dataset_for(client.datasets(spark, feed.id), day.isoformat()).first()
        if chosen is None:
            out.skipped[feed.id] = "no dataset covers the day"
            return None
        provenance = {"feed_id": feed.id, "dataset_id": chosen.id}
        path = client.download(chosen.hosted_url, directory, f"{name}-{chosen.id}", sha256=chosen.hash, provenance=provenance)
        hosted = client.report(chosen.report_url)
    else:
        provenance = {"feed_id": feed.id}
        path = client.download(feed.latest_url or feed.producer_url, directory, name, provenance=provenance)
    stem = os.path.join(directory, f"{name}-{tag}")
    if repair:
        fixed = transform.repair_feed(spark, path, f"{stem}-repaired.zip", **dict(budgets))
        out.repairs[feed.id], path = fixed.fixes, fixed.path
    if crop:
        window = day.strftime("%Y%m%d") if day else None
        path = transform.crop_feed(spark, path, f"{stem}-cropped.zip", box=box, start_date=window, end_date=window, **dict(budgets)).path
    if modes is not None and not feed_modes(spark, path) & set(modes):
        out.skipped[feed.id] = "serves none of the modes"
        return None
    result = validate_feed(spark, path, **dict(budgets))
    if not covers(result.service_window, day.strftime("%Y%m%d") if day else None):
        out.skipped[feed.id] = "no service on the day"
        return None
    out.reports[feed.id] = report.build_report(result, hosted=hosted, provenance=provenance)
    return path
