"""Whole-archive operations: repair, crop, save; each stages, validates and moves in place."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import notices as N
from .. import spec
from ..feed import Feed
from ..operators import crop as crop_op
from ..operators import repair as repair_op
from ..sources import archive
from .validate import Result, validate, validate_feed


class InvalidFeedError(ValueError):
    """A feed to be saved has errors; ``report`` has them."""

    def __init__(self, result: Result) -> None:
        super().__init__(f"the feed has errors: {sorted({r.code for r in result.notices.where(F.col('severity') == N.ERROR).select('code').distinct().collect()})}")
        self.report = result


@dataclass(frozen=True)
class Outcome:
    path: str
    fixes: DataFrame | None
    remaining: Result


def _budgets(options: dict[str, Any], *, today: bool) -> spec.Budgets:
    if today:
        options.setdefault("reference_date", dt.datetime.now(dt.UTC).date().isoformat())
    return spec.Budgets(**options)


def _whole(feed: Feed) -> None:
    if feed.incomplete:
        raise OSError(f"tables were cut short or refused: {sorted(feed.incomplete)}; raise the budgets first")


def _publish(spark: SparkSession, feed: Feed, source: str | None, output: str, budgets: spec.Budgets, keep: dict[str, bytes]) -> Result:
    """Stage beside the output, validate what was staged, then move it there."""
    if os.path.islink(output):
        raise OSError(f"{output} is a symbolic link")
    if source and os.path.exists(output) and os.path.samefile(source, output):
        raise OSError(f"{output} is the source itself")
    staging = f"{output}.staged.zip"
    try:
        archive.write(feed, staging, source=source, keep=keep)
        result = validate(archive.read(spark, staging, budgets), budgets)
        result.notices.count()
        os.replace(staging, output)
    finally:
        if os.path.exists(staging):
            os.unlink(staging)
    return result


def repair_feed(spark: SparkSession, path: str, output: str, *, strict_compat: bool = False, **options: Any) -> Outcome:
    """Repair an archive into another; incomplete or sampled input is refused."""
    budgets = _budgets(options, today=True)
    feed = archive.read(spark, path, budgets)
    _whole(feed)
    found = validate(feed, budgets)
    done = repair_op.repair(feed, found.notices, strict_compat=strict_compat)
    fixes = done.fixes.persist()
    fixes.count()
    return Outcome(output, fixes, _publish(spark, done.feed, path, output, budgets, archive.extras(path)))


def crop_feed(spark: SparkSession, path: str, output: str, *, box: crop_op.Box | None = None, start_date: str | None = None, end_date: str | None = None, full_trips_only: bool = False, **options: Any) -> Outcome:
    """Crop an archive into another; no reference date is assumed."""
    if box is None and not start_date and not end_date:
        raise ValueError("nothing to crop: give an area or a window of dates")
    budgets = _budgets(options, today=False)
    feed = archive.read(spark, path, budgets)
    _whole(feed)
    cut = crop_op.crop(feed, box=box, start=start_date, end=end_date, full=full_trips_only)
    return Outcome(output, None, _publish(spark, cut, path, output, budgets, archive.extras(path)))


def save(spark: SparkSession, feed: Feed, output: str, *, check: bool = True, **options: Any) -> Result:
    """Write a built or edited feed; with ``check``, errors leave the output as it was."""
    budgets = _budgets(options, today=True)
    staging = f"{output}.staged.zip"
    try:
        archive.write(feed, staging)
        result = validate_feed(spark, staging, **{k: getattr(budgets, k) for k in budgets.__dataclass_fields__})
        if check and result.errors():
            raise InvalidFeedError(result)
        if os.path.islink(output):
            raise OSError(f"{output} is a symbolic link")
        os.replace(staging, output)
    finally:
        if os.path.exists(staging):
            os.unlink(staging)
    return result
