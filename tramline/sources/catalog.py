"""Feed catalogues: CSV and API records as DataFrames, search, and downloads.

HTTP stays on the driver, behind a transport that tests replace; everything
that selects or ranks is expressions over DataFrames.
"""

from __future__ import annotations

import email.utils
import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text

Box = tuple[float, float, float, float]
FEED_SCHEMA = (
    "id string, data_type string, status string, official boolean, provider string, producer_url string, license_url string, latest_url string, "
    "locations array<struct<country_code:string,subdivision_name:string,municipality:string>>, west double, south double, east double, north double, raw string"
)
DATASET_SCHEMA = "id string, feed_id string, hosted_url string, downloaded_at timestamp, hash string, first_day date, last_day date, report_url string, raw string"
# Statuses of a reply that are tried again, and how often.
RETRIED, TRIES = (429, 500, 502, 503, 504), 3
CSV_SECONDS = 24 * 3600


class MissingTokenError(RuntimeError):
    """The catalogue's API needs a token and none was given."""


class DownloadError(RuntimeError):
    """A download has no address, an unsafe name, or the wrong content."""


Reply = tuple[int, dict[str, str], bytes]
Transport = Callable[[str, str, dict[str, str], bytes | None], Reply]


def http(method: str, url: str, headers: dict[str, str], body: bytes | None) -> Reply:
    request = urllib.request.Request(url, data=body, headers=headers, method=method)  # noqa: S310
    try:
        with urllib.request.urlopen(request, timeout=60) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def bounds(area: Any) -> Box:
    """(west, south, east, north) of a box or of a polygon's (lon, lat) vertices."""
    points = list(area)
    if len(points) == 4 and all(isinstance(p, (int, float)) for p in points):
        west, south, east, north = map(float, points)
    else:
        west, south = (min(float(p[k]) for p in points) for k in (0, 1))
        east, north = (max(float(p[k]) for p in points) for k in (0, 1))
    if not (west <= east and south <= north):
        raise ValueError(f"not a box: {area!r}")
    return west, south, east, north


def safe_id(value: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_\-][A-Za-z0-9._\-]*", value):
        raise DownloadError(f"unsafe id {value!r}")
    return value


def pause(said: str | None, otherwise: float) -> float:
    """Seconds that a Retry-After header asks for: a number, or a date."""
    if not said:
        return otherwise
    try:
        return max(0.0, float(said))
    except ValueError:
        pass
    try:
        return max(0.0, email.utils.parsedate_to_datetime(said).timestamp() - time.time())
    except (TypeError, ValueError):
        return otherwise


@dataclass
class Client:
    """The catalogue's API: tokens, paging, and tries after refusals."""

    base: str
    refresh_token: str | None = None
    transport: Transport = http
    wait: Callable[[float], None] = time.sleep
    csv_url: str | None = None
    _token: str | None = field(default=None, repr=False)

    def token(self) -> str:
        if self.refresh_token is None:
            raise MissingTokenError("this call needs a refresh token")
        if self._token is None:
            status, _, body = self.transport("POST", f"{self.base}/tokens", {"Content-Type": "application/json"}, json.dumps({"refresh_token": self.refresh_token}).encode())
            if status != 200:
                raise MissingTokenError(f"the token was refused ({status})")
            self._token = json.loads(body)["access_token"]
        return self._token

    def get(self, path: str, params: dict[str, Any] | None = None) -> Any:
        """A reply's JSON; one new token after 401, three more tries when busy."""
        query = urllib.parse.urlencode({k: v for k, v in (params or {}).items() if v is not None})
        renewed, tries = False, 0
        while True:
            status, headers, body = self.transport("GET", f"{self.base}{path}" + (f"?{query}" if query else ""), {"Authorization": f"Bearer {self.token()}"}, None)
            if status == 200:
                return json.loads(body)
            if status == 401 and not renewed:
                renewed, self._token = True, None
            elif status in RETRIED and tries < TRIES:
                tries += 1
                self.wait(pause(headers.get("Retry-After"), 2**tries))
            else:
                raise OSError(f"{path}: reply {status}")

    def catalogue(self, folder: str, *, update: bool = False) -> str:
        """The catalogue's CSV, fetched again once the copy in ``folder`` is a day old."""
        if self.csv_url is None:
            raise MissingTokenError("without a refresh token a csv_url is needed")
        path = os.path.join(folder, "catalogue.csv")
        if update or not os.path.exists(path) or time.time() - os.path.getmtime(path) >= CSV_SECONDS:
            status, _, body = self.transport("GET", self.csv_url, {}, None)
            if status != 200:
                raise OSError(f"{self.csv_url}: reply {status}")
            os.makedirs(folder, exist_ok=True)
            with open(f"{path}.part", "wb") as f:
                f.write(body)
            os.replace(f"{path}.part", path)
        return path

    def pages(self, path: str, params: dict[str, Any], limit: int | None, wanted: Callable[[dict[str, Any]], bool] | None = None, size: int = 100) -> Iterator[dict[str, Any]]:
        """Records page by page until ``limit``; without a predicate no page is longer than what is missing."""
        offset, given = 0, 0
        while limit is None or given < limit:
            page = self.get(path, params | {"limit": size if limit is None or wanted else min(size, limit - given), "offset": offset})
            for record in page:
                if (wanted is None or wanted(record)) and (limit is None or given < limit):
                    given += 1
                    yield record
            offset += len(page)
            if not page:
                return

    def feeds(self, spark: SparkSession, *, area: Any = None, enclosure: str = "partially_enclosed", country_code: str | None = None, subdivision: str | None = None, municipality: str | None = None, status: str | None = "active", official_only: bool = False, limit: int | None = 100) -> DataFrame:
        """Search; area, country, subdivision, municipality and official go to the API, status is looked at here."""
        if enclosure not in ("partially_enclosed", "completely_enclosed"):
            raise ValueError(f"unknown enclosure {enclosure!r}")
        params: dict[str, Any] = {"country_code": country_code, "subdivision_name": subdivision, "municipality": municipality, "is_official": "true" if official_only else None}
        if area is not None:
            west, south, east, north = bounds(area)
            params |= {"dataset_latitudes": f"{south},{north}", "dataset_longitudes": f"{west},{east}", "bounding_filter_method": enclosure}
        wanted = None if status is None else lambda r: r.get("status") == status
        return feeds_of(spark, list(self.pages("/gtfs_feeds", params, limit, wanted)))

    def feed(self, spark: SparkSession, feed_id: str) -> DataFrame:
        return feeds_of(spark, [self.get(f"/gtfs_feeds/{safe_id(feed_id)}")])

    def datasets(self, spark: SparkSession, feed_id: str, *, limit: int | None = 100) -> DataFrame:
        """Datasets of a feed, newest first."""
        return newest_first(datasets_of(spark, list(self.pages(f"/gtfs_feeds/{safe_id(feed_id)}/datasets", {}, limit))))

    def report(self, url: str | None) -> dict[str, Any] | None:
        """A hosted validation report, if there is one; the token never leaves for other hosts."""
        if not url:
            return None
        status, _, body = self.transport("GET", url, {}, None)
        return json.loads(body) if status == 200 else None

    def download(self, url: str | None, folder: str, name: str, *, sha256: str | None = None, provenance: dict[str, Any] | None = None) -> str:
        """A file by its digest: kept if it is already there and right, else fetched, checked and moved in place."""
        if not url:
            raise DownloadError(f"{name} has no address")
        path = os.path.join(folder, f"{safe_id(name)}.zip")
        if sha256 and os.path.exists(path) and file_digest(path) == sha256:
            return path
        os.makedirs(folder, exist_ok=True)
        status, _, body = self.transport("GET", url, {}, None)
        if status != 200:
            raise DownloadError(f"{url}: reply {status}")
        with open(f"{path}.part", "wb") as f:
            f.write(body)
        got = file_digest(f"{path}.part")
        if sha256 and got != sha256:
            os.unlink(f"{path}.part")
            raise DownloadError(f"{url}: the content has another checksum")
        os.replace(f"{path}.part", path)
        with open(f"{path}.json", "w") as f:
            json.dump({"url": url, "sha256": got, **(provenance or {})}, f, indent=1, sort_keys=True)
        return path


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _feed_row(r: dict[str, Any]) -> tuple:
    source, box = r.get("source_info") or {}, ((r.get("latest_dataset") or {}).get("bounding_box") or {})
    places = [{k: p.get(k) for k in ("country_code", "subdivision_name", "municipality")} for p in r.get("locations") or []]
    sides = [None if box.get(k) is None else float(box[k]) for k in ("minimum_longitude", "minimum_latitude", "maximum_longitude", "maximum_latitude")]
    return (r["id"], r.get("data_type", "gtfs"), r.get("status"), r.get("official"), r.get("provider"), source.get("producer_url"), source.get("license_url"), (r.get("latest_dataset") or {}).get("hosted_url"), places, *sides, json.dumps(r, sort_keys=True))


def feeds_of(spark: SparkSession, records: Sequence[dict[str, Any]]) -> DataFrame:
    return spark.createDataFrame([_feed_row(r) for r in records], FEED_SCHEMA)


def datasets_of(spark: SparkSession, records: Sequence[dict[str, Any]]) -> DataFrame:
    rows = [(r["id"], r.get("feed_id"), r.get("hosted_url"), r.get("downloaded_at"), r.get("hash"), r.get("service_date_range_start"), r.get("service_date_range_end"), (r.get("validation_report") or {}).get("url_json"), json.dumps(r, sort_keys=True)) for r in records]
    raw = spark.createDataFrame(rows, "id string, feed_id string, hosted_url string, at string, hash string, a string, b string, report_url string, raw string")
    return raw.select("id", "feed_id", "hosted_url", F.try_to_timestamp("at").alias("downloaded_at"), "hash", F.substring("a", 1, 10).try_cast("date").alias("first_day"), F.substring("b", 1, 10).try_cast("date").alias("last_day"), "report_url", "raw")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue's CSV; older files name some columns otherwise."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    known = {c.lower(): f"`{c}`" for c in raw.columns}

    def cell(*names: str) -> Column:
        own = [F.col(known[n]) for n in names if n in known]
        return F.nullif(text.first_non_empty(*own), F.lit("")) if own else F.lit(None).cast("string")

    def side(name: str) -> Column:
        return cell(f"location.bounding_box.{name}", f"bounding_box.{name}", name).try_cast("double")

    place = F.struct(cell("location.country_code", "country_code").alias("country_code"), cell("location.subdivision_name", "subdivision_name").alias("subdivision_name"), cell("location.municipality", "municipality").alias("municipality"))
    return raw.select(
        cell("id", "mdb_source_id").alias("id"), cell("data_type").alias("data_type"), cell("status").alias("status"), (F.lower(cell("is_official", "official")) == "true").alias("official"), cell("provider").alias("provider"),
        cell("urls.direct_download", "direct_download").alias("producer_url"), cell("urls.license", "license").alias("license_url"), cell("urls.latest", "latest").alias("latest_url"), F.array(place).alias("locations"),
        side("minimum_longitude").alias("west"), side("minimum_latitude").alias("south"), side("maximum_longitude").alias("east"), side("maximum_latitude").alias("north"), F.lit(None).cast("string").alias("raw"),
    )


def _says(value: str) -> Callable[[Column], Column]:
    return lambda place: F.lower(place) == value.lower()


def search(feeds: DataFrame, *, area: Any = None, enclosure: str = "partially_enclosed", country_code: str | None = None, subdivision: str | None = None, municipality: str | None = None, status: str | None = "active", official_only: bool = False, limit: int | None = 100) -> DataFrame:
    """The first ``limit`` static schedule feeds that match, by id; text is compared without regard to case, boundaries count as inside."""
    if enclosure not in ("partially_enclosed", "completely_enclosed"):
        raise ValueError(f"unknown enclosure {enclosure!r}")
    out = feeds.where(F.col("data_type") == "gtfs")
    for name, value in (("country_code", country_code), ("subdivision_name", subdivision), ("municipality", municipality)):
        if value is not None:
            out = out.where(F.exists(F.col(f"locations.{name}"), _says(value)))
    out = out if status is None else out.where(F.lower(F.coalesce("status", F.lit(""))) == status.lower())
    out = out.where("official") if official_only else out
    if area is not None:
        sides = [F.col(c) for c in ("west", "south", "east", "north")]
        out = out.where(geo.boxes_meet(bounds(area), *sides) if enclosure == "partially_enclosed" else geo.box_inside(bounds(area), *sides))
    return out if limit is None else out.orderBy("id").limit(limit)


def ranked(feeds: DataFrame) -> DataFrame:
    """Official first, then active, then of known extent, then the smaller extent, then by id."""
    area = geo.box_area(F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    return feeds.orderBy(F.coalesce("official", F.lit(False)).desc(), F.coalesce(F.col("status") == "active", F.lit(False)).desc(), area.isNull(), area, "id")


def newest_first(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.desc_nulls_last("downloaded_at"), "id")


def dataset_for(datasets: DataFrame, day: str) -> DataFrame:
    """The newest dataset whose service covers the day (unknown ends cover)."""
    covered = (F.col("first_day").isNull() | (F.col("first_day") <= F.lit(day).cast("date"))) & (F.col("last_day").isNull() | (F.col("last_day") >= F.lit(day).cast("date")))
    return newest_first(datasets.where(covered)).limit(1)


def smallest_cover(extracts: DataFrame, area: Any) -> DataFrame:
    """The smallest extract(id, west, south, east, north, ...) that holds the area."""
    west, south, east, north = bounds(area)
    holds = (F.col("west") <= west) & (F.col("south") <= south) & (F.col("east") >= east) & (F.col("north") >= north)
    return extracts.where(holds).orderBy(geo.box_area(F.col("west"), F.col("south"), F.col("east"), F.col("north")), "id").limit(1)
