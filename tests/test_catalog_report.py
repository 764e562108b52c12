import hashlib
import json

import pytest

from tests import feeds
from tramline.feed import from_rows
from tramline import spec
from tramline.plans import fetch, report
from tramline.plans.validate import validate
from tramline.sources import catalog


def record(feed_id, **more):
    return {"id": feed_id, "status": "active", "official": True, "provider": "P", "source_info": {"producer_url": f"https://h/{feed_id}.zip"}, "locations": [{"country_code": "FI", "municipality": "Helsinki"}]} | more


def box(west, south, east, north):
    return {"bounding_box": {"minimum_longitude": west, "minimum_latitude": south, "maximum_longitude": east, "maximum_latitude": north}, "hosted_url": "https://h/x.zip"}


class Server:
    """Answers like the catalogue; remembers what it was asked."""

    def __init__(self, feeds_, files, refusals=()):
        self.feeds, self.files, self.refusals, self.asked = feeds_, files, list(refusals), []

    def __call__(self, method, url, headers, body):
        self.asked.append((url, headers.get("Authorization")))
        if url.endswith("/tokens"):
            return 200, {}, json.dumps({"access_token": "T"}).encode()
        if url in self.files:
            return 200, {}, self.files[url]
        if self.refusals:
            return self.refusals.pop(0), {"Retry-After": "0"}, b""
        if "/datasets" in url:
            return 200, {}, (json.dumps([{"id": "d1", "feed_id": "f1", "hosted_url": "https://h/f1.zip", "downloaded_at": "2026-01-01T00:00:00Z", "hash": hashlib.sha256(self.files["https://h/f1.zip"]).hexdigest()}]) if "offset=0" in url else "[]").encode()
        if "/gtfs_feeds?" in url:
            return 200, {}, json.dumps(self.feeds if "offset=0" in url else []).encode()
        return 404, {}, b""


def test_search_and_rank(spark):
    rows = catalog.feeds_of(spark, [record("b", latest_dataset=box(24, 60, 25, 61)), record("a", latest_dataset=box(20, 58, 30, 70)), record("c", official=False), record("d", status="inactive", latest_dataset=box(24, 60, 25, 61))])
    assert [r.id for r in catalog.ranked(rows).collect()] == ["b", "a", "d", "c"]
    assert {r.id for r in catalog.search(rows, area=(24.5, 60.5, 26, 62)).collect()} == {"a", "b"}
    assert {r.id for r in catalog.search(rows, area=(23, 59, 26, 62), enclosure="completely_enclosed", status=None).collect()} == {"b", "d"}
    assert catalog.search(rows, country_code="fi", official_only=True).count() == 2
    with pytest.raises(ValueError, match="enclosure"):
        catalog.search(rows, enclosure="nearby")


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,data_type,status,is_official,provider,location.country_code,location.bounding_box.minimum_latitude,location.bounding_box.maximum_latitude,location.bounding_box.minimum_longitude,location.bounding_box.maximum_longitude,urls.latest\nmdb-1,gtfs,active,True,"A, B",FI,60,61,24,25,https://h/1.zip\nmdb-2,gtfs_rt,active,,C,SE,,,,,\n')
    got = catalog.read_csv(spark, str(tmp_path / "c.csv"))
    assert [(r.id, r.official, r.west, r.provider) for r in catalog.search(got).collect()] == [("mdb-1", True, 24.0, "A, B")]


def test_client(spark, tmp_path):
    server = Server([record(f"f{k}", status="active" if k % 2 else "inactive") for k in range(5)], {"https://h/f1.zip": b"zip"}, refusals=[401, 429])
    client = catalog.Client("https://api", "R", server, wait=lambda s: None)
    assert [r.id for r in client.feeds(spark, area=(24, 60, 25, 61)).collect()] == ["f1", "f3"]
    newest = client.datasets(spark, "f1").first()
    path = client.download(newest.hosted_url, str(tmp_path), "f1", sha256=newest.hash)
    assert client.download(newest.hosted_url, str(tmp_path), "f1", sha256=newest.hash) == path
    assert all(token is None for url, token in server.asked if url.startswith("https://h/"))
    with pytest.raises(catalog.DownloadError):
        client.download("https://h/f1.zip", str(tmp_path), "f1b", sha256="0" * 64)
    with pytest.raises(catalog.DownloadError):
        catalog.safe_id("../x")
    with pytest.raises(catalog.MissingTokenError):
        catalog.Client("https://api", None, server).token()


@pytest.mark.slow
def test_fetch(spark, tmp_path):
    path = feeds.write(tmp_path / "src.zip", feeds.clean())
    data = open(path, "rb").read()
    client = catalog.Client("https://api", "R", Server([record("f1"), record("f9", source_info={})], {"https://h/f1.zip": data}), wait=lambda s: None)
    out = fetch.fetch(spark, client, (24.8, 60.0, 25.1, 60.3), "2026-06-01", modes=["bus"], directory=str(tmp_path))
    assert "f1" in out.feeds and out.reports["f1"]["summary"]["serviceWindow"] == ["20260601", "20260601"]
    none = fetch.fetch(spark, client, (24.8, 60.0, 25.1, 60.3), "2026-06-01", modes=["ferry"], repair=False, directory=str(tmp_path))
    assert none.skipped["f1"] == "serves none of the modes"
    with pytest.raises(ValueError, match="modes"):
        fetch.fetch(spark, client, (0, 0, 1, 1), modes=["rocket"])


def test_report(spark):
    t = feeds.clean()
    t["stops.txt"][0]["stop_lat"] = "x|y"
    result = validate(from_rows(spark, t), spec.Budgets(reference_date="2026-06-01"))
    hosted = {"notices": [{"code": "invalid_float", "severity": "ERROR", "totalNotices": 1}, {"code": "other", "severity": "warning", "totalNotices": 9}]}
    got = report.build_report(result, hosted=hosted, provenance={"feed_id": "f"})
    assert [(g["code"], g["source"]) for g in got["notices"]][0] == ("invalid_float", "both")
    assert got["summary"]["counts"]["errors"] == 1
    parity = report.parity_summary(got, spark)
    assert parity["agreeing"] == ["invalid_float"] and parity["hosted_only"] == ["other"]
    assert "x\\|y" in report.render_markdown(got, spark) and "<table>" in report.render_html(got, spark)
    with pytest.raises(ValueError, match="hosted"):
        report.parity_summary(report.build_report(result), spark)
