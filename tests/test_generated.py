"""Code that Spark generates for the rules: the JVM interprets methods of over 8000 bytes for every row."""

import contextlib
import io
import re

import pytest

from tramline.functions import text, times
from tramline.operators import conditional, fields, trips
from tramline.plans.star import star_feed

STAR = "/root/testdata/sf0.001"


@pytest.fixture
def compiled(spark):
    """explain() of a query as it is run outside of the tests."""
    own = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)

    def shown(df, mode):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain(mode)
        return out.getvalue()

    yield shown
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(shown: str) -> int:
    return max(map(int, re.findall(r"maxMethodCodeSize:(-?\d+)", shown)))


def test_stop_time_rules_are_compiled_and_sorted_once(spark, compiled):
    (found,) = trips.trip_notices(star_feed(spark, STAR, "stop_times.txt"))
    assert 0 < largest(compiled(found, "codegen")) < 8000
    assert compiled(found, "simple").count(" Sort [") == 1


def test_trimming_and_reading_as_the_format_says(spark):
    spaces = [chr(c) for c in range(1, 0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    values = ["", "a", "a b", "é", *spaces, *[f"{w}x{w}y{w}{w}" for w in spaces], "​z\x1c"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", r"regexp_replace(v, '(?U)^\\s+|\\s+$', '') as wanted")
    assert rows.select("wanted", text.utrim(rows.v).alias("a"), text.utrimmed(rows.v).alias("b")).where("a <> wanted or b <> wanted").count() == 0
    clocks = {"1:00:00": 3600, "+1:+2:+3": 3723, "123:59:59": 446399, "1:60:00": None, "1:00:60": None, "1234:00:00": None, "1:2:03": None, "-1:00:00": None, "1:00:00 ": None, "1:00": None}
    got = spark.createDataFrame([(v,) for v in clocks], "v string")
    assert {r.v: r.s for r in got.select("v", times.as_seconds(got.v).alias("s")).collect()} == clocks
    floats = {"inf": "Infinity", "-Infinity": "-Infinity", "+nan": "NaN", "-NaN": "NaN", "1e400": "Infinity", "1.": "1.0", "1d": None, "+.5e1": "5.0", ".": None}
    got = spark.createDataFrame([(v,) for v in floats], "v string")
    assert {r.v: r.s for r in got.select("v", text.as_float(got.v).cast("string").alias("s")).collect()} == floats


def test_field_rules_are_compiled(spark, compiled):
    for name in ("trips.txt", "stop_times.txt"):
        (found,) = fields.field_notices(star_feed(spark, STAR, name), name)
        assert 0 < largest(compiled(found, "codegen")) < 8000


def test_range_rules_read_each_time_once(spark, compiled):
    (found,) = conditional.ranges(star_feed(spark, STAR, "frequencies.txt"))
    assert compiled(found, "simple").count("RLIKE") == 2
