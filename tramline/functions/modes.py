"""Route types and the coarse modes they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Route types of each mode, single ones and whole ranges.
MODES: dict[str, tuple[tuple[int, int], ...]] = {
    "tram": ((0, 0), (5, 5), (900, 999)),
    "subway": ((1, 1), (12, 12), (400, 699)),
    "rail": ((2, 2), (100, 199), (300, 399)),
    "bus": ((3, 3), (11, 11), (200, 299), (700, 899)),
    "ferry": ((4, 4), (1000, 1099), (1200, 1299)),
}


def mode_of(route_type: Column) -> Column:
    """The mode of a route type, or null."""
    out = F.lit(None).cast("string")
    for mode, ranges in MODES.items():
        for a, b in ranges:
            out = F.when(route_type.between(a, b), mode).otherwise(out)
    return out


def served(routes: DataFrame, column: str = "route_type") -> DataFrame:
    """(mode): the distinct modes of text route types."""
    return routes.select(mode_of(text.as_int(text.utrim(F.col(column)))).alias("mode")).where("mode is not null").distinct()
