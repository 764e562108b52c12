"""Distances, boxes and positions along lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: mean Earth radius in metres.
RADIUS_M = 6_371_008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * RADIUS_M)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """True inside the closed box (west, south, east, north)."""
    west, south, east, north = box
    return (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)


def boxes_meet(box: tuple[float, float, float, float], west: Column, south: Column, east: Column, north: Column) -> Column:
    return (west <= box[2]) & (east >= box[0]) & (south <= box[3]) & (north >= box[1])


def box_inside(box: tuple[float, float, float, float], west: Column, south: Column, east: Column, north: Column) -> Column:
    """True if the columns' box lies in the given one."""
    return (west >= box[0]) & (east <= box[2]) & (south >= box[1]) & (north <= box[3])


def box_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.abs(east - west) * F.abs(north - south)


def with_cumulative_m(points: DataFrame, line: list[str], order: list[str], lat: str = "lat", lon: str = "lon", into: str = "along_m") -> DataFrame:
    """``points`` with the metres along each line up to each of its points."""
    w = Window.partitionBy(*line).orderBy(*order)
    step = haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    stepped = points.withColumn(into, F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn(into, F.sum(into).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def planar_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(x, y) metres from (lat0, lon0) on the local tangent plane; within 0.1 % up to 50 km."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * RADIUS_M, F.radians(lat - lat0) * RADIUS_M


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(distance of a point to a segment, fraction along it of the nearest place)."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey), t
