"""Polygon and radius joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo

from .registry import Tables, query


@query("j7_point_in_polygon", "SELECT business_id, district FROM place WHERE district IS NOT NULL")
def j7(t: Tables):
    return t.districts


@query("j7_points_by_district", "SELECT district, count(*) AS places FROM place GROUP BY 1")
def j7_counts(t: Tables):
    return t.located.groupBy("district").agg(F.count("*").alias("places"))


@query("j8_nearest_places", """SELECT business_id, near_id, round(m, 3) + 0.0 AS meters FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY m, near_id) AS rn FROM (
 SELECT a.business_id, b.business_id AS near_id, sqrt(pow((b.lon - a.lon) * 111320.0::DOUBLE * cos(a.lat * 3.141592653589793::DOUBLE / 180.0::DOUBLE), 2) + pow((b.lat - a.lat) * 110540.0::DOUBLE, 2)) AS m
 FROM place0 a JOIN place0 b ON a.business_id <> b.business_id AND abs(a.lat - b.lat) < 0.008::DOUBLE AND abs(a.lon - b.lon) < 0.02::DOUBLE) WHERE m <= 800) WHERE rn <= 3""")
def j8(t: Tables):
    n = geo.nearby(t.places, "business_id", 800.0, 3)
    return n.select("business_id", "near_id", (F.round("meters", 3) + F.lit(0.0)).alias("meters"))


@query("j8_neighbours_within_500m", """SELECT business_id, count(*) AS near FROM (SELECT a.business_id, sqrt(pow((b.lon - a.lon) * 111320.0::DOUBLE * cos(a.lat * 3.141592653589793::DOUBLE / 180.0::DOUBLE), 2) + pow((b.lat - a.lat) * 110540.0::DOUBLE, 2)) AS m
 FROM place0 a JOIN place0 b ON a.business_id <> b.business_id AND abs(a.lat - b.lat) < 0.008::DOUBLE AND abs(a.lon - b.lon) < 0.02::DOUBLE) WHERE m <= 500 GROUP BY 1""")
def j8_count(t: Tables):
    return geo.neighbour_counts(t.places, "business_id", 500.0)


