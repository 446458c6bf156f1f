"""Points, polygons and radii by grid cell: equi-joins on a cell, never a cross product."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import metres
from .ordering import first_rows


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def polygon_edges(shapes: DataFrame, id_col: str = "district") -> DataFrame:
    """Each ring as edges ``x1, y1, x2, y2``, the last point joined to the first."""
    n = F.size("ring")
    return (shapes.select(id_col, "ring", F.posexplode("ring").alias("pos", "a"))
            .select(id_col, "pos", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"),
                    F.element_at("ring", F.pmod(F.col("pos") + 1, n) + 1).alias("b"))
            .select(id_col, "pos", "x1", "y1", F.col("b.x").alias("x2"), F.col("b.y").alias("y2")))


def check_districts(shapes: DataFrame) -> DataFrame:
    """One row when the district numbers are not 1..N exactly once each."""
    s = shapes.agg(F.count("*").alias("n"), F.count_distinct("district").alias("d"), F.min("district").alias("lo"),
                   F.max("district").alias("hi"))
    return s.where(~((F.col("n") == F.col("d")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))))


def _inside(x: Column, y: Column, ring: Column) -> Column:
    """Crossing parity over a ring, with points on an edge counted as inside."""
    n = F.size(ring)
    edges = F.transform(ring, lambda a, i: F.struct(a.alias("a"), F.element_at(ring, F.pmod(i + 1, n) + 1).alias("b")))

    def on_edge(e: Column) -> Column:
        x1, y1, x2, y2 = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return (((x2 - x1) * (y - y1) == (x - x1) * (y2 - y1)) & x.between(F.least(x1, x2), F.greatest(x1, x2))
                & y.between(F.least(y1, y2), F.greatest(y1, y2)))

    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def point_in_polygon(points: DataFrame, shapes: DataFrame, key: str, cell: float) -> DataFrame:
    """``key, district`` for points in a polygon, boundary included, the lowest number on overlap.

    Distinct coordinates are located once and the answer joined back, so a location shared by many
    points costs one test. Polygons meet points on the cells their box covers.
    """
    c = F.col
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxes = shapes.select("district", "ring",
                          F.explode(F.sequence(_cell(F.array_min(xs), cell), _cell(F.array_max(xs), cell))).alias("_cx"), ys.alias("_ys"))
    boxes = boxes.select("district", "ring", "_cx",
                         F.explode(F.sequence(_cell(F.array_min("_ys"), cell), _cell(F.array_max("_ys"), cell))).alias("_cy"))
    spots = (points.where(c("lon").isNotNull() & c("lat").isNotNull()).select("lon", "lat").distinct()
             .select("lon", "lat", _cell(c("lon"), cell).alias("_cx"), _cell(c("lat"), cell).alias("_cy")))
    hit = (spots.join(boxes, ["_cx", "_cy"]).where(_inside(c("lon"), c("lat"), c("ring")))
           .groupBy("lon", "lat").agg(F.min("district").alias("district")))
    return points.select(key, "lon", "lat").join(hit, ["lon", "lat"]).select(key, "district")


def area_key(district: Column, zip_code: Column) -> Column:
    """District inside, three-digit ZIP outside."""
    return F.coalesce(F.concat(F.lit("D"), district.cast("string")),
                      F.concat(F.lit("Z"), F.coalesce(F.substring(zip_code, 1, 3), F.lit("NA"))))


def nearby(places: DataFrame, key: str, radius_m: float, n: int, levels: int = 10) -> DataFrame:
    """The ``n`` nearest other places within ``radius_m`` of each place, nearest first, ties by id.

    Places at the same coordinates are one spot that offers its ``n + 1`` lowest ids. A spot looks
    for neighbours in the 3 x 3 cells around it, at the finest grid that is still exact: when its own
    cell of side s holds more than ``n`` places, the answer lies within s * sqrt(2), so the grid of
    side 2 s is enough and a crowded cell is never paired with itself at the full radius.
    """
    c = F.col
    step_y = radius_m / 110540.0
    # One longitude step that is at least the radius at every latitude up to 75 degrees.
    step_x = radius_m / (111320.0 * 0.258)
    held = first_rows(places.select(key, "lon", "lat"), ["lon", "lat"], [c(key)], n + 1)
    spots = places.groupBy("lon", "lat").agg(F.count("*").alias("_size"))
    all_levels = F.explode(F.array(*[F.lit(i) for i in range(levels + 1)])).alias("_lv")
    scale = F.pow(F.lit(2.0), c("_lv"))
    celled = (spots.select("*", all_levels)
              .select("*", F.floor(c("lon") / F.lit(step_x) * scale).cast("long").alias("_cx"),
                      F.floor(c("lat") / F.lit(step_y) * scale).cast("long").alias("_cy")))
    full = (celled.groupBy("_lv", "_cx", "_cy").agg(F.sum("_size").alias("_in_cell"))
            .where(c("_in_cell") > n).drop("_in_cell"))
    best = celled.join(full, ["_lv", "_cx", "_cy"], "left_semi").groupBy("lon", "lat").agg(F.max("_lv").alias("_fine"))
    # A cell is up to 3.9 times wider than it is high, so its diagonal is at most 4.1 heights: three levels up is enough.
    look = spots.join(best, ["lon", "lat"], "left").select(
        "lon", "lat", F.greatest(F.coalesce(c("_fine") - 3, F.lit(0)), F.lit(0)).alias("_lv"))
    look = look.select("*", F.floor(c("lon") / F.lit(step_x) * scale).cast("long").alias("_x"),
                       F.floor(c("lat") / F.lit(step_y) * scale).cast("long").alias("_y"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    look = look.select("lon", "lat", "_lv", "_x", "_y", F.explode(around).alias("_dx"))
    look = look.select("lon", "lat", "_lv", (c("_x") + c("_dx")).alias("_cx"), "_y", F.explode(around).alias("_dy"))
    look = look.select("lon", "lat", "_lv", "_cx", (c("_y") + c("_dy")).alias("_cy"))
    wanted = look.select("_lv").distinct()
    there = (celled.join(wanted, "_lv", "left_semi")
             .select("_lv", "_cx", "_cy", c("lon").alias("lon_b"), c("lat").alias("lat_b")))
    pairs = look.join(there, ["_lv", "_cx", "_cy"]).select("lon", "lat", "lon_b", "lat_b")
    pairs = pairs.withColumn("meters", metres(c("lon"), c("lat"), c("lon_b"), c("lat_b"))).where(c("meters") <= radius_m)
    other = held.select(c(key).alias("near_id"), c("lon").alias("lon_b"), c("lat").alias("lat_b"))
    near_spots = first_rows(pairs.join(other, ["lon_b", "lat_b"]).select("lon", "lat", "near_id", "meters"),
                            ["lon", "lat"], [c("meters"), c("near_id")], n + 1)
    mine = places.select(key, "lon", "lat").join(near_spots, ["lon", "lat"]).where(c(key) != c("near_id"))
    out = first_rows(mine, [key], [c("meters"), c("near_id")], n)
    return out.select(key, "near_id", "meters")


def neighbour_counts(places: DataFrame, key: str, radius_m: float) -> DataFrame:
    """``key, near``: how many other places lie within ``radius_m``; places without any are left out.

    Places at the same coordinates are one spot with a size, and only spots of neighbouring cells of one radius meet.
    """
    c = F.col
    step_y, step_x = radius_m / 110540.0, radius_m / (111320.0 * 0.258)
    cx, cy = F.floor(c("lon") / F.lit(step_x)).cast("long"), F.floor(c("lat") / F.lit(step_y)).cast("long")
    spots = places.where("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.count("*").alias("size")).withColumns({"_cx": cx, "_cy": cy})
    around = [F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias(n) for n in ("_dx", "_dy")]
    look = spots.select("lon", "lat", "_cx", "_cy", around[0]).select("*", around[1]).select(
        "lon", "lat", (c("_cx") + c("_dx")).alias("_cx"), (c("_cy") + c("_dy")).alias("_cy"))
    there = spots.select("_cx", "_cy", "size", c("lon").alias("lon_b"), c("lat").alias("lat_b"))
    near = (look.join(there, ["_cx", "_cy"]).where(metres(c("lon"), c("lat"), c("lon_b"), c("lat_b")) <= radius_m)
            .groupBy("lon", "lat").agg(F.sum("size").alias("_all")))
    out = places.select(key, "lon", "lat").join(near, ["lon", "lat"]).select(key, (c("_all") - 1).alias("near"))
    return out.where("near > 0")
