"""Points in regions by crossing parity, and points within a distance of others.

Edges of the regions are binned into latitude strips and, within a strip, into
longitude tiles from the region's west end to the edge's east end. Each point
lies in one tile; it meets only the edges of its tile, and the edges that a ray
to the east crosses are counted per point and region. An odd count is inside;
a point on an edge is handled explicitly. Tiles with many points are split by a
measured number of salts, so that a crowded area is no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371.0088 km; NULL if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def valid_points(df: DataFrame, key: str, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(key, y, x) of the points inside ``box`` = (lat from, lat to, lon from, lon to); NULL and NaN are left out."""
    y, x = F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double")
    rows = df.select(F.col(f"`{key}`").alias("key"), y.alias("y"), x.alias("x"))
    return rows.filter(F.col("key").isNotNull() & F.col("y").between(box[0], box[1]) & F.col("x").between(box[2], box[3]))


def circles(points: DataFrame, radius_km: float, corners: int = 24, margin: float = 1.02) -> DataFrame:
    """A ring of ``corners`` vertices around each point (key, y, x) that encloses its circle: (region, ring)."""
    r = radius_km / EARTH_KM * margin / math.cos(math.pi / corners)
    lat, lon = F.radians("y"), F.radians("x")

    def vertex(k: Column) -> Column:
        bearing = k * (2 * math.pi / corners)
        la = F.asin(F.sin(lat) * math.cos(r) + F.cos(lat) * math.sin(r) * F.cos(bearing))
        lo = lon + F.atan2(F.sin(bearing) * math.sin(r) * F.cos(lat), F.lit(math.cos(r)) - F.sin(lat) * F.sin(la))
        return F.struct(F.degrees(lo).alias("x"), F.degrees(la).alias("y"))

    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: vertex(k % corners))
    return points.select(F.col("key").alias("region"), ring.alias("ring"))


def rings_from_wkt(df: DataFrame, key: str, wkt: str) -> DataFrame:
    """(region, ring) of POLYGON and MULTIPOLYGON texts, a row for each ring of a region.

    As crossings are counted over all of a region's rings, holes are outside
    and parts inside. Numbers may have exponents, and points a third
    coordinate. Rings of under three vertices, NULL texts and other shapes are left out.
    """
    text = F.upper(F.trim(F.col(f"`{wkt}`")))
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1)
    corner = lambda p: F.transform(F.slice(F.split(F.trim(p), r"\s+"), 1, 2), lambda n: n.try_cast("double"))
    vertex = lambda p: F.struct(F.get(corner(p), 0).alias("x"), F.get(corner(p), 1).alias("y"))
    shapes = df.filter(text.rlike(r"^(MULTI)?POLYGON\b")).select(F.col(f"`{key}`").alias("region"), F.explode(rings).alias("r"))
    out = shapes.select("region", F.filter(F.transform(F.split("r", ","), vertex), lambda v: v["x"].isNotNull() & v["y"].isNotNull()).alias("ring")).filter(F.size("ring") >= 3)
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    return out.select("region", closed.alias("ring"))


def points_in_regions(points: DataFrame, regions: DataFrame, *, tile_deg: float = 0.25, rows_per_salt: int = 100_000) -> DataFrame:
    """Pairs (key, region, on_boundary) of points (key, y, x) and regions (region, ring, one row or more) that hold them.

    Points on an edge or vertex come out with ``on_boundary`` true. Repeated
    keys give one row per key and region; empty inputs give no rows. Keys and
    region ids must not be NULL. Rings with crossing edges follow the even-odd
    rule. Regions may overlap, and a point in several comes out with each.
    """
    # A ray starts at the west end of its own ring, so each ring's crossings come in whole.
    edges = (
        regions.select(
            "region",
            F.array_min(F.transform("ring", lambda v: v["x"])).alias("west"),
            F.explode(F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", i + 1).alias("b")))).alias("e"),
        )
        .select("region", "west", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
        .withColumn("strip", F.explode(F.sequence(F.floor(F.least("y1", "y2") / tile_deg), F.floor(F.greatest("y1", "y2") / tile_deg))))
        .withColumn("tile", F.explode(F.sequence(F.floor(F.col("west") / tile_deg), F.floor(F.greatest("x1", "x2") / tile_deg))))
        .drop("west")
    )
    tiled = points.select("key", "y", "x", F.floor(F.col("y") / tile_deg).alias("strip"), F.floor(F.col("x") / tile_deg).alias("tile"))
    # One row per tile that needs more than one salt: at most points / rows_per_salt rows.
    hot = tiled.groupBy("strip", "tile").count().filter(F.col("count") > rows_per_salt).select("strip", "tile", F.ceil(F.col("count") / rows_per_salt).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    tiled = tiled.join(hot, ["strip", "tile"], "left").withColumn("salt", F.pmod(F.xxhash64("key", "x", "y"), salts).cast("int")).drop("salts")
    # Repeated rows would cross each edge twice; they are dropped in the partitioning that the join uses.
    tiled = tiled.repartition("strip", "tile", "salt").dropDuplicates()
    edges = edges.join(hot, ["strip", "tile"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    met = tiled.join(edges, ["strip", "tile", "salt"])
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
    on_edge = (side == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    crossed = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    met = met.select("key", "region", "x", "y", crossed.alias("crossed"), on_edge.alias("on_edge")).filter("crossed or on_edge")
    # Repeated keys may have points of their own: parity is taken per point, then per key.
    parity = met.groupBy("key", "region", "x", "y").agg(F.count_if("crossed").alias("n"), F.bool_or("on_edge").alias("on_boundary"))
    return parity.filter("n % 2 = 1 or on_boundary").groupBy("key", "region").agg(F.bool_and("on_boundary").alias("on_boundary"))


def pairs_within(points: DataFrame, others: DataFrame, radius_km: float, *, tile_deg: float = 0.25, rows_per_salt: int = 100_000) -> DataFrame:
    """Pairs (key, region, km) of points (key, y, x) at most ``radius_km`` from the others (key, y, x).

    Each of the others becomes a ring that encloses its circle; crossing parity
    finds the points inside, and the exact great-circle distance decides. Both
    points travel in the keys, so no keyed join follows, in which one of the
    others amid a crowd would be a hot group. A key with several points gives a
    row for each pair in reach.
    """
    located = points.select(F.struct("key", "y", "x").alias("key"), "y", "x")
    centred = others.select(F.struct("key", "y", "x").alias("key"), "y", "x")
    inside = points_in_regions(located, circles(centred, radius_km), tile_deg=tile_deg, rows_per_salt=rows_per_salt)
    a, b = F.col("key"), F.col("region")
    km = haversine_km(a["y"], a["x"], b["y"], b["x"])
    return inside.select(a["key"].alias("key"), b["key"].alias("region"), km.alias("km")).filter(F.col("km") <= radius_km)
