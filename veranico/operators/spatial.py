"""Grids and regions: nearest neighbours, zonal means with a nearest fallback, named regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veranico.functions.text import clean_number
from veranico.operators.proximity import points_in_regions
from veranico.operators.timestamps import MONTHS
from veranico.session import cut, null_if_nan


def nearest(points: DataFrame, others: DataFrame, *, start_deg: float | None = None, farthest_deg: float = 512.0, per_tile: int = 64, rows_per_salt: int = 100_000) -> DataFrame:
    """(key, near, degrees): for each point (key, y, x) the nearest other (key, y, x), by Euclidean degrees; ties go to the smaller key.

    Points search the tiles around them; those without a hit within the reach
    search again with twice the reach, so dense areas never meet far ones. The
    first reach is the largest at which no tile holds more than ``per_tile`` of
    the others, down to a thousandth of a degree, unless ``start_deg`` gives
    it; tiles with many points are split by a measured number of salts.
    Points without coordinates, and all points if there are no others, give no
    rows.
    """
    left = cut(points.filter("x is not null and y is not null").select("key", "y", "x"))
    there = cut(others.filter("x is not null and y is not null").select(F.col("key").alias("near"), F.col("y").alias("ny"), F.col("x").alias("nx")))
    out, reach = None, start_deg or 0.512
    at = lambda r: [F.floor(F.col("ny") / r), F.floor(F.col("nx") / r)]
    while start_deg is None and reach > 0.002 and not there.groupBy(*at(reach)).count().filter(F.col("count") > per_tile).isEmpty():
        reach /= 2
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    while reach <= farthest_deg and not left.isEmpty():
        tile = lambda v: F.floor(F.col(v) / reach)  # noqa: E731, B023
        a = left.withColumn("s", around).select("key", "y", "x", (tile("y") + F.col("s.a")).alias("ty"), (tile("x") + F.col("s.b")).alias("tx"))
        b = there.select("near", "ny", "nx", tile("ny").alias("ty"), tile("nx").alias("tx"))
        # At most points / rows_per_salt tiles.
        hot = a.groupBy("ty", "tx").count().filter(F.col("count") > rows_per_salt).select("ty", "tx", F.ceil(F.col("count") / rows_per_salt).cast("int").alias("salts"))
        salts = F.coalesce("salts", F.lit(1))
        a = a.join(hot, ["ty", "tx"], "left").withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int")).drop("salts")
        b = b.join(hot, ["ty", "tx"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        d = F.sqrt((F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny")) + (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")))
        best = a.join(b, ["ty", "tx", "salt"]).groupBy("key").agg(F.min(F.struct(d.alias("degrees"), "near")).alias("m"))
        hit = cut(best.filter(F.col("m.degrees") <= reach).select("key", "m.near", "m.degrees"))
        out = hit if out is None else out.unionByName(hit)
        left = cut(left.join(hit.select("key"), "key", "left_anti"))
        reach *= 2
    if out is None:
        return left.join(there).limit(0).select("key", "near", F.lit(0.0).alias("degrees"))
    return out


def zonal_means(cells: DataFrame, regions: DataFrame, values: Sequence[str], centres: DataFrame) -> DataFrame:
    """(region, values, n_cells, method): cos-latitude weighted means of the cells (key, y, x, values) within each region.

    Regions (region, ring) without any cell take the values of the cell nearest
    to their centre (key, y, x) and have method = nearest.
    """
    inside = points_in_regions(cells.select("key", "y", "x"), regions).join(cells, "key")
    w = F.cos(F.radians("y"))
    mean = lambda v: F.sum(null_if_nan(v) * w) / F.sum(F.when(null_if_nan(v).isNotNull(), w))
    zonal = inside.groupBy("region").agg(*[mean(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_cells"))
    bare = centres.join(zonal.select(F.col("region").alias("key")), "key", "left_anti")
    fallback = nearest(bare, cells).join(cells.select(F.col("key").alias("near"), *values), "near")
    return zonal.withColumn("method", F.lit("zonal")).unionByName(fallback.select(F.col("key").alias("region"), *values, F.lit(0).cast("long").alias("n_cells"), F.lit("nearest").alias("method")))


def assign_regions(rules: Mapping[str, Column], other: str | None = None) -> Column:
    """The name of the last rule that holds, so later rules override earlier ones."""
    out = F.lit(other)
    for name, holds in rules.items():
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def unpivot_years(df: DataFrame, ids: Sequence[str], prefix: str, value: str) -> DataFrame:
    """(ids, year, value) of columns named prefix + year."""
    years = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    long = df.select(*ids, *years).unpivot(list(ids), years, "__name", value)
    return long.select(*ids, F.substring("__name", len(prefix) + 1, 10).cast("int").alias("year"), value)


def unpivot_months(df: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """(ids, month, value) of columns named by months, Portuguese or English, whole or shortened, in any case; marks of missing values become NULL."""
    named = {c: MONTHS[c.strip().lower()[:3]] for c in df.columns if c not in ids and c.strip().lower()[:3] in MONTHS}
    long = df.select(*ids, *[clean_number(F.col(f"`{c}`").cast("string")).alias(f"m{m}") for c, m in named.items()]).unpivot(list(ids), [f"m{m}" for m in named.values()], "__name", value)
    return long.select(*ids, F.substring("__name", 2, 2).cast("int").alias("month"), value)
