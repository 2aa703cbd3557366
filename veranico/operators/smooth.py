"""Smooth curves with bootstrap bands, and neighbourhood filters on grids.

A curve needs only sums of products per group, grid point and block of rows;
rows fall into blocks by the hash of their id. The band resamples whole blocks,
so it costs no further pass over the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veranico.session import null_if_nan, ship


def _rows(df: DataFrame, key: str, row_id: str, x: str, y: str, w: str | None, blocks: int) -> DataFrame:
    ship(df.sparkSession)
    weight = null_if_nan(w).cast("double") if w else F.lit(1.0)
    rows = df.select(F.col(key).alias("key"), null_if_nan(x).cast("double").alias("x"), null_if_nan(y).cast("double").alias("y"), weight.alias("w"), F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int").alias("block"))
    return rows.filter("x is not null and y is not null and w > 0")


def _poisson(reps: int, blocks: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).poisson(1.0, (reps, blocks)).astype(float)


def spline_curve(df: DataFrame, key: str, row_id: str, x: str, y: str, w: str | None = None, *, points: int = 25, blocks: int = 50, reps: int = 300, least: int = 60, seed: int = 42) -> DataFrame:
    """(key, x, fit, low, high): cubic B-spline with three degrees of freedom by weighted least squares, with a block-bootstrap band.

    Without inner knots the basis is the Bernstein basis over the range of x;
    of under five distinct values of x it is a line. Groups under ``least`` rows, or with one value of x, give no rows.
    """
    rows = _rows(df, key, row_id, x, y, w, blocks)
    span = rows.groupBy("key").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"), (F.count_distinct("x") < 5).alias("line")).filter((F.col("n") >= least) & (F.col("x1") > F.col("x0")))
    t = (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    basis = [F.pow(1 - t, F.lit(3)), 3 * t * F.pow(1 - t, F.lit(2)), 3 * t * t * (1 - t), t * t * t]
    joined = rows.join(span, "key").select("key", "block", "x0", "x1", "line", "y", "w", *[b.alias(f"b{i}") for i, b in enumerate(basis)])
    sums = [F.sum(F.col("w") * F.col(f"b{i}") * F.col(f"b{j}")).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)] + [F.sum(F.col("w") * F.col("y") * F.col(f"b{i}")).alias(f"c{i}") for i in range(4)]
    per_block = joined.groupBy("key", "x0", "x1", "line", "block").agg(*sums)  # at most `blocks` rows per group
    kind = df.schema[key].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((blocks, 4, 4))
        c = np.zeros((blocks, 4))
        at = group["block"].to_numpy()
        for i in range(4):
            for j in range(i, 4):
                a[at, i, j] = a[at, j, i] = group[f"a{i}{j}"]
            c[at, i] = group[f"c{i}"]
        t = np.linspace(0, 1, points)
        curve = np.stack([(1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3], axis=1)
        if group["line"].iloc[0]:  # a line's coefficients in this basis
            line = np.array([[1, 0], [2 / 3, 1 / 3], [1 / 3, 2 / 3], [0, 1]])
            a, c, curve = np.einsum("ki,bkl,lj->bij", line, a, line), c @ line, curve @ line
        fit = curve @ np.linalg.lstsq(a.sum(0), c.sum(0), rcond=None)[0]
        draws = [curve @ np.linalg.lstsq(np.tensordot(m, a, 1), m @ c, rcond=None)[0] for m in _poisson(reps, blocks, seed)]
        low, high = np.quantile(draws, [0.025, 0.975], axis=0)
        xs = group["x0"].iloc[0] + t * (group["x1"].iloc[0] - group["x0"].iloc[0])
        return pd.DataFrame({"key": [group["key"].iloc[0]] * points, "x": xs, "fit": fit, "low": low, "high": high})

    return per_block.groupBy("key").applyInPandas(solve, f"key {kind}, x double, fit double, low double, high double").withColumnRenamed("key", key)


def lowess_curve(df: DataFrame, key: str, row_id: str, x: str, y: str, *, frac: float = 0.65, points: int = 25, blocks: int = 50, reps: int = 300, least: int = 10, seed: int = 42) -> DataFrame:
    """(key, x, fit, low, high): locally weighted lines at ``points`` places with one robustness step and a block-bootstrap band.

    The bandwidth at a place is the distance to the nearest ``frac`` of the
    group's rows, from a quantile sketch. Groups under ``least`` rows or with
    one value of x give no rows.
    """
    rows = _rows(df, key, row_id, x, y, None, blocks)
    span = rows.groupBy("key").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.col("x1") > F.col("x0")))
    step = (F.col("x1") - F.col("x0")) / (points - 1)
    places, away = F.sequence(F.lit(0), F.lit(points - 1)), lambda g: F.col("x") - (F.col("x0") + g * step)
    placed = rows.join(span, "key").withColumn("g", F.explode(places)).withColumn("d", away(F.col("g")))
    reach = placed.groupBy("key", "g").agg((F.percentile_approx(F.abs("d"), F.lit(frac), F.lit(10000)) * 1.0000001 + 1e-12).alias("h"))
    u = F.abs("d") / F.col("h")
    kernel = F.pow(1 - F.pow(u, F.lit(3)), F.lit(3))
    reaches = reach.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("g", "h"))).alias("hs"))  # a row per group

    def within(data: DataFrame) -> DataFrame:
        """Each row once per place whose reach holds it."""
        met = F.filter(places, lambda g: F.abs(away(g)) < F.try_element_at("hs", g))
        return data.join(reaches, "key").withColumn("g", F.explode(met)).withColumn("d", away(F.col("g"))).withColumn("h", F.try_element_at("hs", F.col("g"))).drop("hs")

    near = within(rows.join(span, "key")).withColumn("k", kernel)

    def sums(data: DataFrame, *by: str) -> DataFrame:
        k, d, yy = F.col("k"), F.col("d"), F.col("y")
        return data.groupBy("key", "g", "x0", "x1", *by).agg(F.sum(k).alias("s0"), F.sum(k * d).alias("s1"), F.sum(k * d * d).alias("s2"), F.sum(k * yy).alias("t0"), F.sum(k * d * yy).alias("t1"))

    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    value = F.when(det > 1e-12 * F.col("s0") * F.col("s0"), (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).otherwise(F.col("t0") / F.col("s0"))
    first = sums(near).select("key", "g", value.alias("fit")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("g", "fit"))).alias("curve"))
    at = (F.col("x") - F.col("x0")) / step
    lo = F.least(F.floor(at).cast("int"), F.lit(points - 2))
    base = F.try_element_at("curve", lo)
    fitted = base + (F.try_element_at("curve", lo + 1) - base) * (at - lo)
    resid = rows.join(span, "key").join(first, "key").select("key", "block", "x", "y", "x0", "x1", F.abs(F.col("y") - fitted).alias("r"))
    scale = resid.groupBy("key").agg((F.percentile_approx("r", F.lit(0.5), F.lit(10000)) * 6).alias("s"))
    robust = F.when(F.col("s") > 0, F.when(F.col("r") < F.col("s"), F.pow(1 - F.pow(F.col("r") / F.col("s"), F.lit(2)), F.lit(2))).otherwise(0.0)).otherwise(1.0)
    again = within(resid.join(scale, "key").withColumn("q", robust)).withColumn("k", kernel * F.col("q"))
    per_block = sums(again, "block")  # at most points x blocks rows per group
    kind = df.schema[key].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros((5, points, blocks))
        for i, name in enumerate(("s0", "s1", "s2", "t0", "t1")):
            s[i, group["g"], group["block"]] = group[name]

        def curve(m: np.ndarray) -> np.ndarray:
            s0, s1, s2, t0, t1 = s @ m
            det = s0 * s2 - s1 * s1
            with np.errstate(all="ignore"):
                return np.where(det > 1e-12 * s0 * s0, (s2 * t0 - s1 * t1) / det, t0 / s0)

        fit = curve(np.ones(blocks))
        low, high = np.nanquantile([curve(m) for m in _poisson(reps, blocks, seed)], [0.025, 0.975], axis=0)
        xs = np.linspace(group["x0"].iloc[0], group["x1"].iloc[0], points)
        return pd.DataFrame({"key": [group["key"].iloc[0]] * points, "x": xs, "fit": fit, "low": low, "high": high})

    return per_block.groupBy("key").applyInPandas(solve, f"key {kind}, x double, fit double, low double, high double").withColumnRenamed("key", key)


def gaussian_filter(df: DataFrame, iy: str, ix: str, value: str, *, sigma: float = 1.0, reach: int = 3) -> DataFrame:
    """(iy, ix, value): Gaussian mean of a cell's neighbours that have a value; cells without a row get none."""
    shift = F.sequence(F.lit(-reach), F.lit(reach))
    sent = df.filter(null_if_nan(value).isNotNull()).select(F.col(iy).alias("y"), F.col(ix).alias("x"), F.col(value).alias("v")).withColumn("dy", F.explode(shift)).withColumn("dx", F.explode(shift))
    k = F.exp(-(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / (2 * sigma * sigma))
    means = sent.groupBy((F.col("y") + F.col("dy")).alias(iy), (F.col("x") + F.col("dx")).alias(ix)).agg((F.sum(k * F.col("v")) / F.sum(k)).alias(value))
    return means.join(df.select(iy, ix).distinct(), [iy, ix])


def binary_filter(df: DataFrame, iy: str, ix: str, mask: str, *, steps: str = "open") -> DataFrame:
    """(iy, ix, mask): opening (erode, dilate) or closing of a mask over the four neighbours; cells without a row are false."""
    cells = df.select(iy, ix, F.coalesce(mask, F.lit(False)).alias("m"))

    def spread(rows: DataFrame, erode: bool) -> DataFrame:
        on = rows.filter("m").select(iy, ix, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])).alias("s"))
        hits = on.groupBy((F.col(iy) + F.col("s.a")).alias(iy), (F.col(ix) + F.col("s.b")).alias(ix)).agg(F.count(F.lit(1)).alias("c"))
        return rows.select(iy, ix).join(hits, [iy, ix], "left").select(iy, ix, (F.coalesce("c", F.lit(0)) >= (5 if erode else 1)).alias("m"))

    first = steps == "open"
    return spread(spread(cells, first), not first).withColumnRenamed("m", mask)
