"""Robust trends of short series: Theil-Sen, Mann-Kendall with lag-one correction, leave-one-out envelopes.

A series has one value per step of a short axis (years or months), so its
points are gathered into one bounded array per key and all pairs are formed
inside the row, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veranico.functions.thermo import normal_tail
from veranico.session import null_if_nan


def series(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, pts, n): the points in order of x; NULL and NaN are left out."""
    pts = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), null_if_nan(y).cast("double").alias("y"))))
    return df.filter(F.col(x).isNotNull() & null_if_nan(y).isNotNull()).groupBy(*keys).agg(pts.alias("pts")).withColumn("n", F.size("pts"))


def _pairs(pts: Column, made) -> Column:
    """``made(a, b)`` of every pair with a before b."""
    return F.flatten(F.transform(pts, lambda a, i: F.transform(F.slice(pts, i + 2, F.size(pts)), lambda b: made(a, b))))


def array_median(values: Column) -> Column:
    s = F.sort_array(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def _slope(pts: Column) -> Column:
    return array_median(F.filter(_pairs(pts, lambda a, b: F.when(b["x"] > a["x"], (b["y"] - a["y"]) / (b["x"] - a["x"]))), lambda v: v.isNotNull()))


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str, *, least: int = 20, per: float = 10.0) -> DataFrame:
    """(keys, n, slope, intercept): median of pairwise slopes times ``per``; NULL under ``least`` points."""
    s = series(df, keys, x, y).withColumn("__b", F.when(F.col("n") >= least, _slope(F.col("pts"))))
    mid = lambda f: array_median(F.transform("pts", lambda p: p[f]))
    return s.select(*keys, "n", (F.col("__b") * per).alias("slope"), (mid("y") - F.col("__b") * mid("x")).alias("intercept"))


def _score(pts: Column) -> tuple[Column, Column]:
    """Kendall's S and its variance with ties."""
    s = F.aggregate(_pairs(pts, lambda a, b: F.signum(b["y"] - a["y"])), F.lit(0.0), lambda acc, v: acc + v)
    n = F.size(pts).cast("double")
    ties = F.aggregate(
        F.transform(F.array_distinct(F.transform(pts, lambda p: p["y"])), lambda v: F.size(F.filter(pts, lambda p: p["y"] == v)).cast("double")),
        F.lit(0.0), lambda acc, t: acc + t * (t - 1) * (2 * t + 5),
    )
    return s, (n * (n - 1) * (2 * n + 5) - ties) / 18


def _z(s: Column, var: Column) -> Column:
    return F.when(var > 0, (s - F.signum(s)) / F.sqrt(var))


def mann_kendall(df: DataFrame, keys: Sequence[str], x: str, y: str, *, least: int = 8) -> DataFrame:
    """(keys, n, s, var_s, z, p_value, tau); statistics are NULL under ``least`` points, p and z where the variance is 0."""
    pts = series(df, keys, x, y)
    s, var = _score(F.col("pts"))
    out = pts.withColumn("s", F.when(F.col("n") >= least, s)).withColumn("var_s", F.when(F.col("n") >= least, var))
    z = _z(F.col("s"), F.col("var_s"))
    return out.select(*keys, "n", "s", "var_s", z.alias("z"), normal_tail(z).alias("p_value"), (F.col("s") / (F.col("n") * (F.col("n") - 1) / 2)).alias("tau"))


def _ranks(values: Column) -> Column:
    """Average ranks."""
    return F.transform(values, lambda v: F.size(F.filter(values, lambda u: u < v)) + (F.size(F.filter(values, lambda u: u == v)) + 1) / 2.0)


def _pearson(pairs: Column) -> Column:
    """Correlation of an array of structs (a, b); NULL without scatter."""
    n = F.size(pairs)
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p))
    ma, mb = total(lambda p: p["a"]) / n, total(lambda p: p["b"]) / n
    cov, va, vb = total(lambda p: (p["a"] - ma) * (p["b"] - mb)), total(lambda p: (p["a"] - ma) * (p["a"] - ma)), total(lambda p: (p["b"] - mb) * (p["b"] - mb))
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def conditional_trend(df: DataFrame, keys: Sequence[str], x: str, y: str, *, least: int = 20, per: float = 10.0) -> DataFrame:
    """Trend with a Mann-Kendall test whose variance is corrected where the detrended ranks are autocorrelated.

    Columns: keys, n, slope, ols_slope, lag1, lag1_critical, method (1 corrected, 0 original), var_factor, z, p_value, original_p.
    The correction for lag one is 1 + 2 (n - 3) / n |lag1|, at least 1.
    """
    s = series(df, keys, x, y).filter(F.col("n") >= least).withColumn("b", _slope(F.col("pts")))
    s = s.withColumn("r", _ranks(F.transform("pts", lambda p: p["y"] - F.col("b") * p["x"])))
    lagged = F.transform(F.slice("r", 1, F.size("r") - 1), lambda v, i: F.struct(v.alias("a"), F.get("r", i + 1).alias("b")))
    s = s.withColumn("lag1", _pearson(lagged)).withColumn("lag1_critical", 1.959963985 / F.sqrt("n"))
    score, var = _score(F.col("pts"))
    s = s.withColumn("s", score).withColumn("var_s", var)
    s = s.withColumn("method", F.coalesce((F.abs("lag1") > F.col("lag1_critical")).cast("int"), F.lit(0)))
    s = s.withColumn("var_factor", F.when(F.col("method") == 1, F.greatest(F.lit(1.0), 1 + 2 * (F.col("n") - 3) / F.col("n") * F.abs("lag1"))).otherwise(1.0))
    z = _z(F.col("s"), F.col("var_s") * F.col("var_factor"))
    xy = F.transform("pts", lambda p: F.struct(p["x"].alias("a"), p["y"].alias("b")))
    sx = lambda f: F.aggregate(xy, F.lit(0.0), lambda acc, p: acc + f(p))
    n = F.col("n")
    ols = (n * sx(lambda p: p["a"] * p["b"]) - sx(lambda p: p["a"]) * sx(lambda p: p["b"])) / (n * sx(lambda p: p["a"] * p["a"]) - sx(lambda p: p["a"]) * sx(lambda p: p["a"]))
    return s.select(*keys, "n", (F.col("b") * per).alias("slope"), (ols * per).alias("ols_slope"), "lag1", "lag1_critical", "method", "var_factor", z.alias("z"), normal_tail(z).alias("p_value"), normal_tail(_z(F.col("s"), F.col("var_s"))).alias("original_p"))


def leave_one_out(df: DataFrame, keys: Sequence[str], x: str, y: str, *, least: int = 8, per: float = 10.0) -> DataFrame:
    """(keys, n, slope_min, slope_q25, slope_median, slope_q75, slope_max, slope_range) of the slopes with one point omitted in turn."""
    s = series(df, keys, x, y).filter(F.col("n") > least)
    without = F.transform("pts", lambda p: _slope(F.filter("pts", lambda q: q["x"] != p["x"])) * per)
    s = s.withColumn("b", F.sort_array(without))

    def q(p: float) -> Column:
        at = F.lit(p) * (F.size("b") - 1)
        lo = F.floor(at).cast("int")
        return F.get("b", lo) + (F.coalesce(F.get("b", lo + 1), F.get("b", lo)) - F.get("b", lo)) * (at - lo)

    return s.select(*keys, "n", q(0).alias("slope_min"), q(0.25).alias("slope_q25"), q(0.5).alias("slope_median"), q(0.75).alias("slope_q75"), q(1).alias("slope_max"), (q(1) - q(0)).alias("slope_range"))


def truncated_slopes(df: DataFrame, keys: Sequence[str], x: str, y: str, *, years: int = 5, least: int = 8, per: float = 10.0) -> DataFrame:
    """(keys, n, slope_all, slope_late_start, slope_early_end): slopes of the whole series and without its first or last ``years``; NULL under ``least`` points."""
    s = series(df, keys, x, y).filter(F.col("n") >= least).withColumn("first", F.array_min(F.transform("pts", lambda p: p["x"]))).withColumn("last", F.array_max(F.transform("pts", lambda p: p["x"])))
    parts = {"slope_all": F.col("pts"), "slope_late_start": F.filter("pts", lambda p: p["x"] >= F.col("first") + years), "slope_early_end": F.filter("pts", lambda p: p["x"] <= F.col("last") - years)}
    return s.select(*keys, "n", *[F.when(F.size(pts) >= least, _slope(pts) * per).alias(name) for name, pts in parts.items()])
