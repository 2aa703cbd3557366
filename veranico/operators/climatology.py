"""Resampling with coverage rules, and day-of-year climatologies over a circular window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veranico.functions.thermo import noleap_doy
from veranico.session import null_if_nan


def resample(df: DataFrame, keys: Sequence[str], at: str, values: Mapping[str, Sequence[str]], *, unit: str = "day", shift_hours: Column | float = 0, least: int = 0, required: str | None = None) -> DataFrame:
    """Per key and period: mean, max, min or sum of the values, and how many there were.

    ``values`` maps a column to the aggregates wanted; the result has
    ``{column}_{aggregate}`` and ``n_{column}``. A variable with fewer than
    ``least`` values in a period is NULL there; periods in which ``required``
    has too few are left out. ``shift_hours`` moves times to local time first.
    NULL times are left out; NaN counts as missing.
    """
    shift = shift_hours if isinstance(shift_hours, Column) else F.lit(float(shift_hours))
    us = F.unix_micros(F.col(at).cast("timestamp")) + (shift * 3600000000).cast("long")
    period = F.to_date(F.date_trunc(unit, F.timestamp_micros(us)))
    made = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    aggs = []
    for column, kinds in values.items():
        x = null_if_nan(column)
        n = F.count(x)
        aggs.append(n.alias(f"n_{column}"))
        aggs += [F.when(n >= least, made[k](x)).alias(f"{column}_{k}") for k in kinds]
    out = df.filter(F.col(at).isNotNull()).groupBy(*keys, period.alias("period")).agg(*aggs)
    return out.filter(F.col(f"n_{required}") >= least) if required else out


def annual_mean(df: DataFrame, keys: Sequence[str], day: str, value: str, *, least: int = 300) -> DataFrame:
    """(keys, year, value, n_days): the mean of a year with at least ``least`` values, else NULL."""
    x = null_if_nan(value)
    return df.groupBy(*keys, F.year(day).alias("year")).agg(F.when(F.count(x) >= least, F.avg(x)).alias(value), F.count(x).alias("n_days"))


def monthly_climatology(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """(keys, month, value): the mean over years of monthly means, so a month with many days weighs no more."""
    x = null_if_nan(value)
    monthly = df.groupBy(*keys, F.year(day).alias("year"), F.month(day).alias("month")).agg(F.avg(x).alias(value))
    return monthly.groupBy(*keys, "month").agg(F.avg(value).alias(value))


def _sorted_quantile(sorted_array: Column, p: float) -> Column:
    """Linear quantile of a sorted array."""
    at = F.lit(p) * (F.size(sorted_array) - 1)
    lo = F.floor(at).cast("int")
    a = F.get(sorted_array, lo)
    b = F.coalesce(F.get(sorted_array, lo + 1), a)
    return a + (b - a) * (at - lo)


def doy_quantiles(df: DataFrame, keys: Sequence[str], day: str, value: str, probs: Mapping[str, float], *, window: int = 31) -> DataFrame:
    """(keys, doy, names of ``probs``): quantiles of all values whose day of year is within the circular window."""
    return doy_quantile_table(df, keys, day, {value: probs}, window=window)


def doy_quantile_table(df: DataFrame, keys: Sequence[str], day: str, values: Mapping[str, Mapping[str, float]], *, window: int = 31) -> DataFrame:
    """(keys, doy, names): quantiles of several values over the circular window, in one pass.

    Values are first gathered per key and day of year (one per year), then
    pooled over neighbouring days with a window in which only the edges of the
    year are repeated; nothing is copied once per day of the window. Days of
    year without any value in the window give no row; a variable without one
    gives NULL. 29 February is left out.
    """
    half = window // 2
    names = {v: f"__x{i}" for i, v in enumerate(values)}
    daily = df.select(*keys, noleap_doy(day).alias("doy"), *[null_if_nan(v).cast("double").alias(x) for v, x in names.items()]).filter("doy is not null")
    days = daily.groupBy(*keys, "doy").agg(*[F.collect_list(x).alias(x) for x in names.values()])
    axis = F.explode(F.filter(F.array(F.col("doy"), F.when(F.col("doy") > 365 - half, F.col("doy") - 365), F.when(F.col("doy") <= half, F.col("doy") + 365)), lambda d: d.isNotNull()))
    # Days of the year without a value of their own still get a row from their neighbours.
    wide = days.withColumn("at", axis)
    none = [F.array().cast("array<double>").alias(x) for x in names.values()]
    empty = days.select(*keys).distinct().select(*keys, F.lit(None).cast("int").alias("doy"), *none, F.explode(F.sequence(F.lit(1), F.lit(365))).alias("at"))
    w = Window.partitionBy(*keys).orderBy("at").rangeBetween(-half, half)
    pooled = wide.unionByName(empty).withColumns({x: F.sort_array(F.flatten(F.collect_list(x).over(w))) for x in names.values()})
    some = F.lit(False)
    for x in names.values():
        some = some | (F.size(x) > 0)
    pooled = pooled.filter(F.col("doy").isNull() & some)
    return pooled.select(*keys, F.col("at").alias("doy"), *[_sorted_quantile(F.col(names[v]), p).alias(name) for v, probs in values.items() for name, p in probs.items()])


def doy_moments(df: DataFrame, keys: Sequence[str], day: str, value: str, *, window: int = 31, ddof: int = 0) -> DataFrame:
    """(keys, doy, mean, std, n) over the circular window, from sums per day of year."""
    half = window // 2
    x = null_if_nan(value)
    sums = df.select(*keys, noleap_doy(day).alias("doy"), x.alias("x")).filter("doy is not null and x is not null").groupBy(*keys, "doy").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    near = F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(365)) + 1))
    total = sums.select(*keys, near.alias("doy"), "n", "s", "q").groupBy(*keys, "doy").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("s") * mean) / F.when(F.col("n") > ddof, F.col("n") - ddof)
    return total.select(*keys, "doy", mean.alias("mean"), F.sqrt(F.when(var < 0, 0.0).otherwise(var)).alias("std"), "n")


def coverage(df: DataFrame, keys: Sequence[str], day: str, value: str, *, fraction: float = 0.7, windows: Mapping[str, tuple[int, int]], least_years: Mapping[str, int]) -> DataFrame:
    """Valid years per key in each window of years, and whether every window has enough.

    A year is valid when its share of days with a value reaches ``fraction`` of
    its calendar days.
    """
    yearly = df.groupBy(*keys, F.year(day).alias("year")).agg(F.count(null_if_nan(value)).alias("n"))
    length = F.when(((F.col("year") % 4 == 0) & (F.col("year") % 100 != 0)) | (F.col("year") % 400 == 0), 366).otherwise(365)
    valid = F.col("n") / length >= fraction
    out = yearly.groupBy(*keys).agg(*[F.count_if(valid & F.col("year").between(a, b)).alias(f"n_valid_{name}") for name, (a, b) in windows.items()])
    ok = F.lit(True)
    for name, n in least_years.items():
        ok = ok & (F.col(f"n_valid_{name}") >= n)
    return out.withColumn("selected", ok)
