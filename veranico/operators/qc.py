"""Range checks of readings, lookups by several spellings of a key, and alignment of grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veranico.session import null_if_nan

# Physical limits of hourly and daily values.
HOURLY_LIMITS = {"tair_c": (-20.0, 50.0), "td_c": (-30.0, 35.0), "rh_pct": (1.0, 100.0), "ws_ms": (0.0, 60.0)}
DAILY_LIMITS = {"tmax": (-20.0, 50.0), "tmin": (-30.0, 40.0), "tmean": (-25.0, 45.0), "twbmax": (-30.0, 40.0), "vpdmean": (0.0, 100.0), "rhmean": (0.0, 100.0)}


def hourly_qc(df: DataFrame, limits: Mapping[str, tuple[float, float]] = HOURLY_LIMITS, *, temperature: str = "tair_c", dewpoint: str = "td_c", slack: float = 0.5) -> DataFrame:
    """Values out of range become NULL, and so does a dew point over ``slack`` above the temperature; rows stay."""
    ok = {c: F.when(null_if_nan(c).between(a, b), null_if_nan(c)) for c, (a, b) in limits.items() if c in df.columns}
    if temperature in ok and dewpoint in ok:
        ok[dewpoint] = F.when(ok[dewpoint] <= F.coalesce(ok[temperature], ok[dewpoint]) + slack, ok[dewpoint])
    return df.withColumns(ok)


def daily_qc(df: DataFrame, limits: Mapping[str, tuple[float, float]] = DAILY_LIMITS, *, high: str = "tmax", low: str = "tmin") -> DataFrame:
    """Values out of range become NULL; on days whose maximum is below the minimum all limited columns do; rows stay."""
    cols = [c for c in limits if c in df.columns]
    broken = F.coalesce(null_if_nan(high) < null_if_nan(low), F.lit(False)) if {high, low} <= set(df.columns) else F.lit(False)
    return df.withColumns({c: F.when(~broken & null_if_nan(c).between(*limits[c]), null_if_nan(c)) for c in cols})


def tolerant_lookup(df: DataFrame, lookup: DataFrame, spellings: Sequence[Column], key: str, row_id: str) -> DataFrame:
    """(row id, key, spelling): the key of ``lookup`` that the first fitting of several spellings finds, and which one; rows without any are left out."""
    tries = df.select(F.col(row_id), F.posexplode(F.array(*spellings)).alias("spelling", "__try")).filter(F.col("__try").isNotNull())
    hit = tries.join(lookup.select(F.col(key).alias("__key")).distinct(), F.col("__try") == F.col("__key"))
    best = hit.groupBy(row_id).agg(F.min(F.struct("spelling", "__key")).alias("b"))
    return best.select(row_id, F.col("b.__key").alias(key), F.col("b.spelling").alias("spelling"))


def require_same_cells(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises if two grids don't have the same cells; nothing is interpolated."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    odd = left.join(right.withColumn("__in", F.lit(1)), key, "full_outer").join(left.withColumn("__here", F.lit(1)), key, "left").filter("__in is null or __here is null")
    if not odd.isEmpty():
        raise ValueError("the grids differ in their cells")
