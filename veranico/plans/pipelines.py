"""Whole analyses as one plan each: gridded regimes, municipal association, station evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veranico.functions import thermo as th
from veranico.operators import climatology as cl
from veranico.operators import events as ev
from veranico.operators import spatial as sp
from veranico.operators import stats as st
from veranico.operators import trends as tr
from veranico.operators import weighted as wt
from veranico.session import cut, join_groups, null_if_nan

# Percentiles of the day of year that the regimes compare with, by variable.
THRESHOLDS = {"tmean": {"tmean_p90": 0.9}, "tmax": {"tmax_p95": 0.95}, "twbmax": {"twbmax_p95": 0.95}, "vpdmean": {"vpdmean_p75": 0.75, "vpdmean_p90": 0.9}, "sm1mean": {"sm1mean_p10": 0.1}, "ws10mean": {"ws10mean_p50": 0.5}}


def thresholds(daily: DataFrame, key: str, day: str, baseline: tuple[int, int], window: int = 31) -> DataFrame:
    """(key, doy, all thresholds): quantiles of the baseline years around each day of year."""
    return cl.doy_quantile_table(daily.filter(F.year(day).between(*baseline)), [key], day, THRESHOLDS, window=window)


def regime_flags() -> dict[str, Column]:
    """Conditions of hot, humid-hot, dry-hot and compound days; missing values make them false."""
    over = lambda v, t: F.coalesce(null_if_nan(v) >= F.col(t), F.lit(False))
    under = lambda v, t: F.coalesce(null_if_nan(v) <= F.col(t), F.lit(False))
    return {
        "HW": over("tmean", "tmean_p90"),
        "HHW": over("twbmax", "twbmax_p95"),
        "DHW": over("tmax", "tmax_p95") & over("vpdmean", "vpdmean_p75"),
        "CHW": over("tmax", "tmax_p95") & over("vpdmean", "vpdmean_p90") & (under("sm1mean", "sm1mean_p10") | under("ws10mean", "ws10mean_p50")),
    }


def flagged_days(daily: DataFrame, key: str, day: str, baseline: tuple[int, int], window: int = 31) -> DataFrame:
    """The daily rows with their thresholds."""
    limits = thresholds(daily, key, day, baseline, window)
    return daily.withColumn("doy", th.noleap_doy(day)).join(limits, [key, "doy"], "left")


def gridded_regimes(daily: DataFrame, key: str, day: str, *, baseline: tuple[int, int] = (1991, 2020), least_run: int = 3, window: int = 31) -> DataFrame:
    """(regime, key, year, frequency, duration, intensity) of the four regimes, in one pass over the flagged days.

    Severity is the excess of the maximum temperature over its threshold, and of the mean for HW.
    """
    days = flagged_days(daily, key, day, baseline, window)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), c.alias("on")) for n, c in regime_flags().items()]))
    long = days.withColumn("r", each).withColumn("regime", F.col("r.regime")).withColumn("on", F.col("r.on"))
    severity = F.when(F.col("regime") == "HW", null_if_nan("tmean") - F.col("tmean_p90")).otherwise(null_if_nan("tmax") - F.col("tmax_p95"))
    return ev.annual_events(long, ["regime", key], day, F.col("on"), severity, least_run)


def regime_trends(annual: DataFrame, key: str, *, least: int = 20) -> DataFrame:
    """(regime, key, metric, trend and test) of the yearly frequency, duration and intensity."""
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("frequency", "duration", "intensity")]))
    long = annual.select("regime", key, "year", metrics.alias("m")).select("regime", key, "year", "m.*")
    return tr.conditional_trend(long, ["regime", key, "metric"], "year", "value", least=least)


def municipal_association(cells: DataFrame, rings: DataFrame, centres: DataFrame, land: DataFrame, *, key: str, values: Sequence[str], predictor: str, weight: str, stratum: str) -> Mapping[str, DataFrame]:
    """Zonal means joined to land metrics, and the tables made of them: municipalities, rank correlations, contrasts, regression."""
    zonal = sp.zonal_means(cells, rings, values, centres).withColumnRenamed("region", key)
    # Written once; every table reads it, and the regression in several passes.
    towns = cut(land.join(zonal, key))
    out = {"municipalities": towns}
    for value in values:
        out[f"spearman_{value}"] = st.weighted_spearman(towns, [stratum], predictor, value, weight)
        out[f"summary_{value}"] = wt.area_percent(towns, [stratum], value, weight)
        out[f"wls_{value}"] = st.wls(towns, value, [predictor], weight, fixed=[stratum])
    return out


def station_evaluation(observed: DataFrame, modelled: DataFrame, *, keys: Sequence[str], day: str, value: str, most_removed: float = 0.03, k: float = 6.0) -> DataFrame:
    """Skill scores per station of daily pairs, after the capped removal of outliers among their differences."""
    pairs = observed.select(*keys, day, F.col(value).alias("o")).join(modelled.select(*keys, day, F.col(value).alias("m")), [*keys, day])
    pairs = pairs.withColumn("d", null_if_nan("m") - null_if_nan("o"))
    bad = st.capped_outliers(pairs, list(keys), day, "d", k=k, most=most_removed).withColumn("bad", F.lit(True)).drop("deviation")
    kept = join_groups(pairs, bad, [*keys, day], "left").filter("bad is null")
    return st.skill_scores(kept, list(keys), "m", "o")
