"""Persistent events in daily series: runs, states within runs, and their yearly counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veranico.functions.thermo import noleap_index
from veranico.session import join_groups


def islands(df: DataFrame, keys: Sequence[str], day: str, flag: Column, *, also: Sequence[str] = ()) -> DataFrame:
    """The rows where ``flag`` holds, with island (its number) and run_length.

    A run is broken by a false or NULL flag and by a missing day; 28 February
    and 1 March are neighbours. One row per key and day is expected: windows
    hold the days of one key, which the calendar bounds.
    """
    on = df.filter(F.coalesce(flag, F.lit(False))).withColumn("__at", noleap_index(day)).filter("__at is not null")
    rank = F.row_number().over(Window.partitionBy(*keys, *also).orderBy("__at"))
    on = on.withColumn("island", F.col("__at") - rank)
    return on.withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(*keys, *also, "island"))).drop("__at")


def persistent_days(df: DataFrame, keys: Sequence[str], day: str, flag: Column, least: int | Column = 3) -> DataFrame:
    """The rows that belong to a run of at least ``least`` days."""
    return islands(df, keys, day, flag).filter(F.col("run_length") >= least)


def annual_events(df: DataFrame, keys: Sequence[str], day: str, flag: Column, severity: Column, least: int | Column = 3) -> DataFrame:
    """(keys, year, frequency, duration, intensity) of runs of at least ``least`` days.

    An event counts in the year it starts; days and severity count in their own
    year, and only severity above 0 is summed. Years of a key with data but
    without events have zeros.
    """
    runs = persistent_days(df.withColumn("__sev", severity), keys, day, flag, least)
    first = F.min(day).over(Window.partitionBy(*keys, "island"))
    runs = runs.withColumn("__starts", (F.col(day) == first).cast("int"))
    found = runs.groupBy(*keys, F.year(day).alias("year")).agg(
        F.sum("__starts").alias("frequency"), F.count(F.lit(1)).alias("duration"), F.sum(F.when(F.col("__sev") > 0, F.col("__sev")).otherwise(0.0)).alias("intensity")
    )
    years = df.select(*keys, F.year(day).alias("year")).distinct()
    out = join_groups(years, found, [*keys, "year"], "left")
    return out.select(*keys, "year", *[F.coalesce(c, F.lit(z)).alias(c) for c, z in (("frequency", 0), ("duration", 0), ("intensity", 0.0))])


def states(dry: Column, humid: Column) -> Column:
    """The one state of a day of two conditions; NULL conditions count as false."""
    d, h = F.coalesce(dry, F.lit(False)), F.coalesce(humid, F.lit(False))
    return F.when(d & h, "MIXED").when(d, "DRY").when(h, "HUMID").otherwise("NEUTRAL")


def state_episodes(df: DataFrame, keys: Sequence[str], day: str, core: Column, state: Column, least: int = 3) -> DataFrame:
    """(keys, year, state, n_days, episodes): days and runs of each state within persistent core events."""
    inside = persistent_days(df.withColumn("state", state), keys, day, core, least).withColumnRenamed("island", "core_island").drop("run_length")
    runs = islands(inside, [*keys, "core_island"], day, F.lit(True), also=["state"])
    first = F.min(day).over(Window.partitionBy(*keys, "core_island", "state", "island"))
    runs = runs.withColumn("__starts", (F.col(day) == first).cast("int"))
    return runs.groupBy(*keys, F.year(day).alias("year"), "state").agg(F.count(F.lit(1)).alias("n_days"), F.sum("__starts").alias("episodes"))


def sweep(df: DataFrame, scenarios: Mapping[str, tuple[Column, int]], keys: Sequence[str], day: str, severity: Column) -> DataFrame:
    """annual_events of several flags, each with its least run length, in one plan: (scenario, keys, year, ...)."""
    flags = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.coalesce(c, F.lit(False)).alias("on"), F.lit(least).alias("least")) for n, (c, least) in scenarios.items()]))
    each = df.withColumn("__s", flags).withColumn("scenario", F.col("__s.scenario")).withColumn("__on", F.col("__s.on")).withColumn("__least", F.col("__s.least"))
    return annual_events(each, ["scenario", *keys], day, F.col("__on"), severity, F.col("__least"))
