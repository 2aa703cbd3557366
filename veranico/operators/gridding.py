"""Irregular readings onto a regular grid per source, by local polynomial regression.

Each reading is sent to the grid times within the bandwidth of a compact
kernel (its index is the slot number), and the weighted moments are summed per
source and slot; a local line, or a local mean where the line isn't
determined, is solved from the moments. All of it is column arithmetic and one
keyed aggregation, so a source with very many readings is spread by its slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _neighbours(t: Column, cadence: Column, reach: Column) -> Column:
    """Slots whose distance from the time ``t`` (microseconds) is below ``reach``."""
    step = cadence * 1000000
    return F.sequence(F.floor((t - reach) / step) + 1, F.ceil((t + reach) / step) - 1)


def local_regression_grid(
    readings: DataFrame,
    *,
    source: str,
    at_us: str,
    cadence_s: str,
    value: str,
    counts: str,
    bandwidth: float = 1.5,
    longest_gap_s: int = 30 * 86400,
    least_support: float = 1.0,
) -> DataFrame:
    """A regular series per source: (source, slot_s, estimate, support, n_readings, missing).

    ``readings`` has the source, the time in microseconds, the source's cadence
    in seconds, a value and a boolean ``counts`` telling whether the reading
    may fill its slot. Slots are the multiples of the cadence; a reading fills
    the slot nearest to it (a tie goes to the later slot). The series runs from
    the first to the last filled slot and leaves out stretches between two
    filled slots that are longer than ``longest_gap_s``. A slot that no reading
    fills has ``missing`` true; its estimate stays, with its support, where
    readings within ``bandwidth`` cadences give at least ``least_support``
    (effective number of readings, Kish), else it is NULL.

    Readings with a NULL source, time or cadence, a cadence under 1, or
    ``counts`` not true have no effect; NULL and NaN values fill a slot but
    carry no weight in the estimate. Repeated readings weigh as often as they
    come. No readings give no rows.
    """
    c = F.col("cad")
    step = c * 1000000
    base = readings.select(
        F.col(f"`{source}`").alias("source"), F.col(f"`{at_us}`").cast("long").alias("t"), F.col(f"`{cadence_s}`").cast("long").alias("cad"),
        F.when(~F.isnan(F.col(f"`{value}`").cast("double")), F.col(f"`{value}`").cast("double")).alias("y"), F.col(f"`{counts}`").alias("ok"),
    ).filter("ok and source is not null and t is not null and cad >= 1")
    reach = (step * bandwidth).cast("long")
    near = F.floor((F.col("t") * 2 + step) / (step * 2))
    sent = base.select("source", "cad", "t", "y", near.alias("near"), F.explode(_neighbours(F.col("t"), c, reach)).alias("slot"))
    d = (F.col("t") - F.col("slot") * step) / step  # in cadences
    u = d / bandwidth
    w = F.when(F.col("y").isNotNull(), F.pow(1 - F.pow(F.abs(u), 3), 3)).otherwise(0.0)
    y = F.coalesce("y", F.lit(0.0))
    sent = sent.select("source", "cad", "slot", (F.col("near") == F.col("slot")).alias("fills"), d.alias("d"), w.alias("w"), y.alias("y"))
    moments = sent.groupBy("source", "cad", "slot").agg(
        F.bool_or("fills").alias("filled"), F.count_if("fills").alias("n"),
        F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("d")).alias("s1"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("s2"),
        F.sum(F.col("w") * F.col("y")).alias("b0"), F.sum(F.col("w") * F.col("d") * F.col("y")).alias("b1"), F.sum(F.col("w") * F.col("w")).alias("q"),
    )
    missing = missing_slots(moments.filter("filled").select("source", "cad", "slot"), longest_gap_s)
    marked = moments.select("*", F.lit(False).alias("gap")).unionByName(missing.withColumn("gap", F.lit(True)), allowMissingColumns=True)
    sums = ["s0", "s1", "s2", "b0", "b1", "q", "n"]
    grid = (
        marked.groupBy("source", "cad", "slot")
        .agg(F.bool_or("gap").alias("gap"), F.coalesce(F.bool_or("filled"), F.lit(False)).alias("filled"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums])
        .filter("gap or filled")
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("b0") - F.col("s1") * F.col("b1")) / det
    support = F.when(F.col("q") > 0, F.col("s0") * F.col("s0") / F.col("q")).otherwise(0.0)
    estimate = F.when(support >= least_support - 1e-9, F.when(det > 1e-6 * F.col("s0") * F.col("s0"), line).otherwise(F.col("b0") / F.col("s0")))
    return grid.select("source", (F.col("slot") * F.col("cad")).alias("slot_s"), estimate.alias("estimate"), support.alias("support"), F.col("n").alias("n_readings"), (~F.col("filled")).alias("missing"))


def missing_slots(filled: DataFrame, longest_gap_s: int) -> DataFrame:
    """Slots between two successive filled slots (source, cad, slot) at most ``longest_gap_s`` apart.

    The series is cut into stretches as long as the longest gap; each stretch
    also gets the last filled slot of the stretch before it, so a window holds
    one stretch of one source, never a whole source.
    """
    span = F.greatest(F.lit(1), F.floor(F.lit(longest_gap_s) / F.col("cad")))
    cut = filled.withColumn("part", F.floor(F.col("slot") / span)).withColumn("carried", F.lit(False))
    last = cut.groupBy("source", "cad", "part").agg(F.max("slot").alias("slot")).select("source", "cad", "slot", (F.col("part") + 1).alias("part"), F.lit(True).alias("carried"))
    w = Window.partitionBy("source", "cad", "part").orderBy("slot")
    steps = cut.unionByName(last).withColumn("before", F.lag("slot").over(w)).filter("not carried and before is not null")
    gaps = steps.filter((F.col("slot") - F.col("before") > 1) & ((F.col("slot") - F.col("before")) * F.col("cad") <= longest_gap_s))
    return gaps.select("source", "cad", F.explode(F.sequence(F.col("before") + 1, F.col("slot") - 1)).alias("slot"))
