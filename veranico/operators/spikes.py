"""Implausible readings per source: limits, stuck values, and spikes by peaks over threshold.

The seasonal residual of a reading is its distance from the nearest of three
running medians of its series, before, after and around it, which follow
seasons and lasting shifts; at the ends of a series also from the median of
the one side extended along its slope. Residuals beyond a high quantile of
their series are excesses, to which a generalised Pareto distribution is
fitted: its shape per variable, from the quartiles of the excesses in units of
each series' scatter, and its scale per series, from the series' own median
excess drawn towards the variable's as far as the series has few excesses.
Medians and quartiles keep spikes out of the fit. The fitted tail gives each
series the cutoff that a reading exceeds at a fixed risk.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veranico.session import cut


#: Standard error of the quartile estimate of the shape, times the root of the number of excesses, for an exponential tail.
SHAPE_ERROR = 3.6


def _median(values):
    s = F.sort_array(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def flag_spikes(
    df: DataFrame,
    limits: DataFrame,
    *,
    key: str,
    series: list[str],
    order: str,
    value: str,
    variable: str,
    half_window: int = 7,
    scatters: float = 7.0,
    risk: float = 1e-5,
    tail: float = 0.8,
    prior: float = 50.0,
    stuck: int = 6,
) -> DataFrame:
    """One row per reading that isn't NULL or NaN: its flags and what they rest on.

    Columns: key, the series columns, residual, scatter, tail_cutoff,
    impossible (outside the variable's range in ``limits``), is_stuck (one of
    ``stuck`` or more successive equal readings of its series) and is_spike
    (beyond the tail cutoff of its series at ``risk``, and no less than
    ``scatters`` times its usual scatter away, the least that counts as a
    spike). Excesses are residuals beyond the quantile ``tail`` of their
    series; the variable's scale counts as ``prior`` excesses beside the
    series' own. The shape is taken two standard errors low, as few excesses
    don't tell it, and not below 0, as noise has no known bound.
    The running medians cover ``half_window`` readings on a side; impossible
    readings take no part in them or in the fit. A NULL series column is a
    series of its own, and so is a NULL variable; a variable without limits has
    none; repeated rows count each. A series of equal values has scatter 0 and
    no spikes unless a value differs. An empty table gives no rows. Series are
    bounded by their dates (one reading per date), so a window never holds a
    whole source with all series.
    """
    names = [f"__s{i}" for i in range(len(series))]
    base = df.select(F.col(f"`{key}`").alias("__k"), *[F.col(f"`{s}`").alias(n) for s, n in zip(series, names)], F.col(f"`{variable}`").alias("__v"), F.col(f"`{order}`").alias("__o"), F.col(f"`{value}`").cast("double").alias("__x"))
    base = base.filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    lim = F.broadcast(limits.groupBy(F.col("variable").alias("__lv")).agg(F.max("low").alias("__low"), F.min("high").alias("__high")))  # one row per variable
    base = base.join(lim, F.col("__v") == F.col("__lv"), "left").withColumn("impossible", F.coalesce((F.col("__x") < F.col("__low")) | (F.col("__x") > F.col("__high")), F.lit(False)))
    w = Window.partitionBy(*names).orderBy("__o", "__k")
    before, after = w.rowsBetween(-2 * half_window, -1), w.rowsBetween(1, 2 * half_window)
    # Runs of equal values: a run starts where the value changes.
    marked = base.withColumn("__new", F.coalesce((F.lag("__x").over(w) != F.col("__x")).cast("int"), F.lit(1)))
    good = F.when(~F.col("impossible"), F.col("__x"))
    marked = marked.withColumn("__run", F.sum("__new").over(w)).withColumn("__before", F.collect_list(good).over(before)).withColumn("__after", F.collect_list(good).over(after))
    own = F.when(good.isNotNull(), F.array(good)).otherwise(F.array().cast("array<double>"))
    # The nearer and the farther half of each side, nearest reading first.
    sides = {"b": F.reverse("__before"), "a": F.col("__after")}
    marked = marked.withColumns({f"__{n}{k}": F.slice(side, 1 + k * half_window, half_window) for n, side in sides.items() for k in (0, 1)})
    marked = marked.withColumns({f"__m{n}{k}": _median(F.col(f"__{n}{k}")) for n in sides for k in (0, 1)})
    # At an end of the series one side is missing; there the other is extended along its slope.
    slope = lambda n, other: F.when(F.size(f"__{other}0") < half_window, F.col(f"__m{n}0") + (F.col(f"__m{n}0") - F.col(f"__m{n}1")) * ((half_window + 1) / 2 / half_window))
    marked = marked.withColumn("__centred", F.col("__x") - _median(F.concat("__b0", own, "__a0")))
    levels = [F.col("__mb0"), F.col("__ma0"), slope("b", "a"), slope("a", "b")]
    tried = F.array(F.col("__centred"), *[F.col("__x") - m for m in levels])
    nearest = F.array_min(F.filter(F.transform(tried, lambda r: F.struct(F.abs(r).alias("size"), r.alias("r"))), lambda p: p["size"].isNotNull()))
    marked = marked.withColumn("residual", nearest["r"])
    # Scatter, threshold and excesses of a series lie in the partition of its window.
    whole = Window.partitionBy(*names)
    size = F.when(~F.col("impossible"), F.abs("__centred"))
    marked = marked.select("__k", *names, "__v", "__x", "impossible", "__run", "residual", (F.percentile(size, 0.5).over(whole) * 1.4826).alias("__mad"), (F.avg(size).over(whole) * 1.2533).alias("__dev"), F.percentile(F.when(~F.col("impossible"), F.abs("residual")), tail).over(whole).alias("__u"))
    # Where over half of the residuals are 0 the mean deviation stands in for the median one.
    marked = marked.withColumn("scatter", F.when(F.col("__mad") > 0, F.col("__mad")).otherwise(F.col("__dev")))
    excess = F.when(~F.col("impossible") & (F.abs("residual") > F.col("__u")), F.abs("residual") - F.col("__u"))
    marked = marked.withColumn("__excess", excess)
    marked = marked.withColumn("__own", F.percentile("__excess", 0.5).over(whole)).withColumn("__ne", F.count("__excess").over(whole))
    marked = marked.withColumn("__len", F.count(F.lit(1)).over(Window.partitionBy(*names, "__run")))
    # Written once: the tail's shape and the result read it.
    marked = cut(marked.select("__k", *names, "__v", "impossible", "residual", "scatter", "__u", "__excess", "__own", "__ne", "__len"))
    # One row per variable, from summaries that combine.
    unit = F.when(F.col("scatter") > 0, F.col("__excess") / F.col("scatter"))
    shape = marked.groupBy(F.col("__v").alias("__sv")).agg(F.percentile_approx(unit, [0.5, 0.75], 10_000).alias("__q"), F.count(unit).alias("__nq"))
    xi = F.greatest(F.lit(0.0), F.log2(F.get("__q", 1) / F.get("__q", 0) - 1) - 2 * SHAPE_ERROR / F.sqrt("__nq"))
    shape = shape.select("__sv", F.get("__q", 0).alias("__mid"), F.when((F.get("__q", 0) > 0) & (F.get("__q", 1) > F.get("__q", 0)), xi).otherwise(0.0).alias("__xi"))
    both = marked.join(F.broadcast(shape), F.col("__v").eqNullSafe(F.col("__sv")), "left")
    median = (F.coalesce("__mid", F.lit(0.0)) * F.col("scatter") * prior + F.coalesce("__own", F.lit(0.0)) * F.col("__ne")) / (prior + F.col("__ne"))
    rate, flat = (1 - tail) / risk, F.col("__xi") < 1e-6
    # The median excess is scale / shape (2^shape - 1), and the cutoff scale / shape (rate^shape - 1) beyond the threshold.
    over = F.when(flat, median * (math.log(rate) / math.log(2))).otherwise(median * (F.pow(F.lit(rate), F.col("__xi")) - 1) / (F.pow(F.lit(2.0), F.col("__xi")) - 1))
    cutoff = F.col("__u") + over
    spike = ~F.col("impossible") & (F.abs("residual") > cutoff) & (F.abs("residual") > F.col("scatter") * scatters)
    return both.select(
        F.col("__k").alias(key), *[F.col(n).alias(s) for s, n in zip(series, names) if s != key], "residual", "scatter", cutoff.alias("tail_cutoff"), "impossible",
        (F.col("__len") >= stuck).alias("is_stuck"), F.coalesce(spike, F.lit(False)).alias("is_spike"),
    )
