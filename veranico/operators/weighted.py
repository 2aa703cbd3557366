"""Weighted summaries: means, quantiles of three definitions, shares of area, criteria and their overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veranico.session import join_groups, null_if_nan


def _both(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    rows = df.select(*keys, null_if_nan(value).cast("double").alias("v"), null_if_nan(weight).cast("double").alias("w"))
    return rows.filter("v is not null and w > 0")


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys, mean, n) over rows with a value and a weight above 0."""
    return _both(df, keys, value, weight).groupBy(*keys).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"), F.count(F.lit(1)).alias("n"))


def weighted_cdf(df: DataFrame, keys: Sequence[str], value: str, weight: str, *, stretches: int = 256) -> DataFrame:
    """(keys, v, w, upto, total): per distinct value its weight and the weight up to it.

    Equal values are merged first. A group's values are cut into stretches at
    approximate quantiles, so the running sums of a very large group are made
    in many tasks and only the stretch totals are summed together.
    """
    merged = _both(df, keys, value, weight).groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    keys = list(keys)
    edges = merged.groupBy(*keys).agg(F.percentile_approx("v", [i / stretches for i in range(1, stretches)], 1000).alias("edges"))
    cut = join_groups(merged, edges, keys).withColumn("stretch", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    totals = cut.groupBy(*keys, "stretch").agg(F.sum("w").alias("sw"))
    by = Window.partitionBy(*keys)  # at most `stretches` rows per group
    totals = totals.withColumn("before", F.sum("sw").over(by.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("sw").over(by)).drop("sw")
    inner = F.sum("w").over(Window.partitionBy(*keys, "stretch").orderBy("v"))
    return join_groups(cut, totals, [*keys, "stretch"]).select(*keys, "v", "w", (inner + F.coalesce("before", F.lit(0.0))).alias("upto"), "total")


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, probs: Mapping[str, float], *, method: str = "inverted_cdf") -> DataFrame:
    """(keys, names of ``probs``) by one of three definitions.

    ``inverted_cdf``: the first value whose share of weight up to it reaches p.
    ``interp_cdf``: linear between (share up to v, v), held at the ends.
    ``midpoint_interp``: the same with half of the own weight subtracted.
    Equal values are merged. Groups without weight give no rows.
    """
    cdf = weighted_cdf(df, keys, value, weight)
    tolerance = 1e-12
    at = F.col("upto") / F.col("total") if method != "midpoint_interp" else (F.col("upto") - F.col("w") / 2) / F.col("total")
    cdf = cdf.withColumn("c", at)
    if method == "inverted_cdf":
        return cdf.groupBy(*keys).agg(*[F.min(F.when(F.col("c") >= p - tolerance, F.col("v"))).alias(name) for name, p in probs.items()])
    picks = []
    for name, p in probs.items():
        picks += [F.max(F.when(F.col("c") <= p, F.struct("c", "v"))).alias(f"{name}_lo"), F.min(F.when(F.col("c") > p, F.struct("c", "v"))).alias(f"{name}_hi")]
    found = cdf.groupBy(*keys).agg(*picks)

    def between(name: str, p: float) -> Column:
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * (p - lo["c"]) / (hi["c"] - lo["c"]))

    return found.select(*keys, *[between(name, p).alias(name) for name, p in probs.items()])


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """(keys, names of ``probs``, n): unweighted quantiles, linear between the two values around rank p (n - 1).

    Made from running counts over stretches of distinct values, so neither a
    group nor a whole table is held by one task. Groups without values give no
    rows; without keys one row comes out, with NULLs if there are no values.
    """
    cdf = weighted_cdf(df.select(*keys, null_if_nan(value).cast("double").alias("__x"), F.lit(1.0).alias("__one")), keys, "__x", "__one")
    at = {name: (F.col("total") - 1) * p for name, p in probs.items()}
    picks = []
    for name, r in at.items():
        picks += [F.min(F.when(F.col("upto") >= F.floor(r) + 1, F.col("v"))).alias(f"{name}_lo"), F.min(F.when(F.col("upto") >= F.ceil(r) + 1, F.col("v"))).alias(f"{name}_hi")]
    found = cdf.groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    between = [(F.col(f"{n}_lo") + (F.coalesce(f"{n}_hi", f"{n}_lo") - F.col(f"{n}_lo")) * (r - F.floor(r))).alias(n) for n, r in at.items()]
    return found.select(*keys, *between, F.col("total").cast("long").alias("n"))


def weighted_zscore(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "z") -> DataFrame:
    """Adds ``out``: the value's distance from the weighted mean in weighted population standard deviations.

    Rows without value or weight above 0 get NULL, and take no part; groups without scatter give NULL.
    """
    good = null_if_nan(value).isNotNull() & (null_if_nan(weight) > 0)
    v, w = F.when(good, null_if_nan(value)), F.when(good, null_if_nan(weight))
    stats = df.groupBy(*keys).agg((F.sum(v * w) / F.sum(w)).alias("__m"), (F.sum(v * v * w) / F.sum(w)).alias("__q"))
    joined = join_groups(df, stats, keys)
    var = F.col("__q") - F.col("__m") * F.col("__m")
    return joined.withColumn(out, F.when(var > 1e-12 * F.abs(F.col("__q")), (v - F.col("__m")) / F.sqrt(var))).drop("__m", "__q")


def area_percent(df: DataFrame, keys: Sequence[str], value: str, weight: str, p_value: str | None = None, alpha: float = 0.05) -> DataFrame:
    """(keys, n, q25, q50, q75, iqr, positive, negative[, significant_positive, significant_negative]): percent shares of weight."""
    good = null_if_nan(value).isNotNull() & (null_if_nan(weight) > 0)
    v, w = null_if_nan(value), null_if_nan(weight)
    share = lambda c: F.sum(F.when(c, w).otherwise(0.0)) / F.sum(w) * 100
    aggs = [F.count(F.lit(1)).alias("n"), share(v > 0).alias("positive"), share(v < 0).alias("negative")]
    if p_value:
        sig = F.coalesce(null_if_nan(p_value) < alpha, F.lit(False))
        aggs += [share(sig & (v > 0)).alias("significant_positive"), share(sig & (v < 0)).alias("significant_negative")]
    shares = df.filter(good).groupBy(*keys).agg(*aggs)
    quantiles = weighted_quantiles(df, keys, value, weight, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, method="interp_cdf")
    return join_groups(shares, quantiles, keys).withColumn("iqr", F.col("q75") - F.col("q25"))


def all_and_each(df: DataFrame, key: str, aggs: Sequence[Column], whole: str = "ALL") -> DataFrame:
    """The aggregates of each group and of all rows in one pass; a NULL key is a group named by NULL."""
    return df.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping_id().alias("__g"), *aggs).withColumn(key, F.when(F.col("__g") == 1, F.lit(whole)).otherwise(F.col(key))).drop("__g")


def criteria_shares(df: DataFrame, criteria: Mapping[str, Column], weight: str, primary: str) -> DataFrame:
    """(criterion, n, area, share, jaccard): rows that meet each criterion, and its overlap of weight with the primary one."""
    w = null_if_nan(weight)
    rows = df.select(w.alias("w"), F.coalesce(criteria[primary], F.lit(False)).alias("p"), F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), F.coalesce(c, F.lit(False)).alias("on")) for n, c in criteria.items()])).alias("c")).filter("w > 0")
    on, p = F.col("c.on"), F.col("p")
    total = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    return rows.groupBy(F.col("c.criterion").alias("criterion")).agg(
        F.count_if(on).alias("n"), total(on).alias("area"), (total(on) / F.sum("w")).alias("share"), (total(on & p) / F.when(total(on | p) > 0, total(on | p))).alias("jaccard")
    )


def dominant(df: DataFrame, keys: Sequence[str], category: str, weight: str) -> DataFrame:
    """(keys, category, weight): the category with the largest total; of equal ones the first in order. A NULL category is one too."""
    sums = df.groupBy(*keys, category).agg(F.sum(null_if_nan(weight)).alias("t"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.coalesce("t", F.lit(0.0))).alias("t"), F.col(category).alias("c"))).alias("b"))
    return best.select(*keys, F.col("b.c").alias(category), (-F.col("b.t")).alias(weight))


def conditional_shares(df: DataFrame, keys: Sequence[str], category: str, weight: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(keys, total, {group}, {group}_pct): weight per named set of categories and its percent share, in one pass."""
    w = null_if_nan(weight)
    out = df.groupBy(*keys).agg(F.sum(w).alias("total"), *[F.sum(F.when(F.col(category).isin(*cats), w).otherwise(0.0)).alias(name) for name, cats in groups.items()])
    return out.select("*", *[F.when(F.col("total") > 0, F.col(name) / F.col("total") * 100).alias(f"{name}_pct") for name in groups])
