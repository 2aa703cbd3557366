"""Filling containers of fixed capacity by patterns of lengths.

Lengths are integers up to the capacity, so a histogram of lengths is bounded
by the capacity, whatever the corpus. Few-item patterns that fill a container
exactly are enumerated from the histogram, their repeat counts are fitted to it
by non-negative least squares, rounded, and the residual lengths are packed
largest first. Items find their container by their rank among the items of
their length; no item passes through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veranico.session import cut


def exact_fills(lengths: np.ndarray, cost: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest multiset of lengths for each sum up to the capacity: (cost by sum, last length by sum)."""
    best = np.full(capacity + 1, np.inf)
    last = np.zeros(capacity + 1, dtype=np.int64)
    best[0] = 0
    for s in range(1, capacity + 1):
        usable = np.searchsorted(lengths, s, side="right")
        if usable:
            c = best[s - lengths[:usable]] + cost[:usable]
            k = int(np.argmin(c))
            best[s], last[s] = c[k], lengths[k]
    return best, last


def fill_patterns(hist: np.ndarray, capacity: int, rounds: int = 6, seed: int = 7) -> list[dict[int, int]]:
    """Patterns {length: times} that fill a container exactly, few items each, one per length and round.

    A round's costs prefer few items and lengths that are frequent and not yet in many patterns.
    """
    rng = np.random.default_rng(seed)
    lengths = np.flatnonzero(hist[1:]) + 1
    if not len(lengths):
        return []
    used = np.zeros(len(hist))
    seen: dict[tuple, dict[int, int]] = {}
    for _ in range(rounds):
        scarce = (1 + used[lengths]) / hist[lengths]
        cost = 1 + scarce / scarce.mean() * rng.uniform(0.5, 1.5, len(lengths))
        best, last = exact_fills(lengths, cost, capacity)
        for a in lengths:
            rest = capacity - int(a)
            if np.isfinite(best[rest]):
                p = {int(a): 1}
                while rest:
                    p[int(last[rest])] = p.get(int(last[rest]), 0) + 1
                    rest -= int(last[rest])
                if (key := tuple(sorted(p.items()))) not in seen:
                    seen[key] = p
                    for length, times in p.items():
                        used[length] += times
    return list(seen.values())


def fit_counts(patterns: list[dict[int, int]], hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of repeat counts to the histogram, by accelerated projected gradients.

    Rows are scaled by 1/sqrt(count), so that rare lengths weigh as much as frequent ones.
    """
    lengths = np.flatnonzero(hist)
    row = {int(v): i for i, v in enumerate(lengths)}
    a = np.zeros((len(lengths), len(patterns)))
    for j, p in enumerate(patterns):
        for length, times in p.items():
            a[row[length], j] = times
    scale = 1 / np.sqrt(hist[lengths])
    a *= scale[:, None]
    b = hist[lengths] * scale
    v = np.ones(len(patterns))
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (v @ (a.T @ (a @ v)) * 1.05)
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - rate * (a.T @ (a @ z - b)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def pack_residual(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) that use up ``left``: the largest length first, each filled up with the largest that fit."""
    runs = []
    while len(present := np.flatnonzero(left)):
        room, pattern = capacity, {}
        for length in present[::-1]:
            n = int(min(left[length], room // length))
            if n:
                pattern[int(length)] = n
                room -= n * int(length)
        times = int(min(left[k] // n for k, n in pattern.items()))
        for k, n in pattern.items():
            left[k] -= n * times
        runs.append((pattern, times))
    return runs


def plan_containers(hist: np.ndarray, capacity: int, fits: int = 4) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first container, containers) for a histogram of lengths 0..capacity.

    What rounding leaves of the histogram is fitted again, ``fits`` times in all, before the last lengths are packed largest first.
    """
    left = hist.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[dict[int, int], int]] = []
    for seed in range(fits):
        if not (patterns := fill_patterns(left, capacity, seed=seed)):
            break
        counts = fit_counts(patterns, left.astype(float))
        for j in np.argsort(-counts):
            p = patterns[j]
            times = int(min([round(counts[j]), *(left[k] // n for k, n in p.items())]))
            if times > 0:
                for k, n in p.items():
                    left[k] -= n * times
                runs.append((p, times))
    runs += pack_residual(left, capacity)
    rows, first, ranks = [], 1, np.zeros(len(hist), dtype=np.int64)
    for p, times in runs:
        for k, n in p.items():
            rows.append((k, int(ranks[k]), int(ranks[k]) + n * times, first, times))
            ranks[k] += n * times
        first += times
    return rows


def pack_items(items: DataFrame, *, key: str, size: str, capacity: int = 2048, rows_per_bucket: int = 50_000) -> DataFrame:
    """(key, piece, size, container_id): every item in a container, none split unless larger than the capacity.

    An item larger than the capacity comes in pieces: full ones with a
    container of their own, and the rest, which is packed like an item. Items
    of size 0, NULL or below take no space and get container 0. Container ids
    start at 1. Repeated keys are items of their own. No items give no rows.
    The histogram that goes to the driver has one row per length, at most
    ``capacity`` rows; the plan that comes back has a few rows per length.
    """
    spark = items.sparkSession
    n = F.coalesce(F.greatest(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0))
    full = F.floor(n / capacity)
    sizes = F.when(n == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.array(n % capacity)), lambda x: x > 0)
    )
    pieces = cut(items.select(F.col(f"`{key}`").alias("key"), F.posexplode(sizes).alias("piece", "n")))
    # Buckets by hash spread a length that very many items share.
    total = pieces.count()
    buckets = max(1, min(4096, -(-total // rows_per_bucket)))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("n", "bucket").count()
    hist = np.zeros(capacity + 1)
    for r in counts.groupBy("n").agg(F.sum("count").alias("c")).collect():  # at most capacity + 1 rows
        hist[r["n"]] = r["c"]
    plan = spark.createDataFrame([(k, a, b, c, t) for k, a, b, c, t in plan_containers(hist, capacity)], "n long, a long, b long, first long, times long")
    before = counts.withColumn("start", F.sum("count").over(Window.partitionBy("n").orderBy("bucket")) - F.col("count")).drop("count")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("n", "bucket").orderBy("key", "piece")) - 1)
    # before: at most capacity x 4096 rows; joined by key, Spark chooses how.
    ranked = ranked.join(before, ["n", "bucket"]).withColumn("rank", F.col("rank") + F.col("start"))
    p = plan.withColumnRenamed("n", "pn")
    placed = ranked.join(p, (F.col("n") == F.col("pn")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")), "left")
    container = F.coalesce(F.col("first") + (F.col("rank") - F.col("a")) % F.col("times"), F.lit(0))
    return placed.select(F.col("key").alias(key), "piece", F.col("n").alias(size), container.alias("container_id"))
