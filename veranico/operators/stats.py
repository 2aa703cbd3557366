"""Correlation, permutation, bootstrap, regression, skill scores and outlier rules as Spark aggregations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from veranico.functions.thermo import normal_tail
from veranico.operators.weighted import linear_quantiles, weighted_cdf
from veranico.session import cut, join_groups, null_if_nan, parallel, ship


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the value's average rank in its group; NULL values get NULL.

    Ranks come from counts per distinct value with running sums over stretches
    of values, so a very large group isn't ranked in one task.
    """
    keys = list(keys)
    ones = df.select(*keys, null_if_nan(value).cast("double").alias("__v")).withColumn("__one", F.lit(1.0))
    cdf = weighted_cdf(ones, keys, "__v", "__one").select(*keys, F.col("v").alias("__v"), (F.col("upto") - (F.col("w") - 1) / 2).alias(out))
    found = join_groups(df.withColumn("__v", null_if_nan(value).cast("double")), cdf, [*keys, "__v"], "left")
    return found.drop("__v")


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str, *, least: int = 5, ranks: bool = True) -> DataFrame:
    """(keys, n, pearson, spearman) over rows with both values; NULL under ``least`` rows or without scatter.

    Without ``ranks`` there is no spearman, and one aggregation does.
    """
    rows = df.select(*keys, null_if_nan(x).cast("double").alias("x"), null_if_nan(y).cast("double").alias("y")).filter("x is not null and y is not null")
    ranked = average_ranks(average_ranks(rows, keys, "x", "rx"), keys, "y", "ry") if ranks else rows
    n = F.count(F.lit(1))
    ok = (n >= least) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    return ranked.groupBy(*keys).agg(n.alias("n"), F.when(ok, F.corr("x", "y")).alias("pearson"), *([F.when(ok, F.corr("rx", "ry")).alias("spearman")] if ranks else []))


def _weighted_corr(x: Column, y: Column, w: Column) -> Column:
    sw = F.sum(w)
    mx, my = F.sum(w * x) / sw, F.sum(w * y) / sw
    vx, vy = F.sum(w * x * x) / sw - mx * mx, F.sum(w * y * y) / sw - my * my
    return F.when((vx > 1e-12) & (vy > 1e-12), (F.sum(w * x * y) / sw - mx * my) / F.sqrt(vx * vy))


def weighted_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str, *, least: int = 10) -> DataFrame:
    """(keys, n, rho): weighted correlation of unweighted average ranks; NULL under ``least`` rows."""
    rows = df.select(*keys, null_if_nan(x).cast("double").alias("x"), null_if_nan(y).cast("double").alias("y"), null_if_nan(w).cast("double").alias("w")).filter("x is not null and y is not null and w > 0")
    ranked = average_ranks(average_ranks(rows, keys, "x", "rx"), keys, "y", "ry")
    n = F.count(F.lit(1))
    return ranked.groupBy(*keys).agg(n.alias("n"), F.when(n >= least, _weighted_corr(F.col("rx"), F.col("ry"), F.col("w"))).alias("rho"))


def permutation_p(df: DataFrame, row_id: str, x: str, y: str, w: str, *, permutations: int = 999) -> DataFrame:
    """(n, rho, exceed, p_value): how often permuted ranks correlate at least as strongly.

    The k-th permutation orders the rows by md5 of id and k, and hands the
    i-th row in that order the y of the i-th row in the order for k = 0; p is
    (exceed + 1) / (permutations + 1). Orders are made with running counts over
    stretches of hash values, so no permutation is sorted in one task. One row
    comes out, with NULLs on an empty table.
    """
    rows = df.select(F.col(row_id).alias("id"), null_if_nan(x).cast("double").alias("x"), null_if_nan(y).cast("double").alias("y"), null_if_nan(w).cast("double").alias("w")).filter("x is not null and y is not null and w > 0")
    ranked = average_ranks(average_ranks(rows, [], "x", "rx"), [], "y", "ry").select("id", "rx", "ry", "w")
    ranked = cut(ranked)
    hashed = lambda d: d.withColumn("h", F.md5(F.concat_ws("-", F.col("id").cast("string"), F.col("perm").cast("string"))))
    base = _place(hashed(ranked.withColumn("perm", F.lit(0))), ["perm"])
    perms = ranked.select("id", "rx", "w", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    perms = _place(hashed(perms), ["perm"])
    shuffled = perms.join(base.select(F.col("place"), F.col("ry")), "place").groupBy("perm").agg(_weighted_corr(F.col("rx"), F.col("ry"), F.col("w")).alias("r"))
    observed = ranked.agg(F.count(F.lit(1)).alias("n"), _weighted_corr(F.col("rx"), F.col("ry"), F.col("w")).alias("rho"))
    both = observed.crossJoin(F.broadcast(shuffled.agg(F.collect_list("r").alias("rs"))))  # one row each, `permutations` numbers
    exceed = F.size(F.filter("rs", lambda r: F.abs(r) >= F.abs(F.col("rho")) - 1e-12))
    return both.select("n", "rho", exceed.alias("exceed"), ((exceed + 1) / F.lit(permutations + 1)).alias("p_value"))


def _place(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds place: the 1-based order of the hash ``h`` (hexadecimal, unique) within keys, counted over stretches of its first three characters."""
    df = df.withColumn("part", F.substring("h", 1, 3))
    sizes = df.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    inner = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("h"))
    return df.join(sizes, [*keys, "part"]).withColumn("place", inner + F.col("before")).drop("part", "before", "h")


def skill_scores(df: DataFrame, keys: Sequence[str], model: str, observed: str, *, least: int = 2) -> DataFrame:
    """(keys, n, bias, mae, rmse, r, sd_ratio, nrmse, crmse) of pairs: centred and normalised by the observed standard deviation."""
    m, o = null_if_nan(model).cast("double"), null_if_nan(observed).cast("double")
    rows = df.select(*keys, m.alias("m"), o.alias("o")).filter("m is not null and o is not null")
    d = F.col("m") - F.col("o")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr("m", "o").alias("r"),
        F.stddev_pop("m").alias("sm"), F.stddev_pop("o").alias("so"), F.sqrt(F.greatest(F.avg(d * d) - F.avg(d) * F.avg(d), F.lit(0.0))).alias("c"),
    ).filter(F.col("n") >= least)
    by = lambda c: F.when(F.col("so") > 0, c / F.col("so"))
    return out.select(*keys, "n", "bias", "mae", "rmse", F.when((F.col("sm") > 0) & (F.col("so") > 0), F.col("r")).alias("r"), by(F.col("sm")).alias("sd_ratio"), by(F.col("rmse")).alias("nrmse"), by(F.col("c")).alias("crmse"))


def capped_outliers(df: DataFrame, keys: Sequence[str], row_id: str, difference: str, *, k: float = 6.0, most: float = 0.03, least_abs: float = 0.0, least: int = 30) -> DataFrame:
    """(keys, row id, deviation): residuals further from the group's median than max(least_abs, k sigma), largest first, at most max(1, floor(most n)).

    Sigma is the scaled MAD, else the IQR over 1.349, else the standard
    deviation, whichever is first above 0. Groups under ``least`` rows have no
    outliers. Only rows beyond the limit are ordered, never a whole group.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(row_id).alias("__id"), null_if_nan(difference).cast("double").alias("d")).filter("d is not null")
    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_samp("d").alias("sd")).filter(F.col("n") >= least)
    dev = join_groups(rows, first, keys).withColumn("dev", F.abs(F.col("d") - F.col("q")[1]))
    second = dev.groupBy(*keys).agg((F.percentile("dev", 0.5) * 1.4826).alias("mad"))
    sigma = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("q")[2] > F.col("q")[0], (F.col("q")[2] - F.col("q")[0]) / 1.349).otherwise(F.col("sd"))
    out = join_groups(dev, second, keys).withColumn("limit", F.greatest(F.lit(float(least_abs)), sigma * k)).filter(F.col("dev") > F.col("limit"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("dev"), "__id"))
    kept = out.withColumn("__r", order).filter(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("n") * most + 1e-9)))
    return kept.select(*keys, F.col("__id").alias(row_id), F.col("dev").alias("deviation"))


def trim(df: DataFrame, x: str, y: str | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows with x within its percentiles; with ``y``, then also y within its own percentiles among those."""
    for c in [x, *([y] if y else [])]:
        lim = linear_quantiles(df, [], c, {"__low": low, "__high": high}).drop("n")
        df = df.crossJoin(F.broadcast(lim)).filter(null_if_nan(c).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")  # one row
    return df


def bootstrap_mean(df: DataFrame, keys: Sequence[str], row_id: str, value: str, weight: str, *, reps: int = 500) -> DataFrame:
    """(keys, mean, low, high): weighted mean with the 2.5 and 97.5 percentiles over ``reps`` Poisson resamples.

    A row's number of copies in a resample is a Poisson(1) draw from the hash
    of its id and the resample's number, so resamples are sums that need no
    shuffled rows, and they come out the same however the data are split.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(row_id).alias("id"), null_if_nan(value).cast("double").alias("v"), null_if_nan(weight).cast("double").alias("w")).filter("v is not null and w > 0")
    drawn = _resampled_sums(rows.withColumn("vw", F.col("v") * F.col("w")), keys, reps, ["vw", "w"])
    means = drawn.withColumn("m", F.col("vw") / F.when(F.col("w") > 0, F.col("w")))
    band = means.groupBy(*keys).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    mean = rows.groupBy(*keys).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))
    return join_groups(mean, band, keys)


def poisson_steps() -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... of a Poisson variable of mean 1."""
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        steps.append(round(total, 12))
        p /= k + 1
    return steps


_MD5_TURNS = [*[7, 12, 17, 22] * 4, *[5, 9, 14, 20] * 4, *[4, 11, 16, 23] * 4, *[6, 10, 15, 21] * 4]
_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that one MD5 block holds besides its end mark and length.
_MD5_BLOCK = 55


def md5_heads(ids: list[bytes], tails: list[bytes]) -> np.ndarray:
    """The first 32 bits of MD5 of each id followed by each tail, (ids, tails); the ids are of one length."""
    size = len(ids[0])
    if size + max(map(len, tails)) > _MD5_BLOCK:
        return np.array([[int.from_bytes(hashlib.md5(i + t).digest()[:4], "big") for t in tails] for i in ids], np.uint32)
    left, right = np.zeros((len(ids), 64), np.uint8), np.zeros((len(tails), 64), np.uint8)
    left[:, :size] = np.frombuffer(b"".join(ids), np.uint8).reshape(len(ids), size)
    for row, tail in zip(right, tails):
        end = size + len(tail)
        row[size:end] = np.frombuffer(tail, np.uint8)
        row[end] = 0x80
        row[56:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
    # The words of the message: of the id alone, of the tail alone, and at most one of both.
    x, y = left.view("<u4").astype(np.uint32), right.view("<u4").astype(np.uint32)
    words = [x[:, k, None] if 4 * k + 4 <= size else y[None, :, k] if 4 * k >= size else x[:, k, None] | y[None, :, k] for k in range(16)]
    a, b, c, d = (np.full((len(ids), len(tails)), v, np.uint32) for v in _MD5_START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps don't touch the first word
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[k] + np.uint32(_MD5_ADDED[i])
        np.left_shift(f, np.uint32(_MD5_TURNS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _MD5_TURNS[i]), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_MD5_START[0])
    return b.byteswap()


def _copies(heads: np.ndarray) -> np.ndarray:
    """How often each row is drawn: the steps that its number, as a part of 2**32, reaches."""
    out = np.zeros(heads.shape, np.uint8)
    for s in poisson_steps():
        if (least := math.ceil(s * 2**32)) < 2**32:
            out += heads >= np.uint32(least)
    return out


def _resampled_sums(rows: DataFrame, keys: Sequence[str], reps: int, sums: Sequence[str]) -> DataFrame:
    """(keys, rep, sums): the sums of columns over the rows times the number of their copies drawn in each resample.

    ``rows`` has the keys, id and the columns. A row's copies are made and
    summed inside its task, so that no row per resample is ever written. Rows
    without an id are in no resample, and resamples without rows are left out.
    """
    keys = list(keys)
    ship(rows.sparkSession)
    tails = [f"-{r}".encode() for r in range(1, reps + 1)]
    names = [f"s{i}" for i in range(len(sums))]
    given = rows.filter("id is not null").select(F.col("id").cast("string").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(sums, names)], *keys)
    schema = StructType([*given.select(*keys).schema.fields, StructField("rep", IntegerType()), StructField("drawn", LongType()), *[StructField(n, DoubleType()) for n in names]])
    step = max(1, 65_536 // reps)  # hashes at a time, that stay in a core's cache

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                group = np.unique(group * batch.num_rows + codes, return_inverse=True)[1]
            firsts = np.unique(group, return_index=True)[1]
            ids = [i.encode() for i in batch.column("id").to_pylist()]
            values = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            order = np.lexsort((sizes, group))
            held = max(1, 100_000 // reps)
            for low in range(0, len(firsts), held):  # so many groups at a time
                n = min(held, len(firsts) - low)
                total, drawn = np.zeros((n, len(names), reps)), np.zeros((n, reps), np.int64)
                mine = order[np.searchsorted(group[order], low) : np.searchsorted(group[order], low + n)]
                for size in np.unique(sizes[mine]):
                    same = mine[sizes[mine] == size]
                    for at in range(0, len(same), step):
                        part = same[at : at + step]
                        copies = _copies(md5_heads([ids[i] for i in part], tails))
                        ends = [0, *(np.flatnonzero(np.diff(group[part])) + 1), len(part)]
                        for start, end in zip(ends, ends[1:]):
                            g, v, c = group[part[start]] - low, values[part[start:end]], copies[start:end]
                            # Copies that aren't drawn add nothing, of an infinite value too.
                            total[g] += v.T @ c.astype(np.float64) if np.isfinite(v).all() else np.where(c[:, None, :] > 0, v[:, :, None] * c[:, None, :], 0.0).sum(0)
                            drawn[g] += c.sum(0, dtype=np.int64)
                g, r = np.nonzero(drawn)
                kept = pa.array(firsts[low + g])
                columns = [*[batch.column(k).take(kept) for k in keys], pa.array(r + 1, pa.int32()), pa.array(drawn[g, r]), *[pa.array(total[g, i, r]) for i in range(len(names))]]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    # Few groups leave few partitions behind a join on them.
    parts = given.repartition(parallel(rows)).mapInArrow(add, schema)
    return parts.groupBy(*keys, "rep").agg(*[F.sum(n).alias(c) for n, c in zip(names, sums)])


def bootstrap_difference(df: DataFrame, keys: Sequence[str], row_id: str, by: str, value: str, weight: str, *, low: float = 0.25, high: float = 0.75, reps: int = 500) -> DataFrame:
    """(keys, difference, low, high): weighted mean of the rows in the upper part of ``by`` less that in its lower part, with the 2.5 and 97.5 percentiles over resamples.

    The parts lie at or beyond the quantiles ``high`` and ``low`` of ``by`` in
    the group. Groups without rows in both parts have a NULL difference.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(row_id).alias("id"), *[null_if_nan(c).cast("double").alias(n) for c, n in ((by, "x"), (value, "v"), (weight, "w"))]).filter("x is not null and v is not null and w > 0")
    ends = linear_quantiles(rows, keys, "x", {"lo": low, "hi": high}).drop("n")
    parted = join_groups(rows, ends, keys).withColumn("side", F.when(F.col("x") >= F.col("hi"), 1).when(F.col("x") <= F.col("lo"), 0)).filter("side is not null").select(*keys, "id", "v", "w", "side")
    mean = lambda s: F.sum(F.when(F.col("side") == s, F.col("v") * F.col("w"))) / F.sum(F.when(F.col("side") == s, F.col("w")))
    difference = (mean(1) - mean(0)).alias("difference")
    part = lambda c, s: F.when(F.col("side") == s, c).otherwise(0.0)
    sides = [part(c, s).alias(f"{n}{s}") for s in (0, 1) for n, c in (("vw", F.col("v") * F.col("w")), ("w", F.col("w")))]
    drawn = _resampled_sums(parted.select(*keys, "id", *sides), keys, reps, ["vw0", "w0", "vw1", "w1"])
    per = lambda s: F.col(f"vw{s}") / F.when(F.col(f"w{s}") > 0, F.col(f"w{s}"))
    band = drawn.withColumn("d", per(1) - per(0)).groupBy(*keys).agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    return join_groups(parted.groupBy(*keys).agg(difference), band, keys)


def wls(df: DataFrame, response: str, predictors: Sequence[str], weight: str, *, fixed: Sequence[str] = (), least: int = 80) -> DataFrame:
    """Weighted least squares with HC3 standard errors: (term, beta, se, low, high, z, p_value, n, r2, adj_r2, aic, bic).

    low and high bound 95 %. ``fixed`` columns enter as indicator columns of their values but the first.
    The normal equations are sums of products made in one pass; only these
    (terms x terms numbers) reach the driver, and a second pass sums the HC3
    meat with each row's leverage. Rows with a missing field or weight are left
    out; under ``least`` rows, or with a singular matrix, no rows come out.
    """
    spark = df.sparkSession
    cols = [null_if_nan(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)]
    rows = df.select(null_if_nan(response).cast("double").alias("y"), null_if_nan(weight).cast("double").alias("w"), *cols, *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fixed)])
    rows = rows.dropna().filter("w > 0")
    names, terms = ["const", *predictors], [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(predictors))]]
    for i, f in enumerate(fixed):
        levels = [r[0] for r in rows.select(f"f{i}").distinct().orderBy(f"f{i}").limit(200).collect()]
        if len(levels) >= 200:
            raise ValueError(f"{f} has too many values for fixed effects")
        names += [f"{f}={v}" for v in levels[1:]]
        terms += [(F.col(f"f{i}") == v).cast("double") for v in levels[1:]]
    k = len(terms)
    w, y = F.col("w"), F.col("y")
    sums = [F.sum(w * terms[i] * terms[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * t * y) for t in terms] + [F.sum(w * y * y), F.sum(w * y), F.sum(w), F.count(F.lit(1)), F.sum(F.log(w))]
    got = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    schema = "term string, beta double, se double, low double, high double, z double, p_value double, n long, r2 double, adj_r2 double, aic double, bic double"
    n = got[len(sums) - 2]
    if n < max(least, k + 1):
        return spark.createDataFrame([], schema)
    a, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = got[at]
            at += 1
    b = np.array(got[at : at + k])
    yy, ys, ws, _, logw = got[at + k :]
    if np.linalg.cond(a) > 1e14:
        return spark.createDataFrame([], schema)
    inv = np.linalg.inv(a)
    beta = inv @ b
    fitted = sum((terms[i] * float(beta[i]) for i in range(k)), F.lit(0.0))
    lever = w * sum((terms[i] * terms[j] * float(inv[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    score = w * (y - fitted) / (1 - lever)
    meat_row = rows.agg(*[F.sum(score * score * terms[i] * terms[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = meat_row[at]
            at += 1
    se = np.sqrt(np.diag(inv @ meat @ inv))
    rss, tss = yy - beta @ b, yy - ys * ys / ws
    r2 = 1 - rss / tss if tss > 0 else None
    like = -n / 2 * math.log(rss / n) - n / 2 * (1 + math.log(2 * math.pi)) + logw / 2 if rss > 0 else None
    out = []
    for name, c, s in zip(names, beta, se):
        z = float(c / s) if s > 0 else None
        out.append((name, float(c), float(s), float(c - 1.959964 * s), float(c + 1.959964 * s), z, math.erfc(abs(z) / math.sqrt(2)) if z is not None else None, int(n), None if r2 is None else float(r2), None if r2 is None else float(1 - (1 - r2) * (n - 1) / (n - k)), None if like is None else float(2 * k - 2 * like), None if like is None else float(k * math.log(n) - 2 * like)))
    return spark.createDataFrame(out, schema)


def stratum_anomaly(df: DataFrame, stratum: str, value: str, weight: str, out: str) -> DataFrame:
    """Adds ``out``: the value less the weighted mean of its stratum."""
    good = null_if_nan(value).isNotNull() & (null_if_nan(weight) > 0)
    means = df.filter(good).groupBy(F.col(stratum).alias("__st")).agg((F.sum(null_if_nan(value) * F.col(weight)) / F.sum(weight)).alias("__sm"))
    return df.join(means, F.col(stratum).eqNullSafe(F.col("__st")), "left").withColumn(out, null_if_nan(value) - F.col("__sm")).drop("__st", "__sm")


def density_bins(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(bx, by, n): counts on a grid of ``bins`` x ``bins`` cells between the extremes."""
    a, b = null_if_nan(x), null_if_nan(y)
    ends = df.filter(a.isNotNull() & b.isNotNull()).agg(F.min(a).alias("x0"), F.max(a).alias("x1"), F.min(b).alias("y0"), F.max(b).alias("y1"))
    cell = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((v - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    rows = df.filter(a.isNotNull() & b.isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return rows.groupBy(cell(a, "x0", "x1").alias("bx"), cell(b, "y0", "y1").alias("by")).agg(F.count(F.lit(1)).alias("n"))


def kendall_p(tau_s: Column, var_s: Column) -> Column:
    """Two-sided p of Kendall's tau by its normal approximation, without the continuity correction of Mann-Kendall."""
    return normal_tail(F.when(var_s > 0, tau_s / F.sqrt(var_s)))
