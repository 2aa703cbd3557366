"""Exact percentiles per group by distributed multi-select over mergeable summaries.

A summary holds the values of each group in sorted blocks of bounded length; a
group of more rows than a block has several, spread by a hash, so no group is
one task. With a resolution, equal rounded values are counted, which bounds a
group's summary. Summaries of separate partitions or dates combine by putting
their blocks together.

Groups of one block answer from it. In larger ones percentiles are selected
together: the blocks propose the medians of what they hold of an open range,
their weighted median is the pivot, counts below, at and above it tell where
the wanted ranks lie, a range splits in two there, and parts without a wanted
rank are discarded, so each round reads less than the one before. Ranges short
enough are gathered and read off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veranico.session import cut, join_groups, null_if_nan

#: Values of a block, and of a range that is gathered.
BLOCK = 20_000
#: Rows up to which the table of groups with several blocks is broadcast.
MOST_BROADCAST = 100_000
_OWN = ("variable", "xs", "ws", "whole")


def summarise(df: DataFrame, groups: Sequence[str], values: Sequence[str], *, resolution: float = 0.0, spread_by: Sequence[str] = (), block_rows: int = BLOCK) -> DataFrame:
    """(groups, variable, xs, ws, whole): sorted blocks of the values of each column of ``values`` per group.

    ``ws`` holds how often each value occurs, or is NULL where each stands for
    one row; ``whole`` tells that a group has one block. NULL and NaN are left
    out. With a ``resolution`` above 0, values are rounded to its multiples, so
    a percentile is at most half of it away from the exact one and a group's
    summary is no longer than its range divided by it. 0 keeps exact values.
    NULL groups form a group. Equal rows count each. Rows of a large group are
    spread by a hash of their values and of ``spread_by``, which should name a
    key where many rows of a group are equal; the hash depends on nothing else,
    so a lost task makes the same blocks again. Columns of ``groups`` must
    not be named variable, xs, ws or whole.
    """
    if set(groups) & set(_OWN):
        raise ValueError(f"group columns must not be named {', '.join(_OWN)}")
    rows = df.select(*[F.col(f"`{g}`").alias(g) for g in groups], *[(null_if_nan(F.col(f"`{v}`").cast("double")) + 0.0).alias(f"__v{i}") for i, v in enumerate(values)], F.xxhash64(*[F.col(f"`{c}`") for c in [*values, *spread_by]]).alias("__spread"))
    names = [f"__v{i}" for i in range(len(values))]
    if resolution > 0:
        scale = round(1 / resolution)
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), (F.round(F.col(n) * scale) / scale).alias("x")) for v, n in zip(values, names)]))
        counted = rows.select(*groups, each.alias("e")).select(*groups, "e.*").filter("x is not null").groupBy(*groups, "variable", "x").agg(F.count(F.lit(1)).alias("w")).withColumn("__spread", F.xxhash64("x"))
        blocked = _blocked(counted, [*groups, "variable"], block_rows)
        pairs = blocked.groupBy(*groups, "variable", "__blocks", "__block").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("p"))
        return pairs.select(*groups, "variable", F.col("p.x").alias("xs"), F.col("p.w").alias("ws"), (F.col("__blocks") == 1).alias("whole"))
    blocked = _blocked(rows, list(groups), block_rows)
    lists = blocked.groupBy(*groups, "__blocks", "__block").agg(*[F.collect_list(n).alias(n) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.sort_array(n).alias("xs")) for v, n in zip(values, names)]))
    none = F.lit(None).cast("array<bigint>").alias("ws")
    return lists.select(*groups, (F.col("__blocks") == 1).alias("whole"), each.alias("e")).select(*groups, "e.variable", "e.xs", none, "whole").filter(F.size("xs") > 0)


def _blocked(rows: DataFrame, groups: list[str], block_rows: int) -> DataFrame:
    """Adds __blocks, the number of blocks of the row's group, and __block, the row's own by its hash __spread."""
    # At most rows / block_rows rows; map-side counts come first.
    many = cut(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows).withColumn("__blocks", F.ceil(F.col("n") / block_rows).cast("int")).drop("n"))
    few = many.count() <= MOST_BROADCAST
    # Without groups, one row for all.
    joined = join_groups(rows, F.broadcast(many) if few else many, groups, "left") if groups else rows.crossJoin(F.broadcast(many.agg(F.max("__blocks").alias("__blocks"))))
    blocks = F.coalesce("__blocks", F.lit(1))
    return joined.withColumn("__block", F.pmod(F.col("__spread"), blocks).cast("int")).withColumn("__blocks", blocks)


def merge(*summaries: DataFrame) -> DataFrame:
    """One summary of several with the same groups; a group's blocks are put together."""
    total = summaries[0]
    for s in summaries[1:]:
        total = total.unionByName(s)
    return total.withColumn("whole", F.lit(False)) if len(summaries) > 1 else total


def select_percentiles(summary: DataFrame, probs: Sequence[float], *, finish_at: int = BLOCK) -> DataFrame:
    """(groups, variable, p, value) of a summary: the smallest value with at least p of the rows at or below it.

    A group of one value gives it for every p; groups without values give no
    rows. ``finish_at`` bounds the values of a range that is gathered in one
    place; larger groups are narrowed first, whatever their size.
    """
    groups = [c for c in summary.columns if c not in ("xs", "ws", "whole")]
    blocks = cut(summary.select(F.struct(*groups).alias("g"), "xs", "ws", "whole"))
    parts = [_read_off(blocks.filter("whole").withColumn("asked", _asked(probs, _weight("xs", "ws"))))]
    spread = blocks.filter("not whole").select("g", "xs", "ws").withColumn("range", F.lit(1).cast("long"))
    sizes = spread.groupBy("g", "range").agg(F.sum(_weight("xs", "ws")).alias("n"), F.sum(F.size("xs")).alias("m"))
    open_ = cut(sizes.select("g", "range", "m", _asked(probs, F.col("n")).alias("asked")))
    while not open_.isEmpty():
        short = open_.filter(F.col("m") <= finish_at)
        near = spread.join(short.select("g", "range", "asked"), ["g", "range"])
        gathered = near.groupBy("g", "range", "asked").agg(F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("ws")).alias("ws"))
        # Blocks without counts stay without; values of several blocks are put in order.
        zipped = F.sort_array(F.arrays_zip("xs", "ws"))
        counted = F.size("ws") > 0
        gathered = gathered.select("g", "asked", F.when(counted, F.transform(zipped, lambda z: z["xs"])).otherwise(F.sort_array("xs")).alias("xs"), F.when(counted, F.transform(zipped, lambda z: z["ws"])).alias("ws"))
        parts.append(_read_off(gathered))
        long = open_.filter(F.col("m") > finish_at)
        if long.isEmpty():
            break
        inside = spread.join(long.select("g", "range"), ["g", "range"], "left_semi")
        local = inside.select("g", "range", F.get("xs", ((F.size("xs") - 1) / 2).cast("int")).alias("median"), _weight("xs", "ws").alias("w"))
        pivots = local.groupBy("g", "range").agg(F.percentile("median", 0.5, F.col("w")).alias("mid"), F.collect_set("median").alias("all"))
        # The weighted median of an even number may lie between two proposals; the pivot is the one below.
        pivots = pivots.select("g", "range", F.array_max(F.filter("all", lambda x: x <= F.col("mid"))).alias("pivot"))
        split = inside.join(pivots, ["g", "range"])
        pivot = F.col("pivot")
        split = split.withColumn("i", F.size(F.filter("xs", lambda x: x < pivot))).withColumn("j", F.size(F.filter("xs", lambda x: x <= pivot)))
        cutting = lambda c, i, j: F.when(F.col(c).isNotNull(), F.slice(c, i + 1, j - i))
        sides = [(0, F.lit(0), F.col("i")), (1, F.col("j"), F.size("xs"))]
        three = split.groupBy("g", "range", "pivot").agg(
            F.sum(_weight(cutting("xs", F.lit(0), F.col("i")), cutting("ws", F.lit(0), F.col("i")))).alias("below"),
            F.sum(_weight(cutting("xs", F.col("i"), F.col("j")), cutting("ws", F.col("i"), F.col("j")))).alias("at"),
            F.sum("i").alias("m0"), F.sum(F.size("xs") - F.col("j")).alias("m1"),
        )
        told = cut(three.join(long.select("g", "range", "asked"), ["g", "range"]))
        low, mid = lambda a: a["k"] <= F.col("below"), lambda a: a["k"] <= F.col("below") + F.col("at")
        parts.append(told.select("g", F.explode(F.filter("asked", lambda a: ~low(a) & mid(a))).alias("a"), "pivot").select("g", F.col("a.p").alias("p"), F.col("pivot").alias("value")))
        lower = F.filter("asked", low)
        upper = F.transform(F.filter("asked", lambda a: ~mid(a)), lambda a: F.struct(a["p"].alias("p"), (a["k"] - F.col("below") - F.col("at")).alias("k")))
        halves = F.array(F.struct((F.col("range") * 2).alias("range"), F.col("m0").alias("m"), lower.alias("asked")), F.struct((F.col("range") * 2 + 1).alias("range"), F.col("m1").alias("m"), upper.alias("asked")))
        open_ = cut(told.select("g", F.explode(halves).alias("h")).select("g", "h.*").filter(F.size("asked") > 0))
        kept = F.array(*[F.struct((F.col("range") * 2 + s).alias("range"), cutting("xs", i, j).alias("xs"), cutting("ws", i, j).alias("ws")) for s, i, j in sides])
        spread = cut(split.select("g", F.explode(kept).alias("s")).select("g", "s.*").filter(F.size("xs") > 0).join(open_.select("g", "range"), ["g", "range"], "left_semi"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*[F.col("g")[c].alias(c) for c in groups], "p", "value")


def _weight(xs: Column | str, ws: Column | str) -> Column:
    """Rows that a block stands for."""
    xs, ws = (F.col(c) if isinstance(c, str) else c for c in (xs, ws))
    return F.when(ws.isNull(), F.size(xs).cast("long")).otherwise(F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + w))


def _asked(probs: Sequence[float], n: Column) -> Column:
    """The rank of each percentile among n rows."""
    return F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * n - 1e-9)).cast("long").alias("k")) for p in probs])


def _read_off(blocks: DataFrame) -> DataFrame:
    """Answers of blocks that hold all of a group or range: the value at each asked rank."""
    a = F.explode("asked").alias("a")
    plain = blocks.filter("ws is null").select("g", "xs", a).select("g", F.col("a.p").alias("p"), F.get("xs", (F.col("a.k") - 1).cast("int")).alias("value"))
    counted = blocks.filter("ws is not null").withColumn("id", F.monotonically_increasing_id())
    rows = counted.select("g", "id", "asked", F.explode(F.arrays_zip("xs", "ws")).alias("z")).select("g", "id", "asked", F.col("z.xs").alias("x"), F.col("z.ws").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("id").orderBy("x", "w").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = rows.withColumn("upto", upto).withColumn("hits", F.filter("asked", lambda a: (a["k"] <= F.col("upto")) & (a["k"] > F.col("upto") - F.col("w"))))
    return plain.unionByName(hit.select("g", "x", F.explode("hits").alias("a")).select("g", F.col("a.p").alias("p"), F.col("x").alias("value")))
