"""Matching records of two sources without a common id.

Records that are equal in all compared fields are first folded into one, and
unfolded at the end. Sorted neighbourhood: the records of both sources are
sorted once by several composite keys, and records of different sources at most
``window`` places apart are compared. Each key ends with a point or an area, so
within a long run of equal names those of one place still lie side by side.
Weighted field similarities give each pair a score and a confidence. Then
records are assigned one to one with the greatest total confidence (as
log-odds), exactly: pairs that no other pair can outweigh are chosen first,
what they leave falls into small connected components, each solved as an
assignment problem inside a task; a component too large for that is assigned by
an auction of DataFrame rounds. Double entries of assigned records are added.
Everything is one global sort and keyed joins: no block of equal keys is ever
compared in full, however many records share a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veranico.operators.proximity import haversine_km
from veranico.session import cut, ship

# Common shortenings in names of places, and words that stand before a name.
SHORT = {"gde": "grande", "sta": "santa", "sto": "santo", "s": "sao", "n": "nova", "nva": "nova", "cpo": "campo", "mte": "monte", "lg": "lagoa", "sra": "serra", "nte": "norte", "rib": "ribeirao", "pto": "porto", "v": "vila"}
BEFORE = r"^(?:municipio|munic|mun|prefeitura|pref)\.?(?: municipal)?(?: d[eo])? "


def name_words(name: Column) -> Column:
    """The words of a place name in lower case: encodings, inversions and shortenings undone, small words left out."""
    x = name
    for pattern, letter in (("Ã[\u0080-\u0083 ¡¢£]", "a"), ("Ã[\u0088-\u008b©ª]", "e"), ("Ã[\u008c-\u008f­]", "i"), ("Ã[\u0092-\u0096³´µ]", "o"), ("Ã[\u0099-\u009cº]", "u"), ("Ã[\u0087§]", "c")):
        x = F.regexp_replace(x, pattern, letter)
    x = F.lower(F.translate(x, "ÁÂÃÀÉÊÍÓÔÕÚÜÇáâãàéêíóôõúüç’`", "AAAAEEIOOOUUCaaaaeeiooouuc''"))
    x = F.regexp_replace(x, r"(?<=[a-z])0|0(?=[a-z])", "o")
    x = F.regexp_replace(F.trim(x), r"^([^,(]+),\s*([^,]+)$", "$2 $1")
    x = F.regexp_replace(F.regexp_replace(x, "'", ""), r"[^a-z0-9]+", " ")
    x = F.regexp_replace(F.trim(x), BEFORE, "")
    words = F.filter(F.split(x, " "), lambda w: ~w.isin("", "de", "do", "da", "dos", "das", "d"))
    short = F.create_map(*[F.lit(v) for kv in SHORT.items() for v in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w))


def sorted_neighbours(left: DataFrame, right: DataFrame, keys: Sequence[Column], window: int, carried: Sequence[str], near: Column) -> DataFrame:
    """Distinct pairs of ids (l, r) at most ``window`` places apart in one of the orders by ``keys``, where ``near`` holds.

    ``near`` is a condition on the ``carried`` columns of the left and right
    record, under their names with ``l_`` and ``r_`` before. A record whose key
    is NULL isn't in that order.
    """
    spark = left.sparkSession
    sides = [df.select(F.lit(i).alias("side"), "id", *carried, F.posexplode(F.array(*keys)).alias("order", "sort")) for i, df in enumerate((left, right))]
    ordered = sides[0].unionByName(sides[1]).filter("sort is not null")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ties are broken by a hash, which mixes the sides.
    ordered = ordered.withColumn("tie", F.xxhash64("id", "side"))
    placed = ordered.repartitionByRange(n, "order", "sort", "tie").sortWithinPartitions("order", "sort", "tie")
    placed = cut(placed.select("side", "id", *carried, "order", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    start, before = [0] * n, 0
    for part in range(n):
        start[part], before = before, before + sizes.get(part, 0)
    rank = F.get(F.array(*[F.lit(s).cast("long") for s in start]), F.col("part")) + F.col("at")
    placed = placed.withColumn("rank", rank).withColumn("stretch", F.floor(F.col("rank") / window))
    l = placed.filter("side = 0").select("order", "stretch", F.col("id").alias("l"), F.col("rank").alias("lr"), *[F.col(c).alias(f"l_{c}") for c in carried])
    r = placed.filter("side = 1").select("order", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("stretch"), F.col("id").alias("r"), F.col("rank").alias("rr"), *[F.col(c).alias(f"r_{c}") for c in carried])
    return l.join(r, ["order", "stretch"]).filter(F.abs(F.col("lr") - F.col("rr")) <= window).filter(near).select("l", "r").distinct()


def place_score(l: Column, r: Column) -> Column:
    """Weighted evidence that two place records are the same: name, point, area in any of three units, state and biome."""
    edits = F.levenshtein(l["name"], r["name"])
    # A name may have been cut off.
    cut_off = (F.least(F.length(l["name"]), F.length(r["name"])) >= 9) & (l["name"].startswith(r["name"]) | r["name"].startswith(l["name"]))
    name = F.when(edits == 0, 4.0).when(edits == 1, 3.0).when((edits == 2) | cut_off, 2.0).when(edits == 3, 0.5).when(edits <= 5, -3.0).otherwise(-6.0)
    km = haversine_km(l["y"], l["x"], r["y"], r["x"])
    point = F.when(km.isNull(), 0.0).when(km < 6, 3.0).when(km < 12, 2.0).when(km < 50, -2.0).otherwise(-2.5)
    ratio = F.abs(F.log(l["area"] / r["area"]))
    same_area = (ratio < 0.06) | (F.abs(ratio - 4.60517) < 0.06)
    area = F.when(ratio.isNull(), 0.0).when(same_area, 3.0).otherwise(-4.0)
    state = F.when(l["state"].isNull() | r["state"].isNull(), 0.0).when(l["state"] == r["state"], 1.0).otherwise(-2.5)
    biome = F.when(l["biome"].isNull() | r["biome"].isNull(), 0.0).when(l["biome"] == r["biome"], 0.3).otherwise(-0.3)
    return name + point + area + state + biome


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of the one-to-one choice with the greatest sum of a matrix of weights, where 0 is no pair; shortest augmenting paths with potentials."""
    turned = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if turned else weights)
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, done, via = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            done[at] = True
            row = row_of[at]
            reach = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (reach < least[1:])
            least[1:][better], via[1:][better] = reach[better], at
            open_ = np.where(done[1:], np.inf, least[1:])
            nxt = int(np.argmin(open_)) + 1
            step = open_[nxt - 1]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            at = nxt
            if row_of[at] == 0:
                break
        while at:
            row_of[at] = row_of[via[at]]
            at = via[at]
    pairs = [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return [(j, i) if turned else (i, j) for i, j in pairs if cost[i, j] < 0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (a, b): the smallest node that each is connected with.

    Alternating large-star and small-star steps; each keeps the connections and
    needs a number of rounds that grows with the logarithm of the nodes.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, mark = cut(edges.select("a", "b").filter("a <> b").distinct()), None
    while True:
        near = both(now)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def auction(pairs: DataFrame, step: float) -> DataFrame:
    """Pairs (l, r, w) chosen one to one; their sum is within ``step`` a record of the greatest.

    In each round every unassigned l bids for the r that is worth most to it at
    the current prices, r goes to the highest bid, and prices rise by a step at
    least, so rounds end: an l stays without a partner once no price is below its weights.
    """
    pairs, owned = cut(pairs), None
    while True:
        if owned is None:
            left = pairs.withColumn("price", F.lit(0.0))
        else:
            left = pairs.join(owned.select("r", "price"), "r", "left").withColumn("price", F.coalesce("price", F.lit(0.0))).join(owned.select("l"), "l", "left_anti")
        worth = left.withColumn("profit", F.col("w") - F.col("price")).filter(F.col("profit") > 0)
        if worth.isEmpty():
            break
        best = worth.groupBy("l").agg(F.max(F.struct("profit", F.xxhash64("l", "r").alias("h"), "r", "w", "price")).alias("b"), F.max("profit").alias("first"))
        second = worth.join(best.select("l", F.col("b.r").alias("top")), "l").filter("r <> top").groupBy("l").agg(F.max("profit").alias("second"))
        bids = best.join(second, "l", "left").select("l", F.col("b.r").alias("r"), F.col("b.w").alias("w"), (F.col("b.price") + F.col("first") - F.coalesce("second", F.lit(0.0)) + step).alias("price"))
        won = bids.groupBy("r").agg(F.max(F.struct("price", F.xxhash64("l").alias("h"), "l", "w")).alias("b")).select("r", "b.price", "b.l", "b.w")
        owned = cut(won if owned is None else won.unionByName(owned.join(won.select("r"), "r", "left_anti").select("r", "price", "l", "w")))
    return pairs.select("l", "r", "w").limit(0) if owned is None else owned.select("l", "r", "w")


def assign(pairs: DataFrame, *, double: float, mutual: float = 5.0, offset: float = 2.0, solve_at: int = 1000, step: float = 0.05) -> DataFrame:
    """Pairs (l, r, slot, score) chosen one to one within a slot, and the double entries of chosen records.

    The choice has the greatest sum of scores above ``offset`` (log-odds of the
    confidences). A pair is chosen at once when it outweighs the best other
    pair of its l and that of its r together, as then a greatest choice has it.
    What is left is solved per connected component of at most ``solve_at``
    records; larger components are assigned by auction, within ``step`` a
    record of the greatest sum. A pair that isn't chosen is one of double
    entries if its score is ``double`` or more and one of its records has no
    partner, or if its score and that of its partners' pair are ``mutual`` or more.
    """
    ship(pairs.sparkSession)
    pairs = cut(pairs)
    left, parts = pairs.withColumn("w", F.col("score") - offset).filter("w > 0"), []
    while True:
        # A record has a bounded number of pairs, those of its windows.
        ranked = left
        for side in ("l", "r"):
            w = Window.partitionBy(side, "slot").orderBy(F.desc("w"), F.xxhash64("l", "r"), "l", "r")
            ranked = ranked.withColumn(f"rank_{side}", F.row_number().over(w)).withColumn(f"next_{side}", F.coalesce(F.lead("w").over(w), F.lit(0.0)))
        now = cut(ranked.filter("rank_l = 1 and rank_r = 1 and w >= next_l + next_r").select("l", "r", "slot", "score"))
        if now.isEmpty():
            break
        parts.append(now)
        left = cut(left.join(now.select("l", "slot"), ["l", "slot"], "left_anti").join(now.select("r", "slot"), ["r", "slot"], "left_anti"))
    if not left.isEmpty():
        parts.append(cut(_solved(left, solve_at, step)))
    chosen = parts[0] if parts else pairs.limit(0)
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    chosen = cut(chosen)
    rest = pairs.filter(F.col("score") >= double).join(chosen.select("l", "r", "slot"), ["l", "r", "slot"], "left_anti")
    rest = rest.join(chosen.select("l", "slot", F.col("r").alias("r2")), ["l", "slot"], "left").join(chosen.select("r", "slot", F.col("l").alias("l2")), ["r", "slot"], "left")
    strong = pairs.filter(F.col("score") >= mutual).select(F.col("l").alias("l2"), F.col("r").alias("r2"), "slot", F.lit(True).alias("strong"))
    rest = rest.join(strong, ["l2", "r2", "slot"], "left").filter((F.col("l2").isNull() | F.col("r2").isNull()) | (F.col("strong") & (F.col("score") >= mutual)))
    return chosen.unionByName(rest.select("l", "r", "slot", "score"))


def _solved(left: DataFrame, solve_at: int, step: float) -> DataFrame:
    """The greatest choice among the pairs (l, r, slot, score, w) that need weighing against each other."""
    # Records of a slot as nodes of the graph of pairs.
    left = left.withColumn("a", F.xxhash64(F.lit(0), "l", "slot")).withColumn("b", F.xxhash64(F.lit(1), "r", "slot"))
    named = components(left.select("a", "b"))
    sized = named.groupBy("component").agg(F.count(F.lit(1)).alias("records"))
    parted = cut(left.join(named.withColumnRenamed("node", "a"), "a").join(sized, "component"))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        rows, columns = pd.factorize(f["a"])[0], pd.factorize(f["b"])[0]
        weights, at = np.zeros((rows.max() + 1, columns.max() + 1)), {}
        for k, (i, j, w) in enumerate(zip(rows, columns, f["w"])):
            weights[i, j], at[i, j] = w, k
        return f.iloc[sorted(at[p] for p in best_assignment(weights) if p in at)][["l", "r", "slot", "score"]]

    small = parted.filter(F.col("records") <= solve_at).groupBy("component").applyInPandas(solve, left.select("l", "r", "slot", "score").schema)
    large = parted.filter(F.col("records") > solve_at)
    if large.isEmpty():
        return small
    won = auction(large.select(F.col("a").alias("l"), F.col("b").alias("r"), "w"), step).select(F.col("l").alias("a"), F.col("r").alias("b"))
    return small.unionByName(large.join(won, ["a", "b"]).select("l", "r", "slot", "score"))


COMPARED = {"name": "string", "core": "string", "state": "string", "area": "double", "biome": "string", "y": "double", "x": "double", "slot": "int"}


def _folded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that differ in some compared field, under the smallest id of their equals, and (id, member) of all."""
    typed = df.select(F.col("id").cast("long").alias("member"), *[F.col(c).cast(kind).alias(c) for c, kind in COMPARED.items()])
    # Windows would hold a run of equals in one task; the smallest id is aggregated before the shuffle instead.
    records = cut(typed.groupBy(*COMPARED).agg(F.min("member").alias("id"), F.count(F.lit(1)).alias("n")))
    folded = records.filter("n > 1").select("id", *[F.col(c).alias(f"f_{c}") for c in COMPARED])
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in COMPARED]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return records.select("id", *COMPARED), typed.join(folded, on).select("id", "member")


def match_places(left: DataFrame, right: DataFrame, *, window: int = 12, least: float = 2.4, double: float = 4.0, common: float = 0.003) -> DataFrame:
    """(l, r, confidence): the pairs of records of one place.

    Both sides have id, name, state, area, biome, y, x, and the right side slot
    (records of different slots, such as vintages, don't compete for a
    partner). NULL fields are no evidence; records without a name, or with an
    empty one, are in no order and come in no pair. Ids must be unique; exact
    repeats of a row count once, and rows equal in all but the id all come out.
    An empty side gives no rows. Names are compared by words that are rare in
    these tables (in under ``common`` of the records), the longest first. A
    record can match one record per slot, and double entries of it.
    """
    sides = []
    for df in (left, right):
        df = df if "slot" in df.columns and len(sides) else df.withColumn("slot", F.lit(0))
        df = df.dropDuplicates(["id"]).withColumn("words", name_words(F.col("name"))).filter(F.size("words") > 0)
        # The words are taken apart once.
        sides.append(cut(df.select("id", "words", F.concat_ws("", "words").alias("name"), *[c for c in COMPARED if c not in ("name", "core")])))
    every = sides[0].select("words").unionByName(sides[1].select("words"))
    n = every.count()
    # At most (words of a name) / common words.
    usual = [r["w"] for r in every.select(F.explode("words").alias("w")).groupBy("w").count().filter(F.col("count") > F.greatest(F.lit(1), F.lit(common * n))).collect()]
    common_words = F.array(*[F.lit(w) for w in usual]).cast("array<string>")
    rare = F.array_except("words", common_words)
    # A misspelt common word isn't what tells a name from others.
    own = F.filter(rare, lambda w: ~F.exists(common_words, lambda u: (F.length(u) >= 5) & (F.levenshtein(u, w, 2) >= 0)))
    longest = F.coalesce(*[F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"] for ws in (own, rare)])
    sides = [df.withColumn("core", F.coalesce(longest, F.col("name"))).drop("words") for df in sides]
    (l, l_members), (r, r_members) = _folded(sides[0]), _folded(sides[1])
    c = F.col
    located = c("y").isNotNull() & c("x").isNotNull()
    # What a long run of equal names is sorted by: the point, or the area in any of the units (which differ by factors of 100).
    point = F.coalesce(F.when(located, F.format_string("%07.3f/%07.3f", c("y") + 90, c("x") + 180)), F.lit("~"))
    log = F.log(c("area")) / 4.605170186
    size = F.coalesce(F.when(c("area") > 0, F.format_string("%06.4f", log - F.floor(log))), F.lit("~"))
    cell = F.concat_ws("/", F.floor(c("y") * 10), F.floor(c("x") * 10))
    keys = [
        F.concat_ws("|", c("core"), c("name"), point),
        F.concat_ws("|", F.reverse(c("core")), c("name"), size),
        F.when(c("state").isNotNull(), F.concat_ws("|", c("state"), c("core"), c("name"), size)),
        F.when(c("state").isNotNull(), F.concat_ws("|", c("state"), F.reverse(c("core")), c("name"), point)),
        F.when(located, F.concat_ws("|", cell, c("core"), size)),
        F.concat_ws("|", F.regexp_replace(c("core"), "[aeiouyh]|(.)(?=\\1)", ""), c("state"), c("name"), size),
    ]
    near = (F.levenshtein("l_core", "r_core", 2) >= 0) | (F.levenshtein("l_name", "r_name", 3) >= 0)  # -1 beyond the threshold
    met = sorted_neighbours(l, r, keys, window, ["name", "core"], near)
    fields = [f for f in COMPARED if f not in ("core", "slot")]
    both = met.join(l.select(c("id").alias("l"), F.struct(*fields).alias("a")), "l").join(r.select(c("id").alias("r"), "slot", F.struct(*fields).alias("b")), "r")
    pairs = both.select("l", "r", "slot", place_score(c("a"), c("b")).alias("score")).filter(F.col("score") >= least)
    chosen = assign(pairs, double=double)
    # Folded records are unfolded; the others are their own only member.
    for side, members in (("l", l_members), ("r", r_members)):
        chosen = chosen.join(members.select(c("id").alias(side), "member"), side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    return chosen.select("l", "r", (1 / (1 + F.exp(2.0 - c("score")))).alias("confidence"))
