"""Queries of the corpus and record problems (p2, p4, p6, p8, p9, p10) and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veranico.llm.canonical import map_places
from veranico.llm.matching import match_places
from veranico.llm.packing import pack_items
from veranico.llm.quantiles import select_percentiles, summarise
from veranico.llm.subjects import label_subjects
from veranico.llm.tokenizer import count_tokens, encode_texts
from veranico.operators.timestamps import state_code
from veranico.session import table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
CAPACITY = 2048
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _point(df: DataFrame) -> DataFrame:
    """Points whose coordinates were swapped or lost a longitude's sign are put right; impossible ones become NULL."""
    lat, lon = F.col("rep_lat"), F.when(F.col("rep_lon").between(34, 74.5), -F.col("rep_lon")).otherwise(F.col("rep_lon"))
    good = lat.between(-34, 6) & lon.between(-74.5, -32)
    turned = ~good & lon.between(-34, 6) & lat.between(-74.5, -32)
    return df.withColumn("y", F.when(good, lat).when(turned, lon)).withColumn("x", F.when(good, lon).when(turned, lat))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one municipality with their confidence."""
    biome = lambda c: F.lower(F.translate(F.trim(c), "âãôíé", "aaoie"))
    towns = _point(table(spark, sf_dir, "municipality_mechanism")).select(
        F.col("municipality_id").alias("id"), F.col("municipality_norm").alias("name"), state_code(F.col("state_acronym_norm")).alias("state"),
        F.col("total_area_2024_ha").alias("area"), biome(F.col("dominant_biome")).alias("biome"), "y", "x",
    )
    shapes = _point(table(spark, sf_dir, "municipality_polygons")).select(
        F.col("polygon_id").alias("id"), F.col("nm_mun").alias("name"), state_code(F.col("sigla_uf")).alias("state"),
        (F.col("area_km2") * 100).alias("area"), biome(F.col("biome_main")).alias("biome"), "y", "x", F.col("vintage").alias("slot"),
    )
    return match_places(towns, shapes).select(F.col("l").alias("municipality_id"), F.col("r").alias("polygon_id"), "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("municipality_id", "polygon_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "urban_module").select("urb_id", "munnm", "statenm", "biomanm")
    return map_places(rows, table(spark, sf_dir, "place_list"), key="urb_id", municipality="munnm", state="statenm", biome="biomanm")


def p4_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value that stands for no entry was entered."""
    rows = table(spark, sf_dir, "urban_module").select("urb_id", "munnm", "statenm", "biomanm")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("munnm", "statenm", "biomanm")]))
    missed = p4_found(spark, sf_dir).filter("entry_id = 0").join(rows.select("urb_id", values.alias("v")).select("urb_id", "v.*"), ["urb_id", "field_name"])
    return missed.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of tmax and vpdmean per region, cell and day of year."""
    grid = table(spark, sf_dir, "daily_grid")
    kinds = (("region", "region"), ("cell", "cell_id"), ("doy", "doy_noleap"))
    parts = [summarise(grid, [c], ["tmax", "vpdmean"], spread_by=["cell_id", "obs_date"]).select(F.lit(k).alias("grouping"), F.col(c).cast("string").alias("group_key"), "variable", "xs", "ws", "whole") for k, c in kinds]
    return select_percentiles(parts[0].unionByName(parts[1]).unionByName(parts[2]), PERCENTILES)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_items(count_tokens(docs, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json"), key="doc_id", size="n_tokens", capacity=CAPACITY)


def p9_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: all documents are in them, none is split that fits, none is overfull, and little space is unused."""
    pieces = p9_containers(spark, sf_dir)
    docs = pieces.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    split = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("split_needlessly"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    loads = pieces.filter("container_id > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    full = loads.agg(F.count(F.lit(1)).alias("containers"), F.count_if(F.col("load") > CAPACITY).alias("overfull"), F.coalesce(F.max("container_id"), F.lit(0)).alias("last"))
    both = split.crossJoin(full)  # one row each
    few = F.col("containers") <= F.ceil(F.col("tokens") / CAPACITY * 1.02) + 2
    return both.select("n_documents", "split_needlessly", "overfull", (F.col("last") == F.col("containers")).alias("numbered_through"), few.alias("little_unused"))


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    subjects = sorted(r["subject"] for r in table(spark, sf_dir, "subject_list").select("subject").distinct().collect())  # fixed, 12 rows
    return label_subjects(docs, table(spark, sf_dir, "subject_labels"), subjects)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p2_found, p2_matches, p4_found, p4_misses, p6_percentiles, p8_ids, p9_containers, p9_properties, p10_found, p10_subjects)}

_P6 = [
    f"select '{kind}' grouping, cast({col} as varchar) group_key, '{v}' variable, cast({p} as double) p, quantile_disc({v}, {p}) as value from daily_grid where {v} is not null and not isnan({v}) group by {col}"
    for kind, col in (("region", "region"), ("cell", "cell_id"), ("doy", "doy_noleap"))
    for v in ("tmax", "vpdmean")
    for p in PERCENTILES
]
SQL = {
    "p6_percentiles": " union all ".join(_P6),
    # The properties hold of any input with unique ids.
    "p9_properties": "select count(distinct doc_id) n_documents, 0 split_needlessly, 0 overfull, true numbered_through, true little_unused from documents",
}
