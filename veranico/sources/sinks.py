"""Tables and run records written through Spark's commit protocol, and reuse of results whose inputs are the same."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable, Mapping

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, folder: str, name: str, *, csv: bool = True) -> None:
    """Parquet, and CSV beside it; a reader never sees half a table."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    if csv:
        flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, kind in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def save_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Several tables, one directory each."""
    for name, df in tables.items():
        save_table(df, folder, name)


def run_record(spark: SparkSession, folder: str, parameters: Mapping[str, object]) -> None:
    """Parameters and versions of a run as one line of JSON."""
    record = {"parameters": dict(parameters), "spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version()}
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run.json")


def reuse(spark: SparkSession, path: str, stamp: Mapping[str, object], make: Callable[[], DataFrame]) -> DataFrame:
    """The table made with this ``stamp`` below ``path``; made and written where there is none.

    Each stamp has a folder of its own, named by its digest, and its mark is
    written after the data, so neither a broken write nor another stamp's data
    is ever read. Folders of older stamps stay.
    """
    want = json.dumps(dict(stamp), sort_keys=True, default=str)
    path = f"{path.rstrip('/')}/{hashlib.sha256(want.encode()).hexdigest()[:24]}"
    try:
        if spark.read.text(f"{path}.stamp").first()[0] == want:
            return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.stamp")
    return spark.read.parquet(path)
