"""Session settings, shared folders and small helpers used by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "veranico", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir); a local one only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="veranico-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as spark-submit --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="veranico-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_if_nan(c: Column | str) -> Column:
    """Missing is NULL everywhere: NaN becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(c)


def clean_missing(df: DataFrame) -> DataFrame:
    """NaN to NULL in every float and double column."""
    return df.withColumns({f.name: null_if_nan(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys where NULL is a key like any other; without keys, ``right`` is one row for all."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row of totals
    names = {k: fresh(f"k{i}") for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    on = [left[f"`{k}`"].eqNullSafe(renamed[n]) for k, n in names.items()]
    return left.join(renamed, on, how).drop(*names.values())


def fresh(stem: str) -> str:
    """A column name that no input has."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, before a step that is heavy on CPU, where its files give fewer.

    Fewer splits than cores hold a small input, so the shuffle is small; other inputs stay as they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def parallel(df: DataFrame, per_core: int = 2) -> int:
    """Partitions for a step that is heavy on CPU."""
    return max(df.sparkSession.sparkContext.defaultParallelism * per_core, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
