"""Readers of station text files, and resolution of columns in tables of unknown layout."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veranico.functions.text import ACCENTED, PLAIN, clean_number, first_date, station_code
from veranico.functions.thermo import wrap_longitude

# Names that columns of gridded and station tables go by.
ALIASES = {
    "valid_time": "time", "latitude": "lat", "longitude": "lon", "var167": "t2m", "var168": "d2m",
    "var165": "u10", "var166": "v10", "swvl1": "sm1", "var39": "sm1",
}


def plain_name(name: str) -> str:
    """A column's name without accents, case and marks."""
    text = unicodedata.normalize("NFKD", name)
    return re.sub(r"[^a-z0-9]+", "", "".join(c for c in text if not unicodedata.combining(c)).lower())


def find_column(columns: Sequence[str], candidates: Sequence[str], required: bool = False) -> str | None:
    """The first column equal to a candidate (names made plain), else the first that contains one."""
    plain = {c: plain_name(c) for c in columns}
    for test in (lambda name, want: name == want, lambda name, want: want in name):
        for want in map(plain_name, candidates):
            for column, name in plain.items():
                if test(name, want):
                    return column
    if required:
        raise ValueError(f"none of {list(candidates)} is among {list(columns)}")
    return None


def standardise_grid(df: DataFrame, required: Sequence[str], box: tuple[float, float, float, float] = (-35.0, 6.0, -75.0, -32.0)) -> DataFrame:
    """Columns by their standard names, longitudes in -180..180, rows inside ``box``; of several expver the highest value per key stays."""
    df = df.withColumnsRenamed({c: ALIASES[c.lower()] for c in df.columns if c.lower() in ALIASES})
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    df = df.withColumn("lon", wrap_longitude("lon")).filter(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
    if "expver" in df.columns:
        keys = [c for c in ("time", "lat", "lon") if c in df.columns]
        df = df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in df.columns if c not in keys and c != "expver"])
    return df


def read_years(spark: SparkSession, folder: str, years: Sequence[int] | None = None) -> DataFrame:
    """Parquet files below ``folder`` by year= partitions; a list of years prunes the scan."""
    df = spark.read.parquet(folder)
    return df.filter(F.col("year").isin(*years)) if years else df


# Words that lines before the table of a station file begin with.
PREAMBLE = {"station_id": "codigo|wmo|station|cod", "station_name": "estacao|nome", "region": "regiao", "uf": "uf", "lat": "latitude", "lon": "longitude", "altitude_m": "altitude"}


def read_station_text(spark: SparkSession, path: str, encoding: str | None = None, preamble: int = 25, separator: str = ";", header: Sequence[str] = ("data", "hora"), search: int = 100) -> DataFrame:
    """Hourly rows of station files: (file, the entries of PREAMBLE, obs_date, hour_text, fields).

    A file has lines of a word and a value, with the separator or a colon
    between them, then a header, then rows, of which only those that start with
    a date are kept. The header is the first of the ``search`` first lines in
    which each word of ``header`` begins a field, in any order, case and with
    or without accents; date and hour are the fields of its first two words.
    Without an ``encoding`` a file is read as UTF-8 where it is valid, else as
    Latin-1. ``fields`` is a map from plain column name to number, so short and
    long rows both fit; cells beyond the header have no name and are left out.
    A file without a header gives no rows, and an entry that the preamble
    lacks is NULL, the station's code then being that of the file's name.
    Files are bounded by a station-year.
    """
    raw = spark.read.format("binaryFile").load(path).select("content", F.element_at(F.split("path", "/"), -1).alias("file"))
    value = F.decode("content", encoding) if encoding else F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    text, sep = raw.select(F.ltrim(value, F.lit("\ufeff")).alias("value"), "file"), f"\\Q{separator}\\E"
    plain = lambda x: F.regexp_replace(F.lower(F.translate(x, ACCENTED, PLAIN)), r"[^a-z0-9]+", "_")
    cells = lambda x: F.transform(F.split(x, sep), lambda c: F.trim(plain(c), F.lit("_")))
    starting = lambda word: lambda c: c.startswith(plain_name(word))
    lines = text.withColumn("lines", F.split("value", "\r?\n"))
    is_header = lambda x: reduce(and_, [F.exists(cells(x), starting(w)) for w in header])
    lines = lines.withColumn("header", F.get(F.filter(F.slice("lines", 1, search), is_header), F.lit(0))).filter("header is not null").withColumn("names", cells("header"))
    place = lambda word: F.array_position(F.transform("names", starting(word)), True).cast("int") - 1
    # The part before the first separator or colon, and the first value behind it.
    entry = lambda words: F.get(F.filter(F.slice("lines", 1, preamble), lambda x: F.lower(F.translate(x, ACCENTED, PLAIN)).rlike(rf"^\s*({words})\b[^:{re.escape(separator)}]*[:{re.escape(separator)}]")), F.lit(0))
    behind = lambda line: F.nullif(F.trim(F.regexp_extract(line, rf"^[^:{re.escape(separator)}]*[:{re.escape(separator)}]+\s*([^{re.escape(separator)}]*)", 1)), F.lit(""))
    found = lines.select("file", "names", place(header[0]).alias("day_at"), place(header[1]).alias("hour_at"), *[behind(entry(words)).alias(name) for name, words in PREAMBLE.items()], F.explode("lines").alias("line"))
    rows = found.withColumn("cells", F.split("line", sep)).withColumn("day", F.trim(F.get("cells", F.col("day_at"))))
    rows = rows.filter(F.col("day").rlike(r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})$"))
    named = F.transform("names", lambda n, i: F.struct(n.alias("k"), F.when(~i.isin(F.col("day_at"), F.col("hour_at")), clean_number(F.get("cells", i))).alias("v")))
    fields = F.map_from_entries(F.array_distinct(F.filter(named, lambda e: (e["k"] != "") & e["v"].isNotNull())))
    code = F.coalesce(station_code("station_id"), F.upper(F.nullif(F.regexp_extract("file", r"(?:^|_)([A-Za-z]\d{3})(?:_|\.)", 1), F.lit(""))))
    numbers = [clean_number(c).alias(c) for c in ("lat", "lon", "altitude_m")]
    return rows.select("file", code.alias("station_id"), "station_name", "region", F.upper("uf").alias("uf"), *numbers, first_date("day").alias("obs_date"), F.get("cells", F.col("hour_at")).alias("hour_text"), fields.alias("fields"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its ending: parquet, csv, json or orc."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind in ("parquet", "json", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"no reader for .{kind}: convert NetCDF, workbooks and shapefiles to Parquet first")


def trusted_stations(df: DataFrame, flags: Mapping[str, Sequence[str]], key: str = "station_id") -> DataFrame:
    """Distinct keys of rows where any flag column has one of its spellings, in any case."""
    hit = F.lit(False)
    for column, spellings in flags.items():
        hit = hit | F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin(*[s.lower() for s in spellings]), F.lit(False))
    return df.filter(hit).select(key).filter(F.col(key).isNotNull()).distinct()
