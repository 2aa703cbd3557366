"""Text, number and date expressions for messy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "ÁÂÃÀÄÉÊÈËÍÎÌÏÓÔÕÒÖÚÛÙÜÇÑáâãàäéêèëíîìïóôõòöúûùüçñ"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn"


def normalise_text(c: Column | str) -> Column:
    """Upper case without accents, white space collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\s+", " ")))


def name_without_state(c: Column | str) -> Column:
    """The name of ``Name (UF)``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"\s*\([A-Za-z]{2}\)\s*$", ""))


def clean_number(c: Column | str, missing: Sequence[float] = (-9999.0, -999.0)) -> Column:
    """A number with a decimal comma or point; NULL for other texts and the marks of missing values."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c)
    # 1.234,5 has points between thousands; 1234,5 and 1234.5 don't.
    text = F.when(text.rlike(r"^-?\d{1,3}(\.\d{3})+,\d+$"), F.translate(text, ".", "")).otherwise(text)
    number = F.when(text.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)$"), F.regexp_replace(text, ",", ".")).try_cast("double")
    return F.when(~number.isin(*[float(m) for m in missing]), number)


def station_code(c: Column | str) -> Column:
    """A letter and three digits, else the first run of digits as a number."""
    c = F.col(c) if isinstance(c, str) else c
    letter = F.upper(F.regexp_extract(c, r"([A-Za-z]\d{3})", 1))
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(letter != "", letter).when(digits != "", digits.cast("long").cast("string"))


def first_date(c: Column | str, formats: Sequence[str] = ("yyyy/M/d", "yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy")) -> Column:
    """The date by the first format that fits the row's own text, else NULL; years of two digits are 20xx."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats]).cast("date")


def decode_offset_time(value: Column | str, unit: str, origin: str) -> Column:
    """A timestamp of ``<unit> since <origin>``."""
    seconds = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit]
    v = F.col(value) if isinstance(value, str) else value
    return F.timestamp_micros((F.unix_micros(F.to_timestamp(F.lit(origin))) + F.round(v * seconds * 1000000)).cast("long"))


def decode_text_time(value: Column | str) -> Column:
    """A timestamp from yyyymmdd (with a fraction of a day as its decimals, if any), yyyymmddhh or an ISO text; NULL where it's none."""
    v = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    day = F.try_to_timestamp(F.substring(v, 1, 8), F.lit("yyyyMMdd"))
    part = F.coalesce(F.regexp_extract(v, r"^\d{8}(\.\d+)$", 1).try_cast("double"), F.lit(0.0))
    dated = F.when(v.rlike(r"^\d{8}(\.\d*)?$"), F.timestamp_micros((F.unix_micros(day) + F.round(part * 86400) * 1000000).cast("long")))
    hourly = F.when(v.rlike(r"^\d{10}$"), F.try_to_timestamp(v, F.lit("yyyyMMddHH")))
    return F.coalesce(dated, hourly, F.when(v.contains("-"), v.try_cast("timestamp")))


def category_rank(value: Column | str, order: Sequence[str]) -> Column:
    """The place of a category in a fixed order, in any case; those that it lacks, and NULL, come behind all."""
    v = F.lower(F.col(value) if isinstance(value, str) else value)
    at = F.array_position(F.array(*[F.lit(x.lower()) for x in order]), v)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1)).cast("int")


def repair_coordinates(lat: Column, lon: Column, box: tuple[float, float, float, float] = (-35.0, 6.0, -75.0, -32.0), scales: Sequence[float] = (1, 10, 100, 1000)) -> Column:
    """A struct (lat, lon, changed): the candidate of scale, sign and order inside ``box`` with the fewest changes, else NULL."""
    candidates = [
        F.struct(F.lit(i * 100 + j * 10 + (2 if turn else 0) + (1 if flip else 0)).alias("changed"), (a / s).alias("lat"), ((-b if flip else b) / r).alias("lon"))
        for turn in (False, True)
        for a, b in ((lon, lat),) * turn or ((lat, lon),)
        for flip in (False, True)
        for i, s in enumerate(scales)
        for j, r in enumerate(scales)
    ]
    inside = F.filter(F.array(*candidates), lambda p: p["lat"].between(box[0], box[1]) & p["lon"].between(box[2], box[3]))
    best = F.array_min(inside)
    return F.when(F.size(inside) > 0, F.struct(best["lat"].alias("lat"), best["lon"].alias("lon"), (best["changed"] > 0).alias("changed")))
