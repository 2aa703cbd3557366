"""One UTC instant from date and time texts in many notations and zones.

Every notation is a branch of one regular expression with named groups. The
expression is applied once to the date and time fields joined by a separator,
with full-width characters folded to ASCII; its components come out as one delimited string. Calendar and clock ranges are
then checked, and the instant is put together with integer day arithmetic.
Local times of a legal zone are resolved with a small table of the zone's
offset changes: a local time that occurred twice or never gives no instant.
"""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_right
from collections.abc import Mapping
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Abbreviations of Brazilian legal time, hours from UTC.
ABBREVIATIONS = {"BRT": -3, "BRST": -2, "AMT": -4, "AMST": -3, "ACT": -5, "ACST": -4, "FNT": -2, "FNST": -1}

# Month names, Portuguese and English, by their first letters.
MONTHS = {
    "jan": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12,
}

# Time zone of each state's capital.
STATE_ZONES = {
    "AC": "America/Rio_Branco", "AL": "America/Maceio", "AM": "America/Manaus", "AP": "America/Belem",
    "BA": "America/Bahia", "CE": "America/Fortaleza", "DF": "America/Sao_Paulo", "ES": "America/Sao_Paulo",
    "GO": "America/Sao_Paulo", "MA": "America/Fortaleza", "MG": "America/Sao_Paulo", "MS": "America/Campo_Grande",
    "MT": "America/Cuiaba", "PA": "America/Belem", "PB": "America/Fortaleza", "PE": "America/Recife",
    "PI": "America/Fortaleza", "PR": "America/Sao_Paulo", "RJ": "America/Sao_Paulo", "RN": "America/Fortaleza",
    "RO": "America/Porto_Velho", "RR": "America/Boa_Vista", "RS": "America/Sao_Paulo", "SC": "America/Sao_Paulo",
    "SE": "America/Maceio", "SP": "America/Sao_Paulo", "TO": "America/Araguaina",
}

# Names of the states without accents, in lower case.
STATE_NAMES = {
    "acre": "AC", "alagoas": "AL", "amazonas": "AM", "amapa": "AP", "bahia": "BA", "ceara": "CE",
    "distrito federal": "DF", "espirito santo": "ES", "goias": "GO", "maranhao": "MA", "minas gerais": "MG",
    "mato grosso do sul": "MS", "mato grosso": "MT", "para": "PA", "paraiba": "PB", "pernambuco": "PE",
    "piaui": "PI", "parana": "PR", "rio de janeiro": "RJ", "rio grande do norte": "RN", "rondonia": "RO",
    "roraima": "RR", "rio grande do sul": "RS", "santa catarina": "SC", "sergipe": "SE", "sao paulo": "SP",
    "tocantins": "TO",
}

# Full-width forms of ASCII's printable characters, and the wide space; both strings run in the same order.
FULL_WIDTH = "\u3000" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
ASCII = " " + "".join(map(chr, range(0x21, 0x7F)))

#: Years for which offset changes are looked up.
FIRST_YEAR, LAST_YEAR = 1970, 2100

SEPARATOR = "\u0001"
_MONTH = "jan|fev|feb|mar|abr|apr|mai|may|jun|jul|ago|aug|set|sep|out|oct|nov|dez|dec"
_ZONE = (
    r"(?:(?<zulu{n}>Z|UTC|GMT)|(?:UTC|GMT)?(?<sign{n}>[+-])(?<offh{n}>\d{{1,2}})(?::?(?<offm{n}>\d{{2}}))?|\(?(?<abbr{n}>"
    + "|".join(ABBREVIATIONS)
    + r")\)?)?"
)
_DATE = (
    r"(?:(?<ya{n}>\d{{4}})[-/.](?<ma{n}>\d{{1,2}})[-/.](?<da{n}>\d{{1,2}})"
    r"|(?<yb{n}>\d{{4}})(?<mb{n}>\d{{2}})(?<db{n}>\d{{2}})"
    r"|(?<dc{n}>\d{{1,2}})[-/. ](?<mc{n}>\d{{1,2}}|(?:" + _MONTH + r")[a-zç]*\.?)[-/. ](?<yc{n}>\d{{4}}|\d{{2}}))"
)
_CLOCK = (
    r"(?:(?<ha{n}>\d{{1,2}})[:h](?<na{n}>\d{{2}})(?::(?<sa{n}>\d{{2}})(?:[.,](?<fa{n}>\d{{1,9}}))?)?(?:\s*(?<half{n}>[AP])\.?M\.?)?"
    r"|(?<hs{n}>\d{{2}})(?<ns{n}>\d{{2}})(?<ss{n}>\d{{2}})|(?<bare{n}>\d{{1,4}}))"
)
_EPOCH = r"(?<millis{n}>\d{{13}})|(?<secs{n}>\d{{9,10}})"


def _pattern() -> str:
    """The alternation: a whole moment in either field, or a date field and a clock field."""
    whole = r"(?:" + _EPOCH + "|" + _DATE + r"[T\s]\s*" + _CLOCK + r"\s*" + _ZONE + ")"
    s = SEPARATOR
    anything = f"[^{s}]*"
    return (
        "^(?i)(?:"
        + rf"{anything}{s}\s*" + whole.format(n="x") + r"\s*"
        + rf"|\s*" + whole.format(n="y") + rf"\s*{s}{anything}"
        + rf"|\s*" + _DATE.format(n="z") + rf"\s*{s}\s*" + (_CLOCK + r"\s*" + _ZONE).format(n="z") + r"\s*"
        + ")$"
    )


PATTERN = _pattern()
# Components by the stems of their groups; as only one branch of a component matches, its groups are written one behind another.
_COMPONENTS = {
    "millis": ["millis"], "secs": ["secs"], "year": ["ya", "yb", "yc"], "month": ["ma", "mb", "mc"], "day": ["da", "db", "dc"], "hour": ["ha", "hs"], "minute": ["na", "ns"], "second": ["sa", "ss"],
    "fraction": ["fa"], "half": ["half"], "bare": ["bare"], "zulu": ["zulu"], "sign": ["sign"], "offh": ["offh"], "offm": ["offm"], "abbr": ["abbr"],
}
_GROUPS = set(re.findall(r"\(\?<([a-z]+)>", PATTERN))
# A last field tells that the text matched.
_FIELDS = SEPARATOR.join(["".join(f"${{{stem + n}}}" for stem in stems for n in "xyz" if stem + n in _GROUPS) for stems in _COMPONENTS.values()] + ["1"])
_NUMBERS = {"millis": "bigint", "secs": "bigint", "day": "int", "hour": "int", "minute": "int", "second": "int", "offh": "int", "offm": "int"}
_SCHEMA = ", ".join(f"{c} {_NUMBERS.get(c, 'string')}" for c in _COMPONENTS) + ", matched int"


def state_code(c: Column) -> Column:
    """Two-letter code of a state that may be written out, in any case, with or without accents; NULL if unknown."""
    plain = F.lower(F.trim(F.translate(c, "ÁÂÃÀÉÊÍÓÔÕÚÇáâãàéêíóôõúç", "AAAAEEIOOOUCaaaaeeiooouc")))
    known = STATE_NAMES | {code.lower(): code for code in STATE_ZONES}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), plain)


@lru_cache(maxsize=None)
def _stretches(name: str, first_year: int, last_year: int) -> list[tuple[int, int, int | None]]:
    """(local from, local to, offset) of one zone; changes under five days apart would be missed."""
    zone, utc = ZoneInfo(name), dt.timezone.utc

    def offset(t: int) -> int:
        return int(dt.datetime.fromtimestamp(t, utc).astimezone(zone).utcoffset().total_seconds())

    lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=utc).timestamp()) for y in (first_year, last_year))
    rows, start, now, step = [], -(2**53), offset(lo), 5 * 86400
    for at in range(lo, hi, step):
        if (then := offset(at + step)) != now:
            a, b = at, at + step
            while b - a > 1:
                a, b = ((a + b) // 2, b) if offset((a + b) // 2) == now else (a, (a + b) // 2)
            edges = sorted((b + now, b + then))
            rows += [(start, edges[0], now), (edges[0], edges[1], None)]
            start, now = edges[1], then
    return [*rows, (start, 2**53, now)]


def zone_segments(spark: SparkSession, zones: Mapping[str, str], first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """Stretches of local time per key of ``zones`` and local year with their one offset; NULL offset where a local time is doubled or absent.

    The first and the last year also hold what lies before and behind them.
    The table holds a few rows per zone and year: bounded by the zone rules,
    not by the data.
    """
    starts = [int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp()) for y in range(first_year, last_year + 2)]
    rows = []
    for key, name in zones.items():
        for a, b, offset in _stretches(name, first_year, last_year):
            first, last = (min(max(bisect_right(starts, t) - 1, 0), last_year - first_year) for t in (a, b - 1))
            rows += [(key, first_year + i, a, b, offset) for i in range(first, last + 1)]
    return spark.createDataFrame(rows, "zone_key string, year int, local_from long, local_to long, offset_s int")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date from year 1 on, in integer arithmetic; years begin in March, so leap days end them."""
    year = y - F.when(m <= 2, 1).otherwise(0)
    month = m + F.when(m > 2, -3).otherwise(9)
    div = lambda a, n: F.call_function("div", a, F.lit(n))
    return (year * 365 + div(year, 4) - div(year, 100) + div(year, 400) + div(month * 153 + 2, 5) + d - 719469).cast("long")


def parse_instants(
    df: DataFrame,
    date_col: str,
    time_col: str,
    *,
    clock_col: str | None = None,
    zone_key: Column | None = None,
    zones: Mapping[str, str] = STATE_ZONES,
    out: str = "utc_us",
) -> DataFrame:
    """Add ``out``: microseconds since 1970 UTC of the moment in two text columns.

    A zone, offset, abbreviation or epoch number in the texts decides; else
    ``clock_col`` = local (any case) means the legal time of the zone named by
    ``zone_key`` in ``zones``; else UTC. NULL, empty, unreadable and impossible
    texts, unknown zones, and local times that occurred twice or never give
    NULL. All rows are kept, repeated rows too, and other columns pass through
    under their own names (a column named ``out`` is replaced).
    """
    spark, names = df.sparkSession, df.columns
    joined = F.concat_ws(SEPARATOR, F.coalesce(F.col(f"`{date_col}`"), F.lit("")), F.coalesce(F.col(f"`{time_col}`"), F.lit("")))
    # The expression's classes are ASCII only, so full-width digits and marks are folded before it.
    tidy = F.regexp_replace(F.translate(joined, FULL_WIDTH, ASCII), "[\\u00a0\\u2007\\u202f\\s]+", " ")
    is_local = F.lower(F.trim(F.col(f"`{clock_col}`"))) == "local" if clock_col else F.lit(False)
    # The input's own columns travel in one struct, so no name of theirs can clash.
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), tidy.alias("__text"), is_local.alias("__is_local"), (zone_key if zone_key is not None else F.lit(None).cast("string")).alias("__zone_key"))
    tidy = F.col("__text")
    # A text that doesn't match stays as it is, so its last field is missing. One call reads and types all components.
    read = F.from_csv(F.regexp_replace(tidy, F.lit(PATTERN), F.lit(_FIELDS)), _SCHEMA, {"sep": SEPARATOR})
    parsed = df.withColumn("__p", read).withColumn("__p", F.when(F.col("__p.matched") == 1, F.col("__p")))
    part = lambda c: F.col(f"__p.{c}")
    month = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.lower(F.substring(part("month"), 1, 3))), part("month").try_cast("int"))
    bare = F.lpad(part("bare"), 4, "0")
    abbr = F.try_element_at(F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 3600)]), F.upper(part("abbr")))
    minutes = F.coalesce(part("offm"), F.lit(0))
    parsed = parsed.withColumns(
        {
            "__epoch": F.coalesce(part("millis") * 1000, part("secs") * 1000000),
            "__mo": month,
            "__d": part("day"),
            "__y": part("year").cast("int") + F.when(F.length(part("year")) == 2, 2000).otherwise(0),
            "__h0": F.coalesce(part("hour"), F.substring(bare, 1, 2).cast("int")),
            "__n": F.coalesce(part("minute"), F.substring(bare, 3, 2).cast("int")),
            "__s": F.coalesce(part("second"), F.lit(0)),
            "__us": F.coalesce(F.rpad(F.substring(part("fraction"), 1, 6), 6, "0").cast("int"), F.lit(0)),
            "__half": F.upper(part("half")),
            "__zone_s": F.coalesce(F.when(part("zulu").isNotNull(), 0), F.when(part("sign") == "-", -1).otherwise(1) * (part("offh") * 3600 + minutes * 60), abbr),
            "__zone_ok": F.coalesce((part("offh") <= 18) & (minutes < 60), F.lit(True)),
        }
    )
    h0, half = F.col("__h0"), F.col("__half")
    hour = F.when(half.isNull(), h0).when(h0.between(1, 12), h0 % 12 + F.when(half == "P", 12).otherwise(0))
    y, m, d, n, s, us = (F.col(c) for c in ("__y", "__mo", "__d", "__n", "__s", "__us"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    whole = (F.col("__h") == 24) & (n == 0) & (s == 0) & (us == 0) & half.isNull()
    valid = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest) & n.between(0, 59) & s.between(0, 59) & (F.col("__h").between(0, 23) | whole) & F.col("__zone_ok")
    local = F.when(valid, days_from_civil(y, m, d) * 86400 + F.col("__h") * 3600 + n * 60 + s)
    parsed = parsed.withColumn("__h", hour).withColumn("__local", local)
    needs = F.col("__local").isNotNull() & F.col("__zone_s").isNull() & F.col("__epoch").isNull() & F.coalesce("__is_local", F.lit(False))
    parsed = parsed.withColumn("__needs", needs).withColumn("__key", F.when(F.col("__needs"), F.col("__zone_key")))
    # One segment holds each local time, so the join keeps the number of rows.
    segments = F.broadcast(zone_segments(spark, zones).toDF("__zk", "__zy", "__zf", "__zt", "__zo"))
    year = F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), F.col("__y")))
    parsed = parsed.join(segments, (F.col("__key") == F.col("__zk")) & (year == F.col("__zy")) & (F.col("__local") >= F.col("__zf")) & (F.col("__local") < F.col("__zt")), "left")
    offset = F.when(F.col("__needs"), F.col("__zo")).otherwise(F.coalesce(F.col("__zone_s"), F.lit(0)))
    instant = F.coalesce(F.col("__epoch"), (F.col("__local") - offset) * 1000000 + us)
    return parsed.select(*[F.col("__row")[c].alias(c) for c in names if c != out], instant.alias(out))
