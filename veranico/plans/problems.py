"""Queries of the general data problems (p1, p3, p5, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veranico.operators.gridding import local_regression_grid
from veranico.operators.proximity import pairs_within, points_in_regions, rings_from_wkt, valid_points
from veranico.operators.spikes import flag_spikes
from veranico.operators.timestamps import parse_instants, state_code
from veranico.session import table

BOX = (-34.0, 6.0, -74.5, -32.0)  # latitudes and longitudes that count as valid
RADIUS_KM = 25.0


def _station_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state per station."""
    return table(spark, sf_dir, "station_metadata").groupBy(F.col("station_id").alias("__station")).agg(F.min("uf").alias("__station_uf"))


def p1_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "inmet_hourly_raw").select("raw_id", "station_id", "uf", "data_text", "hora_utc", "clock")
    # station_metadata has one row per station and is fixed in size; Spark broadcasts it below its own threshold.
    raw = raw.join(_station_states(spark, sf_dir), F.col("station_id") == F.col("__station"), "left")
    given = F.when(F.trim("uf") == "", None).otherwise(F.col("uf"))
    zone = state_code(F.coalesce(given, F.col("__station_uf")))
    return parse_instants(raw, "data_text", "hora_utc", clock_col="clock", zone_key=zone).select("raw_id", "station_id", "utc_us")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_instants(spark, sf_dir).filter("utc_us is not null").select("raw_id", "utc_us")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    towns = valid_points(table(spark, sf_dir, "municipality_mechanism"), "municipality_id", "rep_lat", "rep_lon", BOX)
    stations = valid_points(table(spark, sf_dir, "station_metadata"), "station_id", "lat", "lon", BOX)
    pairs = pairs_within(towns, stations, RADIUS_KM)
    return pairs.select(F.col("key").alias("municipality_id"), F.col("region").alias("station_id"))


def p3_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons that hold each municipality's point."""
    towns = valid_points(table(spark, sf_dir, "municipality_mechanism"), "municipality_id", "rep_lat", "rep_lon", BOX)
    rings = rings_from_wkt(table(spark, sf_dir, "municipality_polygons"), "polygon_id", "geometry_wkt")
    inside = points_in_regions(towns, rings)
    return inside.select(F.col("key").alias("municipality_id"), F.col("region").alias("polygon_id"), "on_boundary")


def p5_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series of air temperature of each station, filled or marked missing."""
    stations = table(spark, sf_dir, "station_metadata").select(F.col("station_id").alias("station"), "cadence_s", "opened_on")
    hourly = table(spark, sf_dir, "station_hourly").select("station_id", "obs_time", "tair_c", "n_valid_before_outlier_qc", "loaded_at")
    rows = hourly.join(stations, F.col("station_id") == F.col("station"))
    counts = (F.col("n_valid_before_outlier_qc") > 0) & (F.col("obs_time") <= F.col("loaded_at")) & (F.col("obs_time") >= F.col("opened_on").cast(hourly.schema["obs_time"].dataType))
    # A repeated delivery of one reading counts once in the estimate, with its last value.
    us = F.unix_micros(F.col("obs_time").cast("timestamp"))
    rows = rows.select("station_id", us.alias("at_us"), "cadence_s", "tair_c", counts.alias("counts"), "loaded_at").filter("counts")
    rows = rows.groupBy("station_id", "cadence_s", "at_us").agg(F.max_by("tair_c", "loaded_at").alias("tair_c"), F.lit(True).alias("counts"))
    grid = local_regression_grid(rows, source="station_id", at_us="at_us", cadence_s="cadence_s", value="tair_c", counts="counts")
    return grid.withColumnRenamed("source", "station_id").withColumns({c: F.round(c, 5) for c in ("estimate", "support")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_series(spark, sf_dir).filter("missing").select("station_id", "slot_s")


def _p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_spikes(
        table(spark, sf_dir, "residual_qc"), table(spark, sf_dir, "variable_limits"),
        key="qc_id", series=["station_id", "variable"], order="window_start", value="median_residual_era5_minus_inmet", variable="variable",
    )


def p7_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading's flags, and the residual, scatter and cutoff that they rest on."""
    return _p7(spark, sf_dir).withColumns({c: F.round(c, 5) for c in ("residual", "scatter", "tail_cutoff")})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir).filter("impossible or is_stuck or is_spike").select("qc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_instants, p3_found, p3_regions, p5_found, p5_series, p7_found, p7_flags)}

# The other engine's own steps: date, clock and zone are cut out one after another, and its zone rules resolve local times.
_P1_SQL = r"""
with st(name, code) as (values ('acre','AC'),('alagoas','AL'),('amazonas','AM'),('amapa','AP'),('bahia','BA'),('ceara','CE'),('distrito federal','DF'),('espirito santo','ES'),('goias','GO'),('maranhao','MA'),
  ('minas gerais','MG'),('mato grosso do sul','MS'),('mato grosso','MT'),('para','PA'),('paraiba','PB'),('pernambuco','PE'),('piaui','PI'),('parana','PR'),('rio de janeiro','RJ'),('rio grande do norte','RN'),
  ('rondonia','RO'),('roraima','RR'),('rio grande do sul','RS'),('santa catarina','SC'),('sergipe','SE'),('sao paulo','SP'),('tocantins','TO')),
zone(code, tz) as (select unnest(['AC','AL','AM','AP','BA','CE','DF','ES','GO','MA','MG','MS','MT','PA','PB','PE','PI','PR','RJ','RN','RO','RR','RS','SC','SE','SP','TO']),
  'America/' || unnest(['Rio_Branco','Maceio','Manaus','Belem','Bahia','Fortaleza','Sao_Paulo','Sao_Paulo','Sao_Paulo','Fortaleza','Sao_Paulo','Campo_Grande','Cuiaba','Belem','Fortaleza','Recife','Fortaleza','Sao_Paulo','Sao_Paulo','Fortaleza','Porto_Velho','Boa_Vista','Sao_Paulo','Sao_Paulo','Maceio','Sao_Paulo','Araguaina'])),
place as (select r.raw_id, lower(strip_accents(trim(coalesce(nullif(trim(r.uf), ''), k.uf)))) u from inmet_hourly_raw r left join (select station_id, min(uf) uf from station_metadata group by 1) k using (station_id)),
legal as (select raw_id, tz from place left join st on st.name = u left join zone on zone.code = coalesce(st.code, upper(u))),
folded as (select raw_id, coalesce(lower(trim(clock)) = 'local', false) loc,
  [trim(regexp_replace(lower(translate(coalesce(x, ''), '０１２３４５６７８９：／．－，＋（）　ＴＺ', '0123456789:/.-,+() TZ')), '[\x{00a0}\x{2007}\x{202f}\s]+', ' ', 'g')) for x in [data_text, hora_utc]] ab from inmet_hourly_raw),
tried as (select raw_id, loc, 1 pri, ab[2] t from folded union all select raw_id, loc, 2, ab[1] from folded
  union all select raw_id, loc, 3, ab[1] || 't' || ab[2] from folded where not regexp_full_match(ab[1], '.*\d[t ].*[:h].*')),
dated as (select *, regexp_extract(t, '^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{8}|\d{1,2}[-/. ](?:\d{1,2}|(?:jan|fev|feb|mar|abr|apr|mai|may|jun|jul|ago|aug|set|sep|out|oct|nov|dez|dec)[a-zç]*\.?)[-/. ](?:\d{4}|\d{2}))[t ] *(\d.*)$', ['d', 'r']) x,
  case when regexp_full_match(t, '\d{13}') then t::bigint * 1000 when regexp_full_match(t, '\d{9,10}') then t::bigint * 1000000 end epoch from tried),
clocked as (select *, x.d d, regexp_extract(x.r, '^(\d{1,2}[:h]\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?|\d{6}|\d{1,4})(?: *([ap])\.?m\.?)? *(z|utc|gmt|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|\(?(?:brt|brst|amt|amst|act|acst|fnt|fnst)\)?)?$', ['c', 'half', 'z']) y from dated),
best as (select raw_id, min(pri) pri from clocked where epoch is not null or y.c <> '' group by 1),
m as (select c.raw_id, loc, epoch, d, y.c c, y.half half, y.z z from clocked c join best b using (raw_id, pri)),
p as (select *, case when regexp_matches(d, '^\d{4}[-/.]') then string_split_regex(d, '[-/.]') when regexp_full_match(d, '\d{8}') then [d[1:4], d[5:6], d[7:8]] else list_reverse(string_split_regex(regexp_replace(d, '\.([-/. ])', '\1'), '[-/. ]')) end ymd,
  case when regexp_matches(c, '[:h]') then string_split_regex(c, '[:h.,]') when length(c) = 6 then [c[1:2], c[3:4], c[5:6]] else [lpad(c, 4, '0')[1:2], lpad(c, 4, '0')[3:4]] end hms from m),
n as (select *, case when length(ymd[1]) = 2 then '20' || ymd[1] else lpad(ymd[1], 4, '0') end yy,
  coalesce(try_cast(ymd[2] as int), ceil(list_position(['jan','jan','fev','feb','mar','mar','abr','apr','mai','may','jun','jun','jul','jul','ago','aug','set','sep','out','oct','nov','nov','dez','dec'], ymd[2][1:3]) / 2)::int) mm, try_cast(hms[1] as int) h0, try_cast(hms[2] as int) mi, try_cast(coalesce(hms[3], '0') as int) se, try_cast(coalesce(rpad(hms[4][1:6], 6, '0'), '0') as int) us from p),
h as (select *, case half when 'a' then case when h0 between 1 and 12 then h0 % 12 end when 'p' then case when h0 between 1 and 12 then h0 % 12 + 12 end else h0 end hh, try_cast(yy || '-' || lpad(mm::varchar, 2, '0') || '-' || lpad(ymd[3], 2, '0') as date) dt,
  regexp_extract(z, '([+-])(\d{1,2}):?(\d{2})?$', ['s', 'h', 'm']) o from n),
w as (select *, case when mi < 60 and se < 60 and (hh < 24 or (hh = 24 and mi = 0 and se = 0 and us = 0 and half = '')) then dt::timestamp + to_hours(hh) + to_minutes(mi) + to_seconds(se) + to_microseconds(us) end lt,
  case when z in ('z', 'utc', 'gmt') then 0 when o.s <> '' then case when try_cast(o.h as int) <= 18 and try_cast(coalesce(nullif(o.m, ''), '0') as int) < 60 then (case o.s when '-' then -1 else 1 end) * (try_cast(o.h as int) * 60 + try_cast(coalesce(nullif(o.m, ''), '0') as int)) end
    when z <> '' then -60 * [3, 2, 4, 3, 5, 4, 2, 1][list_position(['brt', 'brst', 'amt', 'amst', 'act', 'acst', 'fnt', 'fnst'], trim(z, '()'))] when not loc then 0 end off_min, coalesce(z, '') = '' and loc needs from h),
u as (select raw_id, epoch, lt, off_min, needs, tz, lt at time zone tz as ut from w left join legal using (raw_id)),
v as (select raw_id, case when epoch is not null then epoch when not needs then epoch_us(lt - to_minutes(off_min))
  when (ut at time zone tz) = lt and ((ut - interval 1 hour) at time zone tz) <> lt and ((ut + interval 1 hour) at time zone tz) <> lt then epoch_us(ut) end utc_us from u)
"""


_KM = 25.0


def _station_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state per station."""
    return table(spark, sf_dir, "station_metadata").groupBy(F.col("station_id").alias("__station")).agg(F.min("uf").alias("__station_uf"))


def p1_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "inmet_hourly_raw").select("raw_id", "station_id", "uf", "data_text", "hora_utc", "clock")
    # station_metadata has one row per station and is fixed in size; Spark broadcasts it below its own threshold.
    raw = raw.join(_station_states(spark, sf_dir), F.col("station_id") == F.col("__station"), "left")
    given = F.when(F.trim("uf") == "", None).otherwise(F.col("uf"))
    zone = state_code(F.coalesce(given, F.col("__station_uf")))
    return parse_instants(raw, "data_text", "hora_utc", clock_col="clock", zone_key=zone).select("raw_id", "station_id", "utc_us")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_instants(spark, sf_dir).filter("utc_us is not null").select("raw_id", "utc_us")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    towns = valid_points(table(spark, sf_dir, "municipality_mechanism"), "municipality_id", "rep_lat", "rep_lon", BOX)
    stations = valid_points(table(spark, sf_dir, "station_metadata"), "station_id", "lat", "lon", BOX)
    pairs = pairs_within(towns, stations, RADIUS_KM)
    return pairs.select(F.col("key").alias("municipality_id"), F.col("region").alias("station_id"))


def p3_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons that hold each municipality's point."""
    towns = valid_points(table(spark, sf_dir, "municipality_mechanism"), "municipality_id", "rep_lat", "rep_lon", BOX)
    rings = rings_from_wkt(table(spark, sf_dir, "municipality_polygons"), "polygon_id", "geometry_wkt")
    inside = points_in_regions(towns, rings)
    return inside.select(F.col("key").alias("municipality_id"), F.col("region").alias("polygon_id"), "on_boundary")


def p5_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series of air temperature of each station, filled or marked missing."""
    stations = table(spark, sf_dir, "station_metadata").select(F.col("station_id").alias("station"), "cadence_s", "opened_on")
    hourly = table(spark, sf_dir, "station_hourly").select("station_id", "obs_time", "tair_c", "n_valid_before_outlier_qc", "loaded_at")
    rows = hourly.join(stations, F.col("station_id") == F.col("station"))
    counts = (F.col("n_valid_before_outlier_qc") > 0) & (F.col("obs_time") <= F.col("loaded_at")) & (F.col("obs_time") >= F.col("opened_on").cast(hourly.schema["obs_time"].dataType))
    # A repeated delivery of one reading counts once in the estimate, with its last value.
    us = F.unix_micros(F.col("obs_time").cast("timestamp"))
    rows = rows.select("station_id", us.alias("at_us"), "cadence_s", "tair_c", counts.alias("counts"), "loaded_at").filter("counts")
    rows = rows.groupBy("station_id", "cadence_s", "at_us").agg(F.max_by("tair_c", "loaded_at").alias("tair_c"), F.lit(True).alias("counts"))
    grid = local_regression_grid(rows, source="station_id", at_us="at_us", cadence_s="cadence_s", value="tair_c", counts="counts")
    return grid.withColumnRenamed("source", "station_id").withColumns({c: F.round(c, 5) for c in ("estimate", "support")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_series(spark, sf_dir).filter("missing").select("station_id", "slot_s")


def _p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_spikes(
        table(spark, sf_dir, "residual_qc"), table(spark, sf_dir, "variable_limits"),
        key="qc_id", series=["station_id", "variable"], order="window_start", value="median_residual_era5_minus_inmet", variable="variable",
    )


def p7_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading's flags, and the residual, scatter and cutoff that they rest on."""
    return _p7(spark, sf_dir).withColumns({c: F.round(c, 5) for c in ("residual", "scatter", "tail_cutoff")})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir).filter("impossible or is_stuck or is_spike").select("qc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_instants, p3_found, p3_regions, p5_found, p5_series, p7_found, p7_flags)}

def _p1_sql() -> str:
    """SQL with the same notations; calendar, clock and zones are the other engine's own steps over the zones' stretches."""
    groups = ts._GROUPS
    pattern = re.sub(r"\(\?<[a-z]+>", "(", ts.PATTERN).replace("^(?i)", "(?i)^").replace("'", "''")
    part = lambda *stems: "coalesce(" + ", ".join(f"nullif(m.{x + n}, '')" for x in stems for n in "xyz" if x + n in groups) + ", null)"
    months = "case " + " ".join(f"when mo ilike '{k}%' then {v}" for k, v in ts.MONTHS.items()) + " else try_cast(mo as int) end"
    abbreviations = "case " + " ".join(f"when upper({part('abbr')}) = '{k}' then {v * 3600}" for k, v in ts.ABBREVIATIONS.items()) + " end"
    states = ", ".join(f"('{name}', '{code}')" for name, code in [*ts.STATE_NAMES.items(), *((c.lower(), c) for c in ts.STATE_ZONES)])
    stretches = ", ".join(f"('{code}', {a}, {b}, {'null' if o is None else o})" for code, zone in ts.STATE_ZONES.items() for a, b, o in ts._stretches(zone, 1970, 2100) if b > 1.2e9 and a < 1.8e9)
    return f"""
with st(name, code) as (values {states}), seg(code, a, b, off) as (values {stretches}),
t as (select raw_id, lower(trim(clock)) = 'local' loc, lower(strip_accents(trim(coalesce(nullif(trim(r.uf), ''), k.uf)))) u,
  regexp_replace(coalesce(data_text, '') || chr(1) || coalesce(hora_utc, ''), '[\\x{{00a0}}\\s]+', ' ', 'g') s
  from inmet_hourly_raw r left join (select station_id, min(uf) uf from station_metadata group by 1) k using (station_id)),
p as (select *, regexp_extract(s, '{pattern}', {groups}) m from t),
q as (select raw_id, loc, u, coalesce(try_cast({part('millis')} as bigint) * 1000, try_cast({part('secs')} as bigint) * 1000000) epoch, {part('ma', 'mb', 'mc')} mo, {part('da', 'db', 'dc')}::int d, {part('ya', 'yb', 'yc')} y,
  lpad({part('bare')}, 4, '0') bare, coalesce({part('ha', 'hs')}, left(bare, 2))::int h0, coalesce({part('na', 'ns')}, substr(bare, 3, 2))::int n, coalesce({part('sa', 'ss')}::int, 0) sec, coalesce(rpad(left({part('fa')}, 6), 6, '0')::int, 0) us, upper({part('half')}) half,
  coalesce(case when {part('zulu')} is not null then 0 end, case when {part('sign')} = '-' then -1 else 1 end * ({part('offh')}::int * 3600 + coalesce({part('offm')}::int, 0) * 60), {abbreviations}) zs, coalesce({part('offh')}::int <= 18 and coalesce({part('offm')}::int, 0) < 60, true) zok from p),
v as (select *, {months} mm, case when length(y) = 2 then y::int + 2000 else y::int end yy, case when half is null then h0 when h0 between 1 and 12 then h0 % 12 + case when half = 'P' then 12 else 0 end end h from q),
w as (select *, try_cast(lpad(yy::varchar, 4, '0') || '-' || lpad(mm::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') as date) dt from v),
l as (select *, case when zok and yy >= 1 and n between 0 and 59 and sec between 0 and 59 and (h between 0 and 23 or (h = 24 and n = 0 and sec = 0 and us = 0 and half is null)) then (dt - date '1970-01-01')::bigint * 86400 + h * 3600 + n * 60 + sec end ls from w),
z as (select l.*, seg.off, ls is not null and zs is null and epoch is null and coalesce(loc, false) needs from l left join st on st.name = u left join seg on seg.code = st.code and ls >= seg.a and ls < seg.b)
select raw_id, coalesce(epoch, (ls - case when needs then off else coalesce(zs, 0) end) * 1000000 + us) utc_us from z where coalesce(epoch, (ls - case when needs then off else coalesce(zs, 0) end) * 1000000 + us) is not null"""


_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(s.lat - m.rep_lat) / 2), 2) + cos(radians(m.rep_lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - m.rep_lon) / 2), 2))))"
_VALID = "{lat} between -34 and 6 and {lon} between -74.5 and -32"
_COVERED = """
  select distinct h.station_id, m.cadence_s::bigint c, (epoch_us(h.obs_time) * 2 + m.cadence_s::bigint * 1000000) // (m.cadence_s::bigint * 2000000) slot
  from station_hourly h join station_metadata m using (station_id)
  where h.n_valid_before_outlier_qc > 0 and h.obs_time <= h.loaded_at and h.obs_time >= m.opened_on"""

_P7_SQL = """
with lim as (select variable, max(low) low, min(high) high from variable_limits group by 1),
b as (select qc_id, station_id s, r.variable v, window_start o, median_residual_era5_minus_inmet x, coalesce(median_residual_era5_minus_inmet < low or median_residual_era5_minus_inmet > high, false) imp from residual_qc r left join lim using (variable) where median_residual_era5_minus_inmet is not null),
n as (select *, case when not imp then x end g, coalesce((lag(x) over (partition by s, v order by o, qc_id) <> x)::int, 1) fresh from b),
w as (select *, sum(fresh) over (partition by s, v order by o, qc_id) run,
  list_reverse(list_filter(coalesce(list(g) over (partition by s, v order by o, qc_id rows between 14 preceding and 1 preceding), []), lambda z: z is not null)) pb,
  list_filter(coalesce(list(g) over (partition by s, v order by o, qc_id rows between 1 following and 14 following), []), lambda z: z is not null) pa from n),
m as (select *, count(*) over (partition by s, v, run) len, list_median(pb[1:7]) b0, list_median(pb[8:14]) b1, list_median(pa[1:7]) a0, list_median(pa[8:14]) a1,
  x - list_median(list_concat(list_concat(pb[1:7], case when g is null then [] else [g] end), pa[1:7])) cen from w),
c0 as (select *, list_filter([cen, x - b0, x - a0, case when len(pa[1:7]) < 7 then x - b0 - (b0 - b1) * 4.0 / 7 end, case when len(pb[1:7]) < 7 then x - a0 - (a0 - a1) * 4.0 / 7 end], lambda z: z is not null) tried from m),
c as (select *, list_min(list_transform(tried, lambda z: struct_pack(s := abs(z), r := z))).r signed, list_min(list_transform(tried, lambda z: abs(z))) res from c0),
t as (select s, v, median(abs(cen)) filter (not imp) * 1.4826 mad, avg(abs(cen)) filter (not imp) * 1.2533 dev, quantile_cont(res, 0.8) filter (not imp) u from c group by 1, 2),
d as (select c.*, case when mad > 0 then mad else dev end sc, u, case when not imp and res > u then res - u end ex from c join t on c.s is not distinct from t.s and c.v is not distinct from t.v),
own as (select s, v, median(ex) med, count(ex) ne from d group by 1, 2),
var as (select v, quantile_disc(ex / sc, 0.5) filter (sc > 0) q50, quantile_disc(ex / sc, 0.75) filter (sc > 0) q75, count(ex) filter (sc > 0) nq from d group by 1),
f as (select v, coalesce(q50, 0) mid, case when q50 > 0 and q75 > q50 then greatest(0.0, log2(q75 / q50 - 1) - 7.2 / sqrt(nq)) else 0.0 end xi from var),
k as (select own.s, own.v, xi, ne, coalesce(med, 0) med, mid from own join f on own.v is not distinct from f.v),
e as (select d.*, (mid * sc * 50 + med * ne) / (50 + ne) m, xi from d join k on d.s is not distinct from k.s and d.v is not distinct from k.v),
h as (select *, u + m * case when xi < 1e-6 then ln(20000.0) / ln(2) else (power(20000.0, xi) - 1) / (power(2.0, xi) - 1) end cutoff from e),
flagged as (select *, imp impossible, len >= 6 is_stuck, coalesce(not imp and res > cutoff and res > sc * 7, false) is_spike from h)
"""

SQL = {
    "p1_found": _P1_SQL + "select raw_id, utc_us from v where utc_us is not null",
    "p1_instants": _P1_SQL + "select raw_id, station_id, utc_us from inmet_hourly_raw left join v using (raw_id)",
    "p3_found": f"""
select municipality_id, station_id from municipality_mechanism m, station_metadata s
where {_VALID.format(lat="m.rep_lat", lon="m.rep_lon")} and {_VALID.format(lat="s.lat", lon="s.lon")} and {_KM} <= 25""",
    "p3_regions": f"""
with pts as (select municipality_id, rep_lat y, rep_lon x from municipality_mechanism where {_VALID.format(lat="rep_lat", lon="rep_lon")}),
corners as (select polygon_id, i, split_part(p, ' ', 1)::double x, split_part(p, ' ', 2)::double y from (
  select polygon_id, unnest(ps) p, generate_subscripts(ps, 1) i from (
    select polygon_id, regexp_extract_all(geometry_wkt, '-?[0-9.]+ -?[0-9.]+') ps from municipality_polygons where geometry_wkt like 'POLYGON%'))),
edges as (select a.polygon_id, a.x x1, a.y y1, b.x x2, b.y y2 from corners a join corners b on a.polygon_id = b.polygon_id and b.i = a.i + 1),
met as (select municipality_id, polygon_id,
  ((y1 > y) <> (y2 > y)) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) crossed,
  (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1) = 0 and x between least(x1, x2) and greatest(x1, x2) and y between least(y1, y2) and greatest(y1, y2) on_edge
  from pts, edges where y between least(y1, y2) and greatest(y1, y2))
select municipality_id, polygon_id, bool_or(on_edge) on_boundary from met where crossed or on_edge group by 1, 2
having count(*) filter (crossed) % 2 = 1 or bool_or(on_edge)""",
    "p7_found": _P7_SQL + "select qc_id from flagged where impossible or is_stuck or is_spike",
    "p7_flags": _P7_SQL + "select qc_id, s station_id, v as variable, round(signed, 5) residual, round(sc, 5) scatter, round(cutoff, 5) tail_cutoff, impossible, is_stuck, is_spike from flagged",
    "p5_series": """
with r as (select h.station_id s, m.cadence_s::bigint c, epoch_us(h.obs_time) t, arg_max_null(case when isnan(tair_c) then null else tair_c end, loaded_at) y from station_hourly h join station_metadata m using (station_id)
  where n_valid_before_outlier_qc > 0 and obs_time <= loaded_at and obs_time >= opened_on group by 1, 2, 3),
b as (select *, c * 1000000 step, c * 1500000 reach, (t * 2 + c * 1000000) // (c * 2000000) near from r),
e as (select s, c, t, y, step, near, unnest(range(floor((t - reach) / step)::bigint + 1, ceil((t + reach) / step)::bigint)) slot from b),
k as (select s, c, slot, near = slot fills, (t - slot * step) / step d, case when y is not null then power(1 - power(abs((t - slot * step) / step / 1.5), 3), 3) else 0.0 end w, coalesce(y, 0.0) y from e),
m as (select s, c, slot, count(*) filter (fills) n, sum(w) s0, sum(w * d) s1, sum(w * d * d) s2, sum(w * y) b0, sum(w * d * y) b1, sum(w * w) q from k group by 1, 2, 3),
covered as (select s, c, slot from m where n > 0), steps as (select *, lag(slot) over (partition by s order by slot) before from covered),
gaps as (select s, c, unnest(range(before + 1, slot)) slot from steps where slot - before > 1 and (slot - before) * c <= 30 * 86400),
g as (select s, c, slot, false gap from covered union all select s, c, slot, true from gaps),
f as (select g.s, g.c, g.slot, gap, coalesce(n, 0) n, coalesce(s0, 0) s0, coalesce(s1, 0) s1, coalesce(s2, 0) s2, coalesce(b0, 0) b0, coalesce(b1, 0) b1, coalesce(q, 0) q from g left join m on g.s = m.s and g.c = m.c and g.slot = m.slot),
u as (select *, s0 * s2 - s1 * s1 det, case when q > 0 then s0 * s0 / q else 0.0 end sup from f)
select s station_id, slot * c slot_s, round(case when sup >= 1 - 1e-9 then case when det > 1e-6 * s0 * s0 then (s2 * b0 - s1 * b1) / det else b0 / s0 end end, 5) estimate, round(sup, 5) support, n n_readings, gap missing from u""",
    "p5_found": f"""
with covered as ({_COVERED}),
steps as (select *, lag(slot) over (partition by station_id order by slot) before from covered)
select station_id, s * c slot_s from (
  select station_id, c, unnest(range(before + 1, slot)) s from steps where slot - before > 1 and (slot - before) * c <= 30 * 86400)""",
}
