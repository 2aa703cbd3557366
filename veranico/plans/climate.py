"""Queries of the climate operators: resampling, climatologies, events, trends, thermodynamics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veranico.functions import thermo as th
from veranico.operators import climatology as cl
from veranico.operators import events as ev
from veranico.operators import qc
from veranico.operators import stats as st
from veranico.operators import trends as tr
from veranico.plans import pipelines as pl
from veranico.session import clean_missing, null_if_nan, table
from veranico.sources.stations import standardise_grid
from veranico.streaming.resample import stream_hours

# Hours from UTC of the states that don't keep UTC-3.
STATE_SHIFT = {"AC": -5.0, "AM": -4.0, "RO": -4.0, "RR": -4.0, "MT": -4.0, "MS": -4.0}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results compare across engines."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def dated(df: DataFrame) -> DataFrame:
    """Dates as text, so that results compare across engines."""
    return df.select(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series per nation: (k, day, v)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("k"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, m, v): mean daily value per month, m counted in months."""
    d = daily_orders(spark, sf_dir)
    return d.groupBy("k", (F.year("day") * 12 + F.month("day")).alias("m")).agg(F.round(F.avg("v"), 6).alias("v"))


def annual_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_orders(spark, sf_dir).groupBy("k", F.year("day").alias("y")).agg(F.round(F.avg("v"), 6).alias("v"))


def cell_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell and day of the grid: the highest value of repeated ones."""
    grid = clean_missing(table(spark, sf_dir, "daily_grid").select("cell_id", "region", "obs_date", "tmax", "tmean", "vpdmean", "twbmax"))
    return grid.groupBy("cell_id", "region", "obs_date").agg(*[F.max(c).alias(c) for c in ("tmax", "tmean", "vpdmean", "twbmax")])


def local_shift(uf: str = "uf") -> Column:
    """Hours to the legal time of a state without summer time; UTC-3 where it isn't known."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATE_SHIFT.items() for x in kv]), F.upper(F.trim(F.col(uf)))), F.lit(-3.0))


def o03_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per day and cell of the grid's box, whatever the version of the data."""
    raw = clean_missing(table(spark, sf_dir, "daily_grid").select(F.col("obs_date").alias("time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "expver", "tmax"))
    return dated(standardise_grid(raw, ["time", "lat", "lon", "tmax"]))


def o46_daily_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = table(spark, sf_dir, "station_hourly").select("station_id", "obs_time", "tair_c", "rh_pct")
    return dated(rounded(cl.resample(hourly, ["station_id"], "obs_time", {"tair_c": ["mean", "max", "min"], "rh_pct": ["mean"]})))


def o47_daily_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = table(spark, sf_dir, "station_hourly").select("station_id", "uf", "obs_time", "tair_c", "td_c")
    return dated(rounded(cl.resample(hourly, ["station_id"], "obs_time", {"tair_c": ["mean", "max", "min"], "td_c": ["mean"]}, least=18, required="tair_c", shift_hours=local_shift())))


def o48_monthly_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cl.monthly_climatology(daily_orders(spark, sf_dir), ["k"], "day", "v"), 6)


def o49_annual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cl.annual_mean(daily_orders(spark, sf_dir), ["k"], "day", "v", least=60), 6)


def o50_doy_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = daily_orders(spark, sf_dir).filter(F.year("day").between(1995, 2000))
    return rounded(cl.doy_quantiles(base, ["k"], "day", "v", {"p10": 0.1, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}), 4)


def o50_cell_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cl.doy_quantiles(cell_days(spark, sf_dir), ["cell_id"], "obs_date", "tmax", {"p90": 0.9}), 4)


def o51_doy_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cl.doy_moments(cell_days(spark, sf_dir), ["region"], "obs_date", "tmax", ddof=1)
    # Means of hundredths often lie halfway between two rounded values; the shift makes all engines round them up.
    return rounded(m.withColumns({c: F.col(c) + 1e-9 for c in ("mean", "std")}), 6)


def regime_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("tmean", "tmax", "twbmax", "vpdmean", "sm1mean", "ws10mean")
    grid = clean_missing(table(spark, sf_dir, "daily_grid").select("cell_id", "region", "obs_date", *cols))
    return grid.groupBy("cell_id", "region", "obs_date").agg(*[F.max(c).alias(c) for c in cols])


def o26_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each regime per region."""
    days = pl.flagged_days(regime_days(spark, sf_dir), "cell_id", "obs_date", (2000, 2000))
    return days.groupBy("region").agg(*[F.count_if(c).alias(n) for n, c in pl.regime_flags().items()], F.count(F.lit(1)).alias("n_days"))


def o26_regime_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly events of each regime, summed per regime."""
    annual = pl.gridded_regimes(regime_days(spark, sf_dir), "cell_id", "obs_date", baseline=(2000, 2000))
    return rounded(annual.groupBy("regime", "year").agg(F.sum("frequency").alias("frequency"), F.sum("duration").alias("duration"), F.sum("intensity").alias("intensity")), 3)


def _exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_orders(spark, sf_dir)
    limits = cl.doy_quantiles(d.filter(F.year("day").between(1995, 2000)), ["k"], "day", "v", {"p50": 0.5, "p75": 0.75, "p90": 0.9})
    return d.withColumn("doy", th.noleap_doy("day")).join(limits, ["k", "doy"], "left")


def o40_annual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exceedance(spark, sf_dir)
    return rounded(ev.annual_events(x, ["k"], "day", F.col("v") >= F.col("p75"), F.col("v") - F.col("p75"), least=2), 6)


# Scenarios: threshold and least length.
_SCENARIOS = {"primary": ("p75", 2), "lower": ("p50", 2), "higher": ("p90", 2), "shorter": ("p75", 1), "longer": ("p75", 3), "lower_longer": ("p50", 3)}


def o85_scenario_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other thresholds and other least lengths beside the primary ones."""
    x = _exceedance(spark, sf_dir)
    return rounded(ev.sweep(x, {n: (F.col("v") >= F.col(p), least) for n, (p, least) in _SCENARIOS.items()}, ["k"], "day", F.col("v") - F.col("p50")), 6)


def o41_persistent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = ev.persistent_days(cell_days(spark, sf_dir), ["cell_id"], "obs_date", F.col("tmax") >= 34, 3)
    return dated(hot.select("cell_id", "obs_date", "run_length"))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    core = F.col("tmean") >= 25
    return cell_days(spark, sf_dir), core, ev.states((F.col("tmax") >= 33) & (F.col("vpdmean") >= 15), F.col("twbmax") >= 27)


def o27_four_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, _, state = _states(spark, sf_dir)
    return days.groupBy("region", state.alias("state")).agg(F.count(F.lit(1)).alias("n_days"), F.countDistinct("cell_id").alias("n_cells"))


def o42_state_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, core, state = _states(spark, sf_dir)
    return ev.state_episodes(days, ["cell_id"], "obs_date", core, state)


def o43_state_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = o42_state_episodes(spark, sf_dir)
    names = ["DRY", "HUMID", "MIXED", "NEUTRAL"]
    wide = episodes.groupBy("cell_id", "year").pivot("state", names).agg(F.sum("n_days"))
    return wide.select("cell_id", "year", *[F.coalesce(n, F.lit(0)).alias(f"{n.lower()}_days") for n in names])


def o44_event_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean severity of the days within events, 0 in years without any."""
    x = _exceedance(spark, sf_dir).withColumn("sev", F.col("v") - F.col("p75"))
    hot = ev.persistent_days(x, ["k"], "day", F.col("v") >= F.col("p75"), 2)
    years = x.select("k", F.year("day").alias("year")).distinct()
    means = hot.groupBy("k", F.year("day").alias("year")).agg(F.avg("sev").alias("severity"))
    return rounded(years.join(means, ["k", "year"], "left").select("k", "year", F.coalesce("severity", F.lit(0.0)).alias("severity")))


def o72_kendall_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau of annual means and its p-value without continuity correction."""
    m = tr.mann_kendall(annual_orders(spark, sf_dir), ["k"], "y", "v", least=5)
    return rounded(m.select("k", "n", "tau", st.kendall_p(F.col("s"), F.col("var_s")).alias("p_value")), 5)


def o92_metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over regions of each month's correlation of two pairs of daily metrics."""
    days = cell_days(spark, sf_dir).withColumn("month", F.month("obs_date"))
    pairs = [st.correlations(days, ["region", "month"], "tmax", c, ranks=False).select(F.lit(c).alias("metric"), "month", "pearson") for c in ("vpdmean", "tmean")]
    both = pairs[0].unionByName(pairs[1])
    return rounded(both.groupBy("metric").pivot("month", list(range(1, 13))).agg(F.median("pearson")).withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)}), 5)


def o45_valid_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_orders(spark, sf_dir)
    valid = d.groupBy("k", F.year("day").alias("year")).agg(F.count("v").alias("n"), F.avg("v").alias("v")).withColumn("value", F.when(F.col("n") >= 60, F.col("v")))
    return rounded(valid.groupBy("k").agg(F.count("value").alias("n_valid_years"), F.when(F.count("value") >= 5, F.avg("value")).alias("value")), 4)


def o63_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.coverage(daily_orders(spark, sf_dir), ["k"], "day", "v", fraction=0.15, windows={"baseline": (1995, 1998), "full": (1995, 2001)}, least_years={"baseline": 3, "full": 5})


def o67_theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.theil_sen(monthly_orders(spark, sf_dir), ["k"], "m", "v"), 4)


def o68_mann_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.mann_kendall(monthly_orders(spark, sf_dir), ["k"], "m", "v"), 5)


def o71_conditional_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.conditional_trend(monthly_orders(spark, sf_dir), ["k"], "m", "v"), 4)


def pipe_event_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends and tests of the yearly frequency, duration and intensity of each series' events."""
    annual = o40_annual_events(spark, sf_dir).withColumn("regime", F.lit("p75"))
    trends = pl.regime_trends(annual, "k", least=5).drop("regime")
    # Slopes often lie halfway between two rounded values; the shift makes all engines round them up.
    return rounded(trends.withColumns({c: F.col(c) + 1e-7 for c in ("slope", "ols_slope")}), 4)


def o84_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tr.leave_one_out(annual_orders(spark, sf_dir), ["k"], "y", "v", least=5), 4)


def o84_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of the whole period and of periods that start later or end earlier."""
    return rounded(tr.truncated_slopes(annual_orders(spark, sf_dir), ["k"], "y", "v", years=2, least=4), 4)


def o76_trend_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the trends of two series of a nation have the same sign."""
    m = monthly_orders(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # Lines are summed per order before the join, so each order meets its customer once.
    per_order = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    q = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    q = q.groupBy(F.col("c_nationkey").alias("k"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).agg(F.round(F.sum("q") / F.sum("n"), 4).alias("q"))
    a = tr.theil_sen(m, ["k"], "m", "v").select("k", F.col("slope").alias("a"))
    b = tr.theil_sen(q, ["k"], "m", "q").select("k", F.col("slope").alias("b"))
    return a.join(b, "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.signum("a") == F.signum("b"), 100.0).otherwise(0.0)), 6).alias("same_sign_pct"))


def o35_thermo(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, td, rh = "tair_c", "td_c", "rh_pct"
    return rounded(
        table(spark, sf_dir, "station_hourly").select(
            "reading_id",
            th.saturation_pressure(t, "magnus_hpa").alias("es_magnus"),
            th.saturation_pressure(t, "bolton_kpa").alias("es_bolton"),
            th.relative_humidity(t, td).alias("rh_null"),
            th.relative_humidity(t, td, out_of_range="clip").alias("rh_clip"),
            th.vpd_from_dewpoint(t, td).alias("vpd_hpa"),
            th.vpd_from_humidity(t, rh).alias("vpd_kpa"),
            th.dewpoint_from_humidity(t, rh).alias("dewpoint"),
            th.wetbulb_stull(t, rh).alias("wetbulb"),
        ),
        5,
    )


def o39_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive clipped z-scores of hot and dry days against the day of year, and their mean."""
    days = cell_days(spark, sf_dir).withColumn("doy", th.noleap_doy("obs_date"))
    parts = [cl.doy_moments(days, ["region"], "obs_date", c, ddof=0).select("region", "doy", F.col("mean").alias(f"{c}_m"), F.col("std").alias(f"{c}_s")) for c in ("tmax", "vpdmean")]
    joined = days.join(parts[0], ["region", "doy"]).join(parts[1], ["region", "doy"])
    z = [F.round(th.positive_z(c, f"{c}_m", f"{c}_s"), 6) for c in ("tmax", "vpdmean")]
    each = joined.select("region", "cell_id", z[0].alias("zt"), z[1].alias("zv")).withColumn("severity", th.composite_severity((F.col("zt"), 0.5), (F.col("zv"), 0.5)))
    return rounded(each.groupBy("region").agg(F.avg("zt").alias("z_tmax"), F.avg("zv").alias("z_vpd"), F.avg("severity").alias("severity"), F.max("severity").alias("max_severity")), 4)


def o86_vpd_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturation and actual vapour pressure per region and month, the deficit, and what doesn't close."""
    grid = clean_missing(table(spark, sf_dir, "daily_grid").select("region", "obs_date", "tmean", "rhmean", "vpdmean")).filter("tmean is not null and rhmean is not null and vpdmean is not null")
    es = th.saturation_pressure("tmean", "magnus_hpa")
    means = grid.groupBy("region", F.month("obs_date").alias("month")).agg(F.avg(es).alias("es"), F.avg(es * F.col("rhmean") / 100).alias("ea"), F.avg("vpdmean").alias("vpd"))
    return rounded(means.withColumn("closure", F.col("vpd") - (F.col("es") - F.col("ea"))), 5)


def o86_vpd_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of the deficit per region against the difference of the trends of its two parts."""
    grid = clean_missing(table(spark, sf_dir, "daily_grid").select("region", "obs_date", "tmean", "rhmean", "vpdmean")).filter("tmean is not null and rhmean is not null and vpdmean is not null")
    es = th.saturation_pressure("tmean", "magnus_hpa")
    means = grid.groupBy("region", F.datediff("obs_date", F.lit("2000-01-01")).alias("day")).agg(F.avg(es).alias("es"), F.avg(es * F.col("rhmean") / 100).alias("ea"), F.avg("vpdmean").alias("vpd"))
    parts = means.select("region", "day", F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.round(c, 6).alias("v")) for c in ("es", "ea", "vpd")])).alias("e")).select("region", "day", "e.*")
    slopes = tr.theil_sen(parts, ["region", "part"], "day", "v", per=30.0)
    wide = slopes.groupBy("region").agg(*[F.max(F.when(F.col("part") == c, F.col("slope"))).alias(c) for c in ("vpd", "es", "ea")], F.max("n").alias("n"))
    return rounded(wide.withColumn("components", F.col("es") - F.col("ea")).withColumn("difference", F.col("vpd") - F.col("components")), 5)


def o22_physical_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings out of physical range become missing; a dew point over 0.5 above the temperature too."""
    clean = qc.hourly_qc(table(spark, sf_dir, "station_hourly").select("station_id", *qc.HOURLY_LIMITS))
    return clean.groupBy("station_id").agg(*[F.count(c).alias(f"n_{c}") for c in qc.HOURLY_LIMITS], F.count(F.lit(1)).alias("n"))


def o22_daily_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per region that pass the daily limits and the order of maximum and minimum."""
    cols = ["tmax", "tmin", "tmean", "vpdmean"]
    clean = qc.daily_qc(table(spark, sf_dir, "daily_grid").select("region", *cols))
    return clean.groupBy("region").agg(*[F.count(c).alias(f"n_{c}") for c in cols], F.count(F.lit(1)).alias("n"))


def o33_tolerant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many raw lines find their station by the given id, by the code in the file's name, or not at all."""
    raw = table(spark, sf_dir, "inmet_hourly_raw").select("raw_id", "station_id", "source_file")
    spellings = [F.upper(F.trim("station_id")), F.upper(F.nullif(F.regexp_extract("source_file", r"_([A-Za-z]\d{4})_", 1), F.lit("")))]
    found = qc.tolerant_lookup(raw, table(spark, sf_dir, "station_metadata").filter("op_status = 'Operante'"), spellings, "station_id", "raw_id")
    return found.groupBy("station_id", "spelling").agg(F.count(F.lit(1)).alias("n"))


def o39d_cell_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "daily_grid").groupBy("cell_id").agg(F.max("lat").alias("lat"))
    return rounded(cells.select("cell_id", th.cell_area_km2("lat").alias("area_km2"), th.cosine_weight("lat").alias("weight")), 5)


QUERIES = {
    f.__name__: f
    for f in (
        o03_standardise, o26_regimes, o26_regime_events, o46_daily_resample, o47_daily_min_count, o48_monthly_climatology, o49_annual_mean, o50_doy_quantiles, o50_cell_quantiles, o51_doy_moments, o40_annual_events,
        o85_scenario_sweep, o41_persistent_days, o27_four_states, o42_state_episodes, o43_state_pivot, o44_event_severity, o45_valid_years, o72_kendall_p, o92_metric_matrix, o63_coverage, o67_theil_sen, o68_mann_kendall,
        o71_conditional_trend, pipe_event_trends, o84_leave_one_out, o84_truncated, o76_trend_agreement, o35_thermo, o39_severity, o86_vpd_parts, o86_vpd_slopes, o22_physical_qc, o22_daily_qc, o33_tolerant_lookup, o39d_cell_area, stream_hours,
    )
}


def _n(c: str) -> str:
    return f"(case when isnan({c}) then null else {c} end)"


def _doy(d: str) -> str:
    leap = f"((year({d}) % 4 = 0 and year({d}) % 100 <> 0) or year({d}) % 400 = 0)"
    return f"(case when month({d}) = 2 and day({d}) = 29 then null else dayofyear({d}) - case when month({d}) > 2 and {leap} then 1 else 0 end end)"


def _es(t: str, f: float, a: float, b: float) -> str:
    return f"({f} * exp({a} * {t} / ({t} + {b})))"


_D = "d as (select c_nationkey k, cast(o_orderdate as date) as day, round(sum(o_totalprice), 2) v from orders join customer on o_custkey = c_custkey group by 1, 2)"
_M = _D + ", m as (select k, year(day) * 12 + month(day) m, round(avg(v), 6) v from d group by 1, 2)"
_CELL = "c as (select cell_id, region, obs_date, " + ", ".join(f"max({_n(x)}) {x}" for x in ("tmax", "tmean", "vpdmean", "twbmax")) + " from daily_grid group by 1, 2, 3)"
_AT = lambda d: f"(year({d}) * 365 + {_doy(d)})"


def _pool(source: str, keys: str, day: str, value: str) -> str:
    return f"p as (select {keys}, (({_doy(day)} - 1 + s + 365) % 365) + 1 doy, {value} x from {source}, (select unnest(range(-15, 16)) s) where {_doy(day)} is not null and {value} is not null)"


_EXC = f"{_D}, {_pool('(select * from d where year(day) between 1995 and 2000)', 'k', 'day', 'v')}, q as (select k, doy, quantile_cont(x, 0.5) p50, quantile_cont(x, 0.75) p75, quantile_cont(x, 0.9) p90 from p group by 1, 2), x as (select d.*, p50, p75, p90 from d left join q on d.k = q.k and {_doy('d.day')} = q.doy)"


def _events(source: str, keys: str, flag: str, sev: str, least: int | str, day: str = "day") -> str:
    return f"""
r0 as (select *, {_AT(day)} - row_number() over (partition by {keys} order by {day}) isl from {source} where {flag} and {_doy(day)} is not null),
r1 as (select *, count(*) over (partition by {keys}, isl) len, min({day}) over (partition by {keys}, isl) first from r0),
f as (select {keys}, year({day}) as year, sum(case when {day} = first then 1 else 0 end) frequency, count(*) duration, sum(case when {sev} > 0 then {sev} else 0 end) intensity from r1 where len >= {least} group by {keys}, year({day})),
ys as (select distinct {keys}, year({day}) as year from {source})
select {keys}, year, coalesce(frequency, 0)::bigint frequency, coalesce(duration, 0) duration, round(coalesce(intensity, 0), 6) intensity from ys left join f using ({keys}, year)"""


_VARS = ("tmean", "tmax", "twbmax", "vpdmean", "sm1mean", "ws10mean")
_PROBS = {"tmean": (0.9,), "tmax": (0.95,), "twbmax": (0.95,), "vpdmean": (0.75, 0.9), "sm1mean": (0.1,), "ws10mean": (0.5,)}
_REG = (
    "g as (select cell_id, region, obs_date, " + ", ".join(f"max({_n(x)}) {x}" for x in _VARS) + " from daily_grid group by 1, 2, 3), "
    + ", ".join(
        _pool("g", "cell_id", "obs_date", v).replace("p as (", f"p_{v} as (", 1) + f", q_{v} as (select cell_id, doy, " + ", ".join(f"quantile_cont(x, {p}) {v}_p{round(p * 100)}" for p in ps) + f" from p_{v} group by 1, 2)"
        for v, ps in _PROBS.items()
    )
    + ", x as (select g.*, " + ", ".join(f"{v}_p{round(p * 100)}" for v, ps in _PROBS.items() for p in ps) + " from g "
    + " ".join(f"left join q_{v} on q_{v}.cell_id = g.cell_id and q_{v}.doy = {_doy('g.obs_date')}" for v in _PROBS) + "), "
    + "y as (select *, coalesce(tmean >= tmean_p90, false) hw, coalesce(twbmax >= twbmax_p95, false) hhw, coalesce(tmax >= tmax_p95, false) and coalesce(vpdmean >= vpdmean_p75, false) dhw, coalesce(tmax >= tmax_p95, false) and coalesce(vpdmean >= vpdmean_p90, false) and (coalesce(sm1mean <= sm1mean_p10, false) or coalesce(ws10mean <= ws10mean_p50, false)) chw from x)"
)


_SLOPES = _M + ", s as (select a.k, median((b.v - a.v) / (b.m - a.m)) b from m a join m b on a.k = b.k and b.m > a.m group by 1), n as (select k, count(*) n, median(v) my, median(m) mx from m group by 1)"
_MK_STEPS = """s as (select a.k, sum(sign(b.v - a.v))::double s from m a join m b on a.k = b.k and b.m > a.m group by 1),
t as (select k, sum(c * (c - 1) * (2 * c + 5))::double t, sum(c)::double n from (select k, v, count(*) c from m group by 1, 2) group by 1),
w as (select k, n, s, (n * (n - 1) * (2 * n + 5) - t) / 18 var_s from s join t using (k))"""
_MK = f"{_M}, {_MK_STEPS}"
_TAIL = lambda z: (
    f"((1 / (1 + 0.3275911 * abs({z}) / 1.4142135623730951)) * (0.254829592 + (1 / (1 + 0.3275911 * abs({z}) / 1.4142135623730951)) * (-0.284496736 + (1 / (1 + 0.3275911 * abs({z}) / 1.4142135623730951)) * (1.421413741 + (1 / (1 + 0.3275911 * abs({z}) / 1.4142135623730951)) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({z}) / 1.4142135623730951)) * 1.061405429)))) * exp(-({z}) * ({z}) / 2))"
)
# Steps and columns of the conditional trend of a table m of keys k, times m and values v.
_TREND_STEPS = f"""{_MK_STEPS}, sl as (select a.k, median((b.v - a.v) / (b.m - a.m)) b from m a join m b on a.k = b.k and b.m > a.m group by 1),
e as (select m.k, m.m, m.v - b * m.m r from m join sl using (k)),
rk as (select k, m, rank() over (partition by k order by r) + (count(*) over (partition by k, r) - 1) / 2.0 rk from e),
lg as (select k, rk, lead(rk) over (partition by k order by m) nx from rk),
l1 as (select k, nullif(corr(rk, nx), 'nan'::double) lag1 from lg where nx is not null group by 1),
o as (select k, regr_slope(v, m) * 10 ols_slope from m group by 1),
j as (select k, n, b * 10 slope, ols_slope, lag1, 1.959963985 / sqrt(n) lag1_critical, s, var_s from w join sl using (k) join l1 using (k) join o using (k)),
h as (select *, case when abs(lag1) > lag1_critical then 1 else 0 end as method from j),
g as (select *, case when method = 1 then greatest(1.0, 1 + 2 * (n - 3) / n * abs(lag1)) else 1.0 end var_factor from h),
z as (select *, (s - sign(s)) / sqrt(var_s * var_factor) z, (s - sign(s)) / sqrt(var_s) z0 from g)"""
_TREND_COLUMNS = f"n::bigint n, round(slope, 4) slope, round(ols_slope, 4) ols_slope, round(lag1, 4) lag1, round(lag1_critical, 4) lag1_critical, method, round(var_factor, 4) var_factor, round(z, 4) z, round({_TAIL('z')}, 4) p_value, round({_TAIL('z0')}, 4) original_p"
_TREND = f"{_TREND_STEPS} select k, {_TREND_COLUMNS} from z"
_T, _TD, _RH = _n("tair_c"), _n("td_c"), _n("rh_pct")
_RHC = f"(case when {_RH} < 0 then 0.0 when {_RH} > 100 then 100.0 else {_RH} end)"
_RH1 = f"(case when {_RH} between 1 and 100 then {_RH} end)"
_RHT = f"({_es(_TD, 6.112, 17.67, 243.5)} / {_es(_T, 6.112, 17.67, 243.5)} * 100)"
_DEF = f"({_es(_T, 6.112, 17.67, 243.5)} - {_es(_TD, 6.112, 17.67, 243.5)})"
_G = f"ln((case when {_es(_T, 0.6108, 17.27, 237.3)} * {_RHC} / 100 > 0 then {_es(_T, 0.6108, 17.27, 237.3)} * {_RHC} / 100 end) / 0.6108)"
_STATES = "case when coalesce(tmax >= 33 and vpdmean >= 15, false) and coalesce(twbmax >= 27, false) then 'MIXED' when coalesce(tmax >= 33 and vpdmean >= 15, false) then 'DRY' when coalesce(twbmax >= 27, false) then 'HUMID' else 'NEUTRAL' end"
_EPISODES = f"""{_CELL}, r0 as (select *, {_STATES} state, {_AT('obs_date')} - row_number() over (partition by cell_id order by obs_date) isl from c where tmean >= 25 and {_doy('obs_date')} is not null),
r1 as (select *, count(*) over (partition by cell_id, isl) len from r0),
r2 as (select *, {_AT('obs_date')} - row_number() over (partition by cell_id, isl, state order by obs_date) isl2 from r1 where len >= 3),
r3 as (select *, min(obs_date) over (partition by cell_id, isl, state, isl2) first from r2),
e as (select cell_id, year(obs_date) as year, state, count(*) n_days, sum(case when obs_date = first then 1 else 0 end)::bigint episodes from r3 group by 1, 2, 3)"""


def _moments(col: str, ddof: int, name: str) -> str:
    return f"""{name} as (select region, doy, avg(x) mean, {'stddev_samp' if ddof else 'stddev_pop'}(x) std, count(*) n from (
  select region, (({_doy('obs_date')} - 1 + s + 365) % 365) + 1 doy, {col} x from c, (select unnest(range(-15, 16)) s) where {_doy('obs_date')} is not null and {col} is not null) group by 1, 2)"""


def _zpos(v: str, m: str, s: str) -> str:
    return f"round(case when {s} > 1e-6 then least(greatest(({v} - {m}) / {s}, 0), 5) * case when {v} is null then null else 1 end end, 6)"


SQL = {
    "o03_standardise": f"select obs_date::varchar as time, lat, ((lon + 180) % 360) - 180 lon, max({_n('tmax')}) tmax from daily_grid where lat between -35 and 6 and lon between -75 and -32 group by 1, 2, 3",
    "o26_regimes": f"with {_REG} select region, " + ", ".join(f'count(*) filter ({c}) "{c.upper()}"' for c in ("hw", "hhw", "dhw", "chw")) + ", count(*) n_days from y group by 1",
    "o26_regime_events": f"with {_REG}, z as (" + " union all ".join(f"select '{c.upper()}' regime, {c} flag, {'tmean - tmean_p90' if c == 'hw' else 'tmax - tmax_p95'} sev, * from y" for c in ("hw", "hhw", "dhw", "chw")) + "), e as (" + _events("z", "regime, cell_id", "flag", "sev", 3, "obs_date").replace("\nr0 as", "with r0 as", 1) + ") select regime, year, sum(frequency)::bigint frequency, sum(duration)::bigint duration, round(sum(intensity), 3) intensity from e group by 1, 2",
    "o46_daily_resample": f"select station_id, cast(cast(obs_time as date) as varchar) period, count({_T}) n_tair_c, round(avg({_T}), 6) tair_c_mean, max({_T}) tair_c_max, min({_T}) tair_c_min, count({_RH}) n_rh_pct, round(avg({_RH}), 6) rh_pct_mean from station_hourly where obs_time is not null group by 1, 2",
    "o47_daily_min_count": f"""select station_id, cast(obs_time + to_hours(cast(case when upper(trim(uf)) = 'AC' then -5 when upper(trim(uf)) in ('AM', 'RO', 'RR', 'MT', 'MS') then -4 else -3 end as integer)) as date)::varchar period,
count({_T}) n_tair_c, round(avg({_T}), 6) tair_c_mean, max({_T}) tair_c_max, min({_T}) tair_c_min, count({_TD}) n_td_c, case when count({_TD}) >= 18 then round(avg({_TD}), 6) end td_c_mean
from station_hourly where obs_time is not null group by 1, 2 having count({_T}) >= 18""",
    "o48_monthly_climatology": f"with {_D} select k, month, round(avg(v), 6) v from (select k, year(day) as year, month(day) as month, avg(v) v from d group by 1, 2, 3) group by 1, 2",
    "o49_annual_mean": f"with {_D} select k, year(day) as year, case when count(v) >= 60 then round(avg(v), 6) end v, count(v) n_days from d group by 1, 2",
    "o50_doy_quantiles": f"with {_D}, {_pool('(select * from d where year(day) between 1995 and 2000)', 'k', 'day', 'v')} select k, doy, " + ", ".join(f"round(quantile_cont(x, {p}), 4) {n}" for n, p in (("p10", 0.1), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))) + " from p group by 1, 2",
    "o50_cell_quantiles": f"with {_CELL}, {_pool('c', 'cell_id', 'obs_date', 'tmax')} select cell_id, doy, round(quantile_cont(x, 0.9), 4) p90 from p group by 1, 2",
    "o51_doy_moments": f"with {_CELL}, {_moments('tmax', 1, 'g')} select region, doy, round(mean + 1e-9, 6) mean, round(std + 1e-9, 6) std, n from g",
    "o40_annual_events": f"with {_EXC}, {_events('x', 'k', 'v >= p75', '(v - p75)', 2)}",
    "o85_scenario_sweep": f"with {_EXC}, z as (" + " union all ".join(f"select '{n}' scenario, v >= {p} flag, {least} least, * from x" for n, (p, least) in _SCENARIOS.items()) + f"), {_events('z', 'scenario, k', 'flag', '(v - p50)', 'least')}",
    "o41_persistent_days": f"with {_CELL}, r0 as (select *, {_AT('obs_date')} - row_number() over (partition by cell_id order by obs_date) isl from c where tmax >= 34 and {_doy('obs_date')} is not null), r1 as (select cell_id, obs_date::varchar obs_date, count(*) over (partition by cell_id, isl) run_length from r0) select * from r1 where run_length >= 3",
    "o27_four_states": f"with {_CELL} select region, {_STATES} state, count(*) n_days, count(distinct cell_id) n_cells from c group by 1, 2",
    "o42_state_episodes": f"with {_EPISODES} select * from e",
    "o43_state_pivot": f"with {_EPISODES} select cell_id, year, " + ", ".join(f"coalesce(sum(n_days) filter (state = '{s}'), 0)::bigint {s.lower()}_days" for s in ("DRY", "HUMID", "MIXED", "NEUTRAL")) + " from e group by 1, 2",
    "o44_event_severity": f"""with {_EXC}, r0 as (select *, {_AT('day')} - row_number() over (partition by k order by day) isl from x where v >= p75 and {_doy('day')} is not null), r1 as (select *, count(*) over (partition by k, isl) len from r0),
s as (select k, year(day) as year, avg(v - p75) severity from r1 where len >= 2 group by 1, 2), ys as (select distinct k, year(day) as year from x) select k, year, round(coalesce(severity, 0), 6) severity from ys left join s using (k, year)""",
    "o72_kendall_p": f"""with {_D}, m as (select k, year(day) as m, round(avg(v), 6) v from d group by 1, 2), s as (select a.k, sum(sign(b.v - a.v))::double s from m a join m b on a.k = b.k and b.m > a.m group by 1),
t as (select k, sum(c * (c - 1) * (2 * c + 5))::double t, sum(c)::double n from (select k, v, count(*) c from m group by 1, 2) group by 1), w as (select k, n, s, s / sqrt((n * (n - 1) * (2 * n + 5) - t) / 18) z from s join t using (k))
select k, n::bigint n, case when n >= 5 then round(s / (n * (n - 1) / 2), 5) end tau, case when n >= 5 then round({_TAIL('z')}, 5) end p_value from w""",
    "o92_metric_matrix": f"""with {_CELL}, u as (select 'vpdmean' metric, region, month(obs_date) mo, tmax a, vpdmean b from c union all select 'tmean', region, month(obs_date), tmax, tmean from c),
r as (select metric, region, mo, corr(a, b) r from u where a is not null and b is not null group by 1, 2, 3 having count(*) >= 5) select metric, {', '.join(f'round(median(r) filter (mo = {m}), 5) m{m}' for m in range(1, 13))} from r group by 1""",
    "o45_valid_years": f"with {_D}, y as (select k, year(day) as year, case when count(v) >= 60 then avg(v) end v from d group by 1, 2) select k, count(v) n_valid_years, case when count(v) >= 5 then round(avg(v), 4) end as value from y group by 1",
    "o63_coverage": f"""with {_D}, y as (select k, year(day) as year, count(v) * 1.0 / case when (year(day) % 4 = 0 and year(day) % 100 <> 0) or year(day) % 400 = 0 then 366 else 365 end f from d group by 1, 2),
c as (select k, count(*) filter (f >= 0.15 and year between 1995 and 1998) n_valid_baseline, count(*) filter (f >= 0.15 and year between 1995 and 2001) n_valid_full from y group by 1) select *, n_valid_baseline >= 3 and n_valid_full >= 5 selected from c""",
    "o67_theil_sen": f"with {_SLOPES} select k, n, case when n >= 20 then round(b * 10, 4) end slope, case when n >= 20 then round(my - b * mx, 4) end intercept from s join n using (k)",
    "o68_mann_kendall": f"with {_MK}, z as (select *, (s - sign(s)) / sqrt(var_s) z from w) select k, n::bigint n, s, round(var_s, 5) var_s, round(z, 5) z, round({_TAIL('z')}, 5) p_value, round(s / (n * (n - 1) / 2), 5) tau from z",
    "o71_conditional_trend": f"with {_M}, {_TREND}",
    "pipe_event_trends": f"with {_EXC}, ev as (with {_events('x', 'k', 'v >= p75', '(v - p75)', 2).strip()}), m as (select k || '/' || metric k, m, v from (select k, year m, frequency::double frequency, duration::double duration, intensity from ev) unpivot (v for metric in (frequency, duration, intensity))), {_TREND_STEPS} select split_part(k, '/', 1)::int k, split_part(k, '/', 2) metric, {_TREND_COLUMNS.replace('slope, 4)', 'slope + 1e-7, 4)')} from z",
    "o84_leave_one_out": f"""with {_D}, m as (select k, year(day) as m, round(avg(v), 6) v from d group by 1, 2), n as (select k, count(*) n from m group by 1),
s as (select a.k, o.m om, median((b.v - a.v) / (b.m - a.m)) * 10 b from m a join m b on a.k = b.k and b.m > a.m join m o on o.k = a.k and o.m <> a.m and o.m <> b.m group by 1, 2)
select k, n, round(min(b), 4) slope_min, round(quantile_cont(b, 0.25), 4) slope_q25, round(quantile_cont(b, 0.5), 4) slope_median, round(quantile_cont(b, 0.75), 4) slope_q75, round(max(b), 4) slope_max, round(max(b) - min(b), 4) slope_range
from s join n using (k) where n > 5 group by 1, 2""",
    "o84_truncated": f"""with {_D}, m as (select k, year(day) as m, round(avg(v), 6) v from d group by 1, 2), n as (select k, count(*) n, min(m) f, max(m) l from m group by 1),
p as (select 'slope_all' part, m.* from m union all select 'slope_late_start', m.* from m join n using (k) where m >= f + 2 union all select 'slope_early_end', m.* from m join n using (k) where m <= l - 2),
c as (select part, k, count(*) c from p group by 1, 2), s as (select a.part, a.k, median((b.v - a.v) / (b.m - a.m)) * 10 b from p a join p b on a.part = b.part and a.k = b.k and b.m > a.m group by 1, 2)
select n.k, n.n, """ + ", ".join(f"round(max(b) filter (part = '{x}' and c >= 4), 4) {x}" for x in ("slope_all", "slope_late_start", "slope_early_end")) + " from n join c using (k) join s using (k, part) where n.n >= 4 group by 1, 2",
    "o76_trend_agreement": f"""with {_M}, q as (select c_nationkey k, year(o_orderdate) * 12 + month(o_orderdate) m, round(avg(l_quantity), 4) v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2),
sa as (select a.k, median((b.v - a.v) / (b.m - a.m)) b from m a join m b on a.k = b.k and b.m > a.m group by 1), sb as (select a.k, median((b.v - a.v) / (b.m - a.m)) b from q a join q b on a.k = b.k and b.m > a.m group by 1)
select count(*) n, round(avg(case when sign(sa.b) = sign(sb.b) then 100.0 else 0.0 end), 6) same_sign_pct from sa join sb using (k)""",
    "o35_thermo": f"""select reading_id, round({_es(_T, 6.112, 17.62, 243.12)}, 5) es_magnus, round({_es(_T, 0.6112, 17.67, 243.5)}, 5) es_bolton,
round(case when {_RHT} between 0 and 100 then {_RHT} end, 5) rh_null, round(case when {_RHT} < 0 then 0.0 when {_RHT} > 100 then 100.0 else {_RHT} end, 5) rh_clip,
round(case when {_DEF} < 0 then 0.0 else {_DEF} end, 5) vpd_hpa, round({_es(_T, 0.6108, 17.27, 237.3)} * (1 - {_RHC} / 100), 5) vpd_kpa, round(237.3 * {_G} / (17.27 - {_G}), 5) dewpoint,
round({_T} * atan(0.151977 * sqrt({_RH1} + 8.313659)) + atan({_T} + {_RH1}) - atan({_RH1} - 1.676331) + 0.00391838 * power({_RH1}, 1.5) * atan(0.023101 * {_RH1}) - 4.686035, 5) wetbulb from station_hourly""",
    "o39_severity": f"""with {_CELL}, {_moments('tmax', 0, 'g1')}, {_moments('vpdmean', 0, 'g2')},
e as (select c.region, {_zpos('tmax', 'g1.mean', 'g1.std')} zt, {_zpos('vpdmean', 'g2.mean', 'g2.std')} zv from c join g1 on c.region = g1.region and g1.doy = {_doy('obs_date')} join g2 on c.region = g2.region and g2.doy = {_doy('obs_date')})
select region, round(avg(zt), 4) z_tmax, round(avg(zv), 4) z_vpd, round(avg(0.5 * zt + 0.5 * zv), 4) severity, round(max(0.5 * zt + 0.5 * zv), 4) max_severity from e group by 1""",
    "o86_vpd_slopes": f"""with g as (select region, obs_date - date '2000-01-01' as day, {_n('tmean')} t, {_n('rhmean')} r, {_n('vpdmean')} v from daily_grid), e as (select region, day, round(avg({_es('t', 6.112, 17.62, 243.12)}), 6) es, round(avg({_es('t', 6.112, 17.62, 243.12)} * r / 100), 6) ea, round(avg(v), 6) vpd from g where t is not null and r is not null and v is not null group by 1, 2),
s as (select a.region, median((b.vpd - a.vpd) / (b.day - a.day)) * 30 vpd, median((b.es - a.es) / (b.day - a.day)) * 30 es, median((b.ea - a.ea) / (b.day - a.day)) * 30 ea from e a join e b on a.region = b.region and b.day > a.day group by 1), n as (select region, count(*) n from e group by 1)
select region, round(case when n >= 20 then vpd end, 5) vpd, round(case when n >= 20 then es end, 5) es, round(case when n >= 20 then ea end, 5) ea, n, round(case when n >= 20 then es - ea end, 5) components, round(case when n >= 20 then vpd - (es - ea) end, 5) difference from n left join s using (region)""",
    "o86_vpd_parts": f"""with g as (select region, month(obs_date) as month, {_n('tmean')} t, {_n('rhmean')} r, {_n('vpdmean')} v from daily_grid), e as (select region, month, avg({_es('t', 6.112, 17.62, 243.12)}) es, avg({_es('t', 6.112, 17.62, 243.12)} * r / 100) ea, avg(v) vpd from g where t is not null and r is not null and v is not null group by 1, 2)
select region, month, round(es, 5) es, round(ea, 5) ea, round(vpd, 5) vpd, round(vpd - (es - ea), 5) closure from e""",
    "o22_physical_qc": f"""with x as (select station_id, case when {_T} between -20 and 50 then {_T} end t, case when {_TD} between -30 and 35 then {_TD} end td, case when {_RH} between 1 and 100 then {_RH} end rh, case when {_n('ws_ms')} between 0 and 60 then {_n('ws_ms')} end ws from station_hourly)
select station_id, count(t) n_tair_c, count(case when td <= coalesce(t, td) + 0.5 then td end) n_td_c, count(rh) n_rh_pct, count(ws) n_ws_ms, count(*) n from x group by 1""",
    "o22_daily_qc": f"""with x as (select region, {_n('tmax')} a, {_n('tmin')} b, {_n('tmean')} c, {_n('vpdmean')} d from daily_grid), y as (select *, coalesce(a < b, false) bad from x)
select region, count(*) filter (not bad and a between -20 and 50) n_tmax, count(*) filter (not bad and b between -30 and 40) n_tmin, count(*) filter (not bad and c between -25 and 45) n_tmean, count(*) filter (not bad and d between 0 and 100) n_vpdmean, count(*) n from y group by 1""",
    "o33_tolerant_lookup": """with k as (select distinct station_id from station_metadata where op_status = 'Operante'), t as (select raw_id, upper(trim(station_id)) a, upper(nullif(regexp_extract(source_file, '_([A-Za-z][0-9]{4})_', 1), '')) b from inmet_hourly_raw),
f as (select raw_id, case when a in (select station_id from k) then a when b in (select station_id from k) then b end station_id, case when a in (select station_id from k) then 0 when b in (select station_id from k) then 1 end spelling from t)
select station_id, spelling, count(*) n from f where station_id is not null group by 1, 2""",
    "o39d_cell_area": "select cell_id, round(abs(sin(radians(lat + 0.125)) - sin(radians(lat - 0.125))) * (6371.0 * 6371.0 * 0.25 * 0.017453292519943295), 5) area_km2, round(cos(radians(lat)), 5) weight from (select cell_id, max(lat) lat from daily_grid group by 1)",
    "stream_hours": "select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, round(avg(value), 6) mean_value, count(value) n from events where ts is not null group by 1, 2",
}
