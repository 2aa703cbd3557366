"""Queries of the table operators: weighted summaries, correlations, regressions, regions, joins, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veranico.functions import text as tx
from veranico.operators import smooth as sm
from veranico.operators import spatial as sp
from veranico.operators import stats as st
from veranico.operators import weighted as wt
from veranico.operators.proximity import rings_from_wkt, valid_points
from veranico.plans import problems
from veranico.plans.climate import _CELL, _n, cell_days, rounded
from veranico.plans.pipelines import municipal_association, station_evaluation
from veranico.plans.problems import BOX, p3_regions
from veranico.session import clean_missing, join_groups, null_if_nan, table

_Q = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_missing(table(spark, sf_dir, "municipality_mechanism"))


def o52_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.weighted_mean(towns(spark, sf_dir), ["dominant_biome"], "vpd_trend_decade", "total_area_2024_ha"))


def o53a_quantile_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.weighted_quantiles(towns(spark, sf_dir), ["dominant_biome"], "vpd_trend_decade", "total_area_2024_ha", _Q))


def o53b_quantile_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.weighted_quantiles(towns(spark, sf_dir), ["dominant_biome"], "vpd_trend_decade", "total_area_2024_ha", _Q, method="interp_cdf"))


def o53c_quantile_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.weighted_quantiles(towns(spark, sf_dir), ["dominant_biome"], "vpd_trend_decade", "total_area_2024_ha", _Q, method="midpoint_interp"))


def o54_weighted_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = wt.weighted_zscore(towns(spark, sf_dir), ["dominant_biome"], "rh_trend_decade", "total_area_2024_ha")
    return rounded(z.select("municipality_id", "z"), 5)


def o55_area_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.area_percent(towns(spark, sf_dir), ["dominant_biome"], "vpd_trend_decade", "total_area_2024_ha", "agri_gain_pct_points", 5.0))


def o57_conditional_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"built": ["Área urbana", "Infraestrutura"], "informal": ["Favela/aglomerado"]}
    return rounded(wt.conditional_shares(table(spark, sf_dir, "urban_module"), ["biomanm"], "classnm", "ha_2024", groups), 5)


def o58_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.dominant(table(spark, sf_dir, "urban_module"), ["statenm"], "classnm", "ha_2024"), 4)


def o59_region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = towns(spark, sf_dir)
    cols = ("vpd_trend_decade", "rh_trend_decade", "transformed_non_native_pct_2024")
    long = t.select("focus_region", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])).alias("e")).select("focus_region", "e.*")
    quantiles = wt.linear_quantiles(long, ["focus_region", "c"], "v", _Q)
    wide = quantiles.groupBy("focus_region").agg(*[F.max(F.when(F.col("c") == c, F.col(n))).alias(f"{c}_{n}") for c in cols for n in _Q])
    return rounded(join_groups(t.groupBy("focus_region").agg(F.count(F.lit(1)).alias("n")), wide, ["focus_region"], "left"))


def o60_all_and_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = cell_days(spark, sf_dir)
    return rounded(wt.all_and_each(days, "region", [F.count("tmax").alias("n"), F.avg("tmax").alias("tmax"), F.max("vpdmean").alias("vpd_max")]))


def o61_regional_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median per region and day where enough cells have a value."""
    days = cell_days(spark, sf_dir).filter("tmax is not null")
    days = days.withColumn("obs_date", F.col("obs_date").cast("string"))
    # cell_days has one row per cell and day.
    out = wt.linear_quantiles(days, ["region", "obs_date"], "tmax", {"tmax": 0.5}).withColumnRenamed("n", "n_cells")
    return rounded(out.filter("n_cells >= 5"))


def o62_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("dry_minus_humid_intensity_trend")
    criteria = {"over3": x > 3, "over4": x > 4, "over5": x > 5, "over4_dry": (x > 4) & (F.col("vpd_trend_decade") > 0)}
    return rounded(wt.criteria_shares(towns(spark, sf_dir), criteria, "total_area_2024_ha", "over4"))


def o29_quantile_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipalities above fixed and data-driven cutoffs, each also with a second condition."""
    t = towns(spark, sf_dir)
    x, good = F.col("dry_minus_humid_intensity_trend"), F.coalesce(F.col("vpd_trend_decade") > 0, F.lit(False))
    lim = wt.linear_quantiles(t, [], "dry_minus_humid_intensity_trend", {"p75": 0.75, "p90": 0.9}).drop("n")
    cuts = {"over3": F.lit(3.0), "over4": F.lit(4.0), "over5": F.lit(5.0), "p75": F.col("p75"), "p90": F.col("p90")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), c.alias("cut")) for n, c in cuts.items()]))
    rows = t.crossJoin(F.broadcast(lim)).select(x.alias("x"), good.alias("good"), each.alias("c"))  # one row
    return rounded(rows.groupBy("c.criterion").agg(F.max("c.cut").alias("cut"), F.count_if(F.col("x") >= F.col("c.cut")).alias("n"), F.count_if((F.col("x") >= F.col("c.cut")) & F.col("good")).alias("n_both")))


def o24_box_and_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of stations in a box of coordinates with a halo of one degree, in a range of years."""
    m = clean_missing(table(spark, sf_dir, "station_metadata")).filter(F.col("lat").between(-21, -9) & F.col("lon").between(-51, -39)).select("station_id")
    h = table(spark, sf_dir, "station_hourly").select("station_id", "obs_time").filter((F.col("obs_time") >= F.lit("2000-01-01")) & (F.col("obs_time") < F.lit("2005-01-01")))
    return h.join(m, "station_id", "left_semi").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


def o62_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by their share of the area that meets the criterion."""
    t = towns(spark, sf_dir).filter("total_area_2024_ha > 0 and focus_region is not null")
    hot = F.when(F.col("dry_minus_humid_intensity_trend") > 4, F.col("total_area_2024_ha")).otherwise(0.0)
    shares = t.groupBy("focus_region").agg(F.round(F.sum(hot) / F.sum("total_area_2024_ha"), 6).alias("share"))
    from pyspark.sql.window import Window

    return shares.withColumn("rank", F.rank().over(Window.orderBy(F.desc("share"))))  # one row per region


def o64_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each station's reading."""
    x = table(spark, sf_dir, "station_hourly").select("station_id", "obs_time", "reading_id", "loaded_at").filter("obs_time is not null")
    last = x.groupBy("station_id", "obs_time").agg(F.max(F.struct("loaded_at", "reading_id")).alias("m"), F.count(F.lit(1)).alias("n"))
    return last.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_times"), F.sum("n").alias("n_rows"), F.sum("m.reading_id").alias("id_sum"))


def o09_unpivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.unpivot_years(table(spark, sf_dir, "urban_module"), ["urb_id", "classnm"], "ha_", "ha")


def o65_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = o09_unpivot_years(spark, sf_dir)
    return rounded(long.groupBy("classnm").pivot("year", [1985, 2024]).agg(F.sum("ha")).withColumnsRenamed({"1985": "ha_1985", "2024": "ha_2024"}), 4)


def o66_null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return towns(spark, sf_dir).groupBy("state_acronym_norm", "focus_region").agg(F.count(F.lit(1)).alias("n"), F.count("rep_lat").alias("n_points"))


def o73_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.correlations(cell_days(spark, sf_dir), ["region"], "tmax", "vpdmean"), 5)


def o74_weighted_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.weighted_spearman(towns(spark, sf_dir), ["dominant_biome"], "vpd_trend_decade", "rh_trend_decade", "total_area_2024_ha"), 5)


def o74_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.permutation_p(towns(spark, sf_dir), "municipality_id", "vpd_trend_decade", "transformed_non_native_pct_2024", "total_area_2024_ha"), 5)


def o75_skill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.skill_scores(cell_days(spark, sf_dir), ["region"], "tmax", "tmean"), 5)


def o77_capped_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = table(spark, sf_dir, "residual_qc")
    return rounded(st.capped_outliers(qc, ["station_id", "variable"], "qc_id", "median_residual_era5_minus_inmet"), 5)


def o25_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = st.trim(towns(spark, sf_dir), "vpd_trend_decade", "rh_trend_decade", 0.02, 0.98)
    return kept.select("municipality_id")


def o78_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.bootstrap_mean(towns(spark, sf_dir), ["dominant_biome"], "municipality_id", "vpd_trend_decade", "total_area_2024_ha"), 5)


def o78_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of a value's mean between the upper and the lower quarter of another, with its bootstrap interval."""
    return rounded(st.bootstrap_difference(towns(spark, sf_dir), ["dominant_biome"], "municipality_id", "agri_gain_pct_points", "vpd_trend_decade", "total_area_2024_ha"), 5)


def o79_quartile_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of a value's median between the upper and the lower quarter of another."""
    t = towns(spark, sf_dir).filter("agri_gain_pct_points is not null and vpd_trend_decade is not null and focus_region is not null")
    lim = wt.linear_quantiles(t, ["focus_region"], "agri_gain_pct_points", {"lo": 0.25, "hi": 0.75}).drop("n")
    x, v = F.col("agri_gain_pct_points"), F.col("vpd_trend_decade")
    sides = F.filter(F.array(F.when(x >= F.col("hi"), "upper"), F.when(x <= F.col("lo"), "lower")), lambda s: s.isNotNull())
    parted = t.join(lim, "focus_region").select("focus_region", v.alias("v"), F.explode(sides).alias("side"))
    medians = wt.linear_quantiles(parted, ["focus_region", "side"], "v", {"m": 0.5})
    median = lambda side: F.max(F.when(F.col("side") == side, F.col("m")))
    out = medians.groupBy("focus_region").agg((median("upper") - median("lower")).alias("contrast"))
    return rounded(out.join(t.groupBy("focus_region").agg(F.count(F.lit(1)).alias("n")), "focus_region"))


def o80_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.stratum_anomaly(towns(spark, sf_dir), "dominant_biome", "vpd_trend_decade", "total_area_2024_ha", "anomaly")
    return rounded(out.select("municipality_id", "anomaly"))


def o81_wls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression on one predictor with HC3 errors."""
    fit = st.wls(towns(spark, sf_dir), "vpd_trend_decade", ["transformed_non_native_pct_2024"], "total_area_2024_ha")
    return rounded(fit.select("term", "beta", "se", "low", "high", "z", "n", "r2", "adj_r2", "aic", "bic"), 5)


def o81_wls_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression with controls, coordinates and biome effects."""
    return rounded(st.wls(towns(spark, sf_dir), "vpd_trend_decade", ["transformed_non_native_pct_2024", "agri_gain_pct_points", "rep_lat", "rep_lon"], "total_area_2024_ha", fixed=["dominant_biome"]))


def o82_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sm.spline_curve(towns(spark, sf_dir), "dominant_biome", "municipality_id", "transformed_non_native_pct_2024", "vpd_trend_decade", "total_area_2024_ha"), 4)


def o83_lowess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sm.lowess_curve(towns(spark, sf_dir), "dominant_biome", "municipality_id", "transformed_non_native_pct_2024", "vpd_trend_decade"), 4)


def o87_correlation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rank correlations of several predictors with one response."""
    t = towns(spark, sf_dir)
    predictors = ["rh_trend_decade", "dry_minus_humid_intensity_trend", "transformed_non_native_pct_2024", "agri_gain_pct_points"]
    long = t.select("vpd_trend_decade", "total_area_2024_ha", F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).alias("x")) for p in predictors])).alias("p")).select("*", "p.*")
    return rounded(st.weighted_spearman(long, ["predictor"], "x", "vpd_trend_decade", "total_area_2024_ha"), 5)


def o88_same_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = towns(spark, sf_dir).filter("vpd_trend_decade is not null and rh_trend_decade is not null and total_area_2024_ha > 0")
    same = F.signum("vpd_trend_decade") == F.signum("rh_trend_decade")
    return rounded(t.groupBy("dominant_biome").agg((F.sum(F.when(same, F.col("total_area_2024_ha")).otherwise(0.0)) / F.sum("total_area_2024_ha") * 100).alias("same_sign_pct")))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, y, x, tmax) of the grid's cells."""
    grid = clean_missing(table(spark, sf_dir, "daily_grid").select("cell_id", "lat", "lon", "tmax"))
    return grid.groupBy(F.col("cell_id").alias("key")).agg(F.max("lat").alias("y"), F.max("lon").alias("x"), F.avg("tmax").alias("tmax"))


def o89_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).select((F.col("y") * 4).cast("int").alias("iy"), (F.col("x") * 4).cast("int").alias("ix"), "tmax")
    return rounded(sm.gaussian_filter(cells, "iy", "ix", "tmax"), 5)


def o89_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).select((F.col("y") * 4).cast("int").alias("iy"), (F.col("x") * 4).cast("int").alias("ix"), (F.col("tmax") >= 30).alias("hot"))
    return sm.binary_filter(cells, "iy", "ix", "hot", steps="close")


def o90_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.density_bins(cell_days(spark, sf_dir), "tmax", "vpdmean", 20)


def o91_share_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("dry_minus_humid_intensity_trend")
    t = towns(spark, sf_dir)
    return rounded(t.groupBy("focus_region").agg(*[F.avg(F.when(x > k, 100.0).otherwise(0.0)).alias(f"over{k}") for k in (3, 4, 5)]))


_PREDICTORS = ("transformed_non_native_pct_2024", "agri_gain_pct_points")
_OUTCOMES = ("vpd_trend_decade", "rh_trend_decade")


def o91_r2_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted R2 of the weighted regression of each outcome on each predictor."""
    t = towns(spark, sf_dir)
    fits = [st.wls(t, y, [x], "total_area_2024_ha").filter(F.col("term") == x).select(F.lit(x).alias("predictor"), F.lit(y).alias("outcome"), "n", "adj_r2") for x in _PREDICTORS for y in _OUTCOMES]
    out = fits[0]
    for f in fits[1:]:
        out = out.unionByName(f)
    return rounded(out, 5)


def o_ordered_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by biome in a fixed order, biomes without a place in it behind."""
    t = towns(spark, sf_dir).groupBy("dominant_biome").agg(F.sum("total_area_2024_ha").alias("area"))
    place = tx.category_rank("dominant_biome", _BIOMES)
    return rounded(t.select("dominant_biome", place.alias("place"), "area").orderBy("place", "dominant_biome"), 3)


_BIOMES = ("Cerrado", "Amazonia", "Caatinga")


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with readings in both the hourly and the raw table."""
    return table(spark, sf_dir, "station_hourly").select("station_id").intersect(table(spark, sf_dir, "inmet_hourly_raw").select("station_id"))


def o94_axis_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = towns(spark, sf_dir)
    cols = ("vpd_trend_decade", "rh_trend_decade")
    long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.abs(c).alias("v")) for c in cols])).alias("e")).select("e.*")
    limits = wt.linear_quantiles(long, ["c"], "v", {"q": 0.97}).agg(*[F.max(F.when(F.col("c") == c, F.col("q"))).alias(c) for c in cols])
    return rounded(limits.crossJoin(t.agg(F.count(F.lit(1)).alias("n"))))  # one row each


def o93_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second row and column of the grid, the sampling that the operator is."""
    cells = _cells(spark, sf_dir)
    iy, ix = (F.col("y") * 4).cast("int"), (F.col("x") * 4).cast("int")
    return rounded(cells.filter((F.pmod(iy, F.lit(2)) == 0) & (F.pmod(ix, F.lit(2)) == 0)).select("key", "tmax"), 5)


def o28_tolerance_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("vpd_trend_decade"), F.col("rh_trend_decade")
    cls = F.when(a.isNull() | b.isNull(), -1).when((a > 0.01) & (b < -0.01), 3).when(a > 0.01, 2).when(a < -0.01, 1).otherwise(0)
    return towns(spark, sf_dir).groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def o30_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules of which later ones override, two of them from the data's own 75th percentiles."""
    t = towns(spark, sf_dir)
    four = t.filter("state_acronym_norm in ('SP', 'MG', 'RJ', 'ES')")
    lim = wt.linear_quantiles(four, [], "transformed_non_native_pct_2024", {"p_t": 0.75}).drop("n").crossJoin(wt.linear_quantiles(four, [], "agri_gain_pct_points", {"p_a": 0.75}).drop("n"))  # one row each
    x = t.crossJoin(F.broadcast(lim))  # one row
    state = F.col("state_acronym_norm")
    southeast = state.isin("SP", "MG", "RJ", "ES")
    region = sp.assign_regions({
        "cerrado": F.col("dominant_biome") == "Cerrado", "southeast": southeast, "southeast_transformed": southeast & (F.col("transformed_non_native_pct_2024") >= F.col("p_t")),
        "southeast_farming": southeast & (F.col("agri_gain_pct_points") >= F.col("p_a")), "matopiba": state.isin("MA", "TO", "PI", "BA") & (F.col("dominant_biome") == "Cerrado"),
    })
    return x.select("municipality_id", region.alias("region"))


def o32_normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "urban_module")
    return u.groupBy(tx.normalise_text(tx.name_without_state("munnm")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def o33_station_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "inmet_hourly_raw")
    return s.groupBy(tx.station_code("source_file").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("station_id").alias("n_stations"))


def o34_repair_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = towns(spark, sf_dir)
    fixed = m.select("municipality_id", tx.repair_coordinates(F.col("rep_lat"), F.col("rep_lon")).alias("c"))
    return rounded(fixed.select("municipality_id", "c.lat", "c.lon", F.coalesce("c.changed", F.lit(False)).alias("changed")), 5)


def o13_clean_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with decimal commas and marks of missing values, and dates of all plain layouts."""
    r = table(spark, sf_dir, "inmet_hourly_raw").select("station_id", tx.clean_number("tair_text").alias("t"), tx.clean_number("rh_text").alias("h"), tx.first_date("data_text").alias("d"))
    return rounded(r.groupBy("station_id").agg(F.count("t").alias("n_t"), F.sum("t").alias("sum_t"), F.count("h").alias("n_h"), F.sum("h").alias("sum_h"), F.count("d").alias("n_d"), F.max("d").cast("string").alias("last_d")), 4)


def o14_trusted_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of stations that are marked as working, and rows of all others."""
    from veranico.sources.stations import trusted_stations

    good = trusted_stations(table(spark, sf_dir, "station_metadata"), {"op_status": ["Operante", "sim", "true", "1"]})
    h = table(spark, sf_dir, "station_hourly").select("station_id", "uf")
    kept = h.join(good, "station_id", "left_semi").groupBy("uf").agg(F.count(F.lit(1)).alias("n_trusted"))
    rest = h.join(good, "station_id", "left_anti").groupBy("uf").agg(F.count(F.lit(1)).alias("n_other"))
    return kept.join(rest, "uf", "full_outer").select("uf", F.coalesce("n_trusted", F.lit(0)).alias("n_trusted"), F.coalesce("n_other", F.lit(0)).alias("n_other"))


def o_nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = valid_points(table(spark, sf_dir, "municipality_mechanism"), "municipality_id", "rep_lat", "rep_lon", BOX)
    out = sp.nearest(points, _cells(spark, sf_dir))
    return rounded(out.select(F.col("key").alias("municipality_id"), F.col("near").alias("cell_id"), "degrees"))


def o56_zonal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "municipality_polygons")
    rings = rings_from_wkt(shapes, "polygon_id", "geometry_wkt")
    centres = valid_points(shapes, "polygon_id", "rep_lat", "rep_lon", BOX)
    return rounded(sp.zonal_means(_cells(spark, sf_dir), rings, ["tmax"], centres).withColumnRenamed("region", "polygon_id"), 5)


def o56_zonal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each region's weight in cells that meet a condition: the zonal mean of 1 where it holds and 0 where not."""
    shapes = table(spark, sf_dir, "municipality_polygons")
    cells = _cells(spark, sf_dir).select("key", "y", "x", F.when(F.col("tmax").isNotNull(), (F.col("tmax") >= 30).cast("double")).alias("hot"))
    centres = valid_points(shapes, "polygon_id", "rep_lat", "rep_lon", BOX)
    return rounded(sp.zonal_means(cells, rings_from_wkt(shapes, "polygon_id", "geometry_wkt"), ["hot"], centres).withColumnRenamed("region", "polygon_id"), 5)


def pipe_station_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill of the nearest grid cell's daily mean temperature against each station's, after removal of outliers."""
    hourly = clean_missing(table(spark, sf_dir, "station_hourly").select("station_id", "obs_time", "tair_c"))
    observed = hourly.groupBy("station_id", F.to_date("obs_time").alias("day")).agg(F.avg("tair_c").alias("t")).filter("t is not null and day is not null")
    stations = valid_points(table(spark, sf_dir, "station_metadata"), "station_id", "lat", "lon", BOX)
    cell = sp.nearest(stations, _cells(spark, sf_dir)).select(F.col("key").alias("station_id"), F.col("near").alias("cell_id"))
    daily = cell_days(spark, sf_dir).filter("tmean is not null").select("cell_id", F.col("obs_date").alias("day"), F.col("tmean").alias("t"))
    return rounded(station_evaluation(observed, daily.join(cell, "cell_id"), keys=["station_id"], day="day", value="t"), 5)


def pipe_municipal_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation per biome between a municipality's share of transformed land and the temperature of the polygons that hold its point."""
    shapes = table(spark, sf_dir, "municipality_polygons")
    rings = rings_from_wkt(shapes, "polygon_id", "geometry_wkt")
    centres = valid_points(shapes, "polygon_id", "rep_lat", "rep_lon", BOX)
    land = towns(spark, sf_dir).select("municipality_id", "transformed_non_native_pct_2024", "total_area_2024_ha", "dominant_biome").join(p3_regions(spark, sf_dir), "municipality_id")
    out = municipal_association(_cells(spark, sf_dir), rings, centres, land, key="polygon_id", values=["tmax"], predictor="transformed_non_native_pct_2024", weight="total_area_2024_ha", stratum="dominant_biome")
    return rounded(out["spearman_tmax"], 5)


QUERIES = {
    f.__name__: f
    for f in (
        o52_weighted_mean, o53a_quantile_inverted, o53b_quantile_interp, o53c_quantile_midpoint, o54_weighted_zscore, o55_area_percent, o57_conditional_shares, o58_dominant,
        o59_region_summary, o60_all_and_each, o61_regional_median, o62_criteria, o29_quantile_criteria, o24_box_and_period, o62_ranking, o64_keep_last, o09_unpivot_years, o65_pivot, o66_null_groups, o73_correlations,
        o74_weighted_spearman, o74_permutation_p, o75_skill_scores, o77_capped_outliers, o25_trim, o78_bootstrap, o78_difference, o79_quartile_contrast, o80_anomaly, o81_wls, o81_wls_controls,
        o82_spline, o83_lowess, o87_correlation_table, o88_same_sign, o89_gaussian, o89_opening, o90_density, o91_share_matrix, o94_axis_limit, o93_subsample, o28_tolerance_class,
        o30_regions, o32_normalise_text, o33_station_code, o34_repair_coordinates, o13_clean_readings, o14_trusted_stations, o_nearest_cell, o56_zonal_means, o56_zonal_share, pipe_station_evaluation, pipe_municipal_association, o91_r2_matrix, o_ordered_categories, set_intersect,
    )
}

_VW = "b as (select dominant_biome, vpd_trend_decade v, sum(total_area_2024_ha) w from municipality_mechanism where vpd_trend_decade is not null and total_area_2024_ha > 0 group by 1, 2), g as (select *, sum(w) over (partition by dominant_biome order by v) upto, sum(w) over (partition by dominant_biome) total from b)"


def _interp(at: str, digits: int = 6) -> str:
    cols = []
    for n, p in _Q.items():
        lo, hi = f"max(struct_pack(c := c, v := v)) filter (c <= {p})", f"min(struct_pack(c := c, v := v)) filter (c > {p})"
        cols.append(f"round(case when {lo} is null then ({hi}).v when {hi} is null then ({lo}).v else ({lo}).v + (({hi}).v - ({lo}).v) * ({p} - ({lo}).c) / (({hi}).c - ({lo}).c) end, {digits}) {n}")
    return f"with {_VW}, k as (select *, {at} c from g) select dominant_biome, {', '.join(cols)} from k group by 1"


def _spearman(keys: str, source: str) -> str:
    part = f"partition by {keys} order by" if keys else "order by"
    same = f"partition by {keys}, " if keys else "partition by "
    return f"""r as (select {keys + ',' if keys else ''} id, w, rank() over ({part} x) + (count(*) over ({same}x) - 1) / 2.0 rx, rank() over ({part} y) + (count(*) over ({same}y) - 1) / 2.0 ry from {source})"""


def _wcorr(x: str = "rx", y: str = "ry") -> str:
    return f"(sum(w * {x} * {y}) / sum(w) - sum(w * {x}) / sum(w) * sum(w * {y}) / sum(w)) / sqrt((sum(w * {x} * {x}) / sum(w) - (sum(w * {x}) / sum(w)) * (sum(w * {x}) / sum(w))) * (sum(w * {y} * {y}) / sum(w) - (sum(w * {y}) / sum(w)) * (sum(w * {y}) / sum(w))))"


_ACC = "translate({0}, 'ÁÂÃÀÄÉÊÈËÍÎÌÏÓÔÕÒÖÚÛÙÜÇÑáâãàäéêèëíîìïóôõòöúûùüçñ', 'AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn')"
_CELLS = f"cells as (select cell_id as key, max(lat) y, max(lon) x, avg({_n('tmax')}) tmax from daily_grid group by 1)"
_GRID = _CELLS + ", gr as (select cast(trunc(y * 4) as int) iy, cast(trunc(x * 4) as int) ix, tmax from cells)"
_RINGS = """corners as (select polygon_id, i, split_part(p, ' ', 1)::double x, split_part(p, ' ', 2)::double y from (
  select polygon_id, unnest(ps) p, generate_subscripts(ps, 1) i from (select polygon_id, regexp_extract_all(geometry_wkt, '-?[0-9.]+ -?[0-9.]+') ps from municipality_polygons where geometry_wkt like 'POLYGON%'))),
edges as (select a.polygon_id, a.x x1, a.y y1, b.x x2, b.y y2 from corners a join corners b on a.polygon_id = b.polygon_id and b.i = a.i + 1)"""
_NUM = lambda c: (
    f"(select try_cast(replace(case when regexp_full_match(z, '-?[0-9]{{1,3}}([.][0-9]{{3}})+,[0-9]+') then replace(z, '.', '') else z end, ',', '.') as double) from (select case when regexp_full_match(trim({c}), '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)') or regexp_full_match(trim({c}), '-?[0-9]{{1,3}}([.][0-9]{{3}})+,[0-9]+') then trim({c}) end z))"
)

_DATES = ", ".join(
    f"case when regexp_full_match(trim(data_text), '{pattern}') then try_strptime(trim(data_text), '{layout}') end"
    for sep in "/-"
    for pattern, layout in ((f"[0-9]{{4}}{sep}[0-9]{{1,2}}{sep}[0-9]{{1,2}}", f"%Y{sep}%m{sep}%d"), (f"[0-9]{{1,2}}{sep}[0-9]{{1,2}}{sep}[0-9]{{4}}", f"%d{sep}%m{sep}%Y"), (f"[0-9]{{1,2}}{sep}[0-9]{{1,2}}{sep}[0-9]{{2}}", f"%d{sep}%m{sep}%y"))
)

# Rows once per resample with the number of copies that the hash of id and resample draws.
_DRAWN = "u as (select s.*, rep, ('0x' || substr(md5(id || '-' || rep), 1, 8))::bigint / 4294967296.0 u from s, (select unnest(range(1, 501)) rep)), drawn as (select *, " + " + ".join(f"(u >= {x})::int" for x in st.poisson_steps()) + " copies from u)"

SQL = {
    "o52_weighted_mean": "select dominant_biome, round(sum(vpd_trend_decade * total_area_2024_ha) / sum(total_area_2024_ha), 6) mean, count(*) n from municipality_mechanism where vpd_trend_decade is not null and total_area_2024_ha > 0 group by 1",
    "o53a_quantile_inverted": f"with {_VW} select dominant_biome, " + ", ".join(f"round(min(v) filter (upto / total >= {p} - 1e-12), 6) {n}" for n, p in _Q.items()) + " from g group by 1",
    "o53b_quantile_interp": _interp("upto / total"),
    "o53c_quantile_midpoint": _interp("(upto - w / 2) / total"),
    "o54_weighted_zscore": """with g as (select dominant_biome b, sum(rh_trend_decade * total_area_2024_ha) / sum(total_area_2024_ha) m, sum(rh_trend_decade * rh_trend_decade * total_area_2024_ha) / sum(total_area_2024_ha) q from municipality_mechanism where rh_trend_decade is not null and total_area_2024_ha > 0 group by 1)
select municipality_id, case when total_area_2024_ha > 0 then round((rh_trend_decade - m) / sqrt(q - m * m), 5) end z from municipality_mechanism join g on dominant_biome is not distinct from b""",
    "o55_area_percent": f"""with s as (select dominant_biome, count(*) n, sum(case when v > 0 then w else 0 end) / sum(w) * 100 positive, sum(case when v < 0 then w else 0 end) / sum(w) * 100 negative,
sum(case when p < 5 and v > 0 then w else 0 end) / sum(w) * 100 significant_positive, sum(case when p < 5 and v < 0 then w else 0 end) / sum(w) * 100 significant_negative
from (select dominant_biome, vpd_trend_decade v, total_area_2024_ha w, agri_gain_pct_points p from municipality_mechanism where vpd_trend_decade is not null and total_area_2024_ha > 0) group by 1), q as ({_interp('upto / total', 14)})
select s.dominant_biome, n, round(positive, 6) positive, round(negative, 6) negative, round(significant_positive, 6) significant_positive, round(significant_negative, 6) significant_negative, round(q25, 6) q25, round(q50, 6) q50, round(q75, 6) q75, round(q75 - q25, 6) iqr from s join q on s.dominant_biome is not distinct from q.dominant_biome""",
    "o57_conditional_shares": """with s as (select biomanm, sum(ha_2024) total, sum(case when classnm in ('Área urbana', 'Infraestrutura') then ha_2024 else 0 end) built, sum(case when classnm = 'Favela/aglomerado' then ha_2024 else 0 end) informal from urban_module group by 1)
select biomanm, round(total, 5) total, round(built, 5) built, round(informal, 5) informal, case when total > 0 then round(built / total * 100, 5) end built_pct, case when total > 0 then round(informal / total * 100, 5) end informal_pct from s""",
    "o58_dominant": """with s as (select statenm, classnm, coalesce(sum(ha_2024), 0) t from urban_module group by 1, 2), r as (select *, row_number() over (partition by statenm order by t desc, classnm nulls first) rn from s) select statenm, classnm, round(t, 4) ha_2024 from r where rn = 1""",
    "o59_region_summary": "select focus_region, count(*) n, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) {c}_{n}" for c in ("vpd_trend_decade", "rh_trend_decade", "transformed_non_native_pct_2024") for n, p in _Q.items()) + " from municipality_mechanism group by 1",
    "o60_all_and_each": f"with {_CELL} select case when grouping(region) = 1 then 'ALL' else region end region, count(tmax) n, round(avg(tmax), 6) tmax, max(vpdmean) vpd_max from c group by grouping sets ((region), ())",
    "o61_regional_median": f"with {_CELL} select region, obs_date::varchar obs_date, round(median(tmax), 6) tmax, count(distinct cell_id) n_cells from c where tmax is not null group by 1, 2 having count(distinct cell_id) >= 5",
    "o62_criteria": """with t as (select total_area_2024_ha w, dry_minus_humid_intensity_trend x, vpd_trend_decade v from municipality_mechanism where total_area_2024_ha > 0),
c as (select w, coalesce(x > 4, false) p, 'over3' criterion, coalesce(x > 3, false) o from t union all select w, coalesce(x > 4, false), 'over4', coalesce(x > 4, false) from t union all select w, coalesce(x > 4, false), 'over5', coalesce(x > 5, false) from t union all select w, coalesce(x > 4, false), 'over4_dry', coalesce(x > 4 and v > 0, false) from t)
select criterion, count(*) filter (o) n, round(sum(case when o then w else 0 end), 6) area, round(sum(case when o then w else 0 end) / sum(w), 6) as share, round(sum(case when o and p then w else 0 end) / sum(case when o or p then w else 0 end), 6) jaccard from c group by 1""",
    "o29_quantile_criteria": """with l as (select quantile_cont(dry_minus_humid_intensity_trend, 0.75) p75, quantile_cont(dry_minus_humid_intensity_trend, 0.9) p90 from municipality_mechanism),
c as (select 'over3' criterion, 3.0::double cut union all select 'over4', 4.0 union all select 'over5', 5.0 union all select 'p75', p75 from l union all select 'p90', p90 from l)
select criterion, round(cut, 6) cut, count(*) filter (dry_minus_humid_intensity_trend >= cut) n, count(*) filter (dry_minus_humid_intensity_trend >= cut and vpd_trend_decade > 0) n_both from municipality_mechanism, c group by 1, 2""",
    "o24_box_and_period": "select station_id, count(*) n from station_hourly where year(obs_time) between 2000 and 2004 and station_id in (select station_id from station_metadata where lat between -21 and -9 and lon between -51 and -39) group by 1",
    "o62_ranking": "with s as (select focus_region, round(sum(case when dry_minus_humid_intensity_trend > 4 then total_area_2024_ha else 0 end) / sum(total_area_2024_ha), 6) as share from municipality_mechanism where total_area_2024_ha > 0 and focus_region is not null group by 1) select *, rank() over (order by share desc) rank from s",
    "o64_keep_last": "with r as (select station_id, obs_time, reading_id, row_number() over (partition by station_id, obs_time order by loaded_at desc nulls last, reading_id desc) rn from station_hourly where obs_time is not null) select station_id, count(*) filter (rn = 1) n_times, count(*) n_rows, sum(reading_id) filter (rn = 1)::bigint id_sum from r group by 1",
    "o09_unpivot_years": "select urb_id, classnm, 1985 as year, ha_1985 ha from urban_module union all select urb_id, classnm, 2024, ha_2024 from urban_module",
    "o65_pivot": "select classnm, round(sum(ha_1985), 4) ha_1985, round(sum(ha_2024), 4) ha_2024 from urban_module group by 1",
    "o66_null_groups": "select state_acronym_norm, focus_region, count(*) n, count(rep_lat) n_points from municipality_mechanism group by 1, 2",
    "o73_correlations": f"with {_CELL}, s as (select region, 1 w, row_number() over () id, tmax x, vpdmean y from c where tmax is not null and vpdmean is not null), {_spearman('region', 's')}, p as (select region, count(*) n, corr(x, y) pearson from s group by 1) select region, n, round(pearson, 5) pearson, round(spearman, 5) spearman from p join (select region, corr(rx, ry) spearman from r group by 1) using (region)",
    "o74_weighted_spearman": f"with s as (select dominant_biome, municipality_id id, total_area_2024_ha w, vpd_trend_decade x, rh_trend_decade y from municipality_mechanism where vpd_trend_decade is not null and rh_trend_decade is not null and total_area_2024_ha > 0), {_spearman('dominant_biome', 's')} select dominant_biome, count(*) n, case when count(*) >= 10 then round({_wcorr()}, 5) end rho from r group by 1",
    "o74_permutation_p": f"""with s as (select municipality_id id, total_area_2024_ha w, vpd_trend_decade x, transformed_non_native_pct_2024 y from municipality_mechanism where vpd_trend_decade is not null and transformed_non_native_pct_2024 is not null and total_area_2024_ha > 0), {_spearman('', 's')},
b as (select *, row_number() over (order by md5(id || '-0')) place from r), o as (select count(*) n, {_wcorr()} rho from r),
h as (select k, id, rx, w, row_number() over (partition by k order by md5(id || '-' || k)) place from r, (select unnest(range(1, 1000)) k)),
q as (select h.k, {_wcorr('h.rx', 'b.ry').replace('w *', 'h.w *').replace('sum(w)', 'sum(h.w)')} rr from h join b using (place) group by 1)
select n, round(rho, 5) rho, (select count(*) from q where abs(rr) >= abs(rho) - 1e-12)::int exceed, round(((select count(*) from q where abs(rr) >= abs(rho) - 1e-12) + 1) / 1000.0, 5) p_value from o""",
    "o75_skill_scores": f"""with {_CELL}, s as (select region, tmax - tmean d, tmax m, tmean o from c where tmax is not null and tmean is not null), a as (select region, count(*) n, avg(d) bias, avg(abs(d)) mae, sqrt(avg(d * d)) rmse, corr(m, o) r, stddev_pop(m) sm, stddev_pop(o) so, sqrt(avg(d * d) - avg(d) * avg(d)) c from s group by 1)
select region, n, round(bias, 5) bias, round(mae, 5) mae, round(rmse, 5) rmse, round(r, 5) r, round(sm / so, 5) sd_ratio, round(rmse / so, 5) nrmse, round(c / so, 5) crmse from a""",
    "o77_capped_outliers": """with s as (select station_id, variable, qc_id, median_residual_era5_minus_inmet d from residual_qc where median_residual_era5_minus_inmet is not null),
a as (select station_id, variable, count(*) n, quantile_cont(d, 0.25) q1, median(d) q2, quantile_cont(d, 0.75) q3, stddev_samp(d) sd from s group by 1, 2 having count(*) >= 30),
e as (select s.*, n, q1, q3, sd, abs(d - q2) dev from s join a using (station_id, variable)), b as (select station_id, variable, median(dev) * 1.4826 mad from e group by 1, 2),
o as (select e.*, case when mad > 0 then mad when q3 > q1 then (q3 - q1) / 1.349 else sd end * 6 lim from e join b using (station_id, variable)),
r as (select *, row_number() over (partition by station_id, variable order by dev desc, qc_id) rn from o where dev > lim)
select station_id, variable, qc_id, round(dev, 5) deviation from r where rn <= greatest(1, floor(n * 0.03 + 1e-9))""",
    "o25_trim": """with a as (select * from municipality_mechanism where vpd_trend_decade between (select quantile_cont(vpd_trend_decade, 0.02) from municipality_mechanism) and (select quantile_cont(vpd_trend_decade, 0.98) from municipality_mechanism))
select municipality_id from a where rh_trend_decade between (select quantile_cont(rh_trend_decade, 0.02) from a) and (select quantile_cont(rh_trend_decade, 0.98) from a)""",
    "o79_quartile_contrast": """with t as (select focus_region f, agri_gain_pct_points x, vpd_trend_decade v from municipality_mechanism where agri_gain_pct_points is not null and vpd_trend_decade is not null and focus_region is not null), l as (select f, quantile_cont(x, 0.25) lo, quantile_cont(x, 0.75) hi from t group by 1)
select f focus_region, round(median(case when x >= hi then v end) - median(case when x <= lo then v end), 6) contrast, count(*) n from t join l using (f) group by 1""",
    "o80_anomaly": """with g as (select dominant_biome b, sum(vpd_trend_decade * total_area_2024_ha) / sum(total_area_2024_ha) m from municipality_mechanism where vpd_trend_decade is not null and total_area_2024_ha > 0 group by 1)
select municipality_id, round(vpd_trend_decade - m, 6) anomaly from municipality_mechanism left join g on dominant_biome is not distinct from b""",
    "o81_wls": """with s as (select vpd_trend_decade y, transformed_non_native_pct_2024 x, total_area_2024_ha w from municipality_mechanism where vpd_trend_decade is not null and transformed_non_native_pct_2024 is not null and total_area_2024_ha > 0),
a as (select sum(w) s0, sum(w * x) s1, sum(w * x * x) s2, sum(w * y) t0, sum(w * x * y) t1, sum(w * y * y) yy, count(*) n from s),
b as (select *, s0 * s2 - s1 * s1 dt, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) b0, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) b1 from a),
e as (select x, w * (y - b0 - b1 * x) / (1 - w * (s2 - 2 * s1 * x + s0 * x * x) / dt) u from s, b),
m as (select sum(u * u) m0, sum(u * u * x) m1, sum(u * u * x * x) m2 from e),
f as (select 'const' term, b0 c, sqrt((s2 * s2 * m0 - 2 * s2 * s1 * m1 + s1 * s1 * m2) / (dt * dt)) se from b, m
  union all select 'transformed_non_native_pct_2024', b1, sqrt((s1 * s1 * m0 - 2 * s0 * s1 * m1 + s0 * s0 * m2) / (dt * dt)) from b, m),
g as (select n, yy - b0 * t0 - b1 * t1 rss, yy - t0 * t0 / s0 tss, (select sum(ln(w)) from s) lw from b where n >= 80),
l as (select *, -n / 2.0 * ln(rss / n) - n / 2.0 * (1 + ln(2 * pi())) + lw / 2 ll from g)
select term, round(c, 5) beta, round(se, 5) se, round(c - 1.959964 * se, 5) low, round(c + 1.959964 * se, 5) high, round(c / se, 5) z, n, round(1 - rss / tss, 5) r2, round(1 - rss / tss * (n - 1) / (n - 2), 5) adj_r2, round(4 - 2 * ll, 5) aic, round(2 * ln(n) - 2 * ll, 5) bic from f, l""",
    "o78_bootstrap": f"""with s as (select dominant_biome k, municipality_id id, vpd_trend_decade v, total_area_2024_ha w from municipality_mechanism where vpd_trend_decade is not null and total_area_2024_ha > 0), {_DRAWN},
m as (select k, rep, sum(v * w * copies) / sum(w * copies) m from drawn where copies > 0 group by 1, 2), q as (select k, quantile_cont(m, 0.025) low, quantile_cont(m, 0.975) high from m group by 1), o as (select k, sum(v * w) / sum(w) mean from s group by 1)
select o.k dominant_biome, round(mean, 5) mean, round(low, 5) low, round(high, 5) high from o join q on o.k is not distinct from q.k""",
    "o78_difference": f"""with t as (select dominant_biome k, municipality_id id, agri_gain_pct_points x, vpd_trend_decade v, total_area_2024_ha w from municipality_mechanism where agri_gain_pct_points is not null and vpd_trend_decade is not null and total_area_2024_ha > 0),
e as (select k, quantile_cont(x, 0.25) lo, quantile_cont(x, 0.75) hi from t group by 1), s as (select t.*, x >= hi up from t join e on t.k is not distinct from e.k where x >= hi or x <= lo), {_DRAWN},
m as (select k, rep, sum(v * w * copies) filter (up) / sum(w * copies) filter (up) - sum(v * w * copies) filter (not up) / sum(w * copies) filter (not up) m from drawn where copies > 0 group by 1, 2),
q as (select k, quantile_cont(m, 0.025) low, quantile_cont(m, 0.975) high from m group by 1), o as (select k, sum(v * w) filter (up) / sum(w) filter (up) - sum(v * w) filter (not up) / sum(w) filter (not up) difference from s group by 1)
select o.k dominant_biome, round(difference, 5) difference, round(low, 5) low, round(high, 5) high from o join q on o.k is not distinct from q.k""",
    "o87_correlation_table": "with s as (" + " union all ".join(f"select '{p}' predictor, municipality_id id, total_area_2024_ha w, {p} x, vpd_trend_decade y from municipality_mechanism where vpd_trend_decade is not null and {p} is not null and total_area_2024_ha > 0" for p in ("rh_trend_decade", "dry_minus_humid_intensity_trend", "transformed_non_native_pct_2024", "agri_gain_pct_points")) + f"), {_spearman('predictor', 's')} select predictor, count(*) n, round({_wcorr()}, 5) rho from r group by 1",
    "o88_same_sign": "select dominant_biome, round(sum(case when sign(vpd_trend_decade) = sign(rh_trend_decade) then total_area_2024_ha else 0 end) / sum(total_area_2024_ha) * 100, 6) same_sign_pct from municipality_mechanism where vpd_trend_decade is not null and rh_trend_decade is not null and total_area_2024_ha > 0 group by 1",
    "o89_gaussian": f"with {_GRID} select a.iy, a.ix, round(sum(exp(-(power(a.iy - b.iy, 2) + power(a.ix - b.ix, 2)) / 2) * b.tmax) / sum(exp(-(power(a.iy - b.iy, 2) + power(a.ix - b.ix, 2)) / 2)), 5) tmax from (select distinct iy, ix from gr) a join gr b on abs(a.iy - b.iy) <= 3 and abs(a.ix - b.ix) <= 3 and b.tmax is not null group by 1, 2",
    "o89_opening": f"""with {_GRID}, c as (select iy, ix, coalesce(tmax >= 30, false) m from gr), n as (select * from (values (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) v(a, b)),
d as (select c.iy, c.ix, coalesce(bool_or(o.m), false) m from c, n left join c o on o.iy = c.iy + n.a and o.ix = c.ix + n.b group by 1, 2)
select d.iy, d.ix, count(*) filter (o.m) = 5 hot from d, n left join d o on o.iy = d.iy + n.a and o.ix = d.ix + n.b group by 1, 2""",
    "o90_density": f"with {_CELL}, s as (select tmax a, vpdmean b from c where tmax is not null and vpdmean is not null), e as (select min(a) x0, max(a) x1, min(b) y0, max(b) y1 from s) select least(floor((a - x0) / (x1 - x0) * 20), 19)::int bx, least(floor((b - y0) / (y1 - y0) * 20), 19)::int \"by\", count(*) n from s, e group by 1, 2",
    "o91_share_matrix": "select focus_region, " + ", ".join(f"round(avg(case when dry_minus_humid_intensity_trend > {k} then 100.0 else 0.0 end), 6) over{k}" for k in (3, 4, 5)) + " from municipality_mechanism group by 1",
    "o94_axis_limit": "select round(quantile_cont(abs(vpd_trend_decade), 0.97), 6) vpd_trend_decade, round(quantile_cont(abs(rh_trend_decade), 0.97), 6) rh_trend_decade, count(*) n from municipality_mechanism",
    "o93_subsample": f"with {_CELLS} select key, round(tmax, 5) tmax from cells where trunc(y * 4)::int % 2 = 0 and trunc(x * 4)::int % 2 = 0",
    "o28_tolerance_class": "select case when vpd_trend_decade is null or rh_trend_decade is null then -1 when vpd_trend_decade > 0.01 and rh_trend_decade < -0.01 then 3 when vpd_trend_decade > 0.01 then 2 when vpd_trend_decade < -0.01 then 1 else 0 end as class, count(*) n from municipality_mechanism group by 1",
    "o30_regions": """with l as (select quantile_cont(transformed_non_native_pct_2024, 0.75) p_t, quantile_cont(agri_gain_pct_points, 0.75) p_a from municipality_mechanism where state_acronym_norm in ('SP', 'MG', 'RJ', 'ES'))
select municipality_id, case when state_acronym_norm in ('MA', 'TO', 'PI', 'BA') and dominant_biome = 'Cerrado' then 'matopiba' when state_acronym_norm in ('SP', 'MG', 'RJ', 'ES') and agri_gain_pct_points >= p_a then 'southeast_farming'
when state_acronym_norm in ('SP', 'MG', 'RJ', 'ES') and transformed_non_native_pct_2024 >= p_t then 'southeast_transformed' when state_acronym_norm in ('SP', 'MG', 'RJ', 'ES') then 'southeast' when dominant_biome = 'Cerrado' then 'cerrado' end region from municipality_mechanism, l""",
    "o32_normalise_text": "select upper(trim(regexp_replace(" + _ACC.format("trim(regexp_replace(munnm, '\\s*\\([A-Za-z]{2}\\)\\s*$', ''))") + ", '\\s+', ' ', 'g'))) as name, count(*) n from urban_module group by 1",
    "o33_station_code": "with s as (select station_id, upper(regexp_extract(source_file, '([A-Za-z][0-9]{3})', 1)) l, regexp_extract(source_file, '([0-9]+)', 1) d from inmet_hourly_raw) select case when l <> '' then l when d <> '' then try_cast(d as bigint)::varchar end code, count(*) n, count(distinct station_id) n_stations from s group by 1",
    "o34_repair_coordinates": """with c as (select municipality_id id, i * 100 + j * 10 + turn * 2 + flip changed, case when turn = 1 then rep_lon else rep_lat end / power(10, i) lat, case when flip = 1 then -1 else 1 end * case when turn = 1 then rep_lat else rep_lon end / power(10, j) lon
from municipality_mechanism, (select unnest(range(4)) i), (select unnest(range(4)) j), (select unnest([0, 1]) turn), (select unnest([0, 1]) flip)),
r as (select *, row_number() over (partition by id order by changed, lat, lon) rn from c where lat between -35 and 6 and lon between -75 and -32)
select municipality_id, round(lat, 5) lat, round(lon, 5) lon, coalesce(changed > 0, false) changed from municipality_mechanism left join r on id = municipality_id and rn = 1""",
    "o13_clean_readings": f"""with r as (select station_id, {_NUM('tair_text')} t, {_NUM('rh_text')} h, coalesce({_DATES})::date d from inmet_hourly_raw),
c as (select station_id, case when t not in (-9999, -999) then t end t, case when h not in (-9999, -999) then h end h, d from r)
select station_id, count(t) n_t, round(sum(t), 4) sum_t, count(h) n_h, round(sum(h), 4) sum_h, count(d) n_d, max(d)::varchar last_d from c group by 1""",
    "o14_trusted_stations": "with g as (select distinct station_id from station_metadata where lower(trim(op_status)) in ('operante', 'sim', 'true', '1')) select uf, count(*) filter (station_id in (select station_id from g)) n_trusted, count(*) filter (station_id not in (select station_id from g)) n_other from station_hourly group by 1",
    "o_nearest_cell": f"with {_CELLS}, p as (select municipality_id, rep_lat, rep_lon from municipality_mechanism where rep_lat between -34 and 6 and rep_lon between -74.5 and -32), d as (select municipality_id, key, sqrt((rep_lat - y) * (rep_lat - y) + (rep_lon - x) * (rep_lon - x)) dg from p, cells), r as (select *, row_number() over (partition by municipality_id order by dg, key) rn from d) select municipality_id, key cell_id, round(dg, 6) degrees from r where rn = 1",
    "o91_r2_matrix": " union all ".join(
        f"select '{x}' predictor, '{y}' outcome, n, round(1 - (1 - r * r) * (n - 1) / (n - 2), 5) adj_r2 from (select count(*) n, (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) / sqrt((sum(w * x * x) / sum(w) - power(sum(w * x) / sum(w), 2)) * (sum(w * y * y) / sum(w) - power(sum(w * y) / sum(w), 2))) r"
        f" from (select {x} x, {y} y, total_area_2024_ha w from municipality_mechanism where {x} is not null and {y} is not null and total_area_2024_ha > 0)) where n >= 80"
        for x in _PREDICTORS
        for y in _OUTCOMES
    ),
    "o_ordered_categories": "select dominant_biome, coalesce(nullif(list_position(['cerrado', 'amazonia', 'caatinga'], lower(dominant_biome)), 0), 4)::int place, round(sum(total_area_2024_ha), 3) area from municipality_mechanism group by 1",
    "set_intersect": "select station_id from station_hourly intersect select station_id from inmet_hourly_raw",
    "pipe_station_evaluation": f"""with {_CELLS}, {_CELL}, o as (select station_id, cast(obs_time as date) d, avg(case when isnan(tair_c) then null else tair_c end) o from station_hourly where obs_time is not null group by 1, 2),
st as (select station_id, lat, lon from station_metadata where lat between -34 and 6 and lon between -74.5 and -32),
nr as (select station_id, key, row_number() over (partition by station_id order by sqrt((lat - y) * (lat - y) + (lon - x) * (lon - x)), key) rn from st, cells),
p as (select station_id, d, o, tmean m, tmean - o diff from o join nr using (station_id) join c on c.cell_id = nr.key and c.obs_date = o.d where rn = 1 and o is not null and tmean is not null),
a as (select station_id, count(*) n, quantile_cont(diff, 0.25) q1, median(diff) q2, quantile_cont(diff, 0.75) q3, stddev_samp(diff) sd from p group by 1 having count(*) >= 30),
e as (select p.*, n, q1, q3, sd, abs(diff - q2) dev from p join a using (station_id)), h as (select station_id, median(dev) * 1.4826 mad from e group by 1),
r as (select e.station_id, d, n, row_number() over (partition by e.station_id order by dev desc, d) rn from e join h using (station_id) where dev > 6 * case when mad > 0 then mad when q3 > q1 then (q3 - q1) / 1.349 else sd end),
k as (select p.station_id, m, o, diff d from p where not exists (select 1 from r where r.station_id = p.station_id and r.d = p.d and rn <= greatest(1, floor(n * 0.03 + 1e-9)))),
z as (select station_id, count(*) n, avg(d) bias, avg(abs(d)) mae, sqrt(avg(d * d)) rmse, corr(m, o) r, stddev_pop(m) sm, stddev_pop(o) so, sqrt(greatest(avg(d * d) - avg(d) * avg(d), 0)) c from k group by 1 having count(*) >= 2)
select station_id, n, round(bias, 5) bias, round(mae, 5) mae, round(rmse, 5) rmse, case when sm > 0 and so > 0 then round(r, 5) end r, case when so > 0 then round(sm / so, 5) end sd_ratio, case when so > 0 then round(rmse / so, 5) end nrmse, case when so > 0 then round(c / so, 5) end crmse from z""",
    "o56_zonal_means": f"""with {_CELLS}, {_RINGS}, z as (select polygon_id, key from cells, edges where (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) group by 1, 2 having count(*) % 2 = 1),
zm as (select polygon_id, sum(tmax * cos(radians(y))) / sum(case when tmax is not null then cos(radians(y)) end) tmax, count(*) n_cells from z join cells using (key) group by 1),
b as (select polygon_id, rep_lat, rep_lon from municipality_polygons where rep_lat between -34 and 6 and rep_lon between -74.5 and -32 and polygon_id not in (select polygon_id from zm)),
d as (select polygon_id, tmax, row_number() over (partition by polygon_id order by sqrt((rep_lat - y) * (rep_lat - y) + (rep_lon - x) * (rep_lon - x)), key) rn from b, cells)
select polygon_id, round(tmax, 5) tmax, n_cells, 'zonal' as method from zm union all select polygon_id, round(tmax, 5), 0, 'nearest' from d where rn = 1""",
    "o56_zonal_share": f"""with {_CELLS}, hots as (select key, y, x, case when tmax is not null then (tmax >= 30)::int::double end hot from cells), {_RINGS}, z as (select polygon_id, key from hots, edges where (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) group by 1, 2 having count(*) % 2 = 1),
zm as (select polygon_id, sum(hot * cos(radians(y))) / sum(case when hot is not null then cos(radians(y)) end) hot, count(*) n_cells from z join hots using (key) group by 1),
b as (select polygon_id, rep_lat, rep_lon from municipality_polygons where rep_lat between -34 and 6 and rep_lon between -74.5 and -32 and polygon_id not in (select polygon_id from zm)),
d as (select polygon_id, hot, row_number() over (partition by polygon_id order by sqrt((rep_lat - y) * (rep_lat - y) + (rep_lon - x) * (rep_lon - x)), key) rn from b, hots)
select polygon_id, round(hot, 5) hot, n_cells, 'zonal' as method from zm union all select polygon_id, round(hot, 5), 0, 'nearest' from d where rn = 1""",
}
SQL["pipe_municipal_association"] = f"""with zt as ({SQL['o56_zonal_means']}), located as ({problems.SQL['p3_regions']}),
s as (select dominant_biome, municipality_id || '-' || polygon_id id, total_area_2024_ha w, transformed_non_native_pct_2024 x, tmax y from municipality_mechanism join located using (municipality_id) join zt using (polygon_id)
  where tmax is not null and transformed_non_native_pct_2024 is not null and total_area_2024_ha > 0),
{_spearman('dominant_biome', 's')} select dominant_biome, count(*) n, case when count(*) >= 10 then round({_wcorr()}, 5) end rho from r group by 1"""
