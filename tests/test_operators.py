"""Hand-computed vectors and properties of the climate, weighted and statistics operators."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veranico.functions import text as tx
from veranico.functions import thermo as th
from veranico.operators import climatology as cl
from veranico.operators import events as ev
from veranico.operators import qc
from veranico.operators import smooth as sm
from veranico.operators import spatial as sp
from veranico.operators import stats as st
from veranico.operators import trends as tr
from veranico.operators import weighted as wt


def days(*spans):
    return [dt.date.fromisoformat(a) + dt.timedelta(i) for a, n in spans for i in range(n)]


def annual(spark, rows, least=3):
    df = spark.createDataFrame([("k", d, on, s) for d, on, s in rows], "k string, day date, hot boolean, sev double")
    return {r["year"]: (r["frequency"], r["duration"], r["intensity"]) for r in ev.annual_events(df, ["k"], "day", F.col("hot"), F.col("sev"), least).collect()}


def test_runs(spark):
    mask = [1, 1, 0, 1, 1, 1, 0, 1, 1, 1, 1]
    rows = [(d, bool(m), 2.0) for d, m in zip(days(("2001-05-01", 11)), mask)]
    assert annual(spark, rows) == {2001: (2, 7, 14.0)}
    assert annual(spark, [(d, True, 1.0) for d in days(("2001-12-30", 4))]) == {2001: (1, 2, 2.0), 2002: (0, 2, 2.0)}
    assert annual(spark, [(d, True, 1.0) for d in days(("2004-02-27", 2), ("2004-03-01", 1))]) == {2004: (1, 3, 3.0)}
    assert annual(spark, [(d, True, 1.0) for d in days(("2001-05-01", 2), ("2001-05-04", 1))]) == {2001: (0, 0, 0.0)}
    assert annual(spark, [(d, True, s) for d, s in zip(days(("2001-05-01", 3)), (1.0, -1.0, None))]) == {2001: (1, 3, 1.0)}
    assert annual(spark, [(d, None, 1.0) for d in days(("2001-05-01", 4))]) == {2001: (0, 0, 0.0)}


def test_states_are_a_partition(spark):
    df = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    got = [r[0] for r in df.select(ev.states(F.col("a"), F.col("b"))).collect()]
    assert sorted(got) == sorted(["MIXED", "DRY", "DRY", "HUMID", "HUMID", "NEUTRAL", "NEUTRAL", "NEUTRAL", "NEUTRAL"])


def test_noleap_days(spark):
    want = {"2020-02-28": 59, "2020-02-29": None, "2020-03-01": 60, "2020-12-31": 365, "2021-12-31": 365}
    df = spark.createDataFrame([(d,) for d in want], "d string")
    assert {r[0]: r[1] for r in df.select("d", th.noleap_doy(F.to_date("d"))).collect()} == want


def test_doy_window(spark):
    df = spark.createDataFrame([("k", d, 1.0) for d in days(("2001-01-01", 1))] + [(None, d, 2.0) for d in days(("2001-06-01", 1))], "k string, day date, v double")
    got = cl.doy_quantiles(df, ["k"], "day", "v", {"q": 0.5}).collect()
    assert sorted(r["doy"] for r in got if r["k"] == "k") == [*range(1, 17), *range(351, 366)]
    assert len([r for r in got if r["k"] is None]) == 31
    assert cl.doy_quantiles(df.limit(0), ["k"], "day", "v", {"q": 0.5}).count() == 0
    x = spark.createDataFrame([("k", dt.date(2001 + i, 7, 1), v) for i, v in enumerate((1.0, 2.0, 4.0, 8.0, None, float("nan")))], "k string, day date, v double")
    assert cl.doy_quantiles(x, ["k"], "day", "v", {"q": 0.25}).filter("doy = 182").first()["q"] == 1.75
    m = cl.doy_moments(x, ["k"], "day", "v", ddof=1).filter("doy = 182").first()
    assert m["n"] == 4 and abs(m["mean"] - 3.75) < 1e-9 and abs(m["std"] - np.std([1, 2, 4, 8], ddof=1)) < 1e-9


def test_resample(spark):
    rows = [("a", dt.datetime(2001, 1, 1, h), 1.0 * h) for h in range(20)] + [("a", dt.datetime(2001, 1, 2, 1), 5.0), ("a", dt.datetime(2001, 1, 2, 2), float("nan")), (None, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double")
    got = cl.resample(df, ["k"], "t", {"v": ["mean", "max"]}, least=18, required="v").collect()
    assert [(r["k"], str(r["period"]), r["v_mean"], r["v_max"], r["n_v"]) for r in got] == [("a", "2001-01-01", 9.5, 19.0, 20)]
    moved = cl.resample(df, ["k"], "t", {"v": ["max"]}, shift_hours=-3.0).orderBy("period").collect()
    assert [(str(r["period"]), r["n_v"]) for r in moved] == [("2000-12-31", 3), ("2001-01-01", 18)]


def trend(spark, ys, f, **k):
    return f(spark.createDataFrame([("k", i + 1, float(y) if y is not None else None) for i, y in enumerate(ys)], "k string, x int, y double"), ["k"], "x", "y", **k).first()


def test_trends(spark):
    assert abs(trend(spark, [2, 3, 7, 8], tr.theil_sen, least=2)["slope"] - 22.5) < 1e-9
    assert trend(spark, [2, 3, 7, 8], tr.theil_sen)["slope"] is None
    m = trend(spark, [1, 2, 3, 4, 5], tr.mann_kendall, least=2)
    assert m["s"] == 10 and abs(m["var_s"] - 50 / 3) < 1e-9 and abs(m["z"] - 9 / math.sqrt(50 / 3)) < 1e-9
    assert abs(m["p_value"] - math.erfc(m["z"] / math.sqrt(2))) < 1e-6
    m = trend(spark, [1, 1, None, 2, 3], tr.mann_kendall, least=2)
    assert m["n"] == 4 and m["s"] == 5 and abs(m["var_s"] - 138 / 18) < 1e-9
    m = trend(spark, [3, 3, 3, 3, 3], tr.mann_kendall, least=2)
    assert m["s"] == 0 and m["var_s"] == 0 and m["p_value"] is None
    rng = random.Random(1)
    ys = [rng.gauss(0, 1) for _ in range(15)]
    up, down = trend(spark, ys, tr.mann_kendall), trend(spark, ys[::-1], tr.mann_kendall)
    assert up["s"] == -down["s"] and up["var_s"] == down["var_s"]
    a, b = trend(spark, ys, tr.theil_sen, least=5), trend(spark, [3 + 2 * y for y in ys], tr.theil_sen, least=5)
    assert abs(b["slope"] - 2 * a["slope"]) < 1e-9
    e = trend(spark, ys, tr.leave_one_out)
    assert e["slope_min"] <= e["slope_median"] <= e["slope_max"]


@pytest.mark.parametrize("method, values, weights, want", [
    ("inverted_cdf", (1, 2, 3, 4), (1, 1, 1, 1), 2), ("interp_cdf", (1, 2, 3, 4), (1, 1, 1, 1), 2), ("midpoint_interp", (1, 2, 3, 4), (1, 1, 1, 1), 2.5),
    ("inverted_cdf", (10, 20), (1, 3), 20), ("interp_cdf", (10, 20), (1, 3), 40 / 3), ("midpoint_interp", (10, 20), (1, 3), 17.5),
])
def test_weighted_quantiles(spark, method, values, weights, want):
    rows = [("g", float(v), float(w)) for v, w in zip(values, weights)] + [("g", 99.0, 0.0), ("g", None, 5.0), ("g", 99.0, None), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = wt.weighted_quantiles(df, ["g"], "v", "w", {"q": 0.5}, method=method).collect()
    assert len(got) == 1 and abs(got[0]["q"] - want) < 1e-9


def test_weighted_quantiles_of_many_rows(spark):
    rng = np.random.default_rng(0)
    v, w = rng.normal(size=5000).round(2), rng.uniform(0.1, 2, 5000)
    df = spark.createDataFrame(list(zip(v.tolist(), w.tolist())), "v double, w double")
    got = wt.weighted_quantiles(df, [], "v", "w", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    order = np.argsort(v)
    cdf = np.cumsum(w[order]) / w.sum()
    assert [got[c] for c in "abc"] == [v[order][np.searchsorted(cdf, p - 1e-12)] for p in (0.1, 0.5, 0.99)]


def test_ranks_and_correlations(spark):
    df = spark.createDataFrame([("g", float(x), float(-x)) for x in (1, 2, 2, 3)] + [("g", None, 1.0), (None, 1.0, 1.0)], "g string, x double, y double")
    got = st.average_ranks(df, ["g"], "x", "r").filter("g = 'g'").select("x", "r").collect()
    assert sorted((r["x"] or 0, r["r"]) for r in got if r["x"]) == [(1, 1.0), (2, 2.5), (2, 2.5), (3, 4.0)]
    c = st.correlations(df, ["g"], "x", "y", least=3).filter("g = 'g'").first()
    assert c["n"] == 4 and abs(c["spearman"] + 1) < 1e-9
    assert st.correlations(df.limit(0), ["g"], "x", "y").count() == 0


def test_permutation_counts(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.random(), rng.random(), 1.0) for i in range(60)], "id long, x double, y double, w double")
    p = st.permutation_p(df, "id", "x", "y", "w", permutations=19).first()
    assert p["n"] == 60 and 0 <= p["exceed"] <= 19 and abs(p["p_value"] - (p["exceed"] + 1) / 20) < 1e-12
    strong = df.withColumn("y", F.col("x"))
    assert st.permutation_p(strong, "id", "x", "y", "w", permutations=19).first()["exceed"] == 0


def test_outliers_are_capped(spark):
    rows = [("g", i, (-1.0) ** i * (i % 5)) for i in range(36)] + [("g", 100 + i, 100.0 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, id int, d double")
    assert [r["id"] for r in st.capped_outliers(df, ["g"], "id", "d").collect()] == [103]
    assert st.capped_outliers(df.limit(10), ["g"], "id", "d").count() == 0


def test_wls_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 300
    x, z, g, w = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 3, n), rng.uniform(0.5, 2, n)
    y = 1 + 2 * x - z + 0.5 * (g == 1) + rng.normal(size=n) * (1 + np.abs(x))
    rows = [*zip(y.tolist(), x.tolist(), z.tolist(), g.tolist(), w.tolist()), (None, 1.0, 1.0, 1, 1.0), (1.0, 1.0, 1.0, 1, 0.0)]
    fit = {r["term"]: r for r in st.wls(spark.createDataFrame(rows, "y double, x double, z double, g long, w double"), "y", ["x", "z"], "w", fixed=["g"]).collect()}
    a = np.stack([np.ones(n), x, z, g == 1, g == 2], axis=1).astype(float)
    inv = np.linalg.inv(a.T @ (a * w[:, None]))
    beta = inv @ (a.T @ (w * y))
    e = y - a @ beta
    h = np.einsum("ij,jk,ik->i", a, inv, a) * w
    u = w * e / (1 - h)
    se = np.sqrt(np.diag(inv @ (a.T @ (a * (u**2)[:, None])) @ inv))
    names = ["const", "x", "z", "g=1", "g=2"]
    assert np.allclose([fit[t]["beta"] for t in names], beta) and np.allclose([fit[t]["se"] for t in names], se) and fit["x"]["n"] == n
    assert st.wls(spark.createDataFrame(rows[:20], "y double, x double, z double, g long, w double"), "y", ["x"], "w").count() == 0


def test_curves(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 400)
    df = spark.createDataFrame([("g", i, float(v), float(0.3 * v**2 - v)) for i, v in enumerate(x)] + [("few", 1000, 1.0, 1.0), ("g", 2000, None, 1.0)], "g string, id long, x double, y double")
    for got in (sm.spline_curve(df, "g", "id", "x", "y", reps=20).collect(), sm.lowess_curve(df, "g", "id", "x", "y", frac=0.2, reps=20).collect()):
        assert {r["g"] for r in got} == {"g"} and len(got) == 25
        assert all(abs(r["fit"] - (0.3 * r["x"] ** 2 - r["x"])) < 0.6 and r["low"] <= r["fit"] + 0.5 for r in got)


def test_nearest_widens_its_reach(spark):
    others = [(1, 0.0, 0.0), (2, 0.0, 0.2), (3, 40.0, 100.0)]
    pts = [(10, 0.05, 0.05), (11, -5.0, -7.0), (12, 30.0, 90.0), (13, None, 1.0), (14, 0.0, 0.1)]
    a, b = spark.createDataFrame(pts, "key int, y double, x double"), spark.createDataFrame(others, "key int, y double, x double")
    assert sorted((r["key"], r["near"]) for r in sp.nearest(a, b).collect()) == [(10, 1), (11, 1), (12, 3), (14, 1)]
    assert sp.nearest(a, b.limit(0)).count() == 0


def test_messy_values(spark):
    c = {"28,3": 28.3, " -1.5 ": -1.5, "1.234,5": 1234.5, "-9999": None, "": None, "n/d": None, "12a": None, "7": 7.0}
    df = spark.createDataFrame([(k,) for k in c], "v string")
    assert {r[0]: r[1] for r in df.select("v", tx.clean_number("v")).collect()} == c
    d = {"2016/07/22": "2016-07-22", "22/07/2016": "2016-07-22", "31/31/2016": None, "x": None}
    df = spark.createDataFrame([(k,) for k in d], "v string")
    assert {r[0]: r[1] and str(r[1]) for r in df.select("v", tx.first_date("v")).collect()} == d
    n = {"São  Paulo ": "SAO PAULO", "Açaí (MG)": "ACAI (MG)"}
    df = spark.createDataFrame([(k,) for k in n], "v string")
    assert {r[0]: r[1] for r in df.select("v", tx.normalise_text("v")).collect()} == n
    assert df.select(tx.name_without_state(F.lit("Açaí (MG)"))).first()[0] == "Açaí"
    assert [r[0] for r in spark.createDataFrame([("x a701 y",), ("83377",), ("--",)], "v string").select(tx.station_code("v")).collect()] == ["A701", "83377", None]
    fixed = spark.createDataFrame([(-1500.0, -480.0), (-48.0, -15.0), (-15.0, 48.0), (None, 1.0), (80.0, 80.0)], "a double, b double").select(tx.repair_coordinates(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r["c"]["lat"], r["c"]["lon"]) if r["c"] else None for r in fixed][:4] == [(-15.0, -48.0), (-15.0, -48.0), (-15.0, -48.0), None]


def test_thermo(spark):
    row = spark.createDataFrame([(25.0, 25.1, 20.0, 150.0)], "t double, td double, u double, rh double")
    got = row.select(th.relative_humidity("t", "td").alias("a"), th.relative_humidity("t", "td", out_of_range="clip").alias("b"), th.vpd_from_dewpoint("t", "td").alias("c"), th.wetbulb_stull("t", "rh").alias("d"), th.positive_z("t", "u", F.lit(1e-9)).alias("e"), th.positive_z("t", "u", F.lit(0.5)).alias("f")).first()
    assert got["a"] is None and got["b"] == 100.0 and got["c"] == 0.0 and got["d"] is None and got["e"] is None and got["f"] == 5.0


def test_offset_times_and_divisions(spark):
    df = spark.createDataFrame([(0.5, 2.0, 0.0), (None, 1.0, None)], "v double, a double, b double")
    got = df.select(tx.decode_offset_time("v", "days", "1900-01-01 00:00:00").cast("string").alias("t"), th.safe_div("a", "b").alias("q"), th.safe_div("b", "a").alias("r"), th.wrap_longitude(F.lit(310.0)).alias("l")).collect()
    assert [tuple(r) for r in got] == [("1900-01-01 12:00:00", None, 0.0, -50.0), (None, None, None, -50.0)]
    assert abs(df.select(th.wind_speed(F.lit(3.0), F.lit(4.0)).alias("w")).first()["w"] - 5) < 1e-12


def test_quality_rules(spark):
    h = spark.createDataFrame([(20.0, 20.4, 50.0, 1.0), (20.0, 20.6, 0.0, -1.0), (None, 30.0, float("nan"), 61.0), (60.0, 10.0, 100.0, 0.0)], "tair_c double, td_c double, rh_pct double, ws_ms double")
    assert [tuple(r) for r in qc.hourly_qc(h).collect()] == [(20.0, 20.4, 50.0, 1.0), (20.0, None, None, None), (None, 30.0, None, None), (None, 10.0, 100.0, 0.0)]
    d = spark.createDataFrame([(30.0, 20.0, 25.0), (10.0, 20.0, 15.0), (55.0, 20.0, None)], "tmax double, tmin double, tmean double")
    assert [tuple(r) for r in qc.daily_qc(d).collect()] == [(30.0, 20.0, 25.0), (None, None, None), (None, 20.0, None)]
    x = spark.createDataFrame([(1, "a1", "b2"), (2, "zz", "b2"), (3, "zz", None)], "id int, p string, q string")
    keys = spark.createDataFrame([("A1",), ("B2",), ("B2",)], "k string")
    assert sorted(tuple(r) for r in qc.tolerant_lookup(x, keys, [F.upper("p"), F.upper("q")], "k", "id").collect()) == [(1, "A1", 0), (2, "B2", 1)]
    qc.require_same_cells(keys, keys.distinct(), "k")
    with pytest.raises(ValueError):
        qc.require_same_cells(keys, keys.filter("k = 'A1'"), "k")


def test_linear_quantiles(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=3001) ** 3, 2)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 4.0), ("b", 5.0), ("c", None), ("b", float("nan"))], "k string, v double")
    got = {r["k"]: r for r in wt.linear_quantiles(df, ["k"], "v", {"q0": 0.0, "q3": 0.3, "q97": 0.97, "q1": 1.0}).collect()}
    assert set(got) == {"a", "b"} and got["b"]["q3"] == pytest.approx(4.3) and got["b"]["n"] == 2
    assert [got["a"][n] for n in ("q0", "q3", "q97", "q1")] == pytest.approx(list(np.quantile(values, [0, 0.3, 0.97, 1])))
    assert wt.linear_quantiles(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0 and wt.linear_quantiles(df.limit(0), [], "v", {"q": 0.5}).first()["q"] is None


def test_bootstrap_difference(spark):
    rows = [(i, "k", float(i), 10.0 + (5.0 if i >= 150 else 0.0) + (i * 7 % 11) / 10, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, x double, v double, w double")
    r = st.bootstrap_difference(df, ["g"], "id", "x", "v", "w", reps=200).first()
    assert 4.5 < r["low"] < r["difference"] < r["high"] < 5.5
    assert st.bootstrap_difference(df.limit(0), ["g"], "id", "x", "v", "w").count() == 0


def test_resampled_sums(spark):
    """Copies as MD5 draws them, for ids of any length; no row per resample; rows without an id are in no resample."""
    ids = ["7", "1234", "12345678", "é", "", "x" * 51, "x" * 52, "y" * 90, None]
    rows = [(i, g, float(n + 1), float("inf") if i == "7" else 2.0) for n, i in enumerate(ids) for g in ("a", None)]
    df = spark.createDataFrame(rows, "id string, g string, v double, u double")
    out = st._resampled_sums(df, ["g"], 120, ["v", "u"])
    assert "Generate" not in out._jdf.queryExecution().toString()
    got, want = {(r["g"], r["rep"]): (r["v"], r["u"]) for r in out.collect()}, {}
    for i, g, v, u in rows:
        for rep in range(1, 121):
            if i is not None and (n := sum(int(hashlib.md5(f"{i}-{rep}".encode()).hexdigest()[:8], 16) / 2**32 >= s for s in st.poisson_steps())):
                a, b = want.get((g, rep), (0.0, 0.0))
                want[g, rep] = a + n * v, b + n * u
    assert got == want and len(got) == 240
    assert st.bootstrap_mean(df.filter("id is null"), ["g"], "id", "v", "u").count() == 0
    one = st.bootstrap_mean(df.filter("id != '7'"), [], "id", "v", "u", reps=50).first()
    assert one["low"] < one["mean"] < one["high"]


def test_truncated_slopes(spark):
    rows = [("a", y, float(y if y < 2010 else 2010 + 3 * (y - 2010))) for y in range(2000, 2020)] + [("b", 2000 + i, 1.0) for i in range(3)]
    got = {r["k"]: r for r in tr.truncated_slopes(spark.createDataFrame(rows, "k string, y int, v double"), ["k"], "y", "v", years=10).collect()}
    assert set(got) == {"a"} and got["a"]["slope_late_start"] == pytest.approx(30) and got["a"]["slope_early_end"] == pytest.approx(10, abs=3) and 10 < got["a"]["slope_all"] < 30


def test_nearest_in_a_crowd(spark):
    """A crowd of both sides in one place, with tiles by density and salts, against brute force."""
    rng = np.random.default_rng(5)
    a = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.normal(0, 0.05, (300, 2)))] + [(999, 20.0, 20.0)]
    b = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.normal(0, 0.05, (500, 2)))]
    make = lambda rows: spark.createDataFrame(rows, "key int, y double, x double")
    got = {r["key"]: r["near"] for r in sp.nearest(make(a), make(b), per_tile=8, rows_per_salt=20).collect()}
    want = {k: min(b, key=lambda o: (math.hypot(o[1] - y, o[2] - x), o[0]))[0] for k, y, x in a}
    assert got == want


def test_times_in_text_and_ordered_categories(spark):
    values = ["20200229", "20200229.5", "2020022913", "2020-02-29 06:30:00", "20201399", "x", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(tx.decode_text_time("v").cast("string")).collect()]
    assert got == ["2020-02-29 00:00:00", "2020-02-29 12:00:00", "2020-02-29 13:00:00", "2020-02-29 06:30:00", None, None, None]
    ranks = spark.createDataFrame([("b",), ("A",), ("z",), (None,)], "v string").select(tx.category_rank("v", ["a", "B"])).collect()
    assert [r[0] for r in ranks] == [2, 1, 3, 3]


def test_month_columns(spark):
    df = spark.createDataFrame([("A1", "20,5", "-", 7.0), ("A2", None, "3", 8.0)], "code string, Janeiro string, `Dez.` string, other double")
    got = {(r["code"], r["month"]): r["v"] for r in sp.unpivot_months(df, ["code"], "v").collect()}
    assert got == {("A1", 1): 20.5, ("A1", 12): None, ("A2", 1): None, ("A2", 12): 3.0}


def test_spline_of_few_values_is_a_line(spark):
    df = spark.createDataFrame([(i, "k", float(i % 3), 2.0 + 3.0 * (i % 3)) for i in range(90)], "id int, k string, x double, y double")
    got = sm.spline_curve(df, "k", "id", "x", "y", points=5, reps=20).orderBy("x").collect()
    assert [r["fit"] for r in got] == pytest.approx([2 + 3 * r["x"] for r in got])
