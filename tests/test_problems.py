"""Operators of the general problems against brute force and on awkward inputs."""

import datetime as dt
import math
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from veranico.operators.gridding import local_regression_grid
from veranico.operators.proximity import circles, pairs_within, points_in_regions, rings_from_wkt
from veranico.operators.spikes import flag_spikes
from veranico.operators.timestamps import days_from_civil, parse_instants, state_code

UTC = dt.timezone.utc


def us(*a, **k):
    return int((dt.datetime(*a, tzinfo=k.pop("tz", UTC), **k) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


CASES = [
    ("2016/07/22", "0300 UTC", None, "RS", us(2016, 7, 22, 3)),
    ("22-07-2016", "5:00", None, None, us(2016, 7, 22, 5)),
    ("22.07.16", "23h19", "utc", None, us(2016, 7, 22, 23, 19)),
    ("20160722", "300", None, None, us(2016, 7, 22, 3)),
    ("20160722", "5", None, None, us(2016, 7, 22, 0, 5)),
    ("20160722", "180048", None, None, us(2016, 7, 22, 18, 0, 48)),
    ("7 fev 2014", "01:00Z", None, None, us(2014, 2, 7, 1)),
    ("31-DEZ-2016", "11:00 PM UTC", None, None, us(2016, 12, 31, 23)),
    ("2016-07-22", "12:15 AM", None, None, us(2016, 7, 22, 0, 15)),
    ("2016-07-22", "13:15 PM", None, None, None),
    ("2016-07-22", "24:00", None, None, us(2016, 7, 23)),
    ("2016-07-22", "24:30", None, None, None),
    ("2016-07-22", "2561", None, None, None),
    ("2016-02-30", "03:00", None, None, None),
    ("2019-13-23", "03:00", None, None, None),
    ("2016-02-29", "03:00", None, None, us(2016, 2, 29, 3)),
    ("2015-02-29", "03:00", None, None, None),
    ("2016-07-22", "06:00:00,5", None, None, us(2016, 7, 22, 6, 0, 0, 500000)),
    ("2016-07-22", "06:00 BRT", "LOCAL", "SP", us(2016, 7, 22, 9)),
    ("2016-01-22", "06:00 (BRST)", None, "SP", us(2016, 1, 22, 8)),
    ("2016-07-22", "06:00 GMT-3", None, None, us(2016, 7, 22, 9)),
    ("2016-07-22", "06:00 -04:00", "local", "SP", us(2016, 7, 22, 10)),
    (None, "2015-02-21T21:34:00-02:00", None, None, us(2015, 2, 21, 23, 34)),
    ("2017-05-30T00:15:00+05:30", None, None, None, us(2017, 5, 29, 18, 45)),
    ("20140518T090000+0000", "", None, None, us(2014, 5, 18, 9)),
    ("n/d", "1466726410000", None, None, 1466726410000000),
    (None, "1466726410", "LOCAL", "SP", 1466726410000000),
    ("2016/07/22", "2015-02-21T21:34:00Z", None, None, us(2015, 2, 21, 21, 34)),
    ("2016-07-22", "06:00", "LOCAL", "São Paulo", us(2016, 7, 22, 9)),
    ("2016-01-22", "06:00", "local", " sp ", us(2016, 1, 22, 8)),
    ("2016-01-22", "06:00", "LOCAL", "AC", us(2016, 1, 22, 11)),
    ("2016/10/16", "00:30", "LOCAL", "RJ", None),  # the hour that summer time left out
    ("2016-02-20", "23:30", "LOCAL", "MG", None),  # the hour that came twice
    ("2016-02-20", "23:30", "LOCAL", "BA", us(2016, 2, 21, 2, 30)),
    ("2016-07-22", "06:00", "LOCAL", "XX", None),
    ("2016-07-22", "06:00", "LOCAL", None, None),
    (None, None, None, None, None),
    ("", "--", None, None, None),
    ("2016-07-22", "x" * 100000, None, None, None),
]


def test_instants(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)] + [(0, *CASES[0])]
    df = spark.createDataFrame(rows, "id int, d string, t string, clock string, uf string, want long").withColumn("__p", F.lit("mine")).withColumn("zone_key", F.lit("z"))
    got = parse_instants(df, "d", "t", clock_col="clock", zone_key=state_code(F.col("uf"))).collect()
    assert len(got) == len(rows)
    assert {r["__p"] for r in got} == {"mine"} and {r["zone_key"] for r in got} == {"z"}
    assert [(r["id"], r["d"], r["t"][:30] if r["t"] else None, r["utc_us"]) for r in got if r["utc_us"] != r["want"]] == []
    assert parse_instants(df.limit(0), "d", "t").count() == 0


def test_full_width_instants(spark):
    wide = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)} | {" ": "\u3000"})
    rows = [("２０１８/１１/０４", "0241\u00a0UTC", us(2018, 11, 4, 2, 41)), ("２０１８/０２/３０", "0241 UTC", None), ("２０１８/１１/０４", "--", None)]
    rows += [(d.translate(wide), t.translate(wide), w) for d, t, clock, _, w in CASES if d and t and clock is None]
    df = spark.createDataFrame(rows, "d string, t string, want long")
    assert [(r["d"], r["t"][:30], r["utc_us"]) for r in parse_instants(df, "d", "t").collect() if r["utc_us"] != r["want"]] == []


def test_full_width_table_agrees_with_sql(spark):
    """The SQL, which reads ASCII only, over the table with its full-width characters folded by the other engine."""
    import duckdb

    import __spark_entry__ as e

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    fold = lambda c: f"translate({c}, '０１２３４５６７８９／', '0123456789/') as {c}"
    con.execute(f"create view station_metadata as select * from read_parquet('{data}/station_metadata.parquet')")
    con.execute(f"create view inmet_hourly_raw as select * replace ({fold('data_text')}, {fold('hora_utc')}) from read_parquet('{data}/inmet_hourly_raw.parquet')")
    got = sorted(tuple(r) for r in e.queries()["p1_found"](spark, data).select("raw_id", "utc_us").collect())
    assert got == sorted(con.execute(e.oracle_sql()["p1_found"]).fetchall())


def test_local_times_against_zone_rules(spark):
    rng = random.Random(5)
    zones = {"SP": "America/Sao_Paulo", "MT": "America/Cuiaba", "AC": "America/Rio_Branco", "TO": "America/Araguaina", "BA": "America/Bahia"}
    rows = []
    for i in range(3000):
        key = rng.choice(list(zones))
        t = dt.datetime(2009, 1, 1) + dt.timedelta(minutes=rng.randrange(12 * 365 * 24 * 60)) if i % 2 else dt.datetime(rng.randint(2010, 2019), rng.choice([2, 10, 11]), rng.randint(1, 28), rng.choice([0, 22, 23]), rng.randint(0, 59))
        zone = ZoneInfo(zones[key])
        hits = set()
        for fold in (0, 1):
            u = t.replace(tzinfo=zone, fold=fold).astimezone(UTC)
            if u.astimezone(zone).replace(tzinfo=None) == t:
                hits.add(u)
        rows.append((t.strftime("%Y-%m-%d"), t.strftime("%H:%M"), key, us(*hits.pop().timetuple()[:5]) if len(hits) == 1 else None))
    df = spark.createDataFrame(rows, "d string, t string, uf string, want long").withColumn("clock", F.lit("Local"))
    assert parse_instants(df, "d", "t", clock_col="clock", zone_key=F.col("uf")).filter("not utc_us <=> want").count() == 0


def test_days_from_civil(spark):
    days = [dt.date(1600, 2, 29), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2000, 3, 1), dt.date(2024, 12, 31)]
    df = spark.createDataFrame([(d.year, d.month, d.day, (d - dt.date(1970, 1, 1)).days) for d in days], "y int, m int, d int, want long")
    assert df.filter(days_from_civil(F.col("y"), F.col("m"), F.col("d")) != F.col("want")).count() == 0


def km(a, b):
    f = math.radians
    h = math.sin(f(b[0] - a[0]) / 2) ** 2 + math.cos(f(a[0])) * math.cos(f(b[0])) * math.sin(f(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_pairs_within(spark):
    rng = random.Random(3)
    spot = lambda: (rng.uniform(-1, 1), rng.uniform(-1, 1)) if rng.random() < 0.5 else (rng.uniform(-34, 6), rng.uniform(-74, -32))
    pts, others = [(i, *spot()) for i in range(700)], [(f"s{i}", *spot()) for i in range(300)]
    a, b = spark.createDataFrame(pts, "key int, y double, x double"), spark.createDataFrame(others, "key string, y double, x double")
    want = {(p[0], o[0]) for p in pts for o in others if km(p[1:], o[1:]) <= 25}
    for salt in (100_000, 10):  # the second splits crowded tiles
        got = pairs_within(a, b, 25.0, rows_per_salt=salt).collect()
        assert len(got) == len(want) and {(r["key"], r["region"]) for r in got} == want
    assert pairs_within(a.limit(0), b, 25.0).count() == 0 == pairs_within(a, b.limit(0), 25.0).count()


def test_rings_hold_their_circles(spark):
    p = spark.createDataFrame([(1, -33.9, -50.0), (2, 5.9, -60.0)], "key int, y double, x double")
    for r in circles(p, 25.0).join(p, F.col("region") == F.col("key")).collect():
        for a, b in zip(r["ring"], r["ring"][1:]):
            for s in (0, 0.25, 0.5, 0.75):
                assert km((r["y"], r["x"]), (a["y"] + (b["y"] - a["y"]) * s, a["x"] + (b["x"] - a["x"]) * s)) > 25


def test_points_on_edges_and_bad_polygons(spark):
    shapes = [(1, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), (2, "POLYGON ((1 1, 3 1, 3 3, 1 3))"), (3, None), (4, "POLYGON EMPTY"), (5, "")]
    pts = [(1, 1.0, 0.5), (2, 0.0, 1.0), (3, 2.0, 2.0), (4, 5.0, 5.0), (5, 1.5, 1.5), (5, 1.5, 1.5)]
    got = points_in_regions(spark.createDataFrame(pts, "key int, y double, x double"), rings_from_wkt(spark.createDataFrame(shapes, "id int, w string"), "id", "w"))
    assert sorted((r["key"], r["region"], r["on_boundary"]) for r in got.collect()) == [(1, 1, False), (2, 1, True), (3, 1, True), (3, 2, False), (5, 1, False), (5, 2, False)]


def grid(spark, rows, **k):
    df = spark.createDataFrame(rows, "s string, t double, c int, v double, ok boolean").withColumn("at", (F.col("t") * 1e6).cast("long")).withColumn("slot", F.lit(9)).withColumn("source", F.lit("x"))
    return local_regression_grid(df, source="s", at_us="at", cadence_s="c", value="v", counts="ok", **k).orderBy("source", "slot_s").collect()


def test_grid_marks_and_estimates(spark):
    rows = [("a", 0.0, 60, 1.0, True), ("a", 65.0, 60, 2.0, True), ("a", 290.0, 60, 5.0, True), ("a", 150.0, 60, 9.0, False), ("b", 30.0, 60, 1.0, True), (None, 0.0, 60, 1.0, True), ("a", None, 60, 1.0, True), ("a", 1e6, 60, 1.0, True), ("c", 0.0, 60, None, True), ("c", 0.0, 60, float("nan"), True)]
    got = grid(spark, rows, longest_gap_s=600)
    assert [(r["source"], r["slot_s"], r["missing"]) for r in got] == [("a", 0, False), ("a", 60, False), ("a", 120, True), ("a", 180, True), ("a", 240, True), ("a", 300, False), ("a", 999960 + 60, False), ("b", 60, False), ("c", 0, False)]
    assert got[-1]["estimate"] is None and got[-1]["support"] == 0 and got[-1]["n_readings"] == 2
    assert grid(spark, [r for r in rows if r[0] == "z"]) == []


def test_grid_is_exact_for_lines(spark):
    rows = [("a", 60.0 * i + (7 * i % 20), 60, 3.0 + 0.5 * (60.0 * i + (7 * i % 20)) / 60, True) for i in range(30)]
    inner = [r for r in grid(spark, rows) if 60 <= r["slot_s"] <= 1680]
    assert all(abs(r["estimate"] - (3.0 + 0.5 * r["slot_s"] / 60)) < 1e-9 for r in inner if r["support"] > 1.5)


def test_grid_gaps_against_brute_force(spark):
    rng, rows, want = random.Random(8), [], set()
    for s in range(4):
        times = sorted({rng.randrange(0, 40000) for _ in range(60)})
        rows += [(f"s{s}", float(t), 60, 1.0, True) for t in times]
        slots = sorted({(2 * t + 60) // 120 for t in times})
        want |= {(f"s{s}", 60 * k) for a, b in zip(slots, slots[1:]) if (b - a) * 60 <= 1800 for k in range(a + 1, b)}
    assert {(r["source"], r["slot_s"]) for r in grid(spark, rows, longest_gap_s=1800) if r["missing"]} == want


def test_spikes(spark):
    rng, rows, bad = random.Random(2), [], {}
    for s in ("a", "b", None):
        for i in range(120):
            v = round(10 * math.sin(i / 30) + (3 if i > 60 else 0) + rng.gauss(0, 0.3), 3)
            rows.append([len(rows), s, i, v])
    for k, v in ((20, 14.0), (100, -9.0), (150, 500.0), (270, None), (271, float("nan"))):
        rows[k][3] = v
        if v is not None and v == v:
            bad[k] = v
    for k in range(200, 207):
        rows[k][3] = rows[200][3]
    rows[203][3] = None
    stuck = {200, 201, 202, 204, 205, 206}
    df = spark.createDataFrame(rows, "id int, s string, d int, v double").withColumn("var", F.lit("T")).withColumn("scatter", F.lit("mine"))
    lim = spark.createDataFrame([("T", -25.0, 25.0)], "variable string, low double, high double")
    run = lambda x: flag_spikes(x, lim, key="id", series=["s"], order="d", value="v", variable="var")
    got = run(df).collect()
    assert len(got) == 357
    assert {r["id"] for r in got if r["impossible"]} == {150}
    assert {r["id"] for r in got if r["is_stuck"]} == stuck
    assert {r["id"] for r in got if r["is_spike"]} == {20, 100}
    assert run(df.limit(0)).count() == 0
    assert run(spark.createDataFrame([(i, "a", i, 1.0, "T") for i in range(5)], "id int, s string, d int, v double, var string")).filter("is_spike or is_stuck").count() == 0


def test_the_tail_decides(spark):
    """Where a variable's own noise has a heavy tail, readings far beyond seven scatters are usual and only the fitted tail says so."""
    rng, rows = random.Random(5), []
    for s in range(12):
        for i in range(150):
            heavy = rng.choice((-1, 1)) * (rng.random() ** -0.7 - 1)
            rows += [(f"h{s}-{i}", f"s{s}", "heavy", i, heavy), (f"n{s}-{i}", f"s{s}", "normal", i, rng.gauss(0, 1.0))]
    rows = [(*r[:4], 14.0) if r[0] == "n3-70" else (*r[:4], 9000.0) if r[0] == "h3-70" else r for r in rows]
    df = spark.createDataFrame(rows, "id string, s string, var string, d int, v double")
    lim = spark.createDataFrame([], "variable string, low double, high double")
    got = flag_spikes(df, lim, key="id", series=["s", "var"], order="d", value="v", variable="var").withColumn("far", F.abs("residual") > 7 * F.col("scatter")).collect()
    spikes = {r["id"] for r in got if r["is_spike"]}
    assert {"n3-70", "h3-70"} <= spikes and {i for i in spikes if i.startswith("n")} == {"n3-70"}
    far = {r["id"] for r in got if r["far"] and r["id"].startswith("h")}
    assert len(far) > 20 and len(spikes & far) <= len(far) / 5
    assert all(r["tail_cutoff"] > 10 * r["scatter"] for r in got if r["id"].startswith("h")) and all(r["tail_cutoff"] < 12 * r["scatter"] for r in got if r["id"].startswith("n"))


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p5_found", "p7_found"])
def test_result_columns(spark, name):
    import __spark_entry__ as e

    want = {"p1_found": {"raw_id": "bigint", "utc_us": "bigint"}, "p3_found": {"municipality_id": "bigint", "station_id": "string"}, "p5_found": {"station_id": "string", "slot_s": "bigint"}, "p7_found": {"qc_id": "bigint"}}
    df = e.queries()[name](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == want[name] and df.count() > 0


def test_regions_of_several_rings(spark):
    """Holes are outside, parts inside, exponents and third coordinates are read."""
    shapes = [(1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "MultiPolygon (((20 0, 21 0, 21 1, 20 0)), ((30 0 5, 3.2e1 0 5, 32 2 5, 30 2 5)))"), (3, "POINT (1 1)"), (4, None), (5, "POLYGON EMPTY")]
    points = [(1, 5.0, 5.0), (2, 2.0, 2.0), (3, 0.2, 20.7), (4, 1.0, 31.0), (5, 1.0, 25.0), (6, 5.0, 4.0)]
    got = points_in_regions(spark.createDataFrame(points, "key int, y double, x double"), rings_from_wkt(spark.createDataFrame(shapes, "id int, w string"), "id", "w"))
    assert {(r["key"], r["region"], r["on_boundary"]) for r in got.collect()} == {(2, 1, False), (3, 2, False), (4, 2, False), (6, 1, True)}
