"""The whole analyses on small tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from veranico.plans import pipelines as pl


def test_gridded_regimes(spark):
    rng = random.Random(4)
    rows = []
    for year in range(2001, 2007):
        for i in range(365):
            d = dt.date(year, 1, 1) + dt.timedelta(i)
            t = 25 + rng.gauss(0, 2) + (12 if year == 2006 and 100 <= i < 105 else 0)
            rows.append(("c1", d, t, t + 5, t - 3, 10 + t, 0.2, 2.0))
    df = spark.createDataFrame(rows, "cell string, day date, tmean double, tmax double, twbmax double, vpdmean double, sm1mean double, ws10mean double")
    annual = pl.gridded_regimes(df, "cell", "day", baseline=(2001, 2005))
    got = {(r["regime"], r["year"]): r for r in annual.collect()}
    assert len(got) == 4 * 6 and got["DHW", 2006]["duration"] >= 5 and got["HW", 2006]["intensity"] > 30
    trends = pl.regime_trends(annual, "cell", least=5)
    assert trends.count() == 4 * 3 and set(trends.columns) >= {"regime", "cell", "metric", "slope", "p_value"}
    assert pl.gridded_regimes(df.limit(0), "cell", "day").count() == 0


def test_municipal_association(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(i, -10 + 0.25 * (i // 20), -50 + 0.25 * (i % 20), rng.random()) for i in range(400)], "key long, y double, x double, trend double")
    centres = spark.createDataFrame([(k, -9.9 + 0.5 * (k // 10), -49.9 + 0.5 * (k % 10)) for k in range(90)], "key long, y double, x double")
    box = F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0, 0), (0.4, 0), (0.4, 0.4), (0, 0.4), (0, 0))])
    rings = centres.filter("key < 80").select(F.col("key").alias("region"), box.alias("ring"))
    land = spark.createDataFrame([(k, rng.random(), 1.0 + k, "ab"[k % 2]) for k in range(90)], "town long, share double, area double, biome string")
    out = pl.municipal_association(cells, rings, centres, land, key="town", values=["trend"], predictor="share", weight="area", stratum="biome")
    assert out["municipalities"].count() == 90 and out["municipalities"].filter("method = 'nearest'").count() == 10
    assert out["spearman_trend"].count() == 2 and out["summary_trend"].count() == 2 and out["wls_trend"].count() == 3


def test_station_evaluation(spark):
    rng = random.Random(3)
    rows = [("s", dt.date(2001, 1, 1) + dt.timedelta(i), 20 + rng.gauss(0, 3)) for i in range(100)]
    observed = spark.createDataFrame(rows, "station string, day date, v double")
    modelled = spark.createDataFrame([(s, d, v + 1 + rng.gauss(0, 0.1) + (80 if i == 50 else 0)) for i, (s, d, v) in enumerate(rows)], "station string, day date, v double")
    r = pl.station_evaluation(observed, modelled, keys=["station"], day="day", value="v").first()
    assert r["n"] == 99 and abs(r["bias"] - 1) < 0.1 and r["r"] > 0.99
