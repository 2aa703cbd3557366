"""Readers, sinks and streams."""

import pytest

from veranico.sources import sinks, stations
from veranico.streaming.resample import stream_hours

FILE = """REGIAO:;SE
UF:;MG
ESTACAO:;BELO HORIZONTE
CODIGO (WMO):;A521
LATITUDE:;-19,88
LONGITUDE:;-43,96
Data;Hora UTC;TEMPERATURA DO AR (C);UMIDADE (%);
2019/01/01;0000 UTC;24,5;80;
2019/01/01;0100 UTC;-9999;81
bad row;x
02/01/2019;0200 UTC;1.024,5;;;;
"""


def test_station_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(FILE)
    (tmp_path / "b.csv").write_text("no header\n1;2\n")
    got = stations.read_station_text(spark, str(tmp_path)).collect()
    assert [(r["station_id"], r["uf"], r["lat"], str(r["obs_date"]), r["hour_text"]) for r in got] == [("A521", "MG", -19.88, d, h) for d, h in (("2019-01-01", "0000 UTC"), ("2019-01-01", "0100 UTC"), ("2019-01-02", "0200 UTC"))]
    assert [sorted(r["fields"].values()) for r in got] == [[24.5, 80.0], [81.0], [1024.5]]


def test_station_text_in_other_forms(spark, tmp_path):
    """Latin-1 and UTF-8 files side by side, and another separator and header."""
    (tmp_path / "a.csv").write_bytes(FILE.replace("CODIGO", "CÓDIGO").replace("ESTACAO", "ESTAÇÃO").encode("latin-1"))
    (tmp_path / "b.csv").write_text(FILE.replace("CODIGO", "CÓDIGO"), encoding="utf-8")
    got = stations.read_station_text(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {r["station_id"] for r in got} == {"A521"} and {r["file"] for r in got} == {"a.csv", "b.csv"}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.txt").write_text(FILE.replace(";", "|").replace("Data|Hora", "Date|Time"))
    assert stations.read_station_text(spark, str(tmp_path / "c"), separator="|", header=("date", "time")).count() == 3


def test_station_text_of_unusual_headers(spark, tmp_path):
    """Colons, columns in another order, a code only in the file's name, a byte order mark, dates without leading zeros."""
    (tmp_path / "INMET_MG_A521_2019.CSV").write_text("\ufeffUF: MG\nALTITUDE: 854,5\nESTAÇÃO: Ibirité\nHora Medicao;Temperatura;Data Medicao\n0300;22,5;3/1/2019\n0400;23;05-01-19\n0500;1;x\n", encoding="utf-8")
    got = stations.read_station_text(spark, str(tmp_path)).collect()
    assert [(r["station_id"], r["station_name"], r["uf"], r["altitude_m"], r["lat"], str(r["obs_date"]), r["hour_text"], r["fields"]) for r in got] == [
        ("A521", "Ibirité", "MG", 854.5, None, d, h, {"temperatura": t}) for d, h, t in (("2019-01-03", "0300", 22.5), ("2019-01-05", "0400", 23.0))
    ]


def test_read_years(spark, tmp_path):
    """Years that aren't asked for are pruned from the scan."""
    df = spark.createDataFrame([(y, float(y)) for y in (2001, 2002, 2003, 2003)], "year int, v double")
    df.write.partitionBy("year").parquet(f"{tmp_path}/t")
    got = stations.read_years(spark, f"{tmp_path}/t", [2001, 2003])
    assert got.count() == 3 and stations.read_years(spark, f"{tmp_path}/t").count() == 4
    assert len(got.inputFiles()) >= 1 and "PartitionFilters: [" in got._jdf.queryExecution().toString() and "year" in got._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_columns(spark):
    assert stations.find_column(["Código IBGE", "NM_MUN"], ["nm mun"]) == "NM_MUN"
    assert stations.find_column(["x", "Latitude (graus)"], ["latitude"]) == "Latitude (graus)"
    assert stations.find_column(["x"], ["y"]) is None
    with pytest.raises(ValueError):
        stations.find_column(["x"], ["y"], required=True)
    df = spark.createDataFrame([(1, -10.0, 310.0, 5, 280.0), (1, -10.0, 310.0, 1, 281.0), (1, 50.0, 310.0, 1, 1.0)], "valid_time int, latitude double, longitude double, expver int, var167 double")
    got = stations.standardise_grid(df, ["time", "t2m"]).collect()
    assert [(r["lat"], r["lon"], r["t2m"]) for r in got] == [(-10.0, -50.0, 281.0)]
    with pytest.raises(ValueError):
        stations.standardise_grid(df, ["d2m"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], None), (2, None, "ção")], "a int, b array<int>, c string")
    sinks.save_tables({"t": df}, str(tmp_path))
    assert stations.read_any(spark, f"{tmp_path}/t.parquet").count() == 2 == stations.read_any(spark, f"{tmp_path}/t.csv").count()
    sinks.run_record(spark, str(tmp_path), {"window": 31})
    assert '"window": 31' in spark.read.text(f"{tmp_path}/run.json").first()[0]
    made = []
    make = lambda: made.append(1) or df
    for stamp in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert sinks.reuse(spark, f"{tmp_path}/cache", stamp, make).count() == 2
    assert len(made) == 2


def test_reuse_after_a_crash(spark, tmp_path, monkeypatch):
    """A run that dies between the data and their mark leaves other stamps' data alone, and its own is made again."""
    frames = {v: spark.createDataFrame([(v,)], "v int") for v in (1, 2)}
    use = lambda v: sinks.reuse(spark, f"{tmp_path}/cache", {"v": v}, lambda: frames[v]).first()["v"]
    assert use(1) == 1
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            use(2)
    assert use(1) == 1 and use(2) == 2 and use(1) == 1


def test_stream(spark):
    got = stream_hours(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("ts is not null and value is not null").count()
    assert got.groupBy().sum("n").first()[0] == n
