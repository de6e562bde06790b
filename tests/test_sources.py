"""Readers and writers on small files, and demand operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayflow.functions import scalar
from wayflow.model import AlgorithmOptions, TrafficOptions, options_from
from wayflow.operators import demand
from wayflow.sources import readers, writers
from wayflow.streaming import flows


def test_parameters(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("# x\nalpha: 0.15\nbeta: 4.0 # y\ngraph_path: g/a.txt\nqueries_path: q.txt\nlambda: 30\nmax_time: 3600\nalpha: 0.2\n")
    p = readers.parameters(str(f))
    assert p["alpha"] == "0.2"
    assert options_from(p, TrafficOptions) == TrafficOptions(alpha=20, beta=4, max_time=3600)
    assert options_from(p, AlgorithmOptions).lambda_percent == 30
    assert readers.inputs(str(f))["graph_path"] == str(tmp_path / "g/a.txt")
    f.write_text("nocolon\n")
    with pytest.raises(ValueError):
        readers.parameters(str(f))
    f.write_text("a: b\n")
    with pytest.raises(ValueError):
        readers.inputs(str(f))


def test_parsing():
    assert [scalar.parse_percent(x) for x in ("0.15", "0.005", "1", "0", "2", "30", "4.0")] == [15, 0, 100, 0, 2, 30, 400]
    assert scalar.parse_integer("4.0") == 4
    assert scalar.parse_bool("yes") and not scalar.parse_bool("no")
    assert scalar.column_name("Pickup_DateTime ") == "pickupdatetime"


def test_graph_dialects(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("% 6 9\n0 1 3\n1 5 3000\n\nbad\n2 9 100\n")
    edges, n = readers.graph(spark, str(f))
    assert [tuple(r) for r in edges.orderBy("edge_id").collect()] == [(0, 0, 1, 1, 1), (1, 1, 5, 180, 75), (2, 2, 9, 6, 3)] and n == 10
    f.write_text("-1 4 2 0 0\n7 0 1 60 10\n8 1 2 30 5\n1 2\n")
    edges, n = readers.graph(spark, str(f))
    assert [tuple(r) for r in edges.orderBy("edge_id").collect()] == [(0, 0, 1, 60, 10), (1, 1, 2, 30, 5)] and n == 4
    f.write_text("0 1 39\n1 2 400\n")
    assert [tuple(r) for r in readers.graph(spark, str(f))[0].orderBy("edge_id").collect()] == [(0, 0, 1, 39, 1), (1, 1, 2, 400, 10)]


def test_trips_and_coordinates(spark, tmp_path):
    f = tmp_path / "q.txt"
    f.write_text("# c\n0 5 0\nx 5 0\n1 2\n\n1 4 7 9\n")
    assert [tuple(r) for r in readers.trips(spark, str(f)).orderBy("trip_id").collect()] == [(0, 0, 5, 0), (1, 1, 4, 7)]
    with pytest.raises(Exception, match="three columns"):
        readers.trips(spark, str(f), strict=True).collect()
    f.write_text("1 116.5 39.9\n2 a b\n1 116.6 39.8\n")
    assert [tuple(r) for r in readers.coordinates(spark, str(f)).collect()] == [(1, 116.6, 39.8)]
    out = tmp_path / "out"
    writers.write_trips(spark.createDataFrame([(3, 4, 20), (1, 2, 10)], "origin int, destination int, depart bigint"), str(out))
    assert [r.value for r in spark.read.text(str(out)).collect()] == ["1 2 10", "3 4 20"]


def test_pings_and_taxi_trips(spark):
    lines = [("7,2008-02-02 15:36:08,116.5,39.9", "/x/9.txt"), ("2008-02-02 15:36:08,116.5,39.9", "/x/9.txt"), ("7 2008-02-02 15:36:08 116.5 39.9", "/x/9.txt"), ("2008-02-02 15:36:08 116.5 39.9", "/x/9.txt"), ("bad", "/x/9.txt"), ("7,when,1,2", "/x/9.txt")]
    got = readers.pings(spark.createDataFrame(lines, "value string, file string")).collect()
    assert [r.taxi_id for r in got] == ["7", "9", "7", "9"] and all((r.lon, r.lat) == (116.5, 39.9) for r in got)
    raw = spark.createDataFrame([("2013-01-01 00:00:00", "2013-01-01T00:10:00Z", "-73.9", "40.7", "NaN", "40.8")], "Pickup_DateTime string, dropoff_datetime string, pickup_longitude string, pickup_latitude string, dropoff_longitude string, dropoff_latitude string")
    r = readers.taxi_trips(raw).first()
    assert r.dropoff_time - r.pickup_time == dt.timedelta(minutes=10) and r.pickup_lon == -73.9 and r.dropoff_lon is None
    with pytest.raises(ValueError):
        readers.taxi_trips(raw.select("Pickup_DateTime", "dropoff_datetime"))


def test_results(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dataset,x\nHop5Rep1-2,1\n")
    (tmp_path / "b.csv").write_text("dataset,y\nBJRealRep1-0,2\n")
    got = readers.results(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert {(r.dataset, r.x, r.y, r.source_file) for r in got} == {("Hop5Rep1-2", "1", None, "a.csv"), ("BJRealRep1-0", None, "2", "b.csv")}
    (tmp_path / "c.csv").write_text("dataset,x\nHop5Rep1-2,1\ntorn\nHop5Rep1-2,z\nother,4\n")
    assert readers.tolerant_results(spark, str(tmp_path / "c.csv"), "dataset string, x int").count() == 1
    facts = spark.createDataFrame([("Hop5Rep1-2", 5, 1)], "dataset string, hop int, iteration int")
    writers.write_facts(facts, "ablation", str(tmp_path / "facts"), ["hop"], "parquet")
    back = spark.read.parquet(str(tmp_path / "facts"))
    assert set(back.columns) == set(writers.FACTS["ablation"]) and back.first().dataset == "Hop5Rep1-2"


def test_demand(spark):
    assert [r.x for r in spark.createDataFrame([(0,), (5,), (7,), (10,)], "t int").select(scalar.rescaled("t", F.lit(0), F.lit(10), 5).alias("x")).collect()] == [0, 2, 4, 5]
    rows = spark.createDataFrame([(i, 100) for i in range(50)], "trip_id int, depart bigint")
    out = demand.amplified(rows, "trip_id", 3, 10, 1).collect()
    assert len(out) == 150 and all(abs(r.depart - 100) <= 10 for r in out) and all(r.depart == 100 for r in out if r.copy == 0)
    assert sorted(r.trip_id for r in demand.slices(rows, "trip_id", 4, 1).collect()) == list(range(50))
    assert demand.sample(rows, "trip_id", 7, 1).count() == 7


def test_stream(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(minutes=3)), (2, t + dt.timedelta(minutes=14)), (1, t + dt.timedelta(hours=3))]
    spark.createDataFrame(rows, flows.ENTRY).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run adds nothing
        flows.write(flows.bucketed(flows.entries(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r.bucket, r.edge_id, r.flow) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(t, 1, 2), (t + dt.timedelta(minutes=10), 2, 1)]
