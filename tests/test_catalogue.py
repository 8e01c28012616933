"""Every query of the catalogue against its SQL, and literal values of the physics."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from wattroute.functions import geo, physics, road
from wattroute.operators import trips
from wattroute.plans import registry

DATA = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("query", [q for q in registry.QUERIES if q.__name__ in registry.ORACLE], ids=lambda q: q.__name__)
def test_query_equals_sql(spark, query):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events pages".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(([norm(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    sql = con.sql(registry.ORACLE[query.__name__])
    at = [sql.columns.index(c) for c in columns]
    assert ours == sorted(([norm(r[i]) for i in at] for r in sql.fetchall()), key=repr)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("car", "kmh", "temp", "want"), [(physics.TWO_WHEEL, 110.0, 23.0, 204.80793312426513), (physics.ALL_WHEEL, 110.0, 23.0, 208.29794680073573), (physics.ALL_WHEEL, 113.0, 0.0, 244.34873769), (physics.TWO_WHEEL, 110.0, -10.0, 255.41817250)])
def test_consumption(spark, car, kmh, temp, want):
    got = physics.edge_energy_wh(car, F.lit(1000.0), F.lit(kmh), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(temp))
    assert value(spark, got) == pytest.approx(want, rel=1e-8)


@pytest.mark.parametrize(("kw", "warmth", "low", "minutes"), [(350.0, 1.0, False, 18.12726), (350.0, 0.0, False, 30.93886), (150.0, 1.0, True, 24.50260)])
def test_charge_time(spark, kw, warmth, low, minutes):
    got = physics.charge_seconds(physics.ALL_WHEEL, F.lit(0.1), F.lit(0.8), F.lit(kw), F.lit(warmth), low)
    assert value(spark, got) / 60 == pytest.approx(minutes, abs=1e-3)


def test_climb_keeps_small_drift_out(spark):
    rows = [(1, i, 100.0 + (1.5 if i % 2 else -1.5)) for i in range(50)] + [(2, i, float(i)) for i in range(101)] + [(3, 0, None)]
    got = {r.trip_id: (r.ascent_m, r.descent_m) for r in trips.climb(spark.createDataFrame(rows, "trip_id int, seq int, alt_m double")).collect()}
    assert got[1] == (0.0, 0.0) and abs(got[2][0] - 100) <= 3 and got[3] == (0.0, 0.0)


def test_weighted_median(spark):
    rows = [("a", 3.0, 1.0), ("a", 2.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 1.0), ("b", 4.0, 1.0), ("c", 1.0, 0.0)]
    got = dict(map(tuple, trips.weighted_median(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w").collect()))
    assert got == {"a": 2.0, "b": 2.0, "c": None}


def test_acceptance(spark):
    rows = [("a", 1, 1, 3.0), ("a", 2, 2, 1.0), ("a", 3, 3, 1.0), ("b", 1, 1, 3.1), ("b", 2, 2, 1.0), ("c", 1, 1, 9.0), *[("c", i, i, 2.0) for i in range(2, 12)]]
    got = {r.vehicle: r.accepted for r in trips.acceptance(spark.createDataFrame(rows, "vehicle string, trip_id int, start_unix int, error double")).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_tags(spark):
    speed = lambda s: value(spark, road.max_speed_kmh(F.lit(s)))
    assert speed("50") == 50 and speed("30 mph") is None and speed("none") is None
    assert value(spark, road.default_speed_kmh(F.lit("motorway_link"))) == 72 and value(spark, road.default_speed_kmh(F.lit("footway"))) is None
    assert value(spark, road.one_way(F.lit(None).cast("string"), F.lit("roundabout"))) == 1 and value(spark, road.one_way(F.lit(None).cast("string"), F.lit("circular"))) == 0
    assert value(spark, geo.signed_turn_deg(F.lit(270.0))) == -90


def test_stream_counts_equal_batch(spark, tmp_path):
    from wattroute.streaming.latest import windowed_counts

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("hourly")) == key(windowed_counts(events))
