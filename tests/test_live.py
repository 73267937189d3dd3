"""Streams over several files, replays, snapshots, and grid references."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from oroflow.functions import geo
from oroflow.streaming import live

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, value double"


def feed(spark, folder, batches):
    """A stream that takes one file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, u, START + dt.timedelta(seconds=s), "x", 1.0) for i, u, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part-{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_active_set_is_bounded_at_every_moment(spark, tmp_path):
    rng = random.Random(6)
    events = [(i, rng.randrange(60), rng.randrange(5000)) for i in range(400)]
    sent = live.drained(live.active_set(feed(spark, str(tmp_path), [events[k : k + 100] for k in range(0, 400, 100)]), 7, shards=3), "update", "active").toPandas()
    assert sent.groupby(["shard", "version"]).size().max() == 7 and sent["version"].max() == 4
    newest = {}
    for i, u, s in events:
        newest[u] = max(newest.get(u, (-1, -1)), (s, i))
    expected = sorted(((s, i, u) for u, (s, i) in newest.items()), reverse=True)[:7]
    got = live.merge_active(spark.createDataFrame(sent), 7).collect()
    assert sorted(((int((r["ts"] - START).total_seconds()), r["event_id"], r["user_id"]) for r in got), reverse=True) == expected


def test_expired_positions_are_told(spark, tmp_path):
    """A key that falls silent is told as expired once the watermark is ten minutes past its last report, and only then."""
    batches = [[(1, 1, 0), (2, 2, 10)], [(3, 2, 3600)], [(4, 2, 3700)]]
    rows = live.drained(live.live_positions(feed(spark, str(tmp_path), batches)), "update", "live").collect()
    assert [(r["user_id"], r["event_id"]) for r in rows if r["expired"]] == [(1, 1)]
    assert {(r["user_id"], r["event_id"]) for r in rows if not r["expired"]} == {(1, 1), (2, 2), (2, 3), (2, 4)}


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    write = live.batch_writer(str(tmp_path), "update")
    one, two = spark.range(5), spark.range(5, 8)
    for batch, k in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, k)
    read = spark.read.schema("id long").option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    assert sorted(r["id"] for r in read.collect()) == list(range(8))


def test_sessions_stream(spark, tmp_path):
    stream = feed(spark, str(tmp_path), [[(1, 1, 0), (2, 1, 600)], [(3, 1, 1500), (4, 1, 9000)]])
    rows = live.drained(live.sessions(stream), "complete", "sessions").collect()
    assert sorted(r["n"] for r in rows) == [1, 3]


def test_snapshots(spark, tmp_path):
    store = live.Snapshots(spark, str(tmp_path), "k", ["a", "b"])
    polls = [
        {1: (1.0, "x"), 2: (2.0, None), 3: (3.0, "z"), None: (0.0, "bad")},
        {1: (1.0, "x"), 2: (2.0, "y"), 4: (4.0, "w")},
        {},
        {4: (None, None)},
    ]
    told = {}
    for v in (0, 1, 1, 2, 3, 2):  # versions 1 and 2 come twice
        store.poll(v, spark.createDataFrame([(k, *x) for k, x in polls[v].items()], "k long, a double, b string"))
        told[v] = sorted(tuple(r) for r in store.changes(v).collect())
    assert told[0] == [(1, "added", 1.0, "x"), (2, "added", 2.0, None), (3, "added", 3.0, "z")]
    assert told[1] == [(2, "moved", 2.0, "y"), (3, "gone", 3.0, "z"), (4, "added", 4.0, "w")]
    assert told[2] == [(1, "gone", 1.0, "x"), (2, "gone", 2.0, "y"), (4, "gone", 4.0, "w")]
    assert told[3] == [(4, "added", None, None)]
    assert [tuple(r) for r in store.current().collect()] == [(4, None, None)]


@pytest.mark.parametrize("lat, lon, reference", [(48.8582, 2.2945, "31UDQ4825111932"), (0.0, 3.0, "31NEA0000000000"), (-33.85678, 151.21530, "56HLH3490052288"), (85.0, 0.0, None)])
def test_grid_references(spark, lat, lon, reference):
    p = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    for step in geo.utm_steps("lat", "lon"):
        p = p.withColumns({k: F.expr(x) for k, x in step.items()})
    got = p.select(F.expr(geo.mgrs("lat"))).first()[0]
    if reference is None:
        assert got is None
        return
    assert got[:5] == reference[:5]
    assert abs(int(got[5:10]) - int(reference[5:10])) <= 2 and abs(int(got[10:]) - int(reference[10:])) <= 2


def test_the_package_can_be_shipped(spark):
    import zipfile

    import oroflow

    names = zipfile.ZipFile(oroflow.ship(spark)).namelist()
    assert "oroflow/__init__.py" in names and "oroflow/operators/lines.py" in names and not any("__pycache__" in n for n in names)
