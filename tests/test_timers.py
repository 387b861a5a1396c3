import datetime as dt

import pytest

from evidentia.streaming import timers

T0 = dt.datetime(2024, 1, 1)
ROWS = "key string, status string, ts timestamp, event_id long"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def told(spark, tmp_path):
    """A function that runs a stream over batches of rows, one after another, and returns (key, status, minute, event)
    of each batch and the number of keys in the state behind it."""
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.use_state_store(spark)

    def run(batches, make, schema=ROWS):
        src, out = tmp_path / "in", []
        src.mkdir()
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
            found = []
            q = (
                make(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
                .foreachBatch(lambda b, _: found.extend(map(tuple, b.collect()))).start()
            )
            q.awaitTermination()
            out.append((sorted(found, key=repr), q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None))
        return out

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_runs_end_or_time_out_and_leave_the_state(told):
    batches = [
        [("a", "queued", at(0), 1), ("a", "processing", at(1), 2), ("b", "processing", at(2), 3), (None, "queued", at(0), 4), ("c", "queued", None, 5), ("d", None, at(3), 6)],
        [("a", "complete", at(5), 7), ("e", "queued", at(6), 8)],
        [("f", "queued", at(500), 9)],
    ]
    got = told(batches, lambda s: timers.ended_runs(s, 3600))
    assert got[0][0] == [] and got[1][0] == [("a", "complete", at(5), 7)]
    assert got[2][0] == [("b", "timeout", at(2), 3), ("d", "timeout", at(3), 6), ("e", "timeout", at(6), 8)]
    assert got[2][1] < got[1][1]  # only f is left


def test_batches_do_not_matter(told):
    rows = [("k", s, at(m), i) for i, (s, m) in enumerate([("queued", 0), ("processing", 10), ("queued", 200), ("processing", 201), ("error", 205), ("queued", 206), ("complete", 900), ("queued", 901)])]
    want = [("k", "timeout", at(10), 1), ("k", "error", at(205), 4), ("k", "timeout", at(206), 5), ("k", "complete", at(900), 6)]
    got = told([rows[:3], rows[3:5], rows[5:]], lambda s: timers.ended_runs(s, 3600))
    assert sorted((r for found, _ in got for r in found), key=lambda r: r[3]) == want


def test_entries_expire_once(told):
    batches = [[("x", 1, at(0)), ("x", 2, at(30)), ("y", 3, at(31))], [("y", 4, at(80))], [("z", 5, at(400))], [("z", 6, at(401))]]
    got = told(batches, lambda s: timers.expired_entries(s, 3600), "key string, value long, ts timestamp")
    assert [r for found, _ in got for r in found] == [("x", 2, at(30)), ("y", 4, at(80))]
