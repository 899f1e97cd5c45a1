from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from observatory.session import scratch_path
from observatory.streaming import live

T0 = dt.datetime(2024, 6, 1)
DDL = "sequence_id string, label string, ts timestamp, lon double, lat double, id int"


def _events(n=200, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=rng.randrange(20000))
        out.append((f"s{rng.randrange(3)}", rng.choice("ab"), at, -110 + rng.randrange(3) * 0.002, 44.9, i))
    return out


def _land(spark, data, files=4):
    """Several files, time order kept between them, and one far-future row to close everything."""
    path = scratch_path(spark, "landed")
    data = sorted(data, key=lambda r: r[2])
    step = -(-len(data) // files)
    parts = [data[i : i + step] for i in range(0, len(data), step)] + [[("end", "z", T0 + dt.timedelta(days=3), 0.0, 0.0, -1)]]
    for p in parts:
        spark.createDataFrame(p, DDL).coalesce(1).write.mode("append").parquet(path)
    return path


def _read(spark, path, per=1):
    return live.read_stream(spark, path, spark.createDataFrame([], DDL).schema, files_per_batch=per)


def _chains(data, gap, dist):
    from tests.test_operators import hav

    out = []
    for key in sorted({(r[0], r[1]) for r in data}):
        prev = None
        for r in sorted((r for r in data if (r[0], r[1]) == key), key=lambda r: (r[2], r[5])):
            if prev and (r[2] - prev[2]).total_seconds() <= gap and hav((r[3], r[4]), (prev[3], prev[4])) <= dist:
                out[-1][-1] += 1
                out[-1][3] = r[2]
            else:
                out.append([*key, r[2], r[2], 1])
            prev = r
    return sorted(tuple(x) for x in out)


def test_sessions_equal_the_batch_chains(spark):
    data = _events()
    out = live.run_to_end(live.frame_sessions(_read(spark, _land(spark, data), 10).select("sequence_id", "label", "ts"), "60 seconds", "10 seconds"), "t")
    got = sorted((r.sequence_id, r.label, r.first_ts, r.last_ts, r.n) for r in out.filter("sequence_id <> 'end'").collect())
    assert got == _chains(data, 60, 1e9)


def test_stateful_chains_equal_the_batch_chains(spark):
    data = _events(250, 2)
    out = live.run_to_end(live.frame_chains(_read(spark, _land(spark, data), 10), 300, 200.0, "10 seconds"), "t")
    got = sorted((r.sequence_id, r.label, r.first_ts, r.last_ts, r.n) for r in out.filter("sequence_id <> 'end'").collect())
    assert got == _chains(data, 300, 200.0)


def test_chains_of_many_keys_advance_together():
    rows = [("a", None, 10, 1), ("a", None, 70, 2), (None, "b", 60, 3), ("a", None, 131, 4), ("a", "b", 900, 5)]
    table = live._new_rows(pd.DataFrame({
        "sequence_id": [r[0] for r in rows], "label": [r[1] for r in rows], "ts": pd.to_datetime([r[2] for r in rows], unit="us"),
        "id": [r[3] for r in rows], "lon": 0.0, "lat": 0.0,
    }))
    names = ["sequence_id", "label", "first_us", "us", "n", "open"]
    stays, closed = live._advanced(table, 150, 60, 1.0)  # the second chain of the first key is still open
    assert closed.select(names).to_pylist() == [dict(zip(names, r, strict=True)) for r in (("a", None, 10, 70, 2, True), (None, "b", 60, 60, 1, True))]
    assert stays.select(names).to_pylist() == [dict(zip(names, r, strict=True)) for r in (("a", "b", 900, 900, 1, False), ("a", None, 131, 131, 1, True))]
    stays, closed = live._advanced(stays, 1000, 60, 1.0)
    assert stays.num_rows == 0 and closed.num_rows == 2


def test_chains_keep_state_per_bucket_of_keys(spark):
    data = _events(250, 9)
    stream = live.frame_chains(_read(spark, _land(spark, data), 2), 300, 200.0, "10 seconds", buckets=2)
    calls, progress = scratch_path(spark, "chains"), scratch_path(spark, "progress")
    query = stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(calls)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2  # and not one per key
    got = sorted((r.sequence_id, r.label, r.first_ts, r.last_ts, r.n) for r in spark.read.parquet(calls).filter("sequence_id <> 'end'").collect())
    assert got == _chains(data, 300, 200.0)


def test_upsert_over_batches_equals_the_batch(spark):
    data = _events(120, 3)
    s = _read(spark, _land(spark, data)).select((F.col("id") % 10).alias("k"), "ts", "id")
    path, schema, by = scratch_path(spark, "u"), s.schema, (["k"], ["ts", "id"])
    live.continuous_upsert(s, path, *by, scratch_path(spark, "p"))
    want = {}
    for r in sorted(data, key=lambda r: (r[2], r[5])):
        want[r[5] % 10] = r[5]
    table = live.read_latest(spark, path, schema, *by)
    assert spark.read.schema(schema).parquet(path).select("batch").distinct().count() == 5
    assert {r.k: r.id for r in table.filter("id >= 0").collect()} == want
    to = scratch_path(spark, "c")
    live.compact(spark, path, to, schema, *by)
    assert sorted(live.read_latest(spark, to, schema, *by).collect()) == sorted(table.collect())


def test_the_end_mark_writes_what_is_open(spark):
    data = _events(80, 7)
    df = spark.createDataFrame(data, DDL)
    stream = live.read_stream(spark, live.land(df, "ts"), df.schema, files_per_batch=live.FILES)
    out = live.run_to_end(live.frame_chains(stream, 300, 200.0, "10 seconds"), "t")
    got = sorted((r.sequence_id, r.label, r.first_ts, r.last_ts, r.n) for r in out.collect())
    assert got == _chains(data, 300, 200.0)


def test_first_arrivals_are_distinct(spark):
    data = _events(120, 4)
    out = live.run_to_end(live.first_arrivals(_read(spark, _land(spark, data)), ["sequence_id", "label"], "ts").select("sequence_id", "label"), "t")
    keys = [(r.sequence_id, r.label) for r in out.collect()]
    assert len(keys) == len(set(keys)) == 7


def test_cell_counts(spark):
    data = _events(100, 5)
    out = live.run_to_end(live.cell_counts(_read(spark, _land(spark, data), 10).select("ts", "lon", "lat"), "1 hour", None, 6, "1 minute"), "t")
    assert out.agg(F.sum("n")).collect()[0][0] == 100
