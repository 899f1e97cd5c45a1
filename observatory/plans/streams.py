"""Streaming queries, drained to the end of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from observatory.plans import testbed as tb
from observatory.plans.registry import query
from observatory.plans.sightings import hex_sql
from observatory.session import scratch_path
from observatory.streaming import live


def _events(spark, sf):
    """The events table landed in three slots of time, and the mark of its end."""
    path = live.land(tb.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    return live.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=live.FILES)


def _ntz(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return df


_LATEST = """SELECT key, event_id, value FROM (SELECT user_id * 10 + event_id % 7 AS key, event_id, value, row_number() OVER (PARTITION BY user_id * 10 + event_id % 7 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


@query("stream_upsert", _LATEST)
def stream_upsert(spark, sf):
    s = _events(spark, sf).filter("event_id is not null").select((F.col("user_id") * 10 + F.col("event_id") % 7).alias("key"), "ts", "event_id", "value")
    path = scratch_path(spark, "upsert")
    live.continuous_upsert(s, path, ["key"], ["ts", "event_id"], scratch_path(spark, "upsert-progress"))
    return live.read_latest(spark, path, s.schema, ["key"], ["ts", "event_id"]).select("key", "event_id", "value")


@query("stream_first_arrivals", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first(spark, sf):
    """State forgets a key after a day, so one that returns later arrives again; the reader settles those."""
    out = live.first_arrivals(_events(spark, sf), ["user_id", "event_type"], "ts")
    return live.run_to_end(out.select("user_id", "event_type"), "first-arrivals").filter("user_id is not null").distinct()


_US = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


@query(
    "stream_sessions",
    f"""SELECT sequence_id, label, {_US.format(c='min(ts)')} AS first_ts, {_US.format(c='max(ts)')} AS last_ts, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY sequence_id, label ORDER BY ts, event_id) AS s FROM (
     SELECT concat('s', user_id) AS sequence_id, event_type AS label, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 2 DAY THEN 0 ELSE 1 END AS brk FROM events))
     GROUP BY sequence_id, label, s""",
)
def stream_sessions(spark, sf):
    s = _events(spark, sf).select(F.concat(F.lit("s"), "user_id").alias("sequence_id"), F.col("event_type").alias("label"), "ts")
    return _ntz(live.run_to_end(live.frame_sessions(s, "2 days"), "sessions"), "first_ts", "last_ts")


_D = """2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin((radians(lat) - radians(p_lat)) / 2), 2) + cos(radians(p_lat)) * cos(radians(lat)) * pow(sin(radians(lon - p_lon) / 2), 2))))"""


@query(
    "stream_chains",
    f"""WITH e AS (SELECT concat('s', user_id) AS sequence_id, event_type AS label, ts, event_id, {tb.LON} AS lon, {tb.LAT} AS lat FROM events),
     r AS (SELECT *, lag(ts) OVER w AS p_ts, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat FROM e WINDOW w AS (PARTITION BY sequence_id, label ORDER BY ts, event_id)),
     c AS (SELECT *, sum(CASE WHEN ts - p_ts <= INTERVAL 3 DAY AND {_D} <= 2500e0 THEN 0 ELSE 1 END) OVER (PARTITION BY sequence_id, label ORDER BY ts, event_id) AS ch FROM r)
     SELECT sequence_id, label, {_US.format(c='min(ts)')} AS first_ts, {_US.format(c='max(ts)')} AS last_ts, count(*) AS n FROM c GROUP BY sequence_id, label, ch""",
)
def stream_chains(spark, sf):
    s = _events(spark, sf).select(
        F.concat(F.lit("s"), "user_id").alias("sequence_id"), F.col("event_type").alias("label"), "ts", F.col("event_id").alias("id"),
        F.expr(tb.LON).alias("lon"), F.expr(tb.LAT).alias("lat"),
    )
    out = live.frame_chains(s, gap_s=3 * 86400.0, dist_m=2500.0)
    return _ntz(live.run_to_end(out, "chains"), "first_ts", "last_ts")


def _counts_sql(days: int, slide: int) -> str:
    return f"""SELECT strftime(st, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(st + INTERVAL {days} DAY, '%Y-%m-%d %H:%M:%S.%f') AS "end", cell, count(*) AS n FROM (
     SELECT cell, ts, unnest(generate_series(date_trunc('day', ts) - INTERVAL {days - slide} DAY, date_trunc('day', ts), INTERVAL {slide} DAY)) AS st FROM
     {hex_sql(f"(SELECT *, 6 AS res, {tb.LON} AS lon, {tb.LAT} AS lat FROM events)")}) GROUP BY st, cell"""


@query("stream_daily_cell_counts", _counts_sql(1, 1))
def stream_daily(spark, sf):
    s = _events(spark, sf).select("ts", F.expr(tb.LON).alias("lon"), F.expr(tb.LAT).alias("lat"))
    return _ntz(live.run_to_end(live.cell_counts(s), "daily"), "start", "end")


@query("stream_weekly_cell_counts", _counts_sql(7, 1))
def stream_weekly(spark, sf):
    s = _events(spark, sf).select("ts", F.expr(tb.LON).alias("lon"), F.expr(tb.LAT).alias("lat"))
    return _ntz(live.run_to_end(live.cell_counts(s, "7 days", "1 day"), "weekly"), "start", "end")
