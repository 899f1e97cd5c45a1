"""Structured Streaming forms of the batch operators.

State is bounded by an event-time watermark. What is still open when an input
ends is written once the end is marked (``end_of_input``): then each form agrees
with its batch twin.
"""

from __future__ import annotations

import datetime as dt
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from observatory.functions import geo, hexgrid
from observatory.session import scratch_path
from observatory.sources import sinks


#: Files of a slot of landed input, and of a batch that reads one.
FILES = 8


def read_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A file stream with a declared schema."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


END = dt.datetime(2200, 1, 1)


def end_of_input(spark: SparkSession, schema: T.StructType, ts: str) -> DataFrame:
    """The last row of a finished input: all null but for a time far ahead.

    It carries the watermark past every open session, chain and window, which
    writes them; itself it stays open for ever.
    """
    return spark.range(1).select(*[
        F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema
    ])


def land(df: DataFrame, ts: str, slots: int = 3, files: int = FILES) -> str:
    """A finished input as a folder for ``read_stream``: slices of event time one after another, then the end mark.

    The input is read once and dealt into slots of event time; each slot is then
    written by as many tasks as it has ``files``. A slot with fewer files is
    filled up with empty ones, so a reader that takes ``files`` at a time gets one
    slot a batch, and the mark alone at the end.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "landed")
    low, high = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    low, high = low or 0, high or 0
    slot = F.least(F.floor((F.unix_micros(ts) - low) * slots / (high - low + 1)), F.lit(slots - 1))
    dealt = scratch_path(spark, "by-slot")
    df.filter(F.col(ts).isNotNull()).withColumn("_slot", slot.cast("int")).write.partitionBy("_slot").parquet(dealt)
    by_slot = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_slot", T.IntegerType())])).parquet(dealt)
    for i in range(slots):
        before = len(spark.read.schema(df.schema).parquet(path).inputFiles()) if i else 0
        by_slot.filter(F.col("_slot") == i).drop("_slot").repartition(files).write.mode("append").parquet(path)
        short = files - (len(spark.read.schema(df.schema).parquet(path).inputFiles()) - before)
        for _ in range(short):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    end_of_input(spark, df.schema, ts).coalesce(1).write.mode("append").parquet(path)
    return path


def run_to_end(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all that is there, then read the written table."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", scratch_path(spark, label + "-progress"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def continuous_upsert(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], progress: str) -> None:
    """Drain a stream into a keyed table, last write wins (ST1).

    A micro-batch adds the last row of each of its keys as one partition, so its
    cost follows the batch; a replayed batch writes the same partition again.
    """
    by = [F.col(c) for c in order]

    def add(batch: DataFrame, epoch: int) -> None:
        sinks.latest_by_key(batch, keys, by).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def read_latest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The keyed table as it stands: of all batches the last row per key."""
    rows = spark.read.schema(schema).parquet(path).select(schema.names)
    return sinks.latest_by_key(rows, keys, [F.col(c) for c in order])


def compact(spark: SparkSession, path: str, to: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str]) -> None:
    """A batch job that writes the table anew as one batch, for readers and further batches to start from."""
    read_latest(spark, path, schema, keys, order).write.parquet(f"{to}/batch=-1")


def first_arrivals(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Insert-if-absent with state that forgets keys past the watermark (ST2)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def frame_sessions(stream: DataFrame, gap: str = "60 seconds", delay: str = "1 hour") -> DataFrame:
    """Frame chains by time alone, as session windows (ST3).

    ``stream``: sequence_id, label, ts (timestamp).
    """
    return (
        stream.withWatermark("ts", delay)
        .groupBy("sequence_id", "label", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("sequence_id", "label", "first_ts", "last_ts", "n")
    )


def _metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.MEAN_EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


CHAIN_OUTPUT = "sequence_id string, label string, first_ts timestamp, last_ts timestamp, n bigint"

#: What the state of chains keeps: rows that wait, and open chains as their last row with their start and size.
_ROWS = pa.schema([
    ("sequence_id", pa.string()), ("label", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()),
    ("first_us", pa.int64()), ("n", pa.int64()), ("open", pa.bool_()),
])


def _packed(rows: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows.combine_chunks())
    return out.getvalue()


def _new_rows(pdf: pd.DataFrame) -> pa.Table:
    us = pa.array(pdf["ts"].astype("datetime64[us]").astype("int64"))
    n = len(pdf)
    columns = [
        pa.array(pdf["sequence_id"], pa.string(), from_pandas=True), pa.array(pdf["label"], pa.string(), from_pandas=True), us,
        pa.array(pdf["id"], from_pandas=True).cast(pa.int64()), pa.array(pdf["lon"], pa.float64(), from_pandas=True), pa.array(pdf["lat"], pa.float64(), from_pandas=True),
        us, pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, bool)),
    ]
    return pa.Table.from_arrays(columns, schema=_ROWS)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number per value; null is a value."""
    return pa.compute.dictionary_encode(column.combine_chunks(), null_encoding="encode").indices.to_numpy()


def _advanced(rows: pa.Table, mark: int, gap_us: int, dist_m: float) -> tuple[pa.Table, pa.Table]:
    """(what stays, chains that closed) of the open chains and waiting rows of many keys when the watermark is ``mark``.

    Of each key the open chain goes first, as its last row, then its released
    rows by time and id. All keys are linked in one pass over the sorted rows.
    """
    first_key, second_key = _codes(rows["sequence_id"]).astype(np.int64), _codes(rows["label"]).astype(np.int64)
    key = first_key * (second_key.max(initial=0) + 1) + second_key
    us, is_open = rows["us"].to_numpy(), rows["open"].to_numpy()
    ready = np.flatnonzero(is_open | (us <= mark))
    ids = rows["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    at = ready[np.lexsort((ids[ready], us[ready], ~is_open[ready], key[ready]))]
    t, k = us[at], key[at]
    x, y = rows["lon"].to_numpy()[at], rows["lat"].to_numpy()[at]
    same = k[1:] == k[:-1]
    linked = same & (np.diff(t) <= gap_us) & (_metres(x[:-1], y[:-1], x[1:], y[1:]) <= dist_m)
    starts = np.flatnonzero(np.append(True, ~linked)[:len(at)])
    ends = np.append(starts[1:], len(at))[:len(starts)] - 1
    sizes = np.add.reduceat(rows["n"].to_numpy()[at], starts) if len(at) else np.zeros(0, np.int64)
    ahead = np.append(same, False)[:len(at)][ends]  # the key goes on behind the chain
    chains = rows.take(pa.array(at[ends])).set_column(6, "first_us", pa.array(rows["first_us"].to_numpy()[at[starts]]))
    chains = chains.set_column(7, "n", pa.array(sizes)).set_column(8, "open", pa.array(np.ones(len(ends), bool)))
    closed = ahead | (t[ends] + gap_us < mark)
    waiting = rows.filter(pa.array(~is_open & (us > mark)))
    return pa.concat_tables([waiting, chains.filter(pa.array(~closed))]), chains.filter(pa.array(closed))


def frame_chains(stream: DataFrame, gap_s: float = 60.0, dist_m: float = 200.0, delay: str = "1 hour", buckets: int = 2048) -> DataFrame:
    """Frame chains with the distance clause, one open chain of state per key (ST4).

    ``stream``: sequence_id, label, ts, lon, lat, id. Rows of a key are released
    in order of time and id once the watermark passes them; the open chain
    closes when the watermark is a gap past its last row. State is the rows
    still waiting plus one chain per key.

    Keys are dealt into ``buckets`` by hash, and the keys of a bucket advance
    together, so a batch costs a call of Python per bucket and not per key. A
    stream that was begun with one number of buckets goes on with it.
    """
    gap_us = int(gap_s * 1_000_000)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [_ROWS.empty_table()]
        if state.exists:
            parts.append(pa.ipc.open_stream(state.get[0]).read_all())
        if not state.hasTimedOut:
            parts += [_new_rows(pdf) for pdf in batches]
        mark = state.getCurrentWatermarkMs() * 1000
        stays, closed = _advanced(pa.concat_tables(parts), mark, gap_us, dist_m)
        if stays.num_rows:
            state.update((_packed(stays),))
            due = int(np.min(stays["us"].to_numpy() + np.where(stays["open"].to_numpy(), gap_us, 0)))
            state.setTimeoutTimestamp(max(due // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if closed.num_rows:
            yield pd.DataFrame({
                "sequence_id": closed["sequence_id"].to_pandas(), "label": closed["label"].to_pandas(),
                "first_ts": pd.to_datetime(closed["first_us"].to_numpy(), unit="us"), "last_ts": pd.to_datetime(closed["us"].to_numpy(), unit="us"),
                "n": closed["n"].to_numpy(),
            })

    return (
        stream.withWatermark("ts", delay)
        .withColumn("bucket", F.pmod(F.xxhash64("sequence_id", "label"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(advance, CHAIN_OUTPUT, "waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    )


def cell_counts(stream: DataFrame, length: str = "1 day", slide: str | None = None, res: int = 6, delay: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts per cell (ST5). ``stream``: ts, lon, lat."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        stream.withWatermark("ts", delay)
        .groupBy(window.alias("w"), hexgrid.cell_of(F.col("lon"), F.col("lat"), res).alias("cell"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cell", "n")
    )
