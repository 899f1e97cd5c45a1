"""Sinks: keyed upsert, append-if-absent, partition replacement, documents, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from observatory import schemas
from observatory.operators.quality import observed_count


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last row per key. ``max_by`` combines before the shuffle, so a hot key
    arrives at one task as one row per input partition."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(packed.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(packed.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Insert-or-replace by key, the last incoming row winning."""
    fresh = latest_by_key(incoming, keys, order).select(*existing.columns)
    kept = existing.join(fresh.select(*keys), list(keys), "left_anti").select(*existing.columns)
    return kept.unionByName(fresh)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Only the rows whose key is new, the first arrival per key."""
    return first_by_key(incoming, keys, order).join(existing.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def require_append(table: str, mode: str) -> None:
    """Raw model output is never replaced."""
    if table in schemas.APPEND_ONLY and mode != "append":
        raise ValueError(f"{table} is append-only")


def append_new(path: str, existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> int:
    """Append the new rows and return how many there were."""
    counted, metrics = observed_count(insert_if_absent(existing, incoming, keys, order), "appended")
    counted.write.mode("append").parquet(path)
    return int(metrics.get["n"])


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Rewrite only the partitions present in ``df`` (S16): no stale derived row
    of a scope survives, and other scopes are untouched."""
    (
        df.repartition(*partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def replace_scope(existing: DataFrame, derived: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The same replacement as a DataFrame: rows of a rewritten scope go, new rows come."""
    touched = derived.select(*scope).distinct()
    return existing.join(touched, list(scope), "left_anti").select(*existing.columns).unionByName(derived.select(*existing.columns))


def canonical_projection(sightings: DataFrame) -> DataFrame:
    """The published columns of canonical rows."""
    return sightings.filter(F.col("duplicate_of").isNull()).select(*schemas.SIGHTING_EXPORT_COLUMNS)


def write_sightings(sightings: DataFrame, path: str, rows_per_file: int = 5_000_000) -> int:
    """Canonical rows by park, sorted by date inside each file.

    A park is range-split on date and id, so one park with most of the rows
    becomes many files instead of one task.
    """
    ordered = (
        canonical_projection(sightings)
        .repartitionByRange("park", "observed_on", "sighting_id")
        .sortWithinPartitions("park", "observed_on", "sighting_id")
    )
    # counted above the range exchange: the exchange reads its input twice, to
    # find the ranges and to send the rows
    out, metrics = observed_count(ordered, "written")
    out.write.option("maxRecordsPerFile", rows_per_file).partitionBy("park").parquet(path)
    return int(metrics.get["n"])


def cell_features(cells: DataFrame) -> DataFrame:
    """One GeoJSON feature text per cell (S12). Features stay rows: a park's
    collection is the concatenation of its files, never one driver string."""
    ring = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    props = F.struct("cell", "res", "coarsened", "count", "hv", "mp", "y0", "y1", "sp")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        props.alias("properties"),
    )
    return cells.select("park", F.to_json(feature).alias("value"))


def row_documents(df: DataFrame) -> DataFrame:
    """Any per-park table (species, places, photos, climate, index) as one JSON text per row."""
    return df.select("park", F.to_json(F.struct(*[c for c in df.columns if c != "park"])).alias("value"))


def write_documents(rows: DataFrame, path: str) -> None:
    """``park`` and one JSON ``value`` per row, one folder per park."""
    rows.select("park", "value").write.partitionBy("park").text(path)


def write_review_template(template: DataFrame, path: str) -> None:
    """Never overwrites: a half-filled review survives a rerun."""
    template.write.mode("ignore").option("header", "true").csv(path)


def manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SHA-256 and bytes of every file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("bytes")
    )


def verify_manifest(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Files missing, added or changed since the manifest was written."""
    s, r = stored.alias("s"), recomputed.alias("r")
    joined = s.join(r, F.col("s.file") == F.col("r.file"), "full_outer")
    problem = (
        F.when(F.col("r.file").isNull(), "missing")
        .when(F.col("s.file").isNull(), "unlisted")
        .when((F.col("s.sha256") != F.col("r.sha256")) | (F.col("s.bytes") != F.col("r.bytes")), "changed")
    )
    return joined.select(F.coalesce("s.file", "r.file").alias("file"), problem.alias("problem")).filter("problem is not null")
