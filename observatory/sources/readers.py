"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from observatory import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema, each with its own text as ``source_text``.

    The text keeps what the schema does not declare; it is only parsed where
    fields are read. Malformed lines have null fields; blank lines are left out.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema).alias("r"), F.col("value").alias("source_text")).select("r.*", "source_text")


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole JSON documents, one per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_elements(spark: SparkSession, path: str, ways: bool = False) -> DataFrame:
    """Landed map elements: points, or ways with full geometry."""
    item = schemas.OSM_WAY if ways else schemas.OSM_ELEMENT
    doc = T.StructType([T.StructField("elements", T.ArrayType(item))])
    rows = read_documents(spark, path, doc).select(F.explode("elements").alias("e")).select("e.*")
    return rows.filter(F.col("type") == "way") if ways else rows


def read_open_sightings(spark: SparkSession, path: str) -> DataFrame:
    """Mapped rows only; every predicate is pushed to the scan."""
    return spark.read.parquet(path).filter(
        (F.col("coordinate_status") == "open") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    )


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REVIEW_CSV).option("header", "true").option("multiLine", "true").csv(path)


def read_park_tree(spark: SparkSession, root: str, leaf: str, schema: T.StructType) -> DataFrame:
    """One document per park below ``root``; the folder name is the park key."""
    park: Column = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return read_documents(spark, f"{root}/*/{leaf}", schema).select(F.url_decode(park).alias("park"), "*")
