"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that its predecessor kept and returns the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from observatory.llm import mixing, packing, pii, queries, simhash, toxicity
from observatory.llm.batches import bound_batches
from observatory.session import materialise

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``; those without a text stay."""
    bound_batches(spark)
    scored = toxicity.with_scores(docs, queries.toxicity_model(spark, sf_dir, docs))
    return scored.filter(F.col("score") < TOXIC_FROM).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: of the smallest id, and of its texts in the group the one with the smallest fingerprint.

    Rows that repeat an id with one text stay once. An id with different texts is
    several documents: each text stays or goes with its own group. Rows without an
    id cannot be told apart and stay.
    """
    bound_batches(spark)
    groups = materialise(simhash.near_duplicates(docs).filter("doc_id is not null"), "near-duplicates")
    first = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    per_id = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(first).alias("stays"), (F.min("fp") < F.max("fp")).alias("mixed"))
    marked = materialise(per_id.filter("n > 1 or not stays or mixed"), "not-as-they-are")
    single = docs.join(marked.select("doc_id"), "doc_id", "left_anti").select(docs.columns)

    row, order = F.struct(*docs.columns), F.xxhash64(*docs.columns)  # of rows that repeat any is as good, but always the same
    again = docs.join(marked.filter("stays and not mixed").select("doc_id"), "doc_id", "left_semi")
    again = again.groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select("row.*")

    mixed = docs.join(marked.filter("mixed").select("doc_id"), "doc_id", "left_semi").select(F.xxhash64("text").alias("_text"), row.alias("row"))
    mixed = materialise(mixed, "ids-with-texts")
    prints = simhash.fingerprints(mixed.select("_text", F.col("row.text").alias("text")).dropDuplicates(["_text"]), "_text").withColumnRenamed("doc_id", "_text")
    kept = groups.filter(first).groupBy("doc_id", "class_fp").agg(F.min("fp").alias("fp")).select("doc_id", "fp")
    apart = mixed.join(prints, "_text").withColumn("doc_id", F.col("row.doc_id")).join(kept, ["doc_id", "fp"], "left_semi")
    apart = apart.groupBy("doc_id", "fp").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return single.unionByName(again).unionByName(apart)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of data in place of every span; n_chars follows the text."""
    judge = pii.fit(docs)
    _, found = pii.spans(F.col("text"), judge)
    clean = docs.select(F.struct(*docs.columns).alias("row"), pii.redacted(F.col("text"), found).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)}
    return clean.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, fingerprints and token ids have no SQL; the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
