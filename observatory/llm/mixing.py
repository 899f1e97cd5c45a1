"""Mixing sources to target weights with hash-threshold histograms.

Each row has a size in words and a hash. Summing sizes by source and hash bucket
gives a histogram, whose running sum shows the bucket in which a source's budget
ends; only that bucket is summed again by the next digits of the hash, level by
level, until a single hash value is left. A row is then taken when its hash lies
below its source's threshold. Nothing is sorted, and a budget that grows only
adds rows: thresholds are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
HASH_DIGITS = 15
LEVEL_DIGITS = 3


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(row_id: Column, text: Column) -> Column:
    """Hexadecimal digits that any engine with md5 gives alike."""
    name = F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("-")), F.coalesce(F.md5(text.cast("binary")), F.lit("-")))
    return F.substring(F.md5(name.cast("binary")), 1, HASH_DIGITS)


def targets(totals: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Targets in words for ``totals`` (source, source_size): one row per source.

    Sources by code point, null last, have the weights in turn. They share the
    sum of all sizes; a target stops at ``cap`` times its source's size, and the
    excess goes to the others by weight. With the sources in the order in which
    they reach their cap, the share per weight follows from running sums.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("_w", weight.cast("bigint")).withColumn("_cap", F.col("source_size") * cap)
    ratio = F.col("_cap").cast("double") / F.col("_w")
    by_ratio = W.orderBy(ratio, F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumns({
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weights": F.sum("_w").over(onward),
    })
    # the first source whose cap is not reached sets the share per weight for itself and all after it
    fits = F.col("_left").cast("double") * F.col("_w") <= F.col("_cap").cast("double") * F.col("_weights")
    open_at = F.when(fits, F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), "source", "_left", "_weights"))
    t = t.withColumn("_open", F.min(open_at).over(everything))
    share = (F.col("_w") * F.col("_open._left")).cast("double") / F.col("_open._weights").cast("double")
    target = F.least(F.col("_cap").cast("double"), F.coalesce(share, F.col("_cap").cast("double")))
    return t.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``whole`` (copies that every row gives), ``bound`` and ``at_bound``.

    ``rows``: source, size, hash. One more copy is taken of the rows whose hash
    is below ``bound``, and of those at it if ``at_bound``: whichever comes
    closer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = goals.select("source", "rest", F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    for level in range(HASH_DIGITS // LEVEL_DIGITS):
        seen = level * LEVEL_DIGITS
        r, s = rows.alias("r"), state.alias("s")
        here = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.substring(F.col("r.hash"), 1, seen) == F.col("s.prefix"))
        sums = (
            r.join(s, here)
            .groupBy("s.source", "rest", "prefix", "below", F.substring("hash", seen + 1, LEVEL_DIGITS).alias("digits"))
            .agg(F.sum("size").alias("size"))
        )
        upto = F.col("below") + F.sum("size").over(W.partitionBy("source").orderBy("digits"))
        state = (
            sums.withColumn("upto", upto)
            .filter((F.col("upto") - F.col("size") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
            .select(
                "source", "rest", F.concat("prefix", "digits").alias("prefix"),
                (F.col("upto") - F.col("size")).alias("below"), F.col("size").alias("size"),
            )
        )
        if level < HASH_DIGITS // LEVEL_DIGITS - 1:
            state = state.drop("size")
    bounds = state.select(
        "source", F.col("prefix").alias("bound"),
        (F.col("below") + F.col("below") + F.col("size") <= 2 * F.col("rest")).alias("at_bound"),
    )
    g, b = goals.alias("g"), bounds.alias("b")
    return g.join(b, F.col("g.source").eqNullSafe(F.col("b.source")), "left").select("g.*", "bound", "at_bound")


def copies(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (with source and hash) with ``source_size``, ``target`` and ``copies``: how often the mix takes each row."""
    r, s = rows.alias("r"), limits.alias("s")
    extra = F.col("bound").isNull() | (F.col("hash") < F.col("bound")) | ((F.col("hash") == F.col("bound")) & F.col("at_bound"))
    n = F.col("whole") + F.when((F.col("rest") > 0) & extra, 1).otherwise(0)
    return r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.*", "source_size", "target", n.cast("bigint").alias("copies")
    )


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size and hash of every row."""
    return df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col)).alias("hash"),
    )


def mix(
    df: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, hash, source_size, target and copies of every row of ``df``.

    Texts are read once: sizes and hashes are written to the shared folder and
    the levels run over them. Null and empty texts have size 0 and give no
    words; a null source is one source, last in order. Rows alike in id and text
    share a hash and are taken together. An empty table gives no rows; only the
    named columns are read.
    """
    rows = materialise(measured(df, id_col, text_col, source_col), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = materialise(thresholds(rows, materialise(targets(totals, weights, cap), "targets")), "thresholds")
    return copies(rows, limits)  # a written table of one row a source: sent to the rows if small, else a join whose hot source is split


def mixed_documents(df: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The documents of the mix: every column of ``df``, each row as often as the mix takes it.

    Texts stay where they are read: only the per-source thresholds are joined to
    them. Rows of size 0 are dropped, as they hold no words to take.
    """
    slim = materialise(measured(df), "sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = materialise(thresholds(slim, materialise(targets(totals, weights, cap), "targets")), "thresholds")
    text, source = F.col("text"), F.col("source")
    names = df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = df.select(row.alias("_row"), source.alias("source"), hash_of(F.col("doc_id"), text).alias("hash"), (text.rlike(WORD)).alias("_any"))
    out = copies(keyed.filter("_any"), limits).filter("copies > 0")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
