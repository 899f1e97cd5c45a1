"""Sensitivity rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from observatory.functions import names

# The share of flagged rows that makes a species sensitive, and
# the resolution it is then coarsened to.
AUTO_SENSITIVE_SHARE = 0.5
AUTO_RES = 6


def privacy_counts() -> list[Column]:
    """Aggregates over sightings: ``own`` observations and how many of these are ``flagged`` by taxon privacy."""
    own = F.col("source") == "inaturalist"
    flag = F.get_json_object("raw_json", "$.taxon_geoprivacy").isin("obscured", "private")
    return [F.count_if(own).alias("own"), F.count_if(own & flag).alias("flagged")]


def _share() -> Column:
    return F.when(F.col("own") > 0, F.col("flagged") / F.col("own"))


def auto_sensitive(sightings: DataFrame, min_share: float = AUTO_SENSITIVE_SHARE) -> DataFrame:
    """Species whose observations mostly carry taxon privacy, per park (A4)."""
    named = sightings.filter((F.col("source") == "inaturalist") & F.col("scientific_name").isNotNull())
    return auto_sensitive_of(named.groupBy("park", "scientific_name").agg(*privacy_counts()), min_share)


def auto_sensitive_of(counts: DataFrame, min_share: float = AUTO_SENSITIVE_SHARE) -> DataFrame:
    """The same from counts per (park, scientific_name)."""
    return counts.select("park", "scientific_name", _share().alias("share")).filter(F.col("share") >= min_share)


def _prefixes(name: Column) -> Column:
    """Every leading run of whole words of a name, as a rule would spell it."""
    words = F.split(name, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def name_rules(names_df: DataFrame, rules: DataFrame, auto: DataFrame | None = None) -> DataFrame:
    """Rule per distinct ``(park, name)``.

    A rule matches the whole name or the name up to a space, the first listed
    one winning. Exploding a name's own prefixes turns that into an equi-join;
    only distinct names are joined, never the rows that carry them.
    """
    base = names_df.select("park", "name").filter(F.length("name") > 0).distinct()
    hits = base.withColumn("prefix", F.explode(_prefixes(F.col("name")))).join(
        rules, F.col("prefix") == F.col("rule_name")
    )
    listed = hits.groupBy("park", "name").agg(F.min_by(F.struct("action", "rule_res", "why"), "ord").alias("rule"))
    out = base.join(listed, ["park", "name"], "left")
    if auto is not None:
        flagged = auto.select("park", F.col("scientific_name").alias("name"), F.lit(True).alias("auto"))
        derived = F.struct(
            F.lit("coarsen").alias("action"), F.lit(AUTO_RES).alias("rule_res"), F.lit("obscured by default").alias("why")
        )
        out = out.join(flagged, ["park", "name"], "left").withColumn(
            "rule", F.coalesce("rule", F.when(F.col("auto"), derived))
        )
    return out.filter(F.col("rule").isNotNull()).select("park", "name", "rule.action", "rule.rule_res", "rule.why")


def name_lookup(
    sightings: DataFrame, rules: DataFrame, synonyms: Mapping[str, str], min_share: float = AUTO_SENSITIVE_SHARE
) -> DataFrame:
    """Per distinct (park, raw name): the species and the rule it falls under.

    The rule of the canonical name comes first (listed, then derived from
    privacy flags), then the raw name's. One aggregation over the sightings
    yields both the names and their flagged share; everything after it works on
    that short table.
    """
    named = sightings.filter(F.col("scientific_name").isNotNull())
    return name_lookup_of(named.groupBy("park", "scientific_name").agg(*privacy_counts()), rules, synonyms, min_share)


def name_lookup_of(
    counts: DataFrame, rules: DataFrame, synonyms: Mapping[str, str], min_share: float = AUTO_SENSITIVE_SHARE
) -> DataFrame:
    """The same from counts per (park, scientific_name)."""
    stats = counts.select(
        "park", "scientific_name", F.coalesce(_share() >= min_share, F.lit(False)).alias("own_auto"),
        names.canonical_species(F.col("scientific_name"), synonyms).alias("species"),
    )
    same = F.when(F.col("scientific_name") == F.col("species"), F.col("own_auto"))
    stats = stats.withColumn("canon_auto", F.coalesce(F.bool_or(same).over(W.partitionBy("park", "species")), F.lit(False)))

    def tagged(kind: int, column: str) -> Column:
        return F.transform(_prefixes(F.col(column)), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("prefix")))

    spelled = stats.withColumn("t", F.explode(F.concat(tagged(0, "species"), tagged(2, "scientific_name"))))
    hit = F.struct(F.struct(F.col("t.kind").alias("kind"), F.col("ord")).alias("o"), F.struct("action", "rule_res", "why").alias("rule"))
    found = (
        spelled.join(rules, F.col("t.prefix") == F.col("rule_name"), "left")
        .groupBy("park", "scientific_name", "species", "own_auto", "canon_auto")
        .agg(F.min(F.when(F.col("rule_name").isNotNull(), hit)).alias("h"))
    )
    derived = F.struct(
        F.lit("coarsen").alias("action"), F.lit(AUTO_RES).alias("rule_res"), F.lit("obscured by default").alias("why")
    )
    rule = (
        F.when(F.col("h.o.kind") == 0, F.col("h.rule"))
        .when(F.col("canon_auto"), derived)
        .when(F.col("h.o.kind") == 2, F.col("h.rule"))
        .when(F.col("own_auto"), derived)
    )
    return found.withColumn("rule", rule).select(
        "park", "scientific_name", "species", "rule.action", "rule.rule_res", "rule.why"
    )


def apply_rules(
    sightings: DataFrame, everything: DataFrame, rules: DataFrame, synonyms: Mapping[str, str], counts: DataFrame | None = None
) -> DataFrame:
    """Add ``species``, ``action``, ``rule_res`` and ``why`` to ``sightings``.

    ``everything`` is the table the privacy share is taken over, unless
    ``counts`` has it already.
    """
    lookup = name_lookup(everything, rules, synonyms) if counts is None else name_lookup_of(counts, rules, synonyms)
    return sightings.join(lookup, ["park", "scientific_name"])
