"""Names and facts in free text: matching, grounding, answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.functions import geo, stats, text
from observatory.operators import ranking

# Words that do not pick a species on their own; the fact cap.
GENERIC_WORDS = (
    "american", "common", "northern", "western", "eastern", "southern", "great", "greater", "lesser", "little",
    "mountain", "rocky", "north", "canada", "canadian", "grey", "gray", "red", "white", "black", "brown", "yellow",
    "blue", "golden", "ground", "tree", "rock", "sage", "spotted", "striped", "long", "short", "tailed", "eared",
    "headed", "billed", "winged", "the", "of", "and",
)
MAX_FACTS = 28


def _species_names(species: DataFrame) -> DataFrame:
    """One row per (species, normalised name) that may match.

    ``species``: species, common_name, other_names, action, sightings.
    """
    every = F.array_compact(F.concat(F.array("common_name"), F.coalesce("other_names", F.array()), F.array("species")))
    return (
        species.filter(~F.col("action").eqNullSafe("exclude"))
        .select("species", "sightings", F.explode(F.array_distinct(F.transform(every, text.norm_words))).alias("nn"))
        .filter(F.length("nn") > 0)
    )


def match_species(questions: DataFrame, species: DataFrame, k: int = 3) -> DataFrame:
    """Species each question names, best first.

    Scores: 3 for a whole name, 2.5 or 2 when all its distinctive words are
    present, 1 for an unambiguous last word when nothing else matched.

    No question meets a name it cannot match. Candidates come from equi-joins
    on words: each name is filed under its longest word, the corpus vocabulary
    (distinct words, not rows) finds which words hold it, and questions follow
    their words. A whole name may start or end inside a question's word, so a
    filed word is looked up among the pieces of each vocabulary word.

    ``questions``: qid, text. Output: qid, species, score, rank.
    """
    named = _species_names(species)
    q = questions.select("qid", text.norm_words(F.col("text")).alias("q"))
    words = q.select("qid", F.explode(F.array_distinct(F.split("q", " "))).alias("w")).filter(F.length("w") > 0)
    vocab = words.select("w").distinct()

    parts = F.split("nn", " ")
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), -1)["p"]
    generic = F.array(*[F.lit(g) for g in GENERIC_WORDS])
    names_ = named.withColumn("anchor", longest).withColumn("words", parts).withColumn(
        "distinctive", F.array_except(parts, generic)
    )

    # Pieces of a vocabulary word no longer than the longest anchor, so a word of
    # any length yields a number of pieces linear in its length.
    anchors = names_.select("anchor").distinct()
    n = F.length("w")
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.col("_longest"))), lambda m: F.col("w").substr(i, m)),
            )
        )
    )
    sized = vocab.withColumn("_longest", anchors.agg(F.coalesce(F.max(F.length("anchor")), F.lit(1))).scalar())
    holders = sized.select("w", F.explode(pieces).alias("anchor")).join(anchors, "anchor")
    cand = words.join(holders, "w").select("qid", "anchor").distinct()
    whole = (
        cand.join(names_.select("anchor", "nn", "species"), "anchor")
        .join(q, "qid")
        .filter(F.contains("q", F.col("nn")))
        .select("qid", "species", F.lit(3.0).alias("score"))
    )

    # distinctive words: every one must be among the question's words or their singulars
    forms = vocab.select("w", F.explode(F.array_distinct(F.array(F.col("w"), text.singular(F.col("w"))))).alias("form"))
    asked = words.join(forms, "w").select("qid", "form").distinct()
    wanted = names_.filter(F.size("distinctive") > 0).select(
        "species", "nn", F.size("distinctive").alias("need"),
        (F.size("distinctive") == F.size(F.array_distinct("words"))).alias("pure"), F.explode("distinctive").alias("form"),
    )
    partial = (
        asked.join(wanted, "form")
        .groupBy("qid", "species", "nn", "need", "pure")
        .agg(F.count("*").alias("got"))
        .filter(F.col("got") == F.col("need"))
        .select("qid", "species", F.when(F.col("pure"), 2.5).otherwise(2.0).alias("score"))
    )
    scored = whole.unionByName(partial).groupBy("qid", "species").agg(F.max("score").alias("score"))

    # a last word alone counts when only one species carries it
    last = F.get(F.split("nn", " "), F.size(F.split("nn", " ")) - 1)
    common = species.filter(~F.col("action").eqNullSafe("exclude") & (F.length("common_name") > 0)).select(
        "species", text.norm_words(F.col("common_name")).alias("nn")
    )
    lone = (
        common.select("species", last.alias("form"))
        .filter(F.length("form") > 0)
        .groupBy("form")
        .agg(F.count("*").alias("carriers"), F.min("species").alias("species"))
        .filter(F.col("carriers") == 1)
    )
    unmatched = asked.join(scored.select("qid").distinct(), "qid", "left_anti")
    fallback = unmatched.join(lone.select("form", "species"), "form").select("qid", "species", F.lit(1.0).alias("score")).distinct()
    ranked = scored.unionByName(fallback).join(species.select("species", "sightings"), "species")
    return ranking.top_k(
        ranked, ["qid"], [F.desc("score"), F.desc("sightings"), F.asc("species")], k, "rank"
    ).select("qid", "species", "score", "rank")


def question_intents(questions: DataFrame) -> DataFrame:
    """Intents and month of each question."""
    return questions.select(
        "qid", text.intents(F.col("text")).alias("intents"), text.month_mentioned(F.col("text")).alias("month")
    )


def number_facts(facts: DataFrame, cap: int = MAX_FACTS) -> DataFrame:
    """The first facts of each question, numbered in insertion order."""
    return ranking.top_k(facts, ["qid"], [F.asc("ord"), F.asc("fact")], cap, "n")


def park_fact(facts: DataFrame) -> DataFrame:
    """Park summary sentence from ``rollups.park_facts``."""
    share = text.half_up(F.col("summer_share") * 100).cast("string")
    line = F.concat(
        F.col("park"), F.lit(": "), F.format_number("sightings", 0), F.lit(" recorded sightings of "),
        F.col("species").cast("string"), F.lit(" species; "), share, F.lit("% fall in June to August."),
    )
    return facts.select("park", line.alias("fact"))


def species_fact(relative: DataFrame) -> DataFrame:
    """One sentence per species: counts, years, busiest month and when it is seen more than usual."""
    names_ = F.array(*[F.lit(m) for m in stats.MONTH_NAMES])
    busiest = F.get(names_, F.array_position("months", F.array_max("months")) - 1)
    more = F.when(
        F.col("rel_max") > 0,
        F.concat(F.lit("; seen "), F.format_string("%.1f", "rel_max"), F.lit("x more than usual in "), F.get(names_, F.col("rel_peak") - 1)),
    )
    line = F.concat(
        F.coalesce("common_name", "species"), F.lit(" ("), F.col("species"), F.lit("): "), F.format_number("sightings", 0),
        F.lit(" sightings, "), F.format_number("human_verified", 0), F.lit(" verified by people and "),
        F.col("model_predicted").cast("string"), F.lit(" model-predicted, recorded "), F.year("first_on").cast("string"),
        F.lit(" to "), F.year("last_on").cast("string"), F.lit("; busiest month "), busiest, F.coalesce(more, F.lit("")), F.lit("."),
    )
    return relative.select("park", "species", line.alias("fact"))


def name_hotspots(hotspots: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Busiest cells named by their nearest landmark.

    ``hotspots`` are at most a few per species, already ranked.
    """
    from observatory.operators.spatial import nearest

    keyed = hotspots.withColumn("key", F.concat_ws("|", "park", "species", F.col("cell").cast("string")))

    def haversine(a: Column, b: Column, c: Column, d: Column) -> Column:
        return geo.haversine_m(a, b, c, d, geo.SPHERE_RADIUS_M)

    near = nearest(keyed, landmarks, "key", "id", start_m=1000.0, distance=haversine)
    named = near.join(landmarks.select("id", "name"), "id")
    return keyed.join(named, "key", "left").select(
        "park", "species", "cell", "count", "rank", F.col("name").alias("landmark"), "dist_m"
    )


def check_answers(answers: DataFrame) -> DataFrame:
    """Citations, stray numbers and refusals of answers.

    ``answers``: qid, answer, fact_text, fact_count, ms.
    """
    return answers.select(
        "qid",
        text.cited_facts(F.col("answer"), F.col("fact_count")).alias("cited"),
        F.col("fact_count").alias("facts"),
        text.uncited_numbers(F.col("answer"), F.col("fact_text")).alias("uncited_numbers"),
        text.declines(F.col("answer")).alias("says_no_data"),
        "ms",
    )
