"""Scientific names, classifier labels, file names and observers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domestic species that never name a wild sighting, what an
# unnamed box is called, labels that are not animals, naming and keeping bars.
NOT_WILD = (
    "Bos taurus",
    "Canis familiaris",
    "Felis catus",
    "Equus caballus",
    "Ovis aries",
    "Capra hircus",
    "Sus scrofa",
)
UNIDENTIFIED_NAME = "Mammalia"
UNIDENTIFIED_COMMON = "unidentified large mammal (model)"
EXCLUDED_LABELS = ("human", "vehicle", "blank")
SPECIES_MIN_SCORE = 0.8
# A capitalised word, a lower-case word and at least one more.
SUBSPECIES = r"(?s)^\s*(\p{Lu}\S*)\s+([^\s\p{Lu}\p{Lt}]*\p{Ll}[^\s\p{Lu}\p{Lt}]*)\s+\S.*$"
LABEL_PARTS = ("uuid", "class", "order", "family", "genus", "species", "common_name")


def literal_map(values: Mapping[str, str]) -> Column:
    """A small constant lookup as a map literal."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonical_species(name: Column, synonyms: Mapping[str, str] | None = None) -> Column:
    """Collapse a subspecies to its first two words, then apply the synonyms."""
    base = F.regexp_replace(name, SUBSPECIES, "$1 $2")
    if synonyms:
        base = F.coalesce(F.try_element_at(literal_map(synonyms), base), base)
    return F.when(F.length(name) > 0, base)


def split_label(label: Column) -> Column:
    """A seven-part classifier label as a struct; anything else lands in ``raw``."""
    parts = F.split(label, ";")
    whole = F.size(parts) == len(LABEL_PARTS)
    unknown = whole & (F.get(parts, F.lit(1)) == "no cv result")
    raw = (
        F.when(label.isNull() | (label == ""), F.lit(""))
        .when(unknown, F.lit("unknown"))
        .when(~whole, label)
    )
    ok = whole & ~unknown
    fields = [F.when(ok, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(LABEL_PARTS)]
    return F.struct(raw.alias("raw"), *fields)


def display_name(label: Column) -> Column:
    """Common name, else the deepest named rank, else the label itself."""
    parts = split_label(label)
    ranked = [
        F.when(F.length(parts[rank]) > 0, F.concat(parts[rank], F.lit(f" ({rank})")))
        for rank in ("species", "genus", "family", "order", "class")
    ]
    common = F.when(F.length(parts["common_name"]) > 0, parts["common_name"])
    return F.coalesce(parts["raw"], common, *ranked, label)


def exclusion_name(label: Column) -> Column:
    """The name label exclusions are tested against."""
    parts = split_label(label)
    return F.coalesce(F.when(F.length(parts["raw"]) > 0, parts["raw"]), parts["common_name"], F.lit(""))


def is_excluded(label: Column, excluded: Sequence[str] = EXCLUDED_LABELS) -> Column:
    return exclusion_name(label).isin(*excluded)


def resolve_species(label: Column, score: Column, min_score: float = SPECIES_MIN_SCORE) -> Column:
    """``struct<scientific_name,common_name,taxon_rank>`` for a detection."""
    parts = split_label(label)
    sci = F.concat_ws(" ", capitalise(parts["genus"]), parts["species"])
    named = (
        parts["raw"].isNull()
        & (F.length(parts["species"]) > 0)
        & (F.coalesce(score, F.lit(0.0)) >= min_score)
        & ~sci.isin(*NOT_WILD)
    )
    return F.struct(
        F.when(named, sci).otherwise(UNIDENTIFIED_NAME).alias("scientific_name"),
        F.when(named, F.when(F.length(parts["common_name"]) > 0, parts["common_name"]))
        .otherwise(UNIDENTIFIED_COMMON)
        .alias("common_name"),
        F.when(named, F.lit("species")).otherwise(F.lit("class")).alias("taxon_rank"),
    )


def capitalise(text: Column) -> Column:
    """First letter upper, the rest lower, whatever spaces it holds."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def image_and_variant(path: Column) -> Column:
    """``<image>__<variant>.jpg`` to its two parts; whole frames are ``full``."""
    stem = file_stem(path)
    at = F.locate("__", stem)
    return F.struct(
        F.when(at > 0, F.substring_index(stem, "__", 1)).otherwise(stem).alias("image_id"),
        F.when(at > 0, stem.substr(at + 2, F.length(stem))).otherwise(F.lit("full")).alias("variant"),
    )


def variant_name(yaw: Column) -> Column:
    return F.concat(F.lit("yaw"), F.lpad(F.pmod(yaw.cast("int"), F.lit(360)).cast("string"), 3, "0"))


def variant_yaw(variant: Column) -> Column:
    return F.regexp_extract(variant, r"^yaw(\d+)$", 1).try_cast("double")


def observer_key(name: Column) -> Column:
    """Lower-case letters and digits only; empty when nothing is left."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "")


# The word that replaces a raw facility sub-kind.
DEFAULT_NAMES = {
    "camp_site": "Campsite",
    "caravan_site": "RV site",
    "viewpoint": "Viewpoint",
    "picnic_site": "Picnic site",
    "trailhead": "Trailhead",
    "slipway": "Boat launch",
    "marina": "Marina",
}
SUB_KIND_KEYS = ("natural", "tourism", "highway", "leisure", "amenity")


def sub_kind(tags: Column) -> Column:
    """First non-empty sub-kind tag, in the fixed key order."""
    return F.coalesce(*[F.nullif(F.try_element_at(tags, F.lit(k)), F.lit("")) for k in SUB_KIND_KEYS])


def default_name(tags: Column, kind: Column) -> Column:
    sub = F.coalesce(sub_kind(tags), kind)
    return F.coalesce(
        F.try_element_at(literal_map(DEFAULT_NAMES), sub), capitalise(F.replace(sub, F.lit("_"), F.lit(" ")))
    )
