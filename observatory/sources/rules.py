"""Rule tables: validated on the driver, planned as small local relations.

They are configuration, a few dozen rows; a local relation carries its exact
size, so the planner broadcasts it below its own threshold and shuffles it
otherwise. No join below forces the choice.
"""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SUPPRESSION_DDL = "ord int, rule_name string, common string, action string, rule_res int, why string"

# The default suppression list and synonyms.
DEFAULT_SUPPRESSION = (
    {"name": "Canis lupus", "common": "gray wolf", "action": "exclude"},
    {"name": "Gulo gulo", "common": "wolverine", "action": "exclude"},
    {"name": "Lynx canadensis", "common": "Canada lynx", "action": "exclude"},
    {"name": "Ursus arctos", "common": "grizzly bear", "action": "coarsen", "res": 6},
    {"name": "Puma concolor", "common": "mountain lion", "action": "coarsen", "res": 6},
    {"name": "Haliaeetus leucocephalus", "common": "bald eagle", "action": "coarsen", "res": 6},
)
DEFAULT_SYNONYMS = {
    "Bos bison": "Bison bison",
    "Cervus elaphus": "Cervus canadensis",
    "Antigone canadensis": "Antigone canadensis",
}


def read_toml(path: str | Path) -> dict:
    with open(path, "rb") as fh:
        return tomllib.load(fh)


def suppression_rules(spark: SparkSession, rules: Sequence[Mapping] = DEFAULT_SUPPRESSION) -> DataFrame:
    """Ordered suppression rules (S20); a bad action or a coarsening without a resolution is refused."""
    rows = []
    for i, rule in enumerate(rules):
        if rule["action"] not in ("exclude", "coarsen"):
            raise ValueError(f"suppression {rule['name']}: action must be exclude or coarsen")
        if rule["action"] == "coarsen" and rule.get("res") is None:
            raise ValueError(f"suppression {rule['name']}: coarsen needs res")
        rows.append((i, rule["name"], rule.get("common", ""), rule["action"], rule.get("res"), rule.get("why", "")))
    return spark.createDataFrame(rows, SUPPRESSION_DDL)


def load_suppression(spark: SparkSession, path: str | Path) -> DataFrame:
    return suppression_rules(spark, read_toml(path).get("species", []))


def load_synonyms(path: str | Path) -> dict[str, str]:
    return dict(read_toml(path).get("synonyms", {}))


def _box(values: Sequence[float], owner: str) -> tuple[float, float, float, float]:
    if len(values) != 4:
        raise ValueError(f"{owner}: a box needs min_lon, min_lat, max_lon, max_lat")
    w, s, e, n = (float(v) for v in values)
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError(f"{owner}: bad box {values}")
    return w, s, e, n


def load_regions(spark: SparkSession, path: str | Path) -> DataFrame:
    """Parks or corridors: key, name, state, optional parent park, box."""
    rows = [
        (key, sec["name"], sec.get("state"), sec.get("park"), *_box(sec["bbox"], key))
        for key, sec in read_toml(path).items()
    ]
    return spark.createDataFrame(
        rows,
        "key string, name string, state string, park string, min_lon double, min_lat double, max_lon double, max_lat double",
    )


def load_tours(spark: SparkSession, path: str | Path) -> DataFrame:
    """Curated stops per park with their fallback coordinate and article title."""
    rows = []
    for key, sec in read_toml(path).items():
        fallback = sec.get("tour_fallback", {})
        for pos, stop in enumerate(sec.get("tour", ())):
            lon, lat = fallback.get(stop, (None, None))
            rows.append((key, pos, stop, lon, lat, fallback.get(f"{stop}@wiki")))
    return spark.createDataFrame(
        rows, "park string, pos int, stop string, fb_lon double, fb_lat double, article string"
    )
