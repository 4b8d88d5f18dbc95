"""Experiment rules: which rows take part and how classes are merged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions.scalars import literal_map, normalise_label

# Metadata columns that never are features.
METADATA = ["file_name", "timestamp", "period", "is_rain", "mm_5min", "mm_hr", "category", "recorder",
            "location", "file_path", "extension", "year", "month", "day", "hour", "minute", "second", "wet",
            "split", "should_augment", "copy_ordinal", "segment_idx", "offset_sec", "aug_params"]
# The published classes.
DRY = "no rain"
WET_CLASSES = ["light", "moderate", "heavy", "violent"]


def class_map(content: str, granularity: int) -> dict[str, str]:
    """Normalised label to experiment class."""
    wet_names = [c.title() for c in WET_CLASSES]
    pairs = ["Light/Moderate", "Light/Moderate", "Heavy/Violent", "Heavy/Violent"]
    top = ["Light", "Moderate", "Heavy/Violent", "Heavy/Violent"]
    kind = content.lower()
    if kind == "dry":
        return {DRY: "No Rain"}
    if kind == "wet":
        names = {2: pairs, 3: top}.get(granularity, wet_names)
        return dict(zip(WET_CLASSES, names))
    dry_name = "Dry" if granularity == 2 else "No Rain"
    names = {2: ["Wet"] * 4, 3: pairs, 4: top}.get(granularity, wet_names)
    return {DRY: dry_name, **dict(zip(WET_CLASSES, names))}


def normalise_text(label: str) -> str:
    return label.lower().replace("-", " ").replace("_", " ").strip()


def apply_rules(df: DataFrame, label: str = "category", content: str = "dry/wet", granularity: int = 5,
                custom: Mapping[str, str] | None = None, target: str = "target") -> DataFrame:
    """Filter by content and add the merged class; labels outside the map give NULL."""
    norm, kind = normalise_label(label), content.lower()
    if kind == "wet":
        df = df.filter(~norm.eqNullSafe(F.lit(DRY)))
    elif kind == "dry":
        df = df.filter(norm == DRY)
    mapping = {normalise_text(k): v for k, v in custom.items()} if custom else class_map(kind, granularity)
    return df.withColumn(target, literal_map(mapping, norm))


def label_quality(df: DataFrame, label: str = "category", target: str = "target", granularity: int = 5) -> DataFrame:
    """Per normalised label: rows, whether it is unmapped; plus the class count against the request."""
    per = df.groupBy(normalise_label(label).alias("label"), F.col(target).alias("target")).agg(F.count("*").alias("rows"))
    found = df.agg(F.countDistinct(target).alias("classes_found"))
    return (per.withColumn("unmapped", F.col("target").isNull())
            .withColumn("classes_found", found.scalar())
            .withColumn("fewer_than_requested", F.col("classes_found") < granularity))


def column_roles(columns: Sequence[str], label: str = "category", metadata: Sequence[str] = tuple(METADATA)) -> dict[str, list[str]]:
    """Split column names into features, target and metadata; absent metadata names are ignored."""
    meta = [c for c in metadata if c in columns]
    return {"metadata": meta, "target": [label], "features": [c for c in columns if c not in meta and c != label]}
