"""The curation job: recordings and ground truth to a labelled, balanced, split table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from pluvio.operators.curation import discard, extract_filename_metadata, merge_labels, sanitise
from pluvio.operators.sampling import split_dataset, undersample_1_to_1
from pluvio.sources.tables import save_checkpoint, write_splits

# The rules of the published chain, as Spark SQL.
DISCARD_RULES = ["category = 'unlabeled'", "category is null or mm_5min is null or mm_hr is null",
                 "wet = true and mm_5min = 0", "wet = false and mm_5min > 0"]


@dataclass(frozen=True)
class CurationConfig:
    """Settings of one curation run; `key` must identify a recording."""

    pattern: str
    renames: dict[str, str] | None = None
    no_overwrite: Sequence[str] = ("period",)
    rules: Sequence[str] = tuple(DISCARD_RULES)
    anchors: Sequence[str] = ("light", "moderate", "heavy", "violent")
    pool: Sequence[str] = ("no-rain",)
    key: Sequence[str] = ("file_path",)
    test_size: float = 0.1
    val_size: float = 0.1
    stratify: Sequence[str] = ("category",)
    seed: int = 42
    label_ordinal: str | None = None
    balance: bool = field(default=True)


def merged_table(inventory: DataFrame, labels: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Inventory with file-name metadata and ground truth, cleaned."""
    return (inventory.transform(extract_filename_metadata, cfg.pattern)
            .transform(merge_labels, labels, renames=cfg.renames, no_overwrite=cfg.no_overwrite, ordinal=cfg.label_ordinal)
            .transform(sanitise))


def curate(inventory: DataFrame, labels: DataFrame, cfg: CurationConfig, work_dir: str) -> DataFrame:
    """Write the merged, curated and split tables below `work_dir`; returns the split table.

    Each stage is stored once and read back, because the later stages read it more than once.
    """
    root = work_dir.rstrip("/")
    merged = merged_table(inventory, labels, cfg).transform(save_checkpoint, f"{root}/merged")
    curated = discard(merged, cfg.rules).transform(save_checkpoint, f"{root}/curated")
    balanced = curated
    if cfg.balance:
        balanced = undersample_1_to_1(curated, "category", cfg.anchors, cfg.pool, cfg.key, cfg.seed)
        balanced = balanced.transform(save_checkpoint, f"{root}/balanced")
    split = split_dataset(balanced, cfg.key, cfg.test_size, cfg.val_size, cfg.stratify, cfg.seed)
    write_splits(split, f"{root}/splits", "overwrite")
    return split.sparkSession.read.parquet(f"{root}/splits")
