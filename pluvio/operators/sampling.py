"""Balancing and splitting with exact sizes and the same rows on any cluster.

Every random choice is the order of md5(key | seed). A sample is then a cut in that order, so rows
are kept by comparing their hash with a cut point per class: no row is ranked or shuffled for it.
The key columns must identify a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.scalars import hash_bucket, hash_int, hash_number, seeded_hash
from pluvio.operators.ranks import number_by_hash, values_at_ranks
from pluvio.session import null_safe_join, small_side

# Copies made by one explode; keeps a large deficit spread over many tasks.
COPY_CHUNK = 65_536


def shuffle_key(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Random order as a column; sort by it when a physical order is wanted on write."""
    return df.withColumn("shuffle_key", seeded_hash(list(key), seed))


def undersample_1_to_1(df: DataFrame, target: str, anchors: Sequence[str], pool: Sequence[str],
                       key: Sequence[str], seed: int = 42) -> DataFrame:
    """All anchor rows and as many pool rows; a smaller pool is taken whole, no anchors give no rows."""
    is_anchor, in_pool = F.col(target).isin(list(anchors)), F.col(target).isin(list(pool))
    counts = df.agg(F.count_if(is_anchor).alias("a"), F.count_if(in_pool).alias("p")).first()
    listed = shuffle_key(df.filter(is_anchor | in_pool), key, seed)
    if counts["a"] == 0:
        return listed.filter(F.lit(False))
    if counts["p"] <= counts["a"]:
        return listed
    limit = _cuts(listed.filter(in_pool), "shuffle_key", pool=counts["a"])["pool"]
    return listed.filter(is_anchor | (in_pool & (F.col("shuffle_key") <= limit)))


def _cuts(df: DataFrame, h: str, **ranks: int) -> dict[str, str]:
    """Hash at each named rank of the whole table; rank 0 has no entry."""
    wanted = F.array(*[F.struct(F.lit(n).alias("tag"), F.lit(r).cast("long").alias("rank")) for n, r in ranks.items()])
    return {r["tag"]: r["value"] for r in values_at_ranks(df, [], h, hash_bucket(h), ranks=lambda _: wanted).collect()}


def _allocate(strata: DataFrame, size: str, take: str, out: str) -> DataFrame:
    """Share `take` rows (a column, the same in every row) over strata by largest remainder on the complement.

    The kept share is rounded down per stratum, its missing rows go to the largest remainders, ties
    by stratum name; `out` is what is left of each stratum.
    """
    every = Window.partitionBy()
    total = F.sum(size).over(every)
    keep_total = total - F.col(take)
    exact = F.col(size) * keep_total / total
    out_df = strata.withColumn("_floor", F.floor(exact + F.lit(1e-9))).withColumn("_rest", F.round(exact - F.col("_floor"), 9))
    out_df = out_df.withColumn("_missing", keep_total - F.sum("_floor").over(every))
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col("_name")))
    return (out_df.withColumn("_kept", F.col("_floor") + F.when(rank <= F.col("_missing"), 1).otherwise(0))
            .withColumn(out, F.col(size) - F.col("_kept")).drop("_floor", "_rest", "_missing", "_kept"))


def split_sizes(strata: DataFrame, test_size: float, val_size: float, stratify: Sequence[str]) -> DataFrame:
    """Rows per stratum for test, validation and train from `stratify..., n`; global sizes are exact."""
    named = strata.withColumn("_name", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stratify]))
    every = Window.partitionBy()
    named = named.withColumn("_take", F.ceil(F.sum("n").over(every) * F.lit(float(test_size))))
    out = _allocate(named, "n", "_take", "n_test").withColumn("_left", F.col("n") - F.col("n_test"))
    if val_size > 0:
        out = out.withColumn("_take", F.ceil(F.lit(val_size / (1.0 - test_size)) * F.sum("_left").over(every)))
        out = _allocate(out, "_left", "_take", "n_val")
    else:
        out = out.withColumn("n_val", F.lit(0).cast("long"))
    return out.select(*stratify, "n", "n_test", "n_val", (F.col("n") - F.col("n_test") - F.col("n_val")).alias("n_train"))


def split_dataset(df: DataFrame, key: Sequence[str], test_size: float = 0.2, val_size: float = 0.0,
                  stratify: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Add `split` in {train, val, test}: in hash order test comes first, then validation, per stratum.

    Two cut hashes per stratum are found first and the rows are only compared with them, at any size. Rows
    that share a key share a hash and stay together.
    """
    if test_size + val_size >= 1.0:
        raise ValueError("test and validation shares must sum to less than 1")
    by, src = list(stratify), df
    if not by:
        return _split_whole(df, key, test_size, val_size, seed)
    strata = small_side(src.groupBy(*by).agg(F.count("*").alias("n")))
    facts = strata.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    if not facts["most"]:
        raise ValueError("cannot split an empty table")
    if facts["least"] < 2:
        raise ValueError("every stratum needs at least two rows")
    sizes = small_side(split_sizes(strata, test_size, val_size, by).select(*by, "n_test", "n_val"))
    hashed = src.withColumn("_h", seeded_hash(list(key), seed))
    targets = sizes.select(*by, F.explode(F.array(
        F.struct(F.lit("test").alias("tag"), F.col("n_test").alias("rank")),
        F.struct(F.lit("val").alias("tag"), (F.col("n_test") + F.col("n_val")).alias("rank")))).alias("t")).select(*by, "t.*")
    cuts = values_at_ranks(hashed, by, "_h", hash_bucket("_h"), targets=targets)
    pick = lambda tag: F.coalesce(F.max(F.when(F.col("tag") == tag, F.col("value"))), F.lit(""))
    wide = small_side(cuts.groupBy(*by).agg(pick("test").alias("_test"), pick("val").alias("_val")))
    out = null_safe_join(hashed, wide, by, "left")
    split = (F.when(F.col("_h") <= F.coalesce("_test", F.lit("")), "test")
             .when(F.col("_h") <= F.coalesce("_val", F.lit("")), "val").otherwise("train"))
    return out.withColumn("split", split).drop("_h", "_test", "_val")


def _split_whole(df: DataFrame, key: Sequence[str], test_size: float, val_size: float, seed: int) -> DataFrame:
    """Unstratified split: two cut hashes of the whole table, then a projection; no row is shuffled."""
    n = df.count()
    if n == 0:
        raise ValueError("cannot split an empty table")
    n_test = math.ceil(test_size * n)
    n_val = math.ceil(val_size / (1.0 - test_size) * (n - n_test)) if val_size > 0 else 0
    hashed = df.withColumn("_h", seeded_hash(list(key), seed))
    cuts = _cuts(hashed, "_h", test=n_test, val=n_test + n_val)
    split = (F.when(F.col("_h") <= cuts.get("test", ""), "test").when(F.col("_h") <= cuts.get("val", ""), "val").otherwise("train"))
    return hashed.withColumn("split", split).drop("_h")


def balance_with_copies(df: DataFrame, target: str, classes: Sequence[str], key: Sequence[str], seed: int = 42) -> DataFrame:
    """Raise every listed class to the largest one with flagged copies, drawn with replacement.

    Adds `should_augment` (false for originals) and `copy_ordinal` (0 for originals, then 1, 2, ...
    per class). Draw i of a class takes the original at hash position md5(class|i|seed) mod n.
    """
    counts = {r[0]: r[1] for r in df.filter(F.col(target).isin(list(classes))).groupBy(target).count().collect()}
    absent = [c for c in classes if c not in counts]
    if absent:
        raise ValueError(f"classes without rows: {absent}")
    n_max = max(counts.values())
    short = [(c, counts[c], n_max - counts[c]) for c in classes if counts[c] < n_max]
    base = df.withColumns({"should_augment": F.lit(False), "copy_ordinal": F.lit(0).cast("long")})
    if not short:
        return base
    spark = df.sparkSession
    chunks = spark.createDataFrame(short, f"{target} string, _n long, _deficit long").select(
        target, "_n", "_deficit", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_deficit - 1) div {COPY_CHUNK}"))).alias("_chunk"))
    first = F.col("_chunk") * COPY_CHUNK
    draws = (chunks.repartition(target, "_chunk")
             .withColumn("_i", F.explode(F.sequence(first, F.least(first + COPY_CHUNK - 1, F.col("_deficit") - 1))))
             .select(target, F.col("_i"), (hash_int(seeded_hash([target, "_i"], seed)) % F.col("_n")).alias("_pos")))
    originals = df.filter(F.col(target).isin([c for c, _, _ in short])).withColumn("_h", seeded_hash(list(key), seed))
    numbered = number_by_hash(originals, [target], "_h", hash_bucket("_h"), "_pos").drop("_h")
    copies = (numbered.join(draws, [target, "_pos"])
              .withColumns({"should_augment": F.lit(True), "copy_ordinal": F.col("_i") + 1}).select(*base.columns))
    return base.unionByName(copies)


def one_per_class(df: DataFrame, c: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """One random row per class, the one with the smallest hash. NULL classes are left out.

    The first pass reads class and key only and keeps a number per class, so nothing is sorted; the
    second pass compares every row with its class's number.
    """
    hashed = df.filter(F.col(c).isNotNull()).withColumn("_h", seeded_hash(list(key), seed))
    hashed = hashed.withColumn("_n", hash_number("_h"))
    least = small_side(hashed.groupBy(c).agg(F.min("_n").alias("_least")))
    first = hashed.join(least, c).filter("_n = _least")
    rest = [x for x in df.columns if x != c]
    return first.groupBy(c).agg(F.min_by(F.struct(*rest), "_h").alias("_r")).select(c, "_r.*").select(*df.columns)
