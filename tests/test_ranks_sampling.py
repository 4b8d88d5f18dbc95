"""Bucket methods against plain ones, exact sizes, and independence of the partition count."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pluvio.functions.scalars import hash_bucket
from pluvio.operators import ranks as R
from pluvio.operators import sampling as B


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many tied values, some NULL."""
    rng = np.random.default_rng(1)
    n = 6000
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 40}", None if i % 97 == 0 else float(np.round(rng.exponential(3), 1 if i % 2 else 4)), float(i * 7919 % 100003))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v double, t double").repartition(7)


def test_number_rows_hot_path(skewed):
    want = skewed.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("t")) - 1)
    got = R.number_rows(skewed, ["g"], "t", "r", hot_rows=200, buckets=16)
    assert got.join(want.select("id", "w"), "id").filter("r <> w").isEmpty() and got.count() == 6000


def test_number_rows_by_timestamp(skewed):
    df = skewed.withColumn("ts", F.timestamp_seconds(F.col("t") / 10).cast("timestamp_ntz"))
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("ts")) - 1)
    got = R.number_rows(df, ["g"], "ts", "r", hot_rows=200, buckets=16)
    assert got.join(want.select("id", "w"), "id").filter("r <> w").isEmpty()


@pytest.mark.parametrize("hot_rows", [10**6, 100])
def test_quantiles(skewed, hot_rows):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in R.exact_quantiles(skewed, ["g"], "v", probs, hot_rows).collect()}
    pdf = skewed.dropna().toPandas()
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert math.isclose(got[g, p], np.quantile(part["v"], p), abs_tol=1e-12)
    assert len(got) == pdf["g"].nunique() * len(probs)


@pytest.mark.parametrize("hot_rows", [10**6, 100])
def test_running_totals(skewed, hot_rows):
    tied = skewed.dropna().groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r["g"], r["v"]): r["cum_n"] for r in R.running_totals(tied, ["g"], "v", ["n"], True, hot_rows).collect()}
    pdf = skewed.dropna().toPandas()
    for g, part in pdf.groupby("g"):
        for v in set(part["v"]):
            assert got[g, v] == (part["v"] >= v).sum()


def test_split_paths_agree_and_are_exact(skewed):
    a = B.split_dataset(skewed, ["id"], 0.1, 0.1, ["g"])
    b = B.split_dataset(skewed.repartition(3), ["id"], 0.1, 0.1, ["g"])
    assert a.select("id", "split").exceptAll(b.select("id", "split")).isEmpty()
    sizes = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sizes == {"test": 600, "val": 600, "train": 4800}
    per = a.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    assert per.filter(F.abs(F.col("t") - F.col("n") * 0.1) > 1).isEmpty()


def test_split_size_uses_float_order(spark):
    df = spark.range(63)
    sizes = {r["split"]: r["count"] for r in B.split_dataset(df, ["id"], 0.1, 0.1).groupBy("split").count().collect()}
    assert sizes == {"test": 7, "val": 7 if math.ceil(0.1 / (1.0 - 0.1) * 56) == 7 else 8, "train": 63 - 7 - math.ceil(0.1 / (1.0 - 0.1) * 56)}


def test_split_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, c string")
    with pytest.raises(ValueError):
        B.split_dataset(df, ["id"], 0.6, 0.4)
    with pytest.raises(ValueError):
        B.split_dataset(df.filter("id > 9"), ["id"])
    with pytest.raises(ValueError):
        B.split_dataset(df, ["id"], stratify=["c"])


def test_undersample(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b" if i < 30 else "c") for i in range(40)], "id int, c string")
    out = B.undersample_1_to_1(df, "c", ["a"], ["b"], ["id"])
    rows = out.collect()
    h = lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest()
    assert sorted(r["id"] for r in rows if r["c"] == "b") == sorted(sorted(range(5, 30), key=h)[:5])
    assert sum(r["c"] == "a" for r in rows) == 5 and len(rows) == 10
    assert B.undersample_1_to_1(df, "c", ["b"], ["a"], ["id"]).count() == 30
    none = B.undersample_1_to_1(df, "c", ["zzz"], ["a"], ["id"])
    assert none.count() == 0 and "c" in none.columns


def test_balance(spark):
    df = spark.createDataFrame([(i, "x" if i < 3 else "y" if i < 13 else "z") for i in range(50)], "id int, c string")
    out = B.balance_with_copies(df, "c", ["x", "y"], ["id"])
    assert {r["c"]: r["count"] for r in out.groupBy("c").count().collect()} == {"x": 10, "y": 10, "z": 37}
    assert out.filter("should_augment").groupBy("c").count().collect()[0]["count"] == 7
    assert out.filter("should_augment").select("copy_ordinal").distinct().count() == 7
    assert B.balance_with_copies(df, "c", ["z"], ["id"]).filter("should_augment").isEmpty()
    with pytest.raises(ValueError):
        B.balance_with_copies(df, "c", ["x", "nope"], ["id"])


def test_balance_chunks(spark, monkeypatch):
    monkeypatch.setattr(B, "COPY_CHUNK", 4)
    df = spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(40)], "id int, c string")
    out = B.balance_with_copies(df, "c", ["x", "y"], ["id"])
    assert out.filter("c = 'x'").count() == 37 and out.filter("should_augment").select("copy_ordinal").distinct().count() == 34


def test_one_per_class(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, c string")
    assert sorted(r["c"] for r in B.one_per_class(df, "c", ["id"]).collect()) == ["a", "b"]


def test_values_at_ranks_by_hash(skewed):
    from pluvio.functions.scalars import seeded_hash
    df = skewed.withColumn("h", seeded_hash(["id"], 1))
    got = R.values_at_ranks(df, ["g"], "h", hash_bucket("h"), ranks=lambda n: F.array(F.struct(F.lit("m").alias("tag"), F.ceil(n / 2).alias("rank"))))
    for r in got.collect()[:5]:
        hs = sorted(x["h"] for x in df.filter(F.col("g") == r["g"]).select("h").collect())
        assert r["value"] == hs[math.ceil(len(hs) / 2) - 1]


def test_numbering_by_any_ordered_type(spark):
    from pyspark.sql import functions as F

    from pluvio.operators.ranks import number_rows
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id"), (F.col("id") / 7).cast("decimal(12,4)").alias("d"),
                                 F.expr("date_add(date'2024-01-01', int(id / 4))").alias("day"), F.col("id").cast("string").alias("s"))
    for order in ("id", "d", "day"):
        few = number_rows(df, ["g"], order, "n", hot_rows=10**6, ties=["id"]).select("id", "n").collect()
        many = number_rows(df, ["g"], order, "n", hot_rows=20, buckets=16, ties=["id"]).select("id", "n").collect()
        assert sorted(few) == sorted(many)
    with pytest.raises(TypeError):
        number_rows(df, ["g"], "s")


def test_split_keeps_rows_of_a_key_together(spark):
    from pyspark.sql import functions as F

    from pluvio.operators.sampling import split_dataset
    df = spark.range(400).select((F.col("id") % 100).alias("k"), (F.col("id") % 2).alias("c"))
    out = split_dataset(df, ["k"], 0.2, 0.1, ["c"])
    assert out.count() == 400 and out.select("k", "split").distinct().count() == 100
