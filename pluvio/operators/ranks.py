"""Global positions and running totals inside groups, without one task per group.

A group may hold a third of the data, so nothing here sorts a whole group at once. Quantile sketches, which combine on the
map side, give each group edges of its own in the type of its values; rows between two edges are counted, the
counts give offsets, and only what lies between two edges is sorted together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.scalars import as_col
from pluvio.session import null_safe_join, small_side

# Rows that one task sorts; larger groups of `number_rows` and `running_totals` are cut into buckets of about as many.
HOT_ROWS = 2_000_000


def bucket_of(value: str | Column, edges: str | Column, most: int = 1024) -> Column:
    """Number of edges below the value in a sorted array column of fewer than `most`: a binary search. A NULL value is in bucket 0."""
    v, table = as_col(value), as_col(edges)
    steps = F.lit([1 << k for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) < v, low + step).otherwise(low))


def _bucketed(df: DataFrame, by: Sequence[str], order: str, hot_rows: int, buckets: int) -> DataFrame | None:
    """`df` with `_b`, which keeps the order of `order` and splits groups above `hot_rows`; None when there are none.

    A group's number of buckets follows from its row count, up to `buckets`; there are at most rows / hot_rows such groups.
    """
    fractions = [i / buckets for i in range(1, buckets)]
    sketch = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(order, fractions, 4 * buckets).alias("_e"))
    every = F.greatest(F.floor(F.lit(buckets * hot_rows) / F.col("_n")), F.lit(1))
    hot = small_side(sketch.filter(F.col("_n") > hot_rows).select(*by, F.array_distinct(F.filter("_e", lambda e, i: i % every == 0)).alias("_e")))
    if hot.isEmpty():
        return None
    flagged = null_safe_join(df, hot, by, "left")
    return flagged.withColumn("_b", F.when(F.col("_e").isNotNull(), bucket_of(order, "_e", buckets)).otherwise(F.lit(0))).drop("_e")


def _before(sum_of: str, by: Sequence[str], order: Sequence) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(sum_of).over(w), F.lit(0))


def number_rows(df: DataFrame, by: Sequence[str], order: str, out: str = "row_idx",
                hot_rows: int = HOT_ROWS, buckets: int = 1024, ties: Sequence[str] = ()) -> DataFrame:
    """0-based position of every row inside its group by a number, date or timestamp column, then by `ties`.

    Other types are refused whatever the size of the table, and both ways of counting give the same positions. Give
    `ties` where `order` may repeat: rows that are equal in all these columns come in any order.

    Small groups are sorted as they are. Groups above `hot_rows` are cut into buckets first; their
    number is bounded by rows / hot_rows, so their list is small by construction.
    """
    by, kind = list(by), dict(df.dtypes)[order]
    if not kind.startswith(("timestamp", "date", "decimal")) and kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        raise TypeError(f"rows cannot be numbered by {order}, a {kind}")
    sort = [order, *ties]
    keyed = _bucketed(df, by, order, hot_rows, buckets)
    if keyed is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*sort)).cast("long") - 1)
    offsets = (keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
               .withColumn("_off", _before("_n", by, ["_b"])).drop("_n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*sort)).cast("long") - 1
    return (null_safe_join(keyed, offsets, [*by, "_b"])
            .withColumn(out, inside + F.col("_off")).drop("_b", "_off"))


def number_by_hash(df: DataFrame, by: Sequence[str], h: str, bucket: str | Column, out: str = "row_idx") -> DataFrame:
    """0-based position inside each class by a hash column. `bucket` must keep the order of the hash."""
    by = list(by)
    keyed = df.withColumn("_b", as_col(bucket))
    offsets = (keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
               .withColumn("_off", _before("_n", by, ["_b"])).drop("_n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(h)).cast("long") - 1
    return (null_safe_join(keyed, offsets, [*by, "_b"])
            .withColumn(out, inside + F.col("_off")).drop("_b", "_off"))


def values_at_ranks(df: DataFrame, by: Sequence[str], value: str | Column, bucket: str | Column,
                    ranks: Callable[[Column], Column] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Exact order statistics: one row per (group, tag) with the value at a 1-based rank.

    Targets come from `ranks(group_size)`, an array of struct(tag, rank), or from a table of the
    group columns, `tag` and `rank`. Two scans: one counts buckets, one reads only the rows whose
    bucket holds a target. Nothing else is shuffled.
    """
    by = list(by)
    keyed = df.select(*by, as_col(value).alias("_v"), as_col(bucket).alias("_b")).filter(F.col("_v").isNotNull())
    counted = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n")).withColumn("_low", _before("_n", by, ["_b"]))
    if targets is None:
        total = F.sum("_n").over(Window.partitionBy(*by))
        wanted = (counted.withColumn("_total", total).withColumn("_t", F.explode(ranks(F.col("_total"))))
                  .select(*by, "_b", "_n", "_low", F.col("_t.tag").alias("tag"), F.col("_t.rank").alias("rank")))
    else:
        wanted = null_safe_join(counted, targets, by)
    hit = small_side(wanted.filter((F.col("rank") > F.col("_low")) & (F.col("rank") <= F.col("_low") + F.col("_n")))
                     .select(*by, "_b", "tag", (F.col("rank") - F.col("_low")).alias("_k"), F.lit(1).alias("_one")))
    kept = null_safe_join(keyed, hit, [*by, "_b"], "left_semi")
    run = (kept.groupBy(*by, "_b", "_v").agg(F.count("*").alias("_n"))
           .withColumn("_low", _before("_n", [*by, "_b"], ["_v"])))
    return (null_safe_join(run, hit, [*by, "_b"])
            .filter((F.col("_k") > F.col("_low")) & (F.col("_k") <= F.col("_low") + F.col("_n")))
            .select(*by, "tag", F.col("_v").alias("value")))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """One row per (group, prob) with the linearly interpolated quantile; NULL values are skipped.

    A sketch of each group, right to one in `accuracy` of its rows, gives a span that surely holds each quantile: five times as
    wide on both sides. A second pass counts what lies between the spans and the values inside of them, both combined on the
    map side. Only one span's distinct values, about a thousandth of a group, are sorted together. Groups of at most
    `accuracy` rows have one span from the least value to the greatest.
    """
    by, ps, margin = list(by), [float(p) for p in probs], 5 / accuracy
    src = df.select(*by, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    wanted = sorted(set(ps))
    points = [0.0, *[max(0.0, p - margin) for p in wanted], *[min(1.0, p + margin) for p in wanted], 1.0]
    sketch = src.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", points, accuracy).alias("_e"))
    span = lambda lo, hi: F.struct(F.get("_e", F.lit(lo)).alias("lo"), F.get("_e", F.lit(hi)).alias("hi"))
    spans = F.when(F.col("_n") <= accuracy, F.array(span(0, len(points) - 1))).otherwise(F.array(*[span(1 + i, 1 + len(wanted) + i) for i in range(len(wanted))]))
    groups = small_side(sketch.select(*by, "_n", spans.alias("_s")))
    keyed = null_safe_join(src, groups, by)
    x = F.col("_x")
    cells = keyed.select(*by, "_n", F.size(F.filter("_s", lambda s: s["hi"] < x)).alias("_k"),
                         F.when(F.exists("_s", lambda s: (s["lo"] <= x) & (x <= s["hi"])), x).alias("_v"))
    # Before a span stands the count of what lies between it and the one below, with a NULL value.
    cells = cells.groupBy(*by, "_n", "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    offsets = cells.groupBy(*by, "_k").agg(F.sum("_c").alias("_t")).withColumn("_off", _before("_t", by, ["_k"])).drop("_t")
    upto = Window.partitionBy(*by, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = null_safe_join(cells, offsets, [*by, "_k"]).withColumn("_to", F.col("_off") + F.sum("_c").over(upto))

    def at(rank: Column) -> Column:
        found = F.max(F.when((rank <= F.col("_to")) & (rank > F.col("_to") - F.col("_c")), F.col("_v")))
        return F.coalesce(found, F.raise_error(F.lit("a quantile lies outside the span of its sketch")).cast("double"))

    out = []
    for p, (low, high, share) in zip(ps, _positions(F.col("_n"), ps)):
        below = at(low)
        out.append(F.struct(F.lit(p).alias("prob"), (below + (at(high) - below) * F.max(share)).alias("quantile")))
    return placed.groupBy(*by).agg(F.array(*out).alias("_q")).select(*by, F.inline("_q"))


def running_totals(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False,
                   hot_rows: int = HOT_ROWS, buckets: int = 1024) -> DataFrame:
    """Inclusive running sums inside each group by a column that is unique in the group."""
    by, sums = list(by), list(sums)
    arrow = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    upto = lambda keys: Window.partitionBy(*keys).orderBy(arrow(order)).rowsBetween(Window.unboundedPreceding, 0)
    keyed = _bucketed(df, by, order, hot_rows, buckets)
    if keyed is None:
        return df.withColumns({f"cum_{c}": F.sum(c).over(upto(by)) for c in sums})
    offsets = keyed.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_n_{c}") for c in sums])
    offsets = offsets.select(*by, "_b", *[_before(f"_n_{c}", by, [arrow("_b")]).alias(f"_off_{c}") for c in sums])
    return (null_safe_join(keyed, offsets, [*by, "_b"])
            .withColumns({f"cum_{c}": F.sum(c).over(upto([*by, "_b"])) + F.col(f"_off_{c}") for c in sums})
            .drop("_b", *[f"_off_{c}" for c in sums]))


def _positions(n: Column, probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """1-based ranks below and above every quantile position, and the fraction between them."""
    out = []
    for p in probs:
        pos = (n - 1) * F.lit(float(p))
        out.append((F.floor(pos) + 1, F.ceil(pos) + 1, pos - F.floor(pos)))
    return out
