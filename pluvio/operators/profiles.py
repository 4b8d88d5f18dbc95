"""Summary tables behind the reports: compositions, month matrices, box statistics, result pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.scalars import finite_sql, safe_ratio
from pluvio.operators.ranks import exact_quantiles
from pluvio.session import null_safe_join, small_side


def dimension(df: DataFrame, values: Sequence[str], name: str) -> DataFrame:
    """Small ordered dimension from a fixed list; its size is the length of the list."""
    spark = df.sparkSession
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, ord int")


def class_counts(df: DataFrame, c: str) -> DataFrame:
    """NULL excluded. Order for display: count descending, then name."""
    return df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))


def composition(df: DataFrame, c: str, classes: Sequence[str]) -> DataFrame:
    """Count, share and percent over a fixed class list; absent classes show 0."""
    counts = class_counts(df.filter(F.col(c).isin(list(classes))), c)
    full = dimension(df, classes, c).join(counts, c, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy())
    return (full.withColumn("total", total).withColumn("share", safe_ratio("n", "total", F.lit(0.0)))
            .withColumn("percent", F.col("share") * 100))


def crosstab(df: DataFrame, row: str, c: str, classes: Sequence[str]) -> DataFrame:
    """Counts per row key and class with all classes as columns; empty cells are 0."""
    return df.groupBy(row).pivot(c, list(classes)).agg(F.count(F.lit(1))).fillna(0, subset=list(classes))


def _cells(df: DataFrame, row: str, c: str, classes: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c) == v).alias(v) for v in classes]


def quantity_matrix(df: DataFrame, row: str, c: str, classes: Sequence[str]) -> DataFrame:
    """Counts per row key and class, a `Row Total` column and a `TOTAL` row, from one rollup.

    The class list is fixed, so the cells are conditional counts that combine on the map side.
    """
    listed = df.filter(F.col(c).isin(list(classes)) & F.col(row).isNotNull())
    return (listed.rollup(row).agg(F.grouping(row).alias("is_total"), *_cells(df, row, c, classes),
                                   F.count("*").alias("Row Total"))
            .withColumn(row, F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col(row).cast("string"))))


def percent_matrix(df: DataFrame, row: str, c: str, classes: Sequence[str], digits: int = 4) -> DataFrame:
    """Row percents per class, the row's share of everything, and a `TOTAL %` row."""
    counts = quantity_matrix(df, row, c, classes)
    all_rows = F.max(F.when(F.col("is_total") == 1, F.col("Row Total"))).over(Window.partitionBy())
    cells = [F.round(safe_ratio(F.col(f"`{v}`") * 100, "Row Total"), digits).alias(v) for v in classes]
    return (counts.withColumn("_all", all_rows)
            .select(F.when(F.col("is_total") == 1, F.lit("TOTAL %")).otherwise(F.col(row)).alias(row), "is_total", *cells,
                    F.round(safe_ratio(F.col("Row Total") * 100, "_all"), digits).alias("Month/Total %")))


def majority_class(df: DataFrame, c: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Largest class and its size; ties go to the first name."""
    src = df.filter(F.col(c).isin(list(classes))) if classes else df
    counts = class_counts(src, c)
    best = F.min_by(F.struct(c, "n"), F.struct((-F.col("n")).alias("k"), F.col(c)))
    return counts.agg(best.alias("b")).select(F.col(f"b.{c}").alias("majority"), F.col("b.n").alias("n_max"))


def grid_counts(df: DataFrame, row: str, rows: Sequence[str], c: str, classes: Sequence[str]) -> DataFrame:
    """Counts for every combination of two fixed lists, zero included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(r, i, v) for i, r in enumerate(rows) for v in classes], f"{row} string, ord int, {c} string")
    counts = df.groupBy(row, c).agg(F.count("*").alias("n"))
    return grid.join(counts, [row, c], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def rare_event_share(df: DataFrame, amount: str, limit: float = 4.17) -> DataFrame:
    v = F.col(amount)
    return (df.agg(F.count(v).alias("total"), F.count_if(v >= limit).alias("n_rare"), F.max(v).alias("max_value"))
            .withColumn("percent_rare", safe_ratio(F.col("n_rare") * 100, "total")))


def long_features(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide to long after pruning to the needed columns; values as finite doubles or NULL."""
    pruned = df.selectExpr(*[f"`{c}`" for c in ids], *[f"{finite_sql(f)} as `{f}`" for f in features])
    return pruned.unpivot(list(ids), list(features), "feature", "value")


def box_stats(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5, approx: bool = False) -> DataFrame:
    """Quartiles, whiskers (last values inside `reach` interquartile ranges) and outlier counts per group.

    `approx=True` takes sketch quartiles in one pass instead of exact ones.
    """
    by = list(by)
    src = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    if approx:
        q = src.groupBy(*by).agg(F.percentile_approx("_x", [0.25, 0.5, 0.75], 10000).alias("_q")).select(
            *by, F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(2)).alias("q3"))
    else:
        named = {0.25: "q1", 0.5: "median", 0.75: "q3"}
        q = exact_quantiles(src, by, "_x", list(named)).groupBy(*by).agg(
            *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in named.items()])
    q = small_side(q.withColumn("_reach", (F.col("q3") - F.col("q1")) * reach))
    x = F.col("_x")
    inside = (x >= F.col("q1") - F.col("_reach")) & (x <= F.col("q3") + F.col("_reach"))
    return null_safe_join(src, q, by).groupBy(*by, "q1", "median", "q3").agg(
        F.count("*").alias("n"), F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def result_pivot(runs: DataFrame, row: str, column: str, values: Sequence[str], metric: str) -> DataFrame:
    """Row x column table of one metric; a doubled cell raises."""
    cell = F.when(F.count("*") > 1, F.raise_error(F.lit("duplicate cell in result pivot")).cast("double")).otherwise(F.max(metric))
    cells = runs.groupBy(row, column).agg(cell.alias("_m"))
    return cells.groupBy(row).pivot(column, list(values)).agg(F.max("_m"))


def domain_means(runs: DataFrame, domains: Sequence[str], metric: str) -> DataFrame:
    """Mean metric per algorithm and domain, and the gap between the first two domains."""
    wide = runs.groupBy("Algorithm").agg(*[F.avg(F.when(F.col("Domain") == d, F.col(metric))).alias(d) for d in domains])
    return wide.withColumn("gap", F.col(f"`{domains[0]}`") - F.col(f"`{domains[1]}`"))


def survivor_counts(reports: DataFrame, by: str = "granularity") -> DataFrame:
    return reports.groupBy(by).agg(F.sum("Survived_Pipeline").cast("long").alias("survivors"))


def split_summary(df: DataFrame, split: str, c: str) -> DataFrame:
    """Rows per split and class with subtotals, and the split's share rounded to 2 places."""
    rolled = df.rollup(split, c).agg(F.grouping(split).alias("g_split"), F.grouping(c).alias("g_class"), F.count("*").alias("n"))
    total = F.max(F.when(F.col("g_split") == 1, F.col("n"))).over(Window.partitionBy())
    return (rolled.withColumn("share", F.round(safe_ratio("n", total), 2))
            .withColumn(split, F.when(F.col("g_split") == 1, F.lit("ALL")).otherwise(F.col(split)))
            .withColumn(c, F.when(F.col("g_class") == 1, F.lit("ALL")).otherwise(F.col(c)))
            .select(split, c, "n", "share"))


def top_scores(scores: DataFrame, score: str, name: str, n: int = 20) -> DataFrame:
    """The report's best `n` rows; NULL scores are dropped, ties by name."""
    return scores.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), F.col(name)).limit(n)


def month_order(df: DataFrame, ts: str) -> DataFrame:
    """Distinct months present, in time order."""
    months = df.filter(F.col(ts).isNotNull()).select(F.trunc(ts, "MM").alias("month_key")).distinct()
    return months.withColumn("month_label", F.date_format("month_key", "MMM yyyy")).orderBy("month_key")


def month_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Fixed chronological month list; its size is set by the two dates."""
    spark = df.sparkSession
    one = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("month_key"))
    return one.withColumn("month_label", F.date_format("month_key", "MMM yyyy"))
