"""Evaluation tables from predictions: confusion, per-class report, F1, average precision, run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.scalars import safe_ratio
from pluvio.operators.ranks import HOT_ROWS, running_totals
from pluvio.session import small_side, stage


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """`label, prediction, n`: the only pass over the predictions that the class metrics need."""
    return (df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
            .agg(F.count("*").alias("n")))


def confusion_matrix(df: DataFrame, classes: Sequence, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every (true, predicted) cell of a fixed class list, raw and as a share of its true class."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[label]
    grid = spark.createDataFrame([(a, i, b, j) for i, a in enumerate(classes) for j, b in enumerate(classes)],
                                 f"label {kind}, label_ord int, prediction {kind}, prediction_ord int")
    full = grid.join(confusion_counts(df, label, prediction), ["label", "prediction"], "left")
    full = full.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    row = F.sum("n").over(Window.partitionBy("label"))
    return full.withColumn("share", safe_ratio("n", row, F.lit(0.0)))


def class_metrics(counts: DataFrame) -> DataFrame:
    """`class, tp, predicted, support, precision, recall, f1` from confusion counts; 0/0 is 0."""
    hit = F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), hit.cast("long").alias("tp"), zero.alias("predicted"), F.col("n").alias("support")),
        F.struct(F.col("prediction").alias("class"), zero.alias("tp"), F.col("n").alias("predicted"), zero.alias("support")))).alias("s"))
    per = (sides.select("s.*").filter(F.col("class").isNotNull()).groupBy("class")
           .agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")]))
    nil = F.lit(0.0)
    return per.withColumns({
        "precision": safe_ratio("tp", "predicted", nil), "recall": safe_ratio("tp", "support", nil),
        "f1": safe_ratio(F.col("tp") * 2, F.col("predicted") + F.col("support"), nil)})


def _weighted(c: str) -> Column:
    return safe_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"), F.lit(0.0))


def f1_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Macro, micro and weighted precision, recall and F1, plus accuracy, in one row."""
    per = class_metrics(confusion_counts(df, label, prediction))
    nil = F.lit(0.0)
    return per.agg(
        F.avg("f1").alias("f1_macro"), _weighted("f1").alias("f1_weighted"),
        safe_ratio(F.sum("tp") * 2, F.sum("predicted") + F.sum("support"), nil).alias("f1_micro"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        _weighted("precision").alias("precision_weighted"), _weighted("recall").alias("recall_weighted"),
        safe_ratio(F.sum("tp"), F.sum("support"), nil).alias("accuracy"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class rows, then `accuracy`, `macro avg` and `weighted avg`."""
    per = class_metrics(confusion_counts(df, label, prediction))
    rows = per.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support", "tp")
    acc = safe_ratio(F.sum("tp"), F.sum("support"), F.lit(0.0))
    total = F.sum("support").alias("support")
    names = ("precision", "recall", "f1")
    tail = rows.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[acc.alias(n) for n in names], total),
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(n).alias(n) for n in names], total),
        F.struct(F.lit("weighted avg").alias("class"), *[_weighted(n).alias(n) for n in names], total)).alias("a"))
    return rows.drop("tp").unionByName(tail.select(F.inline("a")))


def score_rows(df: DataFrame, classes: Sequence, label: str, scores: Sequence[str | Column]) -> DataFrame:
    """Long one-vs-rest form `class, score, positive`, one row per row and class."""
    cells = [F.struct(F.lit(c).cast("string").alias("class"), (s if isinstance(s, Column) else F.col(s)).cast("double").alias("score"),
                      F.col(label).eqNullSafe(F.lit(c)).cast("int").alias("positive")) for c, s in zip(classes, scores)]
    return df.filter(F.col(label).isNotNull()).select(F.inline(F.array(*cells)))


def pr_curve(long: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Precision-recall points per class, one per distinct score, from high to low.

    Tied scores are grouped before anything is ordered, so a score shared by a third of all rows is one row.
    The grouped table is staged, because sizes, totals and running sums all read it.
    """
    tied = stage(long.groupBy("class", "score").agg(F.sum("positive").alias("pos"), F.count("*").alias("n")))
    run = running_totals(tied, ["class"], "score", ["pos", "n"], descending=True, hot_rows=hot_rows)
    totals = small_side(tied.groupBy("class").agg(F.sum("pos").alias("positives")))
    return run.join(totals, "class").withColumns({"precision": safe_ratio("cum_pos", "cum_n"), "recall": safe_ratio("cum_pos", "positives", F.lit(1.0))})


def average_precision(long: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`class, average_precision, support`: sum of recall steps times precision; no positives gives 0."""
    curve = pr_curve(long, hot_rows)
    step = safe_ratio("pos", "positives", F.lit(0.0)) * F.col("precision")
    return curve.groupBy("class").agg(F.sum(step).alias("average_precision"), F.max("positives").alias("support"))


def pr_auc_summary(df: DataFrame, classes: Sequence, label: str, scores: Sequence[str | Column],
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Macro, micro and weighted PR-AUC in one row. Two classes: only the second one counts."""
    pairs = list(zip(classes, scores))
    if len(pairs) == 2:
        pairs = pairs[1:]
    long = score_rows(df, [c for c, _ in pairs], label, [s for _, s in pairs])
    if len(pairs) == 1:
        one = average_precision(long, hot_rows)
        return one.select(*[F.col("average_precision").alias(f"pr_auc_{a}") for a in ("macro", "micro", "weighted")])
    both = long.select(F.explode(F.array(F.concat(F.lit("c:"), F.col("class")), F.lit("all"))).alias("class"), "score", "positive")
    ap, single = average_precision(both, hot_rows), F.col("class") != "all"
    weight = F.when(single, F.col("support"))
    return ap.agg(F.avg(F.when(single, F.col("average_precision"))).alias("pr_auc_macro"),
                  F.max(F.when(~single, F.col("average_precision"))).alias("pr_auc_micro"),
                  safe_ratio(F.sum(F.col("average_precision") * weight), F.sum(weight), F.lit(0.0)).alias("pr_auc_weighted"))


def thinned_curve(curve: DataFrame, buckets: int = 100) -> DataFrame:
    """Curve for display: the last point of each recall bucket per class."""
    slot = F.floor(F.col("recall") * buckets)
    return (curve.groupBy("class", slot.alias("slot"))
            .agg(F.max_by(F.struct("score", "precision", "recall"), F.col("cum_n")).alias("p")).select("class", "slot", "p.*"))


def run_row(summary: DataFrame, algorithm: str, content: str, granularity: str, domain: str, average: str = "macro") -> DataFrame:
    """One run-log row from a one-row summary; absent metrics are NULL."""
    def pick(prefix: str) -> Column:
        name = f"{prefix}{average}"
        return (F.col(name) if name in summary.columns else F.lit(None)).cast("double")
    return summary.select(F.lit(algorithm.upper()).alias("Algorithm"), F.lit(content).alias("Content"),
                          F.lit(granularity).alias("Granularity"), F.lit(domain).alias("Domain"),
                          F.lit(average).alias("average"), pick("f1_").alias("f1_macro"), pick("pr_auc_").alias("pr_auc_macro"))


def append_run(row: DataFrame, path: str) -> DataFrame:
    """Append to the run log and return the log."""
    row.write.mode("append").parquet(path)
    return row.sparkSession.read.schema(row.schema).parquet(path)


def result_sheet(df: DataFrame, classes: Sequence, label: str, prediction: str, scores: Sequence[str | Column],
                 dry: str, algorithm: str, params: str, features: str) -> DataFrame:
    """One wide row per run: global scores, dry and wet F1, and four scores per class.

    Fixed values: the column names are those of the published sheets.
    """
    per = class_metrics(confusion_counts(df, label, prediction)).withColumn("class", F.col("class").cast("string"))
    ap = average_precision(score_rows(df, classes, label, scores)).select("class", "average_precision")
    known = df.sparkSession.createDataFrame([(str(c),) for c in classes], "class string")
    rows = known.join(per, "class", "left").join(ap, "class", "left").fillna(0)
    at = lambda c, m: F.max(F.when(F.col("class") == str(c), F.col(m)))
    wet = F.avg(F.when(F.col("class") != str(dry), F.col("f1")))
    cells = [at(c, m).alias(f"{c}_{n}") for c in classes
             for m, n in (("f1", "F1"), ("precision", "Precision"), ("recall", "Recall"), ("average_precision", "PR_AUC"))]
    return rows.agg(F.avg("f1").alias("F1_Macro_Global"), at(dry, "f1").alias("F1_Dry"), wet.alias("F1_Macro_Wet"),
                    F.avg("precision").alias("Precision_Macro"), F.avg("recall").alias("Recall_Macro"),
                    safe_ratio(F.sum("tp"), F.sum("support"), F.lit(0.0)).alias("Accuracy"),
                    F.avg("average_precision").alias("PR_AUC_Macro"), *cells).select(
        F.lit(algorithm).alias("Algoritmo"), "*", F.lit(params).alias("Hiperparametros"), F.lit(features).alias("Lista_Features"))
