"""Model fitting on the embedding vectors, with the published settings.

SQL cannot fit a model, so each query returns facts about a fit that SQL can state: how many rows each class has in the test part,
and whether the scores, the losses or the gradient are what the method promises.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pluvio.operators import models as M
from pluvio.operators.profiles import top_scores
from pluvio.operators.sampling import split_dataset
from pluvio.operators.selection import forest_importances
from pluvio.queries.base import Registry, table
from pluvio.queries.sampling import _split_sql

REG = Registry()

# The published settings; all others are the defaults of the kinds. The rounds of `xgb` and the steps and folds of
# `nusvc` are fewer here than the defaults, since each is a job of its own: the README gives the times.
SPECS = {"lr": {"C": 1.0}, "sgd": {"alpha": 0.001, "penalty": "l2"}, "rf": {"n_estimators": 100, "max_depth": 10},
         "xgb": {"max_depth": 5, "learning_rate": 0.1, "n_estimators": 10}, "nusvc": {"max_iter": 20, "folds": 2}}
SPLIT = _split_sql(["label"], 0.2, 0.2, "embeddings", "vec_id")


def parts(spark, sf):
    emb = split_dataset(table(spark, sf, "embeddings"), ["vec_id"], 0.2, 0.2, ["label"])
    return {name: emb.filter(F.col("split") == name) for name in ("train", "val", "test")}


def fitted(kind, p, validation=None, **more):
    return M.fit_classifier(M.Classifier(kind, {**SPECS[kind], **more}), p["train"], "embedding", "label", validation)


def logistic_gradient(model: M.FittedClassifier, train, strength: float) -> float:
    """Largest entry of the gradient of the penalised weighted log-loss at the fitted coefficients."""
    known = M.with_class_weights(train.withColumn("label", F.col("label").cast("string")), "label")
    known = model.predict(known).withColumn("k", F.array_position(F.lit(model.classes), F.col("label")) - 1)
    gap = [F.col("weight") * (F.get("scores", F.lit(k)) - (F.col("k") == k).cast("double")) for k in range(len(model.classes))]
    cells = known.select("weight", *[g.alias(f"g{k}") for k, g in enumerate(gap)], F.posexplode("embedding").alias("j", "x"))
    sums = cells.groupBy("j").agg(F.sum("weight").alias("w"), *[F.sum(F.col(f"g{k}") * F.col("x")).alias(f"s{k}") for k in range(len(gap))]).collect()
    coefficients = model.model.coefficientMatrix.toArray()
    reg = 1.0 / (strength * train.count())
    return max(abs(r[f"s{k}"] / r["w"] + reg * coefficients[k, r["j"]]) for r in sums for k in range(len(gap)))


def facts(model: M.FittedClassifier, test, **more):
    """Rows per class, and whether the scores are chances whose largest is the predicted class."""
    out = model.predict(test.withColumn("label", F.col("label").cast("string")))
    best = F.get(F.lit(model.classes), (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, b: a + b)
    return out.groupBy("label").agg(F.count("*").alias("rows"), F.bool_and(F.col("prediction") == best).alias("argmax"),
                                    F.bool_and((F.abs(total - 1) < 1e-9) & (F.array_min("scores") >= 0)).alias("chances")).withColumns({n: F.lit(bool(v)) for n, v in more.items()})


def facts_sql(*more):
    also = "".join(f", true AS {m}" for m in more)
    return f"SELECT CAST(label AS VARCHAR) AS label, count(*) AS rows, true AS argmax, true AS chances{also} FROM ({SPLIT}) WHERE split = 'test' GROUP BY 1"


@REG.add("predict_lr", facts_sql("optimal"))
def _(spark, sf):
    p = parts(spark, sf)
    model = fitted("lr", p)
    return facts(model, p["test"], optimal=logistic_gradient(model, p["train"], 1.0) < 1e-3)


@REG.add("predict_sgd", facts_sql())
def _(spark, sf):
    p = parts(spark, sf)
    return facts(fitted("sgd", p), p["test"])


@REG.add("predict_rf", facts_sql("all_trees"))
def _(spark, sf):
    p = parts(spark, sf)
    model = fitted("rf", p)
    return facts(model, p["test"], all_trees=model.model.getNumTrees == 100 and max(t.depth for t in model.model.trees) <= 10)


@REG.add("predict_xgb", facts_sql("falling", "all_rounds"))
def _(spark, sf):
    p = parts(spark, sf)
    model = fitted("xgb", p)
    loss = np.array(model.model.train_loss)
    return facts(model, p["test"], falling=(np.diff(loss) < 0).all() and loss[0] < np.log(len(model.classes)), all_rounds=len(model.model.rounds) == 10 == len(loss))


@REG.add("predict_nusvc", facts_sql("calibrated"))
def _(spark, sf):
    p = parts(spark, sf)
    model = fitted("nusvc", p).model
    return facts(M.FittedClassifier(model, sorted({str(r["label"]) for r in p["train"].select("label").distinct().collect()}), "embedding"), p["test"],
                 calibrated=np.abs(model.gradient).max() < 1e-4)


@REG.add("evaluate_forest", f"SELECT count(*) AS rows, true AS same_accuracy, true AS in_range FROM ({SPLIT}) WHERE split = 'test'")
def _(spark, sf):
    p = parts(spark, sf)
    model = fitted("rf", p)
    row = M.evaluate(model, p["test"], "label").first().asDict()
    out = model.predict(p["test"].withColumn("label", F.col("label").cast("string")))
    inside = all(0 <= v <= 1 for v in row.values())
    return out.agg(F.count("*").alias("rows"), (F.abs(F.avg((F.col("prediction") == F.col("label")).cast("double")) - row["accuracy"]) < 1e-12).alias("same_accuracy")).withColumn("in_range", F.lit(inside))


@REG.add("tune_on_validation_set", "SELECT * FROM (VALUES ('xgb', 2, 1, true, true), ('lr', 2, 1, true, true)) t(kind, points, champions, best, bounded), (SELECT count(*) AS watched FROM (" + SPLIT + ") WHERE split = 'val')")
def _(spark, sf):
    """Two grids on the validation part. Boosted trees watch it and keep the rounds after which its loss was least."""
    p = parts(spark, sf)
    rows = []
    for kind, grid in (("lr", {"C": [0.1, 1.0]}), ("xgb", {"learning_rate": [0.1, 0.3]})):
        few = {"n_estimators": 5} if kind == "xgb" else {}
        best = M.tune(M.Classifier(kind, {**SPECS[kind], **few}), grid, p["train"], p["val"], "embedding", "label")
        scores = [s for _, s in best.grid]
        model = best.champion.model
        kept = kind == "lr" or len(model.rounds) == int(np.argmin(model.validation_loss)) + 1 <= 5
        rows.append((kind, len(scores), sum(point == best.best_params for point, _ in best.grid), best.best_score == max(scores), bool(kept), p["val"].count()))
    return spark.createDataFrame(rows, "kind string, points int, champions int, best boolean, bounded boolean, watched long")


@REG.add("forest_importance_top", f"SELECT least(20, max(len(embedding))) AS n, max(len(embedding)) AS features, true AS falling, true AS sums_to_one, true AS kept_from_mean FROM embeddings")
def _(spark, sf):
    p = parts(spark, sf)
    every = forest_importances(fitted("rf", p).model, [f"e{i:02d}" for i in range(64)], spark)
    rows, best = every.collect(), [r["importance"] for r in top_scores(every, "importance", "feature", 20).collect()]
    mean = sum(r["importance"] for r in rows) / len(rows)
    return spark.createDataFrame([(len(best), len(rows), best == sorted((r["importance"] for r in rows), reverse=True)[:20], abs(mean * len(rows) - 1) < 1e-9,
                                   all(r["kept"] == (r["importance"] >= mean) for r in rows))], "n int, features int, falling boolean, sums_to_one boolean, kept_from_mean boolean")
