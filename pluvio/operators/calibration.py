"""Probabilities from the margins of linear classifiers: one sigmoid per class, fitted on held-out folds."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.session import stage

STEPS = [0.5 ** i for i in range(12)]  # lengths of a Newton step that are tried in one job
MAX_ROUNDS, TOLERANCE = 100, 1e-5


def sigmoid_cost(margin: Column, target: Column, a: Column, b: Column) -> Column:
    """Cross entropy of 1 / (1 + exp(a * margin + b)) and a target, without overflow."""
    z = a * margin + b
    return target * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def fit_sigmoids(margins: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) and the last gradients for each class, by Newton steps whose sums Spark adds up.

    `margins` has `k, margin, positive` (0 or 1). Targets are (n+ + 1) / (n+ + 2) and 1 / (n- + 2), so that classes that can be
    parted have a finite fit. All classes take their steps side by side: two jobs a round.
    """
    sizes = {r["k"]: (r["p"], r["n"]) for r in margins.groupBy("k").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("n")).collect()}
    plus, minus = (np.array([sizes.get(k, (0, 0))[i] for k in range(classes)], dtype=np.float64) for i in (0, 1))
    fit = np.stack([np.zeros(classes), np.log((minus + 1) / (plus + 1))])
    of = lambda values: F.get(F.lit([float(v) for v in values]), F.col("k"))
    rows = margins.withColumn("t", F.when(F.col("positive") == 1, of((plus + 1) / (plus + 2))).otherwise(of(1 / (minus + 2))))
    gradient, moving = np.full((2, classes), np.inf), np.array([k in sizes for k in range(classes)])
    for _ in range(MAX_ROUNDS):
        z = of(fit[0]) * F.col("margin") + of(fit[1])
        p = 1 / (1 + F.exp(z))
        gap, spread, f = F.col("t") - p, p * (1 - p), F.col("margin")
        sums = {r["k"]: r for r in rows.groupBy("k").agg(F.sum(gap * f).alias("g0"), F.sum(gap).alias("g1"), F.sum(spread * f * f).alias("h00"),
                                                          F.sum(spread * f).alias("h01"), F.sum(spread).alias("h11")).collect()}
        step = np.zeros((2, classes))
        for k, r in sums.items():
            gradient[:, k] = r["g0"], r["g1"]
            h = np.array([[r["h00"] + 1e-12, r["h01"]], [r["h01"], r["h11"] + 1e-12]])
            step[:, k] = -np.linalg.solve(h, gradient[:, k]) if moving[k] else 0.0
        moving &= np.abs(gradient).max(0) > TOLERANCE
        if not moving.any():
            break
        costs = [F.sum(sigmoid_cost(f, F.col("t"), of(fit[0] + s * step[0]), of(fit[1] + s * step[1]))).alias(f"c{i}") for i, s in enumerate([0.0, *STEPS])]
        for r in rows.groupBy("k").agg(*costs).collect():
            k = r["k"]
            slope = float(gradient[:, k] @ step[:, k])
            good = next((s for i, s in enumerate(STEPS, 1) if r[f"c{i}"] < r["c0"] + 1e-4 * s * slope), 0.0)
            fit[:, k] += good * step[:, k]
            moving[k] &= good > 0
    return fit, gradient


@dataclass(frozen=True)
class CalibratedModel:
    """The margins of a fitted model, and the sigmoid of each class; `gradient` is what was left of it where the fit ended."""

    model: Model
    fit: np.ndarray
    gradient: np.ndarray = field(repr=False, default=None)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `margins`, `probability` (sigmoids, divided by their sum) and `prediction`, the first most likely class."""
        scored = self.model.transform(df).withColumn("margins", vector_to_array("rawPrediction")).drop("rawPrediction", "prediction")
        a, b = (F.lit([float(v) for v in row]) for row in self.fit)
        alone = F.transform("margins", lambda m, k: 1 / (1 + F.exp(F.least(F.get(a, k) * m + F.get(b, k), F.lit(700.0)))))
        scored = scored.withColumn("_s", alone).withColumn("_t", F.aggregate("_s", F.lit(0.0), lambda t, s: t + s))
        scored = scored.withColumn("_p", F.transform("_s", lambda s: s / F.col("_t")))
        best = F.array_position("_p", F.array_max("_p")).cast("double") - 1
        return scored.withColumn("prediction", best).withColumn("probability", array_to_vector("_p")).drop("_s", "_t", "_p")


@dataclass(frozen=True)
class CalibratedMargins:
    """A one-vs-rest margin classifier with sigmoids that are fitted on margins of rows the model has not seen."""

    base: OneVsRest
    folds: int = 5
    seed: int = 42

    def __post_init__(self):
        if self.folds < 2:
            raise ValueError("need at least two folds")

    def fit(self, ready: DataFrame) -> CalibratedModel:
        """Folds go by a hash of the row. A fold whose other rows lack a class does not calibrate."""
        fold = F.pmod(F.xxhash64(vector_to_array("features"), "label_index", F.lit(self.seed)), F.lit(self.folds)).cast("int")
        rows = ready.withColumn("_fold", fold)
        counts = [(int(r["label_index"]), r["_fold"], r["count"]) for r in rows.groupBy("label_index", "_fold").count().collect()]  # classes * folds
        classes = max(k for k, _, _ in counts) + 1
        every = {k for k, _, _ in counts}
        held = None
        for i in sorted({f for _, f, _ in counts}):
            if {k for k, f, _ in counts if f != i} != every:
                continue
            model = self.base.fit(rows.filter(F.col("_fold") != i).drop("_fold"))
            margins = model.transform(rows.filter(F.col("_fold") == i)).select(F.col("label_index").cast("int").alias("label"), vector_to_array("rawPrediction").alias("m"))
            one = stage(margins.select("label", F.posexplode("m").alias("k", "margin")).select("k", "margin", (F.col("label") == F.col("k")).cast("int").alias("positive")))
            held = one if held is None else held.unionByName(one)
        if held is None:
            raise ValueError("no fold leaves all classes to the others")
        fit, gradient = fit_sigmoids(held, classes)
        return CalibratedModel(self.base.fit(ready), fit, gradient)
