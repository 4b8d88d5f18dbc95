"""Classifiers by name, tuning on an explicit validation set, and predictions with scores."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.operators.boosting import BoostedTrees
from pluvio.operators.calibration import CalibratedMargins
from pluvio.operators.evaluation import f1_summary, pr_auc_summary
from pluvio.session import small_side, stage

WEIGHT = "weight"
# Training rows of a task.
ROWS_PER_TASK = 20_000


def with_class_weights(df: DataFrame, label: str, out: str = WEIGHT) -> DataFrame:
    """Balanced weights rows / (classes * rows of the class), joined from the counted classes."""
    counts = small_side(df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col(label).isNotNull()))
    facts = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    return df.join(counts, label).withColumn(out, F.lit(float(facts["n"] or 0)) / (F.col("_n") * facts["k"])).drop("_n")


@dataclass(frozen=True)
class Classifier:
    """A registered kind with its settings; `build(rows)` gives the Spark estimator."""

    kind: str
    params: Mapping = field(default_factory=dict)
    seed: int = 42

    def __post_init__(self):
        if self.kind.lower() not in REGISTRY:
            raise ValueError(f"unknown classifier {self.kind!r}; registered: {sorted(REGISTRY)}")

    def build(self, rows: int):
        return REGISTRY[self.kind.lower()](dict(self.params), self.seed, rows)

    def with_params(self, params: Mapping) -> "Classifier":
        return Classifier(self.kind, {**self.params, **params}, self.seed)


REGISTRY: dict[str, Callable] = {}


def register(kind: str):
    """Add a builder `(params, seed, rows) -> estimator` under a name."""
    def wrap(fn):
        REGISTRY[kind.lower()] = fn
        return fn
    return wrap


def _settings(params: dict, names: Mapping[str, str], defaults: Mapping) -> dict:
    """Published parameter names to Spark names; an unknown name raises instead of being ignored."""
    unknown = set(params) - set(names)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}; known: {sorted(names)}")
    return {**defaults, **{names[k]: v for k, v in params.items() if v is not None}}


COMMON = {"featuresCol": "features", "labelCol": "label_index"}


MAX_TREE_DEPTH = 30  # the library's own limit; beyond it a setting raises


def _penalty(params: dict) -> float | None:
    """Share of the L1 part in `penalty` and `l1_ratio`; None for no penalty."""
    name, ratio = params.pop("penalty", "l2"), params.pop("l1_ratio", None)
    shares = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.15 if ratio is None else float(ratio), None: None, "none": None}
    if name not in shares:
        raise ValueError(f"unknown penalty {name!r}; known: l1, l2, elasticnet, None")
    return shares[name]


def _weighting(params: dict) -> dict:
    """The weight column, unless `class_weight` is None."""
    wish = params.pop("class_weight", "balanced")
    if wish not in ("balanced", None):
        raise ValueError(f"class_weight must be 'balanced' or None, not {wish!r}")
    return {"weightCol": WEIGHT} if wish else {}


@register("lr")
def _logistic(params, seed, rows):
    strength = float(params.pop("C", 1.0))
    weigh, share = _weighting(params), _penalty(params)
    reg = 0.0 if share is None else 1.0 / (strength * max(rows, 1))
    out = _settings(params, {"max_iter": "maxIter", "tol": "tol"}, {"maxIter": 2000})
    return LogisticRegression(**COMMON, **weigh, standardization=False, regParam=reg, elasticNetParam=share or 0.0, **out)


@register("sgd")
def _linear_log_loss(params, seed, rows):
    weigh, share = _weighting(params), _penalty(params)
    out = _settings(params, {"alpha": "regParam", "max_iter": "maxIter", "tol": "tol"}, {"regParam": 1e-4, "maxIter": 1000})
    if share is None:
        out["regParam"] = 0.0
    base = LogisticRegression(**COMMON, **weigh, standardization=False, elasticNetParam=share or 0.0, **out)
    return OneVsRest(**COMMON, **weigh, classifier=base, parallelism=4)


@register("rf")
def _forest(params, seed, rows):
    weigh = _weighting(params)
    if (params.get("max_depth") or 0) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {params['max_depth']}: trees of more than {MAX_TREE_DEPTH} levels are not supported")
    if params.get("max_features") is not None:
        params["max_features"] = str(params["max_features"])
    out = _settings(params, {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
                             "max_features": "featureSubsetStrategy", "criterion": "impurity"}, {"numTrees": 100, "maxDepth": MAX_TREE_DEPTH})
    return RandomForestClassifier(**COMMON, **weigh, seed=seed, **out)


@register("xgb")
def _boosted(params, seed, rows):
    names = {"n_estimators": "rounds", "early_stopping_rounds": "patience"}
    names |= {n: n for n in ("max_depth", "learning_rate", "subsample", "reg_lambda", "gamma", "min_child_weight", "max_bin")}
    return BoostedTrees(**_settings(params, names, {"seed": seed}))


@register("nusvc")
def _margin(params, seed, rows):
    folds = int(params.pop("folds", 5))
    out = _settings(params, {"reg": "regParam", "max_iter": "maxIter", "tol": "tol"}, {"regParam": 0.01, "maxIter": 200})
    return CalibratedMargins(OneVsRest(**COMMON, weightCol=WEIGHT, classifier=LinearSVC(**COMMON, weightCol=WEIGHT, **out), parallelism=4), folds, seed)


@dataclass
class FittedClassifier:
    """Fitted estimator, the classes in sorted order, and the feature input."""

    model: Model
    classes: list[str]
    features: str | list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `prediction` (class name) and `scores` (one number per class, in class order)."""
        scored = self.model.transform(_vectorised(df, self.features))
        if "probability" in scored.columns:
            scores = vector_to_array("probability")
        else:  # one-vs-rest log-odds: the chance of each class alone, divided by their sum
            alone = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(F.least(-m, F.lit(700.0)))))
            scores = F.transform(alone, lambda p: p / F.aggregate(alone, F.lit(0.0), lambda t, q: t + q))
        named = scored.withColumn("scores", scores).withColumnRenamed("prediction", "_index")
        back = IndexToString(inputCol="_index", outputCol="prediction", labels=self.classes)
        return back.transform(named).drop("_index", "rawPrediction", "probability", "features", "margins")


def _vectorised(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_classifier(spec: Classifier, train: DataFrame, features: str | Sequence[str], label: str, validation: DataFrame | None = None) -> FittedClassifier:
    """Fit on rows with a label; classes are indexed in sorted order. `features` is an array column or names.

    Boosted trees stop when the loss on `validation` does; the other kinds have no use for it.
    """
    prepared = _prepare(train, features, label)
    try:
        return _fit(spec, prepared, features, _indexed(validation, prepared, features, label))
    finally:
        prepared.cached.unpersist()


@dataclass(frozen=True)
class Prepared:
    """Training rows in the form the estimators read, cached once for all fits."""

    ready: DataFrame
    cached: DataFrame
    rows: int
    classes: list[str]


def _prepare(train: DataFrame, features, label: str) -> Prepared:
    known = train.filter(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("string"))
    indexer = StringIndexer(inputCol="_label", outputCol="label_index", stringOrderType="alphabetAsc").fit(known)
    ready = _vectorised(with_class_weights(indexer.transform(known), "label_index"), features)
    rows = known.count()
    # Every solver step is a job over this table. Tasks and row order depend on the rows alone, so that a forest
    # drawn from them is the same on any cluster.
    place = F.xxhash64(vector_to_array("features"), "label_index")
    dealt = ready.select("features", "label_index", WEIGHT, place.alias("_place")).repartition(max(1, math.ceil(rows / ROWS_PER_TASK)), "_place")
    cached = dealt.sortWithinPartitions("_place").drop("_place").persist(StorageLevel.MEMORY_AND_DISK)
    return Prepared(cached, cached, rows, list(indexer.labels))


def _indexed(df: DataFrame | None, prepared: Prepared, features, label: str) -> DataFrame | None:
    """Held-out rows in the form of the training rows; classes that these do not have are left out."""
    if df is None:
        return None
    place = F.array_position(F.lit(prepared.classes), F.col(label).cast("string")) - 1
    return _vectorised(df.withColumn("label_index", place.cast("double")).filter("label_index >= 0"), features).select("features", "label_index")


def _fit(spec: Classifier, prepared: Prepared, features, validation: DataFrame | None = None) -> FittedClassifier:
    estimator = spec.build(prepared.rows)
    model = estimator.fit(prepared.ready, validation) if isinstance(estimator, BoostedTrees) else estimator.fit(prepared.ready)
    return FittedClassifier(model, prepared.classes, features)


SCORERS = ("f1_macro", "f1_micro", "f1_weighted", "accuracy", "pr_auc_macro")


def evaluate(fitted: FittedClassifier, df: DataFrame, label: str) -> DataFrame:
    """One row: F1 averages, accuracy and PR-AUC averages on held-out data."""
    pred = fitted.predict(df.withColumn("_truth", F.col(label).cast("string")))
    pred = stage(pred.select("_truth", "prediction", "scores"))  # scored once, read by both summaries
    auc = pr_auc_summary(pred, fitted.classes, "_truth", [F.get("scores", F.lit(i)) for i in range(len(fitted.classes))])
    row = auc.select(F.struct(*auc.columns).alias("_auc")).scalar()
    return f1_summary(pred, "_truth").withColumn("_auc", row).select("*", "_auc.*").drop("_auc")


@dataclass
class Tuned:
    champion: FittedClassifier
    best_params: dict
    best_score: float
    grid: list[tuple[dict, float]]


def tune(spec: Classifier, grid: Mapping[str, Sequence], train: DataFrame, validation: DataFrame, features, label: str,
         metric: str = "f1_macro", parallel: int = 2) -> Tuned:
    """Grid search on a given validation set; models see the train rows only, the first best point wins.

    Boosted trees also watch the validation set while they are fitted, and the champion keeps the rounds that served it best.
    """
    if not grid:
        raise ValueError("the parameter grid is empty")
    if metric not in SCORERS:
        raise ValueError(f"metric must be one of {SCORERS}")
    names = sorted(grid)
    points = [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]
    prepared = _prepare(train, features, label)
    held = validation.persist(StorageLevel.MEMORY_AND_DISK)
    watched = _indexed(held, prepared, features, label)
    try:
        def score(point: dict) -> float:
            fitted = _fit(spec.with_params(point), prepared, features, watched)
            return float(evaluate(fitted, held, label).first()[metric])
        with ThreadPoolExecutor(parallel) as pool:
            scores = list(pool.map(score, points))
        best = max(range(len(points)), key=lambda i: (scores[i], -i))
        champion = _fit(spec.with_params(points[best]), prepared, features, watched)
    finally:
        prepared.cached.unpersist()
        held.unpersist()
    return Tuned(champion, points[best], scores[best], list(zip(points, scores)))
