"""Feature selection: imputation, F scores, collinearity, standardisation, and the fitted chains.

A fitted step holds one small row per feature. `fit` reads the features in a few aggregate passes;
`transform` is a plain projection. Statistics of many columns are wide aggregates, so a hot
class costs nothing extra: partial sums combine on the map side.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.scalars import finite_sql
from pluvio.operators.profiles import long_features
from pluvio.operators.ranks import exact_quantiles


def q(name: str) -> Column:
    return F.col(f"`{name}`")


# Columns whose statistics one select computes; more are read in further passes.
COLUMNS_PER_PASS = 50


def wide_aggregate(df: DataFrame, features: Sequence[str], by: Sequence[str], **measures: str) -> DataFrame:
    """Aggregates of many columns without unfolding rows: (by, feature, measures), one row per group and feature.

    A measure is SQL text with `{v}` for the value, which is NULL where it is not finite.
    """
    parts = []
    for at in range(0, len(features), COLUMNS_PER_PASS):
        some = features[at:at + COLUMNS_PER_PASS]
        cells = [F.expr(text.format(v=finite_sql(f))).alias(f"_{i}_{m}") for i, f in enumerate(some) for m, text in measures.items()]
        rows = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"_{i}_{m}").alias(m) for m in measures]) for i, f in enumerate(some)])
        parts.append(df.groupBy(*by).agg(*cells).select(*by, F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def feature_medians(df: DataFrame, features: Sequence[str], approx: bool = False) -> DataFrame:
    """`feature, median` for features with at least one finite value; exact and interpolated by default."""
    long = long_features(df, [], features)
    if approx:
        return long.filter("value is not null").groupBy("feature").agg(F.percentile_approx("value", 0.5, 10000).alias("median"))
    return exact_quantiles(long, ["feature"], "value", [0.5]).select("feature", F.col("quantile").alias("median"))


@dataclass(frozen=True)
class Imputer:
    """Keeps the features that are not entirely empty and fills gaps with their medians."""

    medians: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], approx: bool = False) -> "Imputer":
        found = {r["feature"]: r["median"] for r in feature_medians(df, features, approx).collect()}
        return cls({f: found[f] for f in features if f in found})

    @property
    def features(self) -> list[str]:
        return list(self.medians)

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {f: f"coalesce({finite_sql(f)}, {m!r}D) as `{f}`" for f, m in self.medians.items()}
        return df.selectExpr(*[fill.get(c, f"`{c}`") for c in df.columns])


def f_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature: `feature, score`; NULL when 0/0. Rows with a NULL label are left out.

    Per (feature, class) count, mean and squared deviation come from wide aggregates per class, so no row is unfolded;
    the deviations are Spark's own centred moments, so large means do not cancel.
    """
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, score double")
    known = df.filter(F.col(label).isNotNull())
    cells = wide_aggregate(known, features, [label], n="count({v})", mean="avg({v})", ss="var_pop({v}) * count({v})").filter("n > 0")
    every = Window.partitionBy("feature")
    cells = cells.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every))
    gap = F.col("mean") - F.col("grand")
    totals = cells.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("ss").alias("within"),
                                          F.sum(F.col("n") * gap * gap).alias("between"))
    top = F.try_divide("between", F.col("k") - 1)
    bottom = F.try_divide("within", F.col("n") - F.col("k"))
    score = F.when(bottom > 0, F.try_divide(top, bottom)).when(top > 0, F.lit(float("inf")))
    return totals.select("feature", score.alias("score"))


def finite_score(score: float | None) -> float:
    """Scores as finite numbers: a missing one is the lowest double, an infinite one the highest."""
    return -sys.float_info.max if score is None else max(min(score, sys.float_info.max), -sys.float_info.max)


def select_percentile(scores: dict[str, float | None], order: Sequence[str], percentile: int) -> list[str]:
    """Names above the (100 - p) percentile; ties at the limit fill up in column order to int(k * p / 100)."""
    if not 1 <= percentile <= 100:
        raise ValueError("percentile must be 1..100")
    names = [f for f in order if f in scores]
    if percentile == 100:
        return names
    value = {f: finite_score(scores[f]) for f in names}
    ranked = sorted(value.values())
    pos = (len(ranked) - 1) * (100 - percentile) / 100
    a, b = ranked[math.floor(pos)], ranked[math.ceil(pos)]
    share = pos - math.floor(pos)
    limit = a if a == b else a * (1 - share) + b * share
    kept = {f for f in names if value[f] > limit}
    room = int(len(names) * percentile / 100) - len(kept)
    kept.update([f for f in names if value[f] == limit][:max(room, 0)])
    return [f for f in names if f in kept]


@dataclass(frozen=True)
class Standardiser:
    """(x - mean) / population standard deviation; a constant feature is only centred."""

    moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> "Standardiser":
        if not features:
            return cls({})
        rows = wide_aggregate(df, features, [], m="avg({v})", s="stddev_pop({v})").filter("m is not null").collect()
        found = {r["feature"]: (r["m"], r["s"]) for r in rows}
        return cls({f: found[f] for f in features if f in found})

    def transform(self, df: DataFrame) -> DataFrame:
        scale = {f: f"(`{f}` - ({m!r}D)) / {s if s else 1.0!r}D as `{f}`" for f, (m, s) in self.moments.items()}
        return df.selectExpr(*[scale.get(c, f"`{c}`") for c in df.columns])


GRAM_SCHEMA = "i int, j int, n double, si double, sj double, qi double, qj double, p double"


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """`i, j, feature_i, feature_j, corr` for i < j, each over the rows where both are present.

    One pass adds up centred cross products per task (NumPy on Arrow batches, one row per pair and task);
    Spark sums them per pair. Values are centred and scaled by a first pass, so large means do not
    cancel. A pair with a constant side gives NULL.
    """
    names = list(features)
    ranges = wide_aggregate(df, names, [], m="avg({v})", r="max({v}) - min({v})") if names else df.sparkSession.createDataFrame([], "feature string, m double, r double")
    scales = {r["feature"]: (r["m"], r["r"]) for r in ranges.filter("m is not null").collect()}
    live = [f for f in names if f in scales and scales[f][1] > 0]
    centred = df.selectExpr(*[f"({finite_sql(f)} - ({scales[f][0]!r}D)) / {scales[f][1]!r}D as c{k}" for k, f in enumerate(live)])
    index = [names.index(f) for f in live]

    def gram(batches):
        import numpy as np
        import pandas as pd
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            seen = ~np.isnan(x)
            x, seen = np.where(seen, x, 0.0), seen.astype("float64")
            part = np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            a, b = np.triu_indices(total.shape[1], 1)
            n, s, sq, p = total
            at = np.asarray(index, dtype="int32")
            yield pd.DataFrame({"i": at[a], "j": at[b], "n": n[a, b], "si": s[a, b], "sj": s[b, a],
                                "qi": sq[a, b], "qj": sq[b, a], "p": p[a, b]})

    spark = df.sparkSession
    sums = (centred.mapInPandas(gram, GRAM_SCHEMA) if len(live) > 1 else spark.createDataFrame([], GRAM_SCHEMA))
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vi, vj = F.col("qi") / n - (F.col("si") / n) ** 2, F.col("qj") / n - (F.col("sj") / n) ** 2
    cov = F.col("p") / n - (F.col("si") / n) * (F.col("sj") / n)
    corr = F.when((vi > 1e-18) & (vj > 1e-18), cov / F.sqrt(vi * vj))
    pairs = spark.createDataFrame([(i, j, names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names))],
                                  "i int, j int, feature_i string, feature_j string")
    return pairs.join(sums.select("i", "j", corr.alias("corr")), ["i", "j"], "left")


def collinear_features(pairs: DataFrame, threshold: float = 0.85) -> list[str]:
    """Features with an earlier feature, kept or not, beyond the threshold."""
    hits = pairs.filter(F.abs("corr") > threshold).select("j", "feature_j").distinct().orderBy("j")
    return [r["feature_j"] for r in hits.collect()]


def drop_collinear(df: DataFrame, features: Sequence[str], threshold: float = 0.85) -> list[str]:
    dropped = set(collinear_features(correlation_pairs(df, features), threshold))
    return [f for f in features if f not in dropped]


def varying_features(df: DataFrame, features: Sequence[str], threshold: float = 0.0) -> list[str]:
    """Features whose population variance is above the threshold."""
    moments = Standardiser.fit(df, features).moments
    return [f for f in features if f in moments and moments[f][1] ** 2 > threshold]


@dataclass
class VectorSelector:
    """Impute, keep the best features by F score, standardise.

    Three more steps are off by default: `drop_constant` removes features without variance, `corr_threshold` those that are collinear with
    an earlier one, and `forest` (settings of the classifier `rf`) those whose importance is below the mean.
    """

    percentile: int = 60
    approx_median: bool = False
    drop_constant: bool = False
    corr_threshold: float | None = None
    forest: Mapping | None = None
    imputer: Imputer | None = field(default=None, init=False)
    scaler: Standardiser | None = field(default=None, init=False)
    scores: dict[str, float | None] = field(default_factory=dict, init=False)
    importances: dict[str, float] = field(default_factory=dict, init=False)
    inputs: list[str] = field(default_factory=list, init=False)
    selected: list[str] = field(default_factory=list, init=False)

    def __post_init__(self):
        if self.corr_threshold is not None and not 0 <= self.corr_threshold <= 1:
            raise ValueError("corr_threshold must be 0..1")

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "VectorSelector":
        self.inputs = list(features)
        self.imputer = Imputer.fit(df, features, self.approx_median)
        filled = self.imputer.transform(df)
        self.scores = {r["feature"]: r["score"] for r in f_scores(filled, self.imputer.features, label).collect()}
        names = select_percentile(self.scores, self.imputer.features, self.percentile)
        if self.drop_constant:
            names = varying_features(filled, names)
        self.scaler = Standardiser.fit(filled, names)
        if self.corr_threshold is not None:
            names = drop_collinear(filled, names, self.corr_threshold)
        if self.forest is not None and names:
            from pluvio.operators.models import Classifier, fit_classifier
            fitted = fit_classifier(Classifier("rf", self.forest), self.scaler.transform(filled), names, label)
            self.importances = dict(zip(names, (float(v) for v in fitted.model.featureImportances.toArray())))
            mean = sum(self.importances.values()) / len(names)
            names = [f for f in names if self.importances[f] >= mean]
        self.selected = names
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Non-feature columns plus the selected, scaled features."""
        self._check()
        rest = [c for c in df.columns if c not in self.inputs]
        return self.scaler.transform(self.imputer.transform(df)).selectExpr(*[f"`{c}`" for c in rest + self.selected])

    def report(self, df: DataFrame) -> DataFrame:
        """Feature report, best score first. Scores are finite: 0 for none, the largest double for an infinite one."""
        self._check()
        rows = [(f, _number(self.scores.get(f)) if f in self.scores else None, self.importances.get(f), int(f in self.selected)) for f in self.inputs]
        rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0.0)))
        return df.sparkSession.createDataFrame(rows, "Feature_Name string, Fisher_Score double, Gini_Importance double, Survived_Pipeline int")

    def _check(self):
        if self.scaler is None:
            raise ValueError("fit the selector first")


def _number(score: float | None) -> float:
    return 0.0 if score is None else finite_score(score)


@dataclass
class SingleSelector:
    """Baseline: impute, keep one named feature, standardise."""

    feature: str
    scaler: Standardiser | None = field(default=None, init=False)
    imputer: Imputer | None = field(default=None, init=False)
    score: float | None = field(default=None, init=False)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "SingleSelector":
        if self.feature not in features:
            raise ValueError(f"feature {self.feature!r} is not among the inputs")
        self.imputer = Imputer.fit(df, [self.feature])
        if not self.imputer.features:
            raise ValueError(f"feature {self.feature!r} has no value")
        filled = self.imputer.transform(df)
        self.score = f_scores(filled, [self.feature], label).first()["score"]
        self.scaler = Standardiser.fit(filled, [self.feature])
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.scaler.transform(self.imputer.transform(df)).select(*keep, q(self.feature))


def selection_status(scores: DataFrame, selected: Sequence[str], name: str = "feature") -> DataFrame:
    return scores.withColumn("status", F.when(F.col(name).isin(list(selected)), "Selected").otherwise("Discarded"))


def forest_importances(model, features: Sequence[str], spark) -> DataFrame:
    """Importances of a fitted forest as rows, and whether each reaches the mean."""
    values = [float(v) for v in model.featureImportances.toArray()]
    mean = sum(values) / len(values)
    return spark.createDataFrame([(f, v, v >= mean) for f, v in zip(features, values)], "feature string, importance double, kept boolean")
