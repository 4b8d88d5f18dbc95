"""One experiment: class rules, feature selection, tuning on the validation split, evaluation, run log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.operators import evaluation as E
from pluvio.operators.experiment import apply_rules, column_roles
from pluvio.operators.models import Classifier, FittedClassifier, evaluate, fit_classifier, tune
from pluvio.operators.selection import SingleSelector, VectorSelector


@dataclass(frozen=True)
class ExperimentConfig:
    """What to compare: content, granularity, model, grid and either a percentile or a single feature."""

    content: str = "dry/wet"
    granularity: int = 5
    label: str = "category"
    custom_mapping: Mapping[str, str] | None = None
    percentile: int = 60
    single_feature: str | None = None
    algorithm: str = "lr"
    params: Mapping = field(default_factory=dict)
    grid: Mapping[str, Sequence] | None = None
    metric: str = "f1_macro"


@dataclass
class Experiment:
    """Fitted selector and model; `evaluate` works on any table with the same features."""

    cfg: ExperimentConfig
    selector: VectorSelector | SingleSelector
    model: FittedClassifier
    features: list[str]

    def prepared(self, df: DataFrame) -> DataFrame:
        ruled = apply_rules(df, self.cfg.label, self.cfg.content, self.cfg.granularity, self.cfg.custom_mapping)
        ruled = ruled.filter("target is not null")
        if isinstance(self.selector, SingleSelector):
            return self.selector.transform(ruled, ["target"])
        return self.selector.transform(ruled).select("target", *[F.col(f"`{f}`") for f in self.features])

    def predictions(self, df: DataFrame) -> DataFrame:
        return self.model.predict(self.prepared(df))

    def evaluate(self, df: DataFrame) -> DataFrame:
        return evaluate(self.model, self.prepared(df), "target")

    def sheet(self, df: DataFrame, dry: str = "No Rain") -> DataFrame:
        """The wide result row of this run on a table."""
        scores = [F.get("scores", F.lit(i)) for i in range(len(self.model.classes))]
        return E.result_sheet(self.predictions(df), self.model.classes, "target", "prediction", scores, dry,
                              self.cfg.algorithm.upper(), str(dict(self.cfg.params)), str(self.features))

    def log_run(self, df: DataFrame, domain: str, path: str) -> DataFrame:
        row = E.run_row(self.evaluate(df), self.cfg.algorithm, self.cfg.content, str(self.cfg.granularity), domain)
        return E.append_run(row, path)


def run_experiment(features: DataFrame, cfg: ExperimentConfig) -> Experiment:
    """Fit on the rows with split `train`; a grid is scored on split `val`. `features` is the feature table."""
    names = column_roles(features.columns, cfg.label)["features"]
    train = features.filter("split = 'train'")
    ruled = apply_rules(train, cfg.label, cfg.content, cfg.granularity, cfg.custom_mapping).filter("target is not null")
    if cfg.single_feature:
        selector, chosen = SingleSelector(cfg.single_feature).fit(ruled, names, "target"), [cfg.single_feature]
    else:
        selector = VectorSelector(cfg.percentile).fit(ruled, names, "target")
        chosen = selector.selected
    out = Experiment(cfg, selector, None, chosen)
    spec = Classifier(cfg.algorithm, cfg.params)
    if cfg.grid:
        tuned = tune(spec, cfg.grid, out.prepared(train), out.prepared(features.filter("split = 'val'")), chosen, "target", cfg.metric)
        out.model, out.cfg = tuned.champion, cfg.__class__(**{**cfg.__dict__, "params": {**cfg.params, **tuned.best_params}})
    else:
        out.model = fit_classifier(spec, out.prepared(train), chosen, "target")
    return out
