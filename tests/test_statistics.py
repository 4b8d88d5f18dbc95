"""Feature selection, evaluation, models, profiles and helpers on small literal tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvio.operators import evaluation as E
from pluvio.operators import models as M
from pluvio.operators import profiles as P
from pluvio.operators import selection as G
from pluvio.operators.flatmap import flat_map_rows
from pluvio.sources import tables as T


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(7)
    n = 240
    label = np.array(["a", "b", "c"])[np.arange(n) % 3]
    good = rng.normal(size=n) + (label == "b") * 2.0
    x = pd.DataFrame({"id": np.arange(n), "label": label, "good": good, "weak": rng.normal(size=n) + 1e6, "copy": good * 3 + 1,
                      "flat": 4.0, "gone": np.nan, "holes": rng.normal(size=n)})
    x.loc[::7, "holes"] = np.nan
    x.loc[1, "holes"] = np.inf
    return spark.createDataFrame(x).repartition(5), x


COLS = ["good", "weak", "copy", "flat", "gone", "holes"]


def test_imputer(features):
    df, x = features
    fitted = G.Imputer.fit(df, COLS)
    assert fitted.features == ["good", "weak", "copy", "flat", "holes"]
    want = x["holes"].replace(np.inf, np.nan).median()
    assert math.isclose(fitted.medians["holes"], want)
    got = fitted.transform(df).orderBy("id").toPandas()
    assert math.isclose(got["holes"][0], want) and math.isclose(got["holes"][1], want) and got["holes"].notna().all()
    approx = G.Imputer.fit(df, ["good"], approx=True)
    assert abs(approx.medians["good"] - x["good"].median()) < 0.1


def test_f_scores(features):
    df, x = features
    got = {r["feature"]: r["score"] for r in G.f_scores(df, COLS, "label").collect()}

    def f(name):
        groups = [g[name].to_numpy() for _, g in x.groupby("label")]
        every = np.concatenate(groups)
        between = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups) / 2
        return between / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(every) - 3))
    for name in ("good", "weak", "copy"):
        assert math.isclose(got[name], f(name), rel_tol=1e-6)
    assert got["flat"] is None and "gone" not in got


def test_select_percentile():
    order = ["a", "b", "c", "d", "e"]
    assert G.select_percentile(dict(zip(order, [5, 4, 3, 2, 1])), order, 60) == ["a", "b", "c"]
    assert G.select_percentile(dict.fromkeys(order, 1.0), order, 60) == ["a", "b", "c"]
    assert G.select_percentile({"a": None, "b": 2.0, "c": 1.0, "d": 1.0, "e": 1.0}, order, 40) == ["b", "c"]
    assert G.select_percentile(dict.fromkeys(order, 1.0), order, 100) == order
    with pytest.raises(ValueError):
        G.select_percentile({}, [], 0)


def test_correlation(features):
    df, x = features
    got = {(r["feature_i"], r["feature_j"]): r["corr"] for r in G.correlation_pairs(df, COLS).collect()}
    want = x[COLS].replace(np.inf, np.nan).corr()
    assert len(got) == 15
    for (a, b), v in got.items():
        if v is None:
            assert np.isnan(want.loc[a, b])
        else:
            assert math.isclose(v, want.loc[a, b], abs_tol=1e-9)
    assert G.drop_collinear(df, COLS, 0.85) == ["good", "weak", "flat", "gone", "holes"]
    assert G.varying_features(df, COLS) == ["good", "weak", "copy", "holes"]


def test_selector(features):
    df, x = features
    sel = G.VectorSelector(60)
    with pytest.raises(ValueError):
        sel.report(df)
    sel.fit(df, COLS, "label")
    assert sel.selected == ["good", "copy", "weak"] or sel.selected == [f for f in COLS if f in sel.selected]
    out = sel.transform(df)
    assert out.columns == ["id", "label"] + sel.selected
    stats = out.agg(F.avg("good").alias("m"), F.stddev_pop("good").alias("s")).first()
    assert abs(stats["m"]) < 1e-9 and abs(stats["s"] - 1) < 1e-9
    report = sel.report(df).collect()
    assert [r["Feature_Name"] for r in report][-1] == "gone" and report[0]["Survived_Pipeline"] == 1
    flat = G.Standardiser.fit(df, ["flat"]).transform(df).select("flat").distinct().collect()
    assert [r[0] for r in flat] == [0.0]
    with pytest.raises(ValueError):
        G.SingleSelector("nope").fit(df, COLS, "label")
    single = G.SingleSelector("weak").fit(df, COLS, "label")
    assert single.transform(df, ["id"]).columns == ["id", "weak"] and single.score is not None


PAIRS = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), (None, "a")]


def test_class_metrics(spark):
    df = spark.createDataFrame(PAIRS, "label string, prediction string")
    rep = {r["class"]: r for r in E.class_report(df).collect()}
    assert (rep["a"]["precision"], rep["a"]["recall"], rep["a"]["f1"], rep["a"]["support"]) == (0.5, 0.5, 0.5, 2)
    assert (rep["c"]["precision"], rep["c"]["recall"], rep["c"]["f1"]) == (0.0, 0.0, 0.0)
    assert math.isclose(rep["macro avg"]["f1"], (0.5 + 0.8 + 0) / 3) and math.isclose(rep["accuracy"]["f1"], 0.6)
    grid = {(r["label"], r["prediction"]): (r["n"], r["share"]) for r in E.confusion_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(grid) == 16 and grid["a", "b"] == (1, 0.5) and grid["d", "a"] == (0, 0.0)
    s = E.f1_summary(df).first()
    assert math.isclose(s["f1_micro"], 0.6) and math.isclose(s["f1_weighted"], (2 * 0.5 + 2 * 0.8) / 5)


def average_precision(y, s):
    out, pos = 0.0, sum(y)
    for t in sorted(set(s), reverse=True):
        tied = sum(a for a, b in zip(y, s) if b == t)
        cum = [(a, b) for a, b in zip(y, s) if b >= t]
        out += tied / pos * sum(a for a, _ in cum) / len(cum)
    return out


@pytest.mark.parametrize("hot_rows", [10**7, 20])
def test_average_precision(spark, hot_rows):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 3, 400), np.round(rng.random((400, 3)), 2)
    df = spark.createDataFrame([(int(a), [float(v) for v in r]) for a, r in zip(y, s)], "label int, v array<double>")
    cols = [F.get("v", F.lit(i)) for i in range(3)]
    got = {r["class"]: r["average_precision"] for r in E.average_precision(E.score_rows(df, range(3), "label", cols), hot_rows).collect()}
    want = [average_precision((y == i).astype(int).tolist(), s[:, i].tolist()) for i in range(3)]
    assert np.allclose([got[str(i)] for i in range(3)], want)
    one = E.pr_auc_summary(df, range(3), "label", cols, hot_rows).first()
    assert math.isclose(one["pr_auc_macro"], np.mean(want)) and math.isclose(one["pr_auc_weighted"], np.average(want, weights=np.bincount(y)))
    assert math.isclose(one["pr_auc_micro"], average_precision(np.eye(3)[y].astype(int).ravel().tolist(), s.ravel().tolist()))


def test_average_precision_edges(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("b", 0.1, 0), ("b", 0.2, 0)], "class string, score double, positive int")
    got = {r["class"]: r["average_precision"] for r in E.average_precision(df).collect()}
    assert got == {"a": 0.5, "b": 0.0}


def test_result_sheet_identities(spark):
    rng = np.random.default_rng(3)
    classes = ["No Rain", "Light", "Moderate", "Heavy", "Violent"]
    rows = [(classes[int(rng.integers(5))], classes[int(rng.integers(4))], rng.random(5).tolist()) for _ in range(200)]
    df = spark.createDataFrame(rows, "label string, prediction string, s array<double>")
    r = E.result_sheet(df, classes, "label", "prediction", [F.get("s", F.lit(i)) for i in range(5)], "No Rain", "LR", "{}", "['psd_mean']").first().asDict()
    f1 = [r[f"{c}_F1"] for c in classes]
    assert math.isclose(r["F1_Macro_Global"], np.mean(f1)) and math.isclose(r["F1_Macro_Wet"], np.mean(f1[1:])) and r["F1_Dry"] == f1[0]
    assert math.isclose(r["PR_AUC_Macro"], np.mean([r[f"{c}_PR_AUC"] for c in classes])) and r["Violent_F1"] == 0


def test_run_log(spark, tmp_path):
    summary = spark.createDataFrame([(0.5, 0.4)], "f1_macro double, pr_auc_macro double")
    E.append_run(E.run_row(summary, "rf", "wet", "2", "A"), str(tmp_path / "runs"))
    log = E.append_run(E.run_row(summary.drop("pr_auc_macro"), "lr", "wet", "2", "B"), str(tmp_path / "runs"))
    rows = {r["Algorithm"]: r for r in log.collect()}
    assert rows["RF"]["pr_auc_macro"] == 0.4 and rows["LR"]["pr_auc_macro"] is None


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        c = i % 4 if i % 4 < 3 else 0
        rows.append((i, ["dry", "light", "storm"][c], rng.normal(size=3).tolist() if c == 0 else (rng.normal(size=3) + 4 * c).tolist()))
    df = spark.createDataFrame(rows, "id int, y string, x array<double>")
    return df.filter("id % 5 < 3"), df.filter("id % 5 = 3"), df.filter("id % 5 = 4")


@pytest.mark.parametrize("kind,params", [("lr", {"C": 1.0, "max_iter": 30}), ("sgd", {"alpha": 0.001, "max_iter": 20, "penalty": "l2"}),
                                         ("rf", {"n_estimators": 5, "max_depth": 4}), ("xgb", {"n_estimators": 2, "max_depth": 2}), ("nusvc", {"max_iter": 10})])
def test_classifiers(blobs, kind, params):
    train, _, test = blobs
    fitted = M.fit_classifier(M.Classifier(kind.upper(), params), train, "x", "y")
    assert fitted.classes == ["dry", "light", "storm"]
    pred = fitted.predict(test)
    assert pred.filter("prediction = y").count() / pred.count() > 0.85
    assert all(len(r["scores"]) == 3 for r in pred.select("scores").collect())


def test_registry_errors():
    with pytest.raises(ValueError, match="registered"):
        M.Classifier("tree")
    with pytest.raises(ValueError, match="unknown parameters"):
        M.Classifier("rf", {"colour": 1}).build(10)


def test_tuning_uses_validation_only_to_choose(blobs):
    train, val, test = blobs
    spec = M.Classifier("lr", {"max_iter": 20})
    tuned = M.tune(spec, {"C": [1e-9, 1.0]}, train, val, "x", "y")
    assert tuned.best_params == {"C": 1.0} and tuned.best_score == max(s for _, s in tuned.grid)
    again = M.fit_classifier(spec.with_params(tuned.best_params), train, "x", "y")
    assert np.allclose(again.model.coefficientMatrix.toArray(), tuned.champion.model.coefficientMatrix.toArray())
    assert M.evaluate(tuned.champion, test, "y").first()["f1_macro"] > 0.9
    with pytest.raises(ValueError):
        M.tune(spec, {}, train, val, "x", "y")
    with pytest.raises(ValueError):
        M.tune(spec, {"C": [1.0]}, train, val, "x", "y", metric="roc")


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    assert {(r["y"], round(r["weight"], 6)) for r in M.with_class_weights(df, "y").collect()} == {("a", 0.666667), ("b", 2.0)}


def test_composition_of_nothing(spark):
    df = spark.createDataFrame([], "c string")
    assert [(r["n"], r["percent"]) for r in P.composition(df, "c", ["a", "b"]).collect()] == [(0, 0.0), (0, 0.0)]


def test_box_stats(spark):
    v = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", x) for x in v] + [("g", None), ("h", 7.0)], "k string, v double")
    got = {r["k"]: r for r in P.box_stats(df, ["k"], "v").collect()}
    assert (got["g"]["q1"], got["g"]["median"], got["g"]["q3"], got["g"]["whisker_high"], got["g"]["outliers"], got["g"]["n"]) == (2, 3, 4, 4, 1, 5)
    assert got["h"]["whisker_low"] == 7 and P.box_stats(df, ["k"], "v", approx=True).count() == 2


def test_result_pivot_rejects_doubles(spark):
    runs = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "r string, c string, m double")
    with pytest.raises(Exception, match="duplicate cell"):
        P.result_pivot(runs, "r", "c", ["x"], "m").collect()


def test_flat_map(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")

    def fn(pdf):
        if (pdf["n"] == 2).any():
            raise RuntimeError("two")
        return pdf.loc[pdf.index.repeat(pdf["n"])]
    assert flat_map_rows(df, fn, "n int", "skip").count() == 4
    rows = flat_map_rows(df.coalesce(1), fn, "n int", "capture").collect()
    assert len(rows) == 5 and [r["_error"] for r in rows if r["n"] is None] == ["RuntimeError: two"]
    with pytest.raises(Exception, match="two"):
        flat_map_rows(df, fn, "n int").collect()
    empty = flat_map_rows(df.filter("n > 9"), fn, "n int")
    assert empty.count() == 0 and empty.columns == ["n"]
    with pytest.raises(ValueError):
        flat_map_rows(df, fn, "n int", "ignore")


def test_flat_map_retries_in_parts_over_all_cores(spark):
    import os
    import pandas as pd
    calls = spark.sparkContext.accumulator(0)

    def fn(rows):
        calls.add(1)
        if (rows["id"] % 100 == 7).any():
            raise ValueError(f"row {rows['id'].iloc[0]}" if len(rows) == 1 else "some row")
        return pd.DataFrame({"id": rows["id"], "task": os.getpid()})[rows["id"] % 3 > 0]

    df = spark.range(0, 4000, 1, 1)
    rows = flat_map_rows(df, fn, "id long, task long", "capture").collect()
    bad = [i for i in range(4000) if i % 100 == 7]
    assert sorted(r["id"] for r in rows if r["_error"] is None) == [i for i in range(4000) if i % 3 and i not in bad]
    assert sorted(r["_error"] for r in rows if r["_error"]) == sorted(f"ValueError: row {i}" for i in bad)
    assert len({r["task"] for r in rows if r["task"]}) > 1  # one task had all of them
    assert calls.value < 2000  # single rows would be 4001
    assert flat_map_rows(df, fn, "id long, task long", "skip").count() == len(rows) - len(bad)


def test_flat_map_keeps_large_numbers_beside_nulls(spark):
    def fn(rows):
        if len(rows) > 1:
            raise ValueError("one by one")
        return rows.assign(id=float("nan")) if rows["id"].iloc[0] % 2 else rows

    rows = flat_map_rows(spark.range(2**60, 2**60 + 6, 1, 1), fn, "id long", "skip", 1).collect()
    assert sorted(r["id"] for r in rows if r["id"] is not None) == [2**60, 2**60 + 2, 2**60 + 4] and len(rows) == 6


def test_label_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.read_labels(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        T.read_labels(spark, str(tmp_path / "none.xlsx"))
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert T.read_labels(spark, str(tmp_path / "t.csv")).first().asDict() == {"a": 1, "b": "x"}
    tagged = T.read_split_files(spark, {"train": str(tmp_path / "t.csv"), "test": str(tmp_path / "t.csv")}, T.read_labels(spark, str(tmp_path / "t.csv")).schema)
    assert sorted(r["split"] for r in tagged.collect()) == ["test", "train"]


def test_checkpoint_and_prune(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "if(id < 8, 'train', 'test') as split")
    same = T.save_checkpoint(df, str(tmp_path / "c"))
    assert same.count() == 10 and "Range" not in same._jdf.queryExecution().optimizedPlan().toString()
    T.write_splits(df, str(tmp_path / "s"))
    part = T.read_splits(spark, str(tmp_path / "s")).filter("split = 'test'")
    assert part.count() == 2 and "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()


def test_small_side_guard(spark):
    from pluvio.session import small_side
    few, many = small_side(spark.range(5), 10), small_side(spark.range(50), 10)
    big = spark.range(100)
    plan = lambda other: big.join(other, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(few) and "broadcast" not in plan(many)
    assert small_side(spark.range(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from pluvio.streaming.windows import stream_window_stats, window_stats
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "a" if m % 2 else "b", float(h + m)) for h in range(6) for m in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(3):
        df.filter((F.hour("ts") >= part * 2) & (F.hour("ts") < part * 2 + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = stream_window_stats(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "state"), "ts", ["k"], "v",
                              "1 hour", "30 minutes", "10 hours", "2024-01-01")
    assert out.count() == 0  # nothing is closed while the watermark lies before the first window
    out = stream_window_stats(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out2"), str(tmp_path / "state2"), "ts", ["k"], "v",
                              "1 hour", "30 minutes", "10 minutes", "2024-01-01", files_per_trigger=1)
    batch = window_stats(df, "ts", ["k"], "v", "1 hour", "30 minutes", "2024-01-01").filter("end <= timestamp'2024-01-01 05:45:00'")
    assert out.count() == batch.count() > 10 and out.exceptAll(batch).isEmpty()


def test_percentile_with_constant_and_perfect_features():
    from pluvio.operators.selection import Standardiser, select_percentile
    scores = {"a": None, "b": None, "c": 1.0, "d": 2.0, "e": 3.0}
    assert select_percentile(scores, list(scores), 60) == ["c", "d", "e"]
    assert select_percentile({**scores, "f": float("inf")}, [*scores, "f"], 20) == ["f"]
    assert select_percentile(dict.fromkeys(scores), list(scores), 40) == ["a", "b"]
    assert Standardiser.fit(None, []).moments == {}


def test_estimator_settings():
    from pluvio.operators.models import Classifier
    assert Classifier("lr", {"penalty": "l1"}).build(10).getElasticNetParam() == 1.0
    assert Classifier("lr", {"penalty": None}).build(10).getRegParam() == 0.0
    assert Classifier("sgd", {"penalty": "elasticnet", "l1_ratio": 0.4}).build(10).getClassifier().getElasticNetParam() == 0.4
    forest = Classifier("rf", {"max_features": "sqrt", "criterion": "entropy", "class_weight": None}).build(10)
    assert (forest.getFeatureSubsetStrategy(), forest.getImpurity(), forest.isSet("weightCol")) == ("sqrt", "entropy", False)
    for kind, bad in (("rf", {"max_depth": 31}), ("lr", {"penalty": "l3"}), ("rf", {"class_weight": {0: 1}})):
        with pytest.raises(ValueError):
            Classifier(kind, bad).build(10)
