import numpy as np
from pyspark.sql import functions as F

from pluvio.plans.curation import CurationConfig, curate
from pluvio.plans.experiment import ExperimentConfig, run_experiment
from test_curation import PATTERN


def test_curation_job(spark, tmp_path):
    names, truth = [], []
    for i in range(400):
        name = f"SMM1-202501{i % 28 + 1:02d}T{i // 28:02d}0000~{i}.wav"
        names.append((f"/d/{name}", name))
        wet = i % 4 == 0
        if i % 10:
            truth.append((f"x/{name}", 0.5 if wet else 0.0, ["Light", "heavy"][i // 4 % 2] if wet else "No Rain", wet))
    inv = spark.createDataFrame(names, "file_path string, file_name string")
    gt = spark.createDataFrame(truth, "filename string, total_rain double, rain_class string, wet boolean")
    out = curate(inv, gt, CurationConfig(PATTERN, test_size=0.1, val_size=0.1), str(tmp_path))
    counts = {r["category"]: r["count"] for r in out.groupBy("category").count().collect()}
    assert counts["no-rain"] == counts["light"] + counts["heavy"] and set(counts) == {"no-rain", "light", "heavy"}
    total = sum(counts.values())
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes["test"] == int(np.ceil(total * 0.1)) and sum(sizes.values()) == total
    assert out.select("file_path").distinct().count() == total


def test_experiment_job(spark, tmp_path):
    rng = np.random.default_rng(5)
    classes = ["no-rain", "light", "moderate", "heavy", "violent"]
    rows = [(classes[i % 5], ["train", "train", "val", "test"][i // 5 % 4], float(rng.normal() + 3 * (i % 5)), float(rng.normal()), None if i % 9 == 0 else float(rng.normal() - i % 5))
            for i in range(400)]
    df = spark.createDataFrame(rows, "category string, split string, psd_mean double, junk double, ACI double")
    run = run_experiment(df, ExperimentConfig(granularity=3, percentile=67, algorithm="lr", params={"max_iter": 20}, grid={"C": [0.01, 1.0]}))
    assert run.features == ["psd_mean", "ACI"] and run.model.classes == ["Heavy/Violent", "Light/Moderate", "No Rain"]
    test = df.filter("split = 'test'")
    assert run.evaluate(test).first()["f1_macro"] > 0.7
    log = run.log_run(test, "here", str(tmp_path / "runs")).first()
    assert (log["Algorithm"], log["Granularity"], log["Domain"]) == ("LR", "3", "here") and log["pr_auc_macro"] > 0.7
    single = run_experiment(df, ExperimentConfig(single_feature="psd_mean", algorithm="rf", params={"n_estimators": 5, "max_depth": 4}))
    sheet = single.sheet(test).first().asDict()
    assert sheet["Algoritmo"] == "RF" and np.isclose(sheet["F1_Macro_Wet"], np.mean([sheet[f"{c}_F1"] for c in ["Light", "Moderate", "Heavy", "Violent"]]))
    assert sheet["Lista_Features"] == "['psd_mean']" and single.features == ["psd_mean"]
