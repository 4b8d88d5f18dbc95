import pytest
from pyspark.sql import functions as F

from pluvio.functions import scalars as S
from pluvio.operators import curation as C
from pluvio.operators import experiment as X

DATE = "".join(f"(?P<{part}>[0-9]{{{n}}})" for part, n in (("year", 4), ("month", 2), ("day", 2)))
TIME = "".join(f"(?P<{part}>[0-9][0-9])" for part in ("hour", "minute", "second"))
PATTERN = rf"(?P<recorder>SMM[0-9]+[A-Z]?)-{DATE}T{TIME}(?:\+(?P<rain_mm_str>[0-9]+-[0-9]+))?(?:~(?P<category>[\w-]+))?"


def test_filename_metadata(spark):
    names = ["SMM7-20250102T031500+0-2~light.wav", "SMM7-20250102T120000.wav", "SMM7A-20250102T060000~no-rain.wav",
             "SMM7-20250230T235900+1-0~heavy.wav", "notes.wav"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = {r["file_name"]: r for r in C.extract_filename_metadata(df, PATTERN).collect()}
    a, b, c, d, e = (got[n] for n in names)
    assert (a["recorder"], a["mm_5min"], a["mm_hr"], a["category"], str(a["timestamp"]), a["period"]) == (
        "SMM7", 0.2, 2.4, "light", "2025-01-02 03:15:00", "overnight")
    assert (b["mm_5min"], b["category"], b["period"]) == (None, "unlabeled", "afternoon")
    assert (c["recorder"], c["category"], c["period"]) == ("SMM7", "no-rain", "morning")
    assert (d["mm_5min"], d["timestamp"], d["period"]) == (1.0, None, "night")
    assert (e["recorder"], e["category"], e["timestamp"], e["period"]) == (None, "unlabeled", None, None)
    assert "rain_mm_str" not in got[names[0]].asDict()


def test_metadata_without_file_name_is_unchanged(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert C.extract_filename_metadata(df, PATTERN).columns == ["x"]


def test_rate_rounds_half_to_even(spark):
    df = spark.createDataFrame([("0-2",), ("x",), (None,), ("0-010416666666666666",)], "t string")
    rows = df.select(C.dashed_number("t").alias("v"), S.hourly_rate(C.dashed_number("t")).alias("r")).collect()
    assert [r["v"] for r in rows][:3] == [0.2, None, None]
    assert rows[0]["r"] == 2.4 and rows[3]["r"] == 0.12


def test_period_limits(spark):
    hours = ["0", "5", "6", "11", "12", "17", "18", "23", "24", None]
    df = spark.createDataFrame([(h,) for h in hours], "h string")
    got = [r[0] for r in df.select(S.period_of_day("h")).collect()]
    assert got == ["overnight"] * 2 + ["morning"] * 2 + ["afternoon"] * 2 + ["night"] * 2 + [None, None]


def test_merge_labels_rules(spark):
    raw = spark.createDataFrame([("a.wav", "unlabeled", "night", 1.0), ("b.wav", "light", "night", 2.0), ("c.wav", "heavy", None, 3.0)],
                                "file_name string, category string, period string, mm_5min double")
    gt = spark.createDataFrame([("x/y/a.wav", "Heavy", "morning", None, "1", 2), ("a.wav", "late", "noon", 9.0, "0", 5),
                                ("b.wav", None, None, 7.5, "7", 1)],
                               "filename string, rain_class string, period string, total_rain double, rain string, o int")
    got = {r["file_name"]: r for r in C.merge_labels(raw, gt, no_overwrite=["period"], ordinal="o").collect()}
    assert len(got) == 3
    assert (got["a.wav"]["category"], got["a.wav"]["period"], got["a.wav"]["mm_5min"], got["a.wav"]["is_rain"]) == ("Heavy", "night", 1.0, True)
    assert (got["b.wav"]["category"], got["b.wav"]["mm_5min"], got["b.wav"]["is_rain"]) == ("light", 7.5, None)
    assert got["c.wav"]["category"] == "heavy"
    out = C.merge_labels(raw, gt, ordinal="o")
    assert out.columns[:5] == ["file_name", "period", "is_rain", "mm_5min", "category"]
    assert not [c for c in out.columns if c.endswith("_gt")]
    with pytest.raises(KeyError):
        C.merge_labels(raw, gt, key="nothing")


def test_sanitise(spark):
    df = spark.createDataFrame([(" No Rain ", 0.1), ("NaN", None), (None, 1.0), ("Light", 0.5)], "category string, mm_5min double")
    rows = C.sanitise(df.withColumn("rain", F.lit(1))).collect()
    assert [r["category"] for r in rows] == ["no-rain", None, None, "light"]
    assert [r["mm_hr"] for r in rows] == [1.2, None, 12.0, 6.0]


def test_discard_keeps_null_results(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "b", None), (4, "b", 5.0)], "id int, c string, v double")
    assert [r.id for r in C.discard(df, ["c = 'a'", "v > 4"]).collect()] == [2, 3]
    assert C.discard(df, []).count() == 4
    audit = {r["rule"]: r["rows"] for r in C.discard_audit(df, ["c = 'a'", "v > 4"]).collect()}
    assert audit == {0: 2, 1: 1, 2: 1}
    with pytest.raises(Exception):
        C.discard(df, ["no_such_column = 1"]).collect()


def test_daily_status_null_is_dry(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,)], "v double")
    assert [r[0] for r in df.select(C.daily_status("v")).collect()] == ["Wet (Rain)", "Dry (No Rain)", "Dry (No Rain)"]


def test_experiment_rules(spark):
    df = spark.createDataFrame([("No-Rain",), ("light",), (None,), ("VIOLENT",), ("hail",)], "category string")
    wet = X.apply_rules(df, content="WET", granularity=2).collect()
    assert [(r["category"], r["target"]) for r in wet] == [("light", "Light/Moderate"), (None, None), ("VIOLENT", "Heavy/Violent"), ("hail", None)]
    assert [r["target"] for r in X.apply_rules(df, content="dry").collect()] == ["No Rain"]
    q = {r["label"]: r for r in X.label_quality(X.apply_rules(df), granularity=5).collect()}
    assert q["hail"]["unmapped"] and not q["light"]["unmapped"] and q["light"]["classes_found"] == 3 and q["light"]["fewer_than_requested"]
    roles = X.column_roles(["file_name", "is_rain", "a", "category", "b"])
    assert roles["features"] == ["a", "b"] and "is_rain" in roles["metadata"]


def test_named_groups():
    java, groups = S.named_groups(r"(?P<a_b>x+)-(?:y)(?P<c>z)(?P=a_b)")
    assert java == r"(x+)-(?:y)(z)\1" and groups == {"a_b": 1, "c": 2}


def test_title_and_base_name(spark):
    df = spark.createDataFrame([("light/moderate", "a/b/c.wav"), ("NO RAIN", r"x\y.wav"), (None, "z.wav"), ("ÁGUA-fria", "/a/b/")], "t string, p string")
    rows = df.select(S.title_case("t").alias("t"), S.base_name("p").alias("p")).collect()
    assert [tuple(r) for r in rows] == [("Light/Moderate", "c.wav"), ("No Rain", "y.wav"), (None, "z.wav"), ("Água-Fria", "b")]
