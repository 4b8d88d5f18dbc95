import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvio.functions import arrays as A
from pluvio.functions import kernels as K
from pluvio.operators import metrics as M
from pluvio.operators import segments as S
from pluvio.plans import feature_extraction as X
from pluvio.sources import catalog as CAT
from pluvio.sources import recordings as R

RATE = 8000
CFG = M.MetricsConfig(sample_rate=RATE, n_fft=256)


def wav_bytes(x, rate=RATE, width=2, channels=1):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        if width == 2:
            raw = np.rint(x * 32767).astype("<i2").tobytes()
        elif width == 1:
            raw = np.rint(x * 127 + 128).astype("u1").tobytes()
        else:
            raw = np.rint(x * (2**23 - 1)).astype("<i4").view("u1").reshape(-1, 4)[:, :3].tobytes()
        w.writeframes(raw)
    return buf.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    t = np.arange(RATE * 2) / RATE
    rng = np.random.default_rng(3)
    files = {"sine.wav": wav_bytes(0.5 * np.sin(2 * np.pi * 1000 * t)), "noise.WAV": wav_bytes(0.1 * rng.normal(size=len(t)).clip(-3, 3)),
             "silence.wav": wav_bytes(np.zeros(len(t))), "short.wav": wav_bytes(np.zeros(100)), "broken.wav": b"RIFF....", "empty.wav": b"",
             "rate.wav": wav_bytes(np.zeros(100), rate=44100), "notes.txt": b"x", "sub/deep.wav": wav_bytes(0.3 * np.sin(2 * np.pi * 500 * t)),
             ".hidden/x.wav": wav_bytes(np.zeros(9)), "_odd/_first.Wav": b"", ".dot.wav": b"RIFF"}
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    return str(root)


def test_scan(spark, folder):
    got = R.scan_files(spark, folder).orderBy("file_path").collect()
    assert sorted(r["file_name"] for r in got) == sorted(["sine.wav", "noise.WAV", "silence.wav", "short.wav", "broken.wav", "rate.wav", "deep.wav", "empty.wav", "_first.Wav", ".dot.wav"])
    assert {r["extension"] for r in got} == {".wav"} and {r["location"] for r in got} == {folder.rsplit("/", 1)[-1]}
    assert {r["bytes"] for r in got if r["file_name"] in ("empty.wav", "_first.Wav")} == {0}
    listed = {r["file_path"] for r in R.read_content(spark, folder).select("file_path").collect()}
    assert listed < {r["file_path"] for r in got} and {r["location"] for r in R.scan_files(spark, folder + "/", location="here").collect()} == {"here"}
    assert R.scan_files(spark, folder, [".flac"]).count() == 0
    with pytest.raises(FileNotFoundError):
        R.scan_files(spark, folder + "/nothing")
    plan = R.scan_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


@pytest.mark.parametrize("width", [1, 2, 3])
def test_decode_widths(width):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    rate, got = K.decode_wav(wav_bytes(x, width=width))
    assert rate == RATE and np.allclose(got, x, atol=0.02)


def test_decode_stereo_and_duration():
    both = np.stack([np.full(800, 0.5), np.full(800, -0.5)], axis=1).ravel()
    _, got = K.decode_wav(wav_bytes(both, channels=2), duration=0.05)
    assert len(got) == 400 and np.allclose(got, 0, atol=1e-4)


def test_decode_errors_are_rows(spark, folder):
    got = {r["file_path"].rsplit("/", 1)[-1]: r for r in R.decode_signals(R.read_content(spark, folder), sample_rate=RATE, convert=False).collect()}
    assert got["sine.wav"]["error"] is None and got["sine.wav"]["n_samples"] == 2 * RATE
    assert got["broken.wav"]["error"] and "44100" in got["rate.wav"]["error"]
    assert len(got) == 7  # Spark does not list files of zero bytes


def test_parseval():
    x = np.random.default_rng(0).normal(size=256)
    p = K.power_spectrogram(x, 1, 256, 128)[0]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    assert np.isclose(p.sum() / 256, np.sum((x * w) ** 2) / np.sum(w**2) , rtol=1e-9)


def test_wavelet_keeps_energy_and_shape():
    x = np.random.default_rng(0).normal(size=4096)
    bands = K.wavelet_levels(x)
    assert [len(b) for b in bands] == [134, 134, 262, 518, 1029, 2051]
    assert np.isclose(sum((b**2).sum() for b in bands), (x**2).sum(), rtol=0.02)
    assert abs(K.wavelet_levels(np.ones(512))[1]).max() < 1e-9


def test_delta_of_a_line():
    rows = np.arange(30.0)[:, None] * np.array([[2.0, -1.0]])
    assert np.allclose(K.mean_delta(rows), [2.0, -1.0]) and K.mean_delta(rows[:8]) is None


def test_mel_bands_and_dct():
    w = K.mel_weights(24000, 1024)
    assert w.shape == (128, 513) and (w >= 0).all()
    b = K.dct_basis(20, 128)
    assert np.allclose(b @ b.T, np.eye(20))


def test_metrics_of_a_sine(spark, folder):
    sine = R.decode_signals(R.read_content(spark, folder).filter("file_path like '%sine.wav'"), sample_rate=RATE).select("file_path", "samples")
    row = M.acoustic_metrics(sine, "samples", CFG).first().asDict()
    assert [c for c in row if c != "file_path"] == M.METRICS and len(M.METRICS) == 102
    assert abs(row["spec_centroid"] - 1000) < 60 and abs(row["rms_mean"] - 0.5 / np.sqrt(2)) < 1e-3
    assert abs(row["zcr_mean"] - 0.25) < 0.02 and abs(row["mae"] - (1 + np.sqrt(2)) / 8) < 1e-3 and row["num_peaks"] >= 1
    assert abs(row["temp_kurtosis"] - 1.5) < 0.01 and all(row[f"wav_detail_lvl{i}_var"] is not None for i in range(1, 6))
    assert np.isclose(row["mfcc_mean"], np.mean([row[f"mfcc_{i}"] for i in range(1, 21)]))


def test_each_metric_fails_alone(spark, folder):
    df = R.decode_signals(R.read_content(spark, folder), sample_rate=RATE).filter("error is null").select("file_path", "samples")
    got = {r["file_path"].rsplit("/", 1)[-1]: r for r in M.acoustic_metrics(df, "samples", CFG).collect()}
    assert got["silence.wav"]["temp_skew"] is None and got["silence.wav"]["rms_mean"] == 0 and got["silence.wav"]["psd_mean"] is not None
    assert [m for m in M.METRICS if got["short.wav"][m] is not None] == []


def test_single_metrics_run_alone(spark, folder):
    """Pruned to one column, each metric still plans and runs."""
    df = R.decode_signals(R.read_content(spark, folder), sample_rate=RATE).filter("error is null").select("samples")
    out = M.acoustic_metrics(df, "samples", CFG)
    for name in ["temp_entropy", "ACI", "num_peaks", "BI", "ADI", "AEI", "spec_slope", "spec_skew", "psd_std", "spec_bandwidth_50%"]:
        assert len(out.select(F.col(f"`{name}`")).collect()) == 6


def test_spaced_peaks_brute_force(spark):
    rng = np.random.default_rng(5)
    for _ in range(5):
        v, f = rng.normal(size=60), np.arange(60) * 70.0
        peaks = sorted(((-v[i], f[i]) for i in range(1, 59) if v[i] > v[i - 1] and v[i] > v[i + 1]))
        kept = []
        for _, at in peaks:
            if all(abs(at - k) >= 200 for k in kept):
                kept.append(at)
        df = spark.createDataFrame([(v.tolist(), f.tolist())], "v array<double>, f array<double>")
        assert df.selectExpr(A.spaced_peaks("v", "f", 200.0)).first()[0] == len(kept)


def test_array_formulas(spark):
    x = np.random.default_rng(2).gamma(2, size=40)
    f = np.arange(40) * 10.0
    df = spark.createDataFrame([(x.tolist(), f.tolist())], "x array<double>, f array<double>")
    names = [A.std("x"), A.skewness("x"), A.kurtosis("x"), A.entropy("x"), A.gini("x"), A.slope("f", "x"), A.share_frequency("x", "f", 0.85), A.sign_changes("x")]
    got = df.selectExpr(*names).first()
    z, p, s = (x - x.mean()) / x.std(), x / x.sum(), np.sort(x)
    want = [x.std(), (z**3).mean(), (z**4).mean(), -(p * np.log(p)).sum(), 2 * (s * np.arange(1, 41)).sum() / (40 * x.sum()) - 41 / 40,
            np.polyfit(f, x, 1)[0], f[(np.cumsum(x) >= 0.85 * x.sum()).argmax()], 0.0]
    assert np.allclose(got, want)
    flat = spark.createDataFrame([([1.0, 1.0],)], "x array<double>").selectExpr(A.skewness("x"), A.std("x")).first()
    assert tuple(flat) == (None, 0.0)


@pytest.mark.parametrize("n,want", [(9, 0), (10, 1), (11, 1), (15, 2), (30, 5)])
def test_segment_counts(spark, n, want):
    df = spark.createDataFrame([(1, [float(i) for i in range(n)])], "id int, samples array<double>")
    rows = S.segment_arrays(df, "samples", 1.0, 0.5, 10).collect()
    assert len(rows) == want and [r["offset_sec"] for r in rows] == [k * 0.5 for k in range(want)]
    assert all(len(r["samples"]) == 10 and r["samples"][0] == r["segment_idx"] * 5 for r in rows)


def test_segment_validation():
    for bad in [(0, 0.5, 10), (1, 1.0, 10), (1, -0.1, 10), (1, 0.5, 0), (1, 0.99, 10)]:
        with pytest.raises(ValueError):
            S.window_and_stride(*bad)


def test_ordered_rows_hot_and_plain_agree(spark):
    df = spark.createDataFrame([(i % 3 if i % 2 else 0, float(i * 31 % 997), float(i % 13)) for i in range(900)], "k int, t double, v double").dropDuplicates(["k", "t"])
    a = S.segment_ordered_rows(df, ["k"], "t", "v", 16, 5)
    b = S.segment_ordered_rows(df, ["k"], "t", "v", 16, 5, hot_rows=50)
    assert a.count() > 50 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_augment_column_and_kernel_agree(spark):
    x = np.random.default_rng(1).normal(size=(6, 50)).astype("float32")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(6, [])], "id int, samples array<float>")
    rows = {r["id"]: r for r in S.augment(df, "samples", ["id"], 100).collect()}
    plain = {r["id"]: r for r in S.augment(df, "samples", ["id"], 100, noise_prob=0.0).collect()}
    quiet = {r["id"]: r["d"].asDict() for r in df.select("id", S.augment_draws(["id"], noise_prob=0.0).alias("d")).collect()}
    assert plain[6]["samples"] == [] and all(np.allclose(plain[i]["samples"], S.augmented(x[i], quiet[i], 100)[0], atol=1e-6) for i in range(6))
    draws = {r["id"]: r["d"].asDict() for r in df.select("id", S.augment_draws(["id"]).alias("d")).collect()}
    assert rows[6]["aug_params"] == "empty" and rows[6]["samples"] == []
    for i in range(6):
        y, log = S.augmented(x[i], draws[i], 100)
        assert np.allclose(rows[i]["samples"], y, atol=1e-6) and rows[i]["aug_params"] == log
        shift = int(log.split("|")[0][6:])
        assert 5 <= shift < 45 and 0.7 <= draws[i]["gain"] < 1.2


def test_feature_job(spark, folder):
    files = R.scan_files(spark, folder).select("file_path")
    meta = files.select("file_path", F.lit("train").alias("split"), F.lit("a").alias("category"), F.lit(False).alias("should_augment"), F.lit(0).cast("long").alias("copy_ordinal"))
    copies = meta.filter("file_path like '%sine.wav'").select("file_path", "split", "category", F.lit(True).alias("should_augment"), F.explode(F.expr("sequence(1L, 70L)")).alias("copy_ordinal"))
    train = meta.unionByName(copies)
    out = X.extract_features(train, CFG, duration=0.5, overlap=0.5)
    per = {r["name"]: r["count"] for r in out.filter("copy_ordinal = 0").groupBy(F.element_at(F.split("file_path", "/"), -1).alias("name")).count().collect()}
    assert per == {"sine.wav": 7, "noise.WAV": 7, "silence.wav": 7, "deep.wav": 7}
    augmented = out.filter("should_augment")
    assert augmented.count() == 70 * 7 and augmented.select("aug_params").distinct().count() == 70
    same = X.extract_features(train.repartition(3), CFG, duration=0.5, overlap=0.5)
    key = ["file_path", "copy_ordinal", "segment_idx", "aug_params", "mae", "mfcc_1"]
    assert out.select(key).exceptAll(same.select(key)).isEmpty()
    held = X.extract_features(train.withColumn("split", F.lit("val")), CFG, duration=0.5)
    assert held.filter("aug_params <> 'raw'").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and plan.count("Exchange") <= 6
    gone = meta.unionByName(meta.limit(1).withColumn("file_path", F.lit("/not/there.wav"))).unionByName(meta.limit(1).withColumn("file_path", F.lit(None).cast("string")))
    run = X.feature_run(gone, CFG, duration=0.5, overlap=0.5)
    errors = {(r["file_path"] or "null").rsplit("/", 1)[-1]: r["error"] for r in run.errors.collect()}
    assert set(errors) == {"broken.wav", "empty.wav", "_first.Wav", ".dot.wav", "there.wav", "null"} and errors["there.wav"] == "no such file" and run.failures == 6
    assert run.features.count() == run.segments and run.features.columns == out.columns
    with pytest.raises(ValueError):
        X.extract_features(train.withColumn("mae", F.lit(1.0)), CFG)
    assert X.extract_features(train.limit(0), CFG).count() == 0


def test_no_recording_ends_the_job(spark, tmp_path):
    """Rate 0, no channels, odd widths and cut headers are errors of their rows."""
    import struct

    def riff(kind, channels, rate, bits, data=b"\0" * 64, size=None):
        fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
        body = b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data) if size is None else size) + data
        return b"RIFF" + struct.pack("<I", len(body)) + body
    bad = {"rate0": riff(1, 1, 0, 16), "channels0": riff(1, 0, 8000, 16), "float0": riff(3, 0, 8000, 32), "floatrate0": riff(3, 1, 0, 32), "bits4": riff(1, 1, 8000, 4),
           "bits40": riff(1, 1, 8000, 40), "long": riff(1, 1, 8000, 16, size=1 << 31), "law": riff(7, 1, 8000, 8), "cut": riff(1, 1, 8000, 16)[:30]}
    readable = {"long", "bits4"}  # what is there is read, and samples of up to a byte are bytes
    for name, data in bad.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
        try:
            K.decode_wav(data, RATE)
        except ValueError:
            pass
        else:
            assert name in readable
    table = R.read_content(spark, str(tmp_path))
    rows = {r["file_path"].rsplit("/", 1)[-1][:-4]: r["error"] for r in R.decode_signals(table, sample_rate=RATE).collect()}
    assert set(rows) == set(bad) and all(rows[n] for n in set(bad) - readable)
    run = X.feature_run(R.scan_files(spark, str(tmp_path)), CFG, duration=0.5)
    assert run.failures == len(bad) - 2 and run.segments == 0


def test_write_recordings(spark, tmp_path):
    rows = [("a.wav", [0.0, 0.5, -0.5, 2.0], 8000), ("_b.wav", [float("nan")] * 3, 16000), (None, [0.1], 8000), ("c.wav", None, 8000), ("d.wav", [], 8000)]
    root = str(tmp_path / "out" / "deep")
    done = R.write_recordings(spark.createDataFrame(rows, "file_name string, samples array<float>, sample_rate int"), root)
    assert sorted(r["file_path"] for r in done.collect()) == sorted(r["file_path"] for r in R.scan_files(spark, root).collect()) and done.count() == 3
    back = {r["file_name"]: r for r in R.read_signals(R.scan_files(spark, root), sample_rate=None).collect()}
    assert np.allclose(back["a.wav"]["samples"], [0, 0.5, -0.5, 1], atol=1e-3) and back["_b.wav"]["sample_rate"] == 16000 and back["d.wav"]["error"] == "no samples"


def test_walk_is_shared_out(spark, tmp_path, monkeypatch):
    from pluvio.sources import inventory as I
    for i in range(12):
        (tmp_path / f"f{i}" / "g" / "h").mkdir(parents=True)
        (tmp_path / f"f{i}" / "g" / "h" / "x.wav").write_bytes(b"")
        (tmp_path / f"f{i}" / "y.FLAC").write_bytes(b"ab")
    for most in (1, 5, 20, 256):
        monkeypatch.setattr(I, "PLANNED_FOLDERS", most)
        reader = I.InventoryReader(str(tmp_path), (".wav", ".flac"), None)
        found = [row for part in reader.partitions() for row in reader.read(part)]
        assert len(found) == len(set(found)) == 24 and {r[2] for r in found} == {".wav", ".flac"} and len(reader.partitions()) >= min(most, 13) - 1


def test_a_folder_is_not_held_whole(tmp_path):
    import tracemalloc
    from pluvio.sources import inventory as I
    for i in range(5000):
        (tmp_path / f"_{i:06d}.wav").touch()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "gone.wav").symlink_to(tmp_path / "nowhere")
    reader = I.InventoryReader(str(tmp_path), (".wav",), None)
    tracemalloc.start()
    try:
        parts = reader.partitions()
        found = sum(1 for part in parts for _ in reader.read(part))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 5000 and len(parts) == 1
    assert peak < 500_000  # a list of all files takes more than 1 MB


def test_catalog(spark, folder, tmp_path):
    root = str(tmp_path / "cat")
    assert CAT.load_catalog(spark, root).columns == ["audio_id", "file_name", "sample_rate", "file_path"]
    files = R.scan_files(spark, folder).select(F.substring(F.sha2("file_name", 256), 1, 16).alias("audio_id"), "file_name", F.lit(RATE).alias("sample_rate"), "file_path")
    assert CAT.save_catalog(files, root) == 1
    more = files.withColumn("device", F.lit("d1")).unionAll(files.limit(1).withColumns({"audio_id": F.lit("new"), "device": F.lit("d2")}))
    assert CAT.save_catalog(CAT.register(CAT.load_catalog(spark, root), more), root) == 2
    back = CAT.load_catalog(spark, root)
    assert back.count() == 11 and back.filter("device = 'd2'").count() == 1 and back.filter("device is null").count() == 10
    signals = R.catalog_signals(files, RATE)
    assert signals.count() == 6 and "audio_id" in signals.columns


def test_decode_other_rates_and_formats():
    import struct

    from pluvio.functions.kernels import decode_wav, resample
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 440 * t).astype("<f4")
    fmt = struct.pack("<HHIIHH", 3, 1, 16000, 64000, 4, 32)
    body = b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", tone.nbytes) + tone.tobytes()
    wav = b"RIFF" + struct.pack("<I", len(body)) + body
    rate, x = decode_wav(wav, 16000)
    assert rate == 16000 and np.array_equal(x, tone)
    rate, x = decode_wav(wav, 24000)
    assert rate == 24000 and len(x) == 24000
    assert np.abs(x - np.sin(2 * np.pi * 440 * np.arange(24000) / 24000))[200:-200].max() < 1e-3
    high = np.sin(2 * np.pi * 7000 * t)
    assert np.abs(resample(high, 16000, 8000))[100:-100].max() < 0.01  # beyond the new band
    wide = struct.pack("<HHIIHH", 1, 1, 16000, 80000, 5, 40)
    odd = b"WAVEfmt " + struct.pack("<I", 16) + wide + b"data" + struct.pack("<I", 10) + bytes(10)
    with pytest.raises(ValueError):
        decode_wav(b"RIFF" + struct.pack("<I", len(odd)) + odd, 16000)
    with pytest.raises(ValueError):
        decode_wav(wav, 24000, convert=False)


def test_chunks_are_counted_per_file(spark):
    from pyspark.sql import functions as F

    from pluvio.plans.feature_extraction import COPIES_PER_TASK, copy_chunks
    copies = {"a": 1, "b": COPIES_PER_TASK, "c": 2 * COPIES_PER_TASK + 1}
    rows = [(name, 7 * i) for name, n in copies.items() for i in range(n)]  # ordinals count per class, with gaps per file
    out = copy_chunks(spark.createDataFrame(rows, "file_path string, copy_ordinal long"), F.struct("copy_ordinal"))
    got = {r[0]: (r[1], r[2]) for r in out.groupBy("file_path").agg(F.count("*"), F.sum(F.size("copies"))).collect()}
    assert got == {"a": (1, 1), "b": (1, COPIES_PER_TASK), "c": (3, 2 * COPIES_PER_TASK + 1)}


def test_gaussian_counters():
    """Mean, spread, tails and independence of places and seeds."""
    z = np.stack([K.gaussian(int(s), 4000) for s in np.random.default_rng(2).integers(0, 1 << 32, 50)])
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs((np.abs(z) > 1.96).mean() - 0.05) < 0.003
    assert abs((z[:, 1:] * z[:, :-1]).mean()) < 0.01 and np.abs(np.corrcoef(z) - np.eye(50)).max() < 0.1
    assert np.isfinite(z).all() and np.array_equal(K.gaussian(7, 10), K.gaussian(7, 20)[:10])


def test_catalog_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Another writer commits first, with some of the same ids."""
    root = str(tmp_path / "cat")
    rows = lambda ids, **more: spark.createDataFrame([(i, f"{i}.wav", 8000, f"/x/{i}") for i in ids], CAT.BASE_SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})
    assert CAT.save_catalog(rows("ab"), root) == 1 and CAT.save_catalog(rows("ab"), root) == 1
    commit, others = CAT._commit, [rows("cd", device="other"), rows("e")]

    def late(*args):
        if others:
            mine, CAT._commit = CAT._commit, commit
            CAT.save_catalog(others.pop(0), root)
            CAT._commit = mine
        return commit(*args)
    monkeypatch.setattr(CAT, "_commit", late)
    assert CAT.save_catalog(rows("bcef", device="mine"), root) == 4
    monkeypatch.setattr(CAT, "_commit", commit)
    got = {r["audio_id"]: r["device"] for r in CAT.load_catalog(spark, root).collect()}
    assert got == {"a": None, "b": None, "c": "other", "d": "other", "e": None, "f": "mine"} and CAT.load_catalog(spark, root).count() == 6
    assert sorted(r["rows"] for r in CAT.manifest(spark, root).collect()) == [1, 1, 2, 2]
    assert CAT.save_catalog(rows([None, "g"]), root) == 5 and CAT.load_catalog(spark, root).count() == 7
