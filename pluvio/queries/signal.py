"""Segments, augmentation, spectra and metrics on 64-sample embedding vectors and on event values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pluvio.functions import arrays as A
from pluvio.functions.kernels import DB4, encode_wav
from pluvio.functions.scalars import finite
from pluvio.operators import metrics as M
from pluvio.operators import segments as S
from pluvio.plans import feature_extraction as X
from pluvio.queries.sampling import _split_sql
from pluvio.queries.base import Registry, table
from pluvio.session import scratch_path
from pluvio.sources import recordings as R
from pluvio.streaming import windows as W

REG = Registry()

RATE, N_FFT = 16_000, 16
CFG = M.MetricsConfig(sample_rate=RATE, n_fft=N_FFT)
VALUES = "x AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i))"
SAMPLES = 64


def cells(values: str, n: int) -> str:
    """Spectrogram cells of the signals x (vec_id, i, v) of SAMPLES samples, by a discrete Fourier transform of `n` points."""
    frames = (SAMPLES - n) // (n // 2) + 1
    return f"""WITH {values},
w AS (SELECT vec_id, t, n, v, v * (0.5 - 0.5 * cos(2 * pi() * n / {n})) AS h FROM x JOIN (SELECT t, n, t * {n // 2} + n AS i FROM range({frames}) a(t), range({n}) b(n)) USING (i)),
d AS (SELECT vec_id, t, k, sum(h * cos(2 * pi() * k * n / {n})) AS re, sum(h * sin(2 * pi() * k * n / {n})) AS im FROM w, range({n // 2 + 1}) c(k) GROUP BY ALL),
c AS (SELECT vec_id, t, k, k * {RATE / n}::DOUBLE AS f, greatest((re * re + im * im) / ({RATE} * {3 * n // 8}) * CASE WHEN k BETWEEN 1 AND {n // 2 - 1} THEN 2 ELSE 1 END, 1e-12) AS p FROM d)"""


CELLS = cells(VALUES, N_FFT)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def scaled(df, digits=6, **factors):
    """Round for comparison, very small numbers after a factor."""
    return df.withColumns({n: F.round(F.col(f"`{n}`") * f, digits) for n, f in factors.items()})


@REG.add("spectrogram_cells", CELLS + " SELECT vec_id, CAST(t AS INTEGER) AS frame_idx, CAST(k AS INTEGER) AS bin_idx, round(p * 1e9, 4) AS power FROM c")
def _(spark, sf):
    return scaled(M.spectrogram_cells(vectors(spark, sf), "embedding", RATE, N_FFT), 4, power=1e9)


def metric_query(names, factors, sql):
    """Register a metric group; `factors` lift small numbers before rounding."""
    def run(spark, sf):
        out = M.acoustic_metrics(vectors(spark, sf), "embedding", CFG)
        return scaled(out.select("vec_id", *[F.col(f"`{n}`") for n in names]), 6, **{n: factors.get(n, 1) for n in names})
    return run, sql


def metric_groups(values: str, n: int) -> dict[str, tuple]:
    """Metric groups of the signals x (vec_id, i, v) of SAMPLES samples, with a window of `n`: names, factors and SQL."""
    CELLS, bins, hop = cells(values, n), n // 2 + 1, n // 2
    frames = (SAMPLES - n) // hop + 1
    BINS = CELLS + f""",
g AS (SELECT *, abs(sqrt(p) - sqrt(lag(p) OVER o)) AS dm, abs(p - lag(p) OVER o) AS dp FROM c WINDOW o AS (PARTITION BY vec_id, k ORDER BY t)),
b AS (SELECT vec_id, k, f, avg(p) AS m, var_pop(p) AS v, sum(sqrt(p)) AS mag, sum(dm) AS flux, avg(dp) * {RATE // hop} AS grad FROM g GROUP BY ALL)"""
    H = "(1 + sum({e} / s_{n} * ln({e} / s_{n})) / ln(" + str(bins) + "))"

    return {
        "metrics_complexity": (["ACI", "AGI", "EAS", "ECU", "ECV", "roughness"], {"roughness": 1e9}, BINS + f""",
s AS (SELECT *, sum(m) OVER z AS s_m, sum(v) OVER z AS s_v, sum(sqrt(v) / m) OVER z AS s_c FROM b WINDOW z AS (PARTITION BY vec_id)),
r AS (SELECT vec_id, avg(abs(p - mu)) AS rough FROM (SELECT *, avg(p) OVER (PARTITION BY vec_id) AS mu FROM c) GROUP BY 1)
SELECT vec_id, round(sum(flux / mag), 6) AS "ACI", round(sum(grad / m), 6) AS "AGI", round({H.format(e="m", n="m")}, 6) AS "EAS",
  round({H.format(e="v", n="v")}, 6) AS "ECU", round({H.format(e="(sqrt(v) / m)", n="c")}, 6) AS "ECV", round(max(rough) * 1e9, 6) AS roughness
FROM s JOIN r USING (vec_id) GROUP BY vec_id"""),
        "metrics_bands": (["NDSI", "ratioBA", "anthro_energy", "bio_energy", "BI", "num_peaks"], {"anthro_energy": 1e9, "bio_energy": 1e9}, BINS + """,
e AS (SELECT *, 10 * log10(m) AS l, lag(m) OVER z AS below, lead(m) OVER z AS above FROM b WINDOW z AS (PARTITION BY vec_id ORDER BY k)),
y AS (SELECT vec_id, sum(m) FILTER (WHERE f < 1000) AS a, sum(m) FILTER (WHERE f >= 1000 AND f < 10000) AS o, sum(l) FILTER (WHERE f >= 2000) AS sl,
  min(l) FILTER (WHERE f >= 2000) AS ml, count(*) FILTER (WHERE f >= 2000) AS nl, count(*) FILTER (WHERE m > below AND m > above) AS peaks FROM e GROUP BY 1)
SELECT vec_id, round((o - a) / (o + a), 6) AS "NDSI", round(o / a, 6) AS "ratioBA", round(a * 1e9, 6) AS anthro_energy, round(o * 1e9, 6) AS bio_energy,
  round((sl - ml * nl) * """ + str(RATE / n / 1000) + """, 6) AS "BI", CAST(peaks AS DOUBLE) AS num_peaks FROM y"""),
        "metrics_diversity": (["ADI", "AEI", "tfsd"], {}, CELLS + f""",
l AS (SELECT *, 10 * log10(p) AS db, 10 * log10(max(p) OVER (PARTITION BY vec_id)) AS top FROM c),
a AS (SELECT vec_id, k, count(*) FILTER (WHERE db - top > -50) / {frames} AS s FROM l GROUP BY ALL),
n AS (SELECT *, sum(s) OVER (PARTITION BY vec_id) AS tot, row_number() OVER (PARTITION BY vec_id ORDER BY s, k) AS rk FROM a WHERE k < {bins}),
q AS (SELECT vec_id, CASE WHEN count(*) = 0 THEN NULL END AS z, -sum(CASE WHEN s > 0 THEN s / tot * ln(s / tot) ELSE 0 END) AS adi,
  2 * sum(rk * s) / (count(*) * sum(s)) - (count(*) + 1) / count(*) AS aei FROM n GROUP BY 1),
u AS (SELECT vec_id, t, k, f, db - lag(db) OVER (PARTITION BY vec_id, k ORDER BY t) AS dt FROM l),
v AS (SELECT vec_id, t, k, f, abs(lead(dt) OVER (PARTITION BY vec_id, t ORDER BY k) - dt) AS d2 FROM u WHERE t > 0)
SELECT vec_id, round(adi, 6) AS "ADI", round(aei, 6) AS "AEI", round(tf, 6) AS tfsd FROM q JOIN
  (SELECT vec_id, sum(d2) FILTER (WHERE f >= 2000 AND f < 8000) / sum(d2) AS tf FROM v GROUP BY 1) USING (vec_id)"""),
        "metrics_temporal": (["temp_entropy", "temp_skew", "temp_kurtosis", "rms_mean", "rms_std", "rms_var", "zcr_mean", "zcr_std", "zcr_var", "mae"], {"zcr_var": 1e3}, CELLS + f""",
m AS (SELECT vec_id, avg(abs(v)) AS mae, avg(power(v - mu, 2)) AS m2, avg(power(v - mu, 3)) AS m3, avg(power(v - mu, 4)) AS m4
      FROM (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS mu FROM x) GROUP BY 1),
e AS (SELECT vec_id, i // {hop} AS blk, max(abs(v)) AS env FROM x GROUP BY ALL),
h AS (SELECT vec_id, -sum(env / s * ln(env / s)) / ln({SAMPLES // hop}) AS ent FROM (SELECT *, sum(env) OVER (PARTITION BY vec_id) AS s FROM e) GROUP BY 1),
r AS (SELECT vec_id, t, sqrt(avg(v * v)) AS rms, sum(CASE WHEN n > 0 AND (v < 0) <> (pv < 0) THEN 1 ELSE 0 END) / {n} AS zcr
      FROM (SELECT *, lag(v) OVER (PARTITION BY vec_id, t ORDER BY n) AS pv FROM w) GROUP BY ALL),
s AS (SELECT vec_id, avg(rms) AS rm, stddev_pop(rms) AS rs, avg(zcr) AS zm, stddev_pop(zcr) AS zs FROM r GROUP BY 1)
SELECT vec_id, round(ent, 6) AS temp_entropy, round(m3 / power(m2, 1.5), 6) AS temp_skew, round(m4 / (m2 * m2), 6) AS temp_kurtosis, round(rm, 6) AS rms_mean,
  round(rs, 6) AS rms_std, round(rs * rs, 6) AS rms_var, round(zm, 6) AS zcr_mean, round(zs, 6) AS zcr_std, round(zs * zs * 1e3, 6) AS zcr_var, round(mae, 6) AS mae
FROM m JOIN h USING (vec_id) JOIN s USING (vec_id)"""),
        "metrics_spectrum": (["psd_mean", "psd_std", "psd_var", "spec_slope", "spec_mean", "spec_std", "spec_var", "spec_skew", "spec_kurtosis"],
                         {"psd_mean": 1e9, "psd_std": 1e9, "psd_var": 1e14, "spec_slope": 1e12, "spec_mean": 1e9, "spec_std": 1e9, "spec_var": 1e14}, BINS + """,
a AS (SELECT vec_id, avg(m) AS mu, stddev_pop(m) AS sd, regr_slope(m * 1e9, f) * 1e3 AS sl FROM b GROUP BY 1),
q AS (SELECT vec_id, avg(power((m - mu) / sd, 3)) AS sk, avg(power((m - mu) / sd, 4)) AS ku FROM b JOIN a USING (vec_id) GROUP BY 1)
SELECT vec_id, round(mu * 1e9, 6) AS psd_mean, round(sd * 1e9, 6) AS psd_std, round(sd * sd * 1e14, 6) AS psd_var, round(sl, 6) AS spec_slope, round(mu * 1e9, 6) AS spec_mean,
  round(sd * 1e9, 6) AS spec_std, round(sd * sd * 1e14, 6) AS spec_var, round(sk, 6) AS spec_skew, round(ku, 6) AS spec_kurtosis FROM a JOIN q USING (vec_id)"""),
        "metrics_shape": (["spec_centroid", "spec_flatness", "spec_rolloff", "spec_bandwidth_mean", "spec_bandwidth_50%", "spec_bandwidth_90%"], {}, BINS + """,
z AS (SELECT *, sqrt(p) / sum(sqrt(p)) OVER (PARTITION BY vec_id, t) AS wt FROM c),
y AS (SELECT *, sum(wt * f) OVER (PARTITION BY vec_id, t) AS ce, sum(wt) OVER (PARTITION BY vec_id, t ORDER BY k) AS run FROM z),
j AS (SELECT vec_id, t, max(ce) AS ce, sqrt(sum(wt * power(f - ce, 2))) AS bw, exp(avg(ln(p))) / avg(p) AS fl, min(f) FILTER (WHERE run >= 0.85 - 1e-12) AS ro FROM y GROUP BY ALL),
e AS (SELECT *, sum(m) OVER (PARTITION BY vec_id ORDER BY k) / sum(m) OVER (PARTITION BY vec_id) AS cum FROM b),
o AS (SELECT vec_id, min(f) FILTER (WHERE cum >= 0.75 - 1e-12) - min(f) FILTER (WHERE cum >= 0.25 - 1e-12) AS b50, min(f) FILTER (WHERE cum >= 0.95 - 1e-12) - min(f) FILTER (WHERE cum >= 0.05 - 1e-12) AS b90 FROM e GROUP BY 1)
SELECT vec_id, round(avg(ce), 6) AS spec_centroid, round(avg(fl), 6) AS spec_flatness, round(avg(ro), 6) AS spec_rolloff, round(avg(bw), 6) AS spec_bandwidth_mean,
  round(max(b50), 6) AS "spec_bandwidth_50%", round(max(b90), 6) AS "spec_bandwidth_90%" FROM j JOIN o USING (vec_id) GROUP BY vec_id"""),
    }


GROUPS = metric_groups(VALUES, N_FFT)
for _name, _group in GROUPS.items():
    _fn, _sql = metric_query(*_group)
    REG.add(_name, _sql)(_fn)


def _wavelet_sql(values: str) -> str:
    """Five filter-and-halve steps with mirrored edges, each a join of the signal with the eight taps."""
    taps = ", ".join(f"({j}, {float(lo)!r}::DOUBLE, {float(hi)!r}::DOUBLE)" for j, (lo, hi) in
                     enumerate(zip(DB4, DB4[::-1] * np.where(np.arange(8) % 2 == 0, -1.0, 1.0))))
    parts, n, src = [values, f"taps(j, lo, hi) AS (VALUES {taps})"], 64, "x"
    for level in range(1, 6):
        i = "2 * k + 1 - j"
        parts.append(f"""l{level} AS (SELECT vec_id, CAST(k AS INTEGER) AS i, sum(lo * v) AS v, sum(hi * v) AS d FROM (SELECT k, j, lo, hi,
  CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN {2 * n - 1} - ({i}) ELSE {i} END AS i FROM range({(n + 7) // 2}) r(k), taps) JOIN {src} USING (i) GROUP BY vec_id, k)""")
        n, src = (n + 7) // 2, f"l{level}"
    stats = [f"s{lvl} AS (SELECT vec_id, avg(d * d) AS e, stddev_pop(d) AS s FROM l{lvl} GROUP BY 1)" for lvl in range(1, 6)]
    parts += stats + ["s0 AS (SELECT vec_id, avg(v * v) AS e, stddev_pop(v) AS s FROM l5 GROUP BY 1)"]
    cols = ", ".join(f"round(s{lvl}.e, 6) AS {n}_energy, round(s{lvl}.s, 6) AS {n}_std, round(s{lvl}.s * s{lvl}.s, 6) AS {n}_var"
                     for lvl, n in [(0, "wav_approx")] + [(k, f"wav_detail_lvl{k}") for k in range(1, 6)])
    joins = " ".join(f"JOIN s{lvl} USING (vec_id)" for lvl in range(1, 6))
    return f"WITH {', '.join(parts)} SELECT vec_id, {cols}, round((s0.e + s1.e + s2.e + s3.e + s4.e + s5.e) / 6, 6) AS wav_energy_mean FROM s0 {joins}"


WAVELET = [f"{n}_{s}" for n in ["wav_approx"] + [f"wav_detail_lvl{k}" for k in range(1, 6)] for s in ("energy", "std", "var")] + ["wav_energy_mean"]
_fn, _sql = metric_query(WAVELET, {}, _wavelet_sql(VALUES))
REG.add("metrics_wavelet", _sql)(_fn)


def _mfcc_sql(values: str) -> str:
    """Cepstral coefficients for a window of 8."""
    return "WITH " + values + """,
w AS (SELECT vec_id, t, n, v * (0.5 - 0.5 * cos(2 * pi() * n / 8)) AS h FROM x JOIN (SELECT t, n, t * 4 + n AS i FROM range(15) a(t), range(8) b(n)) USING (i)),
d AS (SELECT vec_id, t, k, sum(h * cos(2 * pi() * k * n / 8)) AS re, sum(h * sin(2 * pi() * k * n / 8)) AS im FROM w, range(5) c(k) GROUP BY ALL),
c AS (SELECT vec_id, t, k, greatest((re * re + im * im) / (16000 * 3) * CASE WHEN k BETWEEN 1 AND 3 THEN 2 ELSE 1 END, 1e-12) AS p FROM d),
top AS (SELECT 15 + ln(8.0) / (ln(6.4) / 27) AS mel),
hz AS (SELECT b, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp(ln(6.4) / 27 * (m - 15)) END AS f FROM (SELECT b, mel * b / 129 AS m FROM range(130) r(b), top)),
tri AS (SELECT l.b, l.f AS lo, m.f AS mid, u.f AS hi FROM hz l JOIN hz m ON m.b = l.b + 1 JOIN hz u ON u.b = l.b + 2),
mw AS (SELECT b, k, greatest(0, least((k * 2000 - lo) / (mid - lo), (hi - k * 2000) / (hi - mid))) * 2 / (hi - lo) AS wt FROM tri, range(5) r(k)),
me AS (SELECT vec_id, t, b, 10 * log10(greatest(sum(p * wt), 1e-10)) AS db FROM c JOIN mw USING (k) GROUP BY vec_id, t, b),
cl AS (SELECT vec_id, t, b, greatest(db, max(db) OVER (PARTITION BY vec_id) - 80) AS db FROM me),
ce AS (SELECT vec_id, t, q, sum(db * cos(pi() * q * (2 * b + 1) / 256)) * CASE WHEN q = 0 THEN sqrt(1 / 128) ELSE sqrt(2 / 128) END AS m FROM cl, range(20) r(q) GROUP BY vec_id, t, q),
av AS (SELECT vec_id, q, avg(m) AS m FROM ce GROUP BY ALL),
sl AS (SELECT e.vec_id, e.q, sum((e.t - g.c) * e.m) / 60 / 15 AS dm FROM (SELECT t AS t0, greatest(4, least(t, 10)) AS c FROM range(15) r(t)) g JOIN ce e ON e.t BETWEEN g.c - 4 AND g.c + 4 GROUP BY e.vec_id, e.q)
SELECT vec_id, """ + ", ".join(f"round(max(m) FILTER (WHERE q = {i}), 6) AS mfcc_{i + 1}, round(max(dm) FILTER (WHERE q = {i}), 6) AS mfcc_delta_{i + 1}" for i in range(20)) + """,
  round(avg(m), 6) AS mfcc_mean, round(stddev_pop(m), 6) AS mfcc_std, round(var_pop(m), 6) AS mfcc_var FROM av JOIN sl USING (vec_id, q) GROUP BY vec_id"""


@REG.add("metrics_mfcc", _mfcc_sql(VALUES))
def _(spark, sf):
    names = [f"mfcc_{d}{i}" for i in range(1, 21) for d in ("", "delta_")] + ["mfcc_mean", "mfcc_std", "mfcc_var"]
    out = M.acoustic_metrics(vectors(spark, sf), "embedding", M.MetricsConfig(sample_rate=RATE, n_fft=8))
    return out.selectExpr("vec_id", *[f"round({n}, 6) as {n}" for n in names])


def _all_metrics_sql(values: str) -> tuple[dict[str, float], str]:
    """The factors of all 102 metrics, and the join of all groups for a window of 8."""
    groups = list(metric_groups(values, 8).values()) + [(WAVELET, {}, _wavelet_sql(values)), ([], {}, _mfcc_sql(values))]
    factors = {m: 1 for m in M.METRICS} | {name: f for _, scale, _ in groups for name, f in scale.items()}
    first, *rest = [f"({sql})" for _, _, sql in groups]
    return factors, f"SELECT * FROM {first}" + "".join(f" JOIN {sql} USING (vec_id)" for sql in rest)


ALL_FACTORS, ALL_SQL = _all_metrics_sql(VALUES)


@REG.add("metrics_all", ALL_SQL)
def _(spark, sf):
    return scaled(M.acoustic_metrics(vectors(spark, sf), "embedding", M.MetricsConfig(sample_rate=RATE, n_fft=8)), 6, **ALL_FACTORS)


@REG.add("segment_vectors", "WITH " + VALUES + """
SELECT vec_id, CAST(s AS INTEGER) AS segment_idx, s * 8 / 16 AS offset_sec, round(sum(v), 6) AS total, max(CASE WHEN i = s * 8 THEN round(v, 6) END) AS first, count(*) AS n
FROM x JOIN range(7) t(s) ON i >= s * 8 AND i < s * 8 + 16 GROUP BY vec_id, s""")
def _(spark, sf):
    seg = S.segment_arrays(vectors(spark, sf), "embedding", 1.0, 0.5, 16)
    return seg.select("vec_id", "segment_idx", "offset_sec", F.round(F.expr(A.total("embedding")), 6).alias("total"),
                      F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("n"))


def _segment_sql(window, stride):
    return f"""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events)
SELECT user_id, s AS segment_idx, count(*) AS n, round(sqrt(avg(value * value)), 7) AS rms, round(avg(abs(value)), 7) AS mae, min(value) AS min, max(value) AS max
FROM r, LATERAL (SELECT unnest(range(CAST(greatest(0, (i - {window}) // {stride} + 1) AS BIGINT), CAST(i // {stride} + 1 AS BIGINT))) AS s)
WHERE i >= s * {stride} AND i < s * {stride} + {window} GROUP BY user_id, s HAVING count(*) = {window}"""


@REG.add("segment_event_rows", _segment_sql(16, 8).replace("(i - 16) // 8 + 1", "CAST(floor((i - 16) / 8.0) AS BIGINT) + 1"))
def _(spark, sf):
    out = S.segment_ordered_rows(table(spark, sf, "events"), ["user_id"], "ts", "value", 16, 8)
    return out.withColumns({"rms": F.round("rms", 7), "mae": F.round("mae", 7)})


UNIT = "(CAST('0x' || substr(md5(vec_id || '|{p}|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
# 0.2 and 0.3 are the default shares of copies with noise and with a cutout.
DRAWS = ("d AS (SELECT vec_id, CAST(least(6 + floor(" + UNIT.format(p="shift") + " * 51), 63) AS INTEGER) AS shift, " + UNIT.format(p="gain") + " * 0.5 + 0.7 AS gain, "
         + "CASE WHEN " + UNIT.format(p="noise?") + " < 0.2 THEN " + UNIT.format(p="noise") + " * 0.019 + 0.001 END AS noise, "
         + "CASE WHEN " + UNIT.format(p="cutout?") + " < 0.3 THEN CAST(floor(" + UNIT.format(p="cutout") + " * (64 - 8)) AS INTEGER) END AS cut FROM embeddings)")


@REG.add("augment_shift_gain_cutout", "WITH " + VALUES + ", " + DRAWS + """
SELECT vec_id, (i + shift) % 64 AS pos, round(CASE WHEN (i + shift) % 64 >= cut AND (i + shift) % 64 < cut + 8 THEN 0 ELSE CAST(CAST(v * gain AS FLOAT) AS DOUBLE) END, 5) AS value FROM x JOIN d USING (vec_id)""")
def _(spark, sf):
    out = S.augment(vectors(spark, sf), "embedding", ["vec_id"], 80, noise_prob=0.0)
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5))


@REG.add("augment_log", "WITH " + DRAWS + """
SELECT vec_id, concat_ws('|', printf('shift=%d', shift), printf('gain=%.2f', gain), CASE WHEN noise IS NOT NULL THEN printf('noise=%.4f', noise) END,
  CASE WHEN cut IS NOT NULL THEN 'cutout' END) AS aug_params FROM d""")
def _(spark, sf):
    df = vectors(spark, sf).withColumn("_d", S.augment_draws(["vec_id"], 42))
    return df.select("vec_id", F.expr(S.augment_log("size(embedding)", 80)).alias("aug_params"))


def _mixed_sql(out: str, number: str) -> str:
    """Columns that end in `out`, the counter hash of a number."""
    return (f"{number} AS {out}0, xor({out}0, {out}0 >> 16) * 73244475 % 4294967296 AS {out}1, xor({out}1, {out}1 >> 16) * 73244475 % 4294967296 AS {out}2, "
            f"xor({out}2, {out}2 >> 16) AS {out}")


NOISE_SQL = f""", g AS (SELECT vec_id, (i + shift) % 64 AS pos, v * gain AS v, noise, cut, CAST('0x' || substr(md5(vec_id || '|noise seed|42'), 1, 8) AS BIGINT) AS seed,
  max(abs(v * gain)) OVER (PARTITION BY vec_id) AS peak FROM x JOIN d USING (vec_id)),
u AS (SELECT *, {_mixed_sql("a", "CAST(2 * pos AS BIGINT)")}, {_mixed_sql("b", "(a + seed) % 4294967296")}, {_mixed_sql("c", "CAST(2 * pos + 1 AS BIGINT)")}, {_mixed_sql("e", "(c + seed) % 4294967296")} FROM g),
n AS (SELECT *, v + coalesce(noise * peak * sqrt(-2 * ln((b + 0.5) / 4294967296.0::DOUBLE)) * cos(2 * pi() * ((e + 0.5) / 4294967296.0::DOUBLE)), 0) AS s FROM u)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, noise IS NOT NULL AS noisy, round(CASE WHEN pos >= cut AND pos < cut + 8 THEN 0 ELSE CAST(CAST(s AS FLOAT) AS DOUBLE) END, 5) AS value FROM n"""


@REG.add("augment_with_noise", "WITH " + VALUES + ", " + DRAWS + NOISE_SQL)
def _(spark, sf):
    out = S.augment(vectors(spark, sf), "embedding", ["vec_id"], 80)
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "value"), F.col("aug_params").contains("noise=").alias("noisy")).withColumn(
        "value", F.round(F.col("value").cast("double"), 5))


def wav_files(spark, sf):
    """The vectors as 16-bit WAV bytes, written by the tasks that hold them."""
    @F.pandas_udf("binary")
    def encode(x: pd.Series) -> pd.Series:
        return x.map(lambda v: encode_wav(v, RATE))
    v = vectors(spark, sf)
    return v.select(F.format_string("/rec/%06d.wav", "vec_id").alias("file_path"), encode("embedding").alias("content"), "vec_id")


QUANT = "WITH " + VALUES + ", y AS (SELECT vec_id, i, CAST(round(v * 32767) AS INTEGER) / 32768 AS s FROM x)"


@REG.add("decode_wav", QUANT + " SELECT vec_id, 16000 AS sample_rate, CAST(64 AS BIGINT) AS n_samples, round(sum(s), 6) AS total, round(sum(abs(s)), 6) AS mass FROM y GROUP BY 1")
def _(spark, sf):
    out = R.decode_signals(wav_files(spark, sf), sample_rate=RATE).filter("error is null")
    return out.select("vec_id", "sample_rate", "n_samples", F.round(F.expr(A.total("samples")), 6).alias("total"),
                      F.round(F.expr(A.total("samples", "abs({})".format)), 6).alias("mass"))


@REG.add("decode_errors", "SELECT vec_id, 'sample rate 16000, expected 24000' AS error FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id, 'unreadable' FROM embeddings WHERE label = 3")
def _(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    files = wav_files(spark, sf).join(labels, "vec_id")
    broken = files.withColumn("content", F.when(F.col("label") == 3, F.substring("content", 1, 20)).otherwise(F.col("content")))
    out = R.decode_signals(broken, sample_rate=24_000, convert=False)
    return out.select("vec_id", F.when(F.col("error").startswith("not a readable"), "unreadable").otherwise(F.col("error")).alias("error"))


@REG.add("decode_resampled", "SELECT vec_id, 8000 AS sample_rate, CAST(32 AS BIGINT) AS n_samples FROM embeddings")
def _(spark, sf):
    out = R.decode_signals(wav_files(spark, sf), sample_rate=RATE // 2).filter("error is null")
    return out.select("vec_id", "sample_rate", F.size("samples").cast("long").alias("n_samples"))


@REG.add("catalog_signals_stored", QUANT + " SELECT vec_id, count(*) AS n, round(sum(s), 6) AS total FROM y GROUP BY 1")
def _(spark, sf):
    signals = R.decode_signals(wav_files(spark, sf), sample_rate=RATE).filter("error is null").withColumn("file_id", F.col("vec_id"))
    stored = R.save_signals(signals, scratch_path(spark, "signals"))
    return stored.select("vec_id", F.size("samples").cast("long").alias("n"), F.round(F.expr(A.total("samples")), 6).alias("total"))


# Recordings of two vectors, cut into three segments of SAMPLES samples that overlap by half. As a signal of its own each
# segment has the number 4 * recording + segment.
SEGMENTS = ("pair AS (SELECT vec_id // 2 AS rec, vec_id % 2 * 64 + i AS j, CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 32767) AS INTEGER) / 32768 AS s FROM embeddings, range(64) t(i)), "
            "whole AS (SELECT rec FROM pair GROUP BY 1 HAVING count(*) = 128), "
            "x AS (SELECT rec * 4 + g AS vec_id, CAST(j - 32 * g AS INTEGER) AS i, s AS v FROM pair JOIN whole USING (rec) JOIN range(3) t(g) ON j >= 32 * g AND j < 32 * g + 64)")
PAIRED = M.MetricsConfig(sample_rate=RATE, n_fft=8)
SEGMENT_FACTORS, SEGMENT_METRICS = _all_metrics_sql(SEGMENTS)


def recorded(spark, sf):
    """Every two vectors as one WAV file in a new folder, listed again from there: `rec` and the columns of the inventory."""
    pairs = vectors(spark, sf).groupBy(F.floor(F.col("vec_id") / 2).alias("rec")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    signals = pairs.select(F.format_string("_%07d.wav", "rec").alias("file_name"), F.flatten("v.embedding").alias("samples"), F.lit(RATE).alias("sample_rate"))
    root = scratch_path(spark, "recordings")
    R.write_recordings(signals, root).count()
    return R.scan_files(spark, root).withColumn("rec", F.regexp_extract("file_name", r"(\d+)", 1).cast("long"))


@REG.add("extract_features", f"SELECT vec_id // 4 AS rec, CAST(vec_id % 4 AS INTEGER) AS segment_idx, vec_id % 4 * 32 / 16000 AS offset_sec, 'raw' AS aug_params, * EXCLUDE (vec_id) FROM ({SEGMENT_METRICS})")
def _(spark, sf):
    out = X.extract_features(recorded(spark, sf).select("rec", "file_path", "bytes"), PAIRED, duration=SAMPLES / RATE, overlap=0.5)
    return scaled(out.drop("file_path", "bytes", "copy_ordinal"), 6, **SEGMENT_FACTORS)


@REG.add("feature_run_errors", """
WITH f AS (SELECT vec_id // 2 AS rec, count(*) AS n FROM embeddings GROUP BY 1)
SELECT rec, CASE rec % 5 WHEN 0 THEN 'no such file' WHEN 1 THEN 'no samples' END AS error, CASE WHEN rec % 5 > 1 THEN n * 2 - 1 ELSE 0 END AS segments,
  CAST(sum(CASE WHEN rec % 5 < 2 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS failures FROM f""")
def _(spark, sf):
    """A fifth of the recordings is missing and a fifth is empty; both tables come from one pass."""
    files = recorded(spark, sf)
    empty = R.write_recordings(files.filter("rec % 5 = 1").select("file_name", F.array().cast("array<float>").alias("samples"), F.lit(RATE).alias("sample_rate")), scratch_path(spark, "empty"))
    bad = empty.select("file_path", F.regexp_extract("file_path", r"_(\d+)\.wav", 1).cast("long").alias("rec"), "bytes")
    wanted = files.select(F.when(F.col("rec") % 5 == 0, F.concat("file_path", F.lit(".gone"))).otherwise(F.col("file_path")).alias("file_path"), "rec", "bytes").filter("rec % 5 <> 1").unionByName(bad)
    run = X.feature_run(wanted, PAIRED, duration=SAMPLES / RATE, overlap=0.5)
    good = run.features.groupBy("rec").agg(F.count("*").alias("segments")).withColumn("error", F.lit(None).cast("string"))
    failed = run.errors.select("rec", F.lit(0).cast("long").alias("segments"), "error")
    return good.unionByName(failed).withColumn("failures", F.lit(run.failures))


@REG.add("extract_features_balanced", "WITH s AS (" + _split_sql(["label"], 0.1, 0.1, "embeddings", "vec_id") + """),
n AS (SELECT label, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1), m AS (SELECT max(n) AS most FROM n)
SELECT 'c' || label AS category, false AS should_augment, 3 * n AS segments, n AS recordings FROM n
UNION ALL SELECT 'c' || label, true, 3 * (most - n), most - n FROM n, m WHERE n < most""")
def _(spark, sf):
    from pluvio.operators.sampling import balance_with_copies, split_dataset
    root = scratch_path(spark, "recordings")
    named = table(spark, sf, "embeddings").select(F.format_string("%06d.wav", "vec_id").alias("file_name"), F.col("embedding").alias("samples"), F.lit(RATE).alias("sample_rate"))
    R.write_recordings(named, root).count()
    ids = R.scan_files(spark, root).select("file_path", "bytes", F.regexp_extract("file_name", r"(\d+)", 1).cast("long").alias("vec_id"))
    meta = ids.join(table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("c"), "label").alias("category")), "vec_id")
    parts = split_dataset(meta, ["vec_id"], 0.1, 0.1, ["category"])
    train = balance_with_copies(parts.filter("split = 'train'"), "category", [f"c{i}" for i in range(10)], ["vec_id"])
    out = X.extract_features(train, PAIRED, duration=32 / RATE)
    return out.groupBy("category", "should_augment").agg(F.count("*").alias("segments"), F.countDistinct("vec_id", "copy_ordinal").alias("recordings"))


@REG.add("recording_inventory", """
WITH f AS (SELECT vec_id, vec_id % 6 AS kind, printf('%06d', vec_id) AS n FROM embeddings)
SELECT CASE kind WHEN 0 THEN '_' || n || '.wav' WHEN 1 THEN '.' || n || '.WAV' ELSE n || CASE kind WHEN 2 THEN '.Wav' WHEN 3 THEN '.flac' ELSE '.wav' END END AS file_name,
  CASE kind WHEN 3 THEN '.flac' ELSE '.wav' END AS extension, 'site' AS location, CASE kind WHEN 0 THEN 0 ELSE vec_id % 50 END AS bytes,
  CASE kind WHEN 0 THEN '_deep/_er' WHEN 1 THEN 'plain' WHEN 2 THEN 'plain' ELSE 'd' || (vec_id % 40) END AS folder FROM f WHERE kind < 5""")
def _(spark, sf):
    """Files of all kinds of names in visible and hidden folders, some without a byte, listed again."""
    kind, number = F.col("vec_id") % 6, F.format_string("%06d", "vec_id")
    suffix = F.when(kind == 2, ".Wav").when(kind == 3, ".flac").when(kind == 4, ".wav").otherwise(".txt")
    name = F.when(kind == 0, F.concat(F.lit("_deep/_er/_"), number, F.lit(".wav"))).when(kind == 1, F.concat(F.lit("plain/."), number, F.lit(".WAV"))).when(
        kind == 2, F.concat(F.lit("plain/"), number, suffix)).otherwise(F.concat(F.lit("d"), (F.col("vec_id") % 40).cast("string"), F.lit("/"), number, suffix))
    size = F.when(kind == 0, 0).otherwise(F.col("vec_id") % 50).cast("int")
    rows = vectors(spark, sf).select(name.alias("file_name"), F.repeat(F.lit("x"), size).cast("binary").alias("content"))
    root = scratch_path(spark, "inventory")
    hidden = rows.withColumn("file_name", F.concat(F.lit(".hidden/"), "file_name"))
    R.write_contents(rows.union(hidden), root).count()
    listed = R.scan_files(spark, root, [".wav", ".FLAC"], location="site")
    return listed.select("file_name", "extension", "location", "bytes", F.regexp_extract("file_path", "inventory-[0-9a-f]+/(.*)/[^/]+$", 1).alias("folder"))


@REG.add("catalog_signals_by_path", """
SELECT vec_id // 2 AS rec, substr(sha256(printf('_%07d.wav', vec_id // 2) || '_dev_'), 1, 16) AS audio_id, 16000 AS sample_rate, count(*) * 64 AS n_samples,
  round(sum(list_sum([round(CAST(x AS DOUBLE) * 32767) / 32768 FOR x IN embedding])), 5) AS total FROM embeddings WHERE vec_id // 2 % 3 > 0 GROUP BY 1""")
def _(spark, sf):
    """The catalog's recordings, each opened by its path; a third of them is gone."""
    from pluvio.functions.scalars import hash_id
    files = recorded(spark, sf).withColumn("device", F.lit("dev"))
    lost = F.when(F.col("rec") % 3 == 0, F.concat("file_path", F.lit(".gone"))).otherwise(F.col("file_path"))
    catalog = files.select(hash_id("file_name", "device").alias("audio_id"), "file_name", F.lit(RATE).alias("sample_rate"), lost.alias("file_path"), "rec")
    out = R.catalog_signals(catalog, RATE)
    return out.select("rec", "audio_id", "sample_rate", F.size("samples").cast("long").alias("n_samples"), F.round(F.expr(A.total("samples")), 5).alias("total"))


@REG.add("non_finite_to_null", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem""")
def _(spark, sf):
    raw = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(finite(raw), 6).alias("ratio"))


STREAM_SQL = """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, event_type, value FROM events, range(4) t(k)),
m AS (SELECT max(ts) AS last FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sqrt(avg(value * value)), 5) AS rms, round(avg(abs(value)), 5) AS mae, min(value) AS min, max(value) AS max
FROM w, m WHERE start >= TIMESTAMP '2024-01-01' AND start + INTERVAL 24 HOUR <= last - INTERVAL 1 HOUR GROUP BY ALL"""


def _shown(df):
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("rms", 5).alias("rms"),
                     F.round("mae", 5).alias("mae"), "min", "max")


@REG.add("sliding_windows_batch", STREAM_SQL)
def _(spark, sf):
    ev = table(spark, sf, "events")
    last = ev.agg((F.max("ts") - F.expr("interval 1 hour")).alias("m")).scalar()
    return _shown(W.closed_before(W.window_stats(ev, "ts", ["event_type"], "value", "24 hours", "6 hours", "2024-01-01"), last))


@REG.add("sliding_windows_stream", STREAM_SQL)
def _(spark, sf):
    schema = table(spark, sf, "events").schema
    out = W.stream_window_stats(spark, sf, schema, scratch_path(spark, "windows"), scratch_path(spark, "windows-state"), "ts",
                                ["event_type"], "value", "24 hours", "6 hours", "1 hour", "2024-01-01", glob="events.parquet")
    return _shown(out)
