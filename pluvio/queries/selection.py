"""Feature statistics and selection on line items (four features) and embeddings (64 features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvio.operators import profiles as P
from pluvio.operators import selection as G
from pluvio.queries.base import Registry, table

REG = Registry()

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIMS = [f"e{i:02d}" for i in range(64)]
EMB_LONG = "SELECT vec_id, label, 'e' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i)"
LI_LONG = " UNION ALL ".join(f"SELECT l_returnflag AS label, '{f}' AS feature, {f} AS value FROM lineitem" for f in LI)
# gaps as the imputer sees them: discount 0 is missing, tax is missing everywhere
GAPS = "(SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, nullif(l_discount, 0) AS l_discount, l_extendedprice FROM lineitem)"


def wide_embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", *[F.expr(f"double(get(embedding, {i}))").alias(n) for i, n in enumerate(DIMS)])


def gappy(spark, sf):
    li = table(spark, sf, "lineitem")
    zero = F.col("l_discount") == 0
    return li.withColumns({"l_discount": F.when(zero & (F.col("l_quantity") > 25), F.lit(float("inf"))).when(zero, F.lit(float("nan"))).otherwise(F.col("l_discount")),
                           "l_tax": F.lit(None).cast("double")})


@REG.add("impute_medians", f"""
WITH g AS {GAPS}, m AS (SELECT quantile_cont(l_discount, 0.5) AS d FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, coalesce(l_discount, d) AS l_discount FROM g, m""")
def _(spark, sf):
    df = gappy(spark, sf)
    fitted = G.Imputer.fit(df, LI)
    return fitted.transform(df).select("l_orderkey", "l_linenumber", "l_partkey", *fitted.features)


def _f_sql(long):
    return f"""WITH s AS ({long}), c AS (SELECT feature, label, count(*) AS n, avg(value) AS mu, var_pop(value) * count(*) AS ss FROM s GROUP BY ALL),
g AS (SELECT feature, avg(value) AS grand FROM s GROUP BY feature)
SELECT feature, round((sum(n * (mu - grand) * (mu - grand)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 6) AS score
FROM c JOIN g USING (feature) GROUP BY feature"""


@REG.add("anova_f_lineitem", _f_sql(LI_LONG))
def _(spark, sf):
    return G.f_scores(table(spark, sf, "lineitem"), LI, "l_returnflag").withColumn("score", F.round("score", 6))


@REG.add("anova_f_embeddings", _f_sql(EMB_LONG))
def _(spark, sf):
    return G.f_scores(wide_embeddings(spark, sf), DIMS, "label").withColumn("score", F.round("score", 6))


PICK_SQL = f"""WITH f AS ({_f_sql(EMB_LONG)}), l AS (SELECT quantile_cont(score, 0.4) AS cut FROM f)
SELECT feature AS "Feature_Name", score AS "Fisher_Score", CAST(NULL AS DOUBLE) AS "Gini_Importance", CAST(score > cut AS INTEGER) AS "Survived_Pipeline" FROM f, l"""


@REG.add("selector_report", PICK_SQL)
def _(spark, sf):
    df = wide_embeddings(spark, sf)
    return G.VectorSelector(60).fit(df, DIMS, "label").report(df).withColumn("Fisher_Score", F.round("Fisher_Score", 6))


@REG.add("selector_transform", f"""
WITH f AS ({_f_sql(EMB_LONG)}), l AS (SELECT quantile_cont(score, 0.4) AS cut FROM f), k AS (SELECT feature FROM f, l WHERE score > cut),
e AS ({EMB_LONG}), m AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM e GROUP BY 1)
SELECT vec_id, label, feature, round((value - mu) / sd, 6) AS value FROM e JOIN m USING (feature) WHERE feature IN (SELECT feature FROM k)""")
def _(spark, sf):
    df = wide_embeddings(spark, sf)
    fitted = G.VectorSelector(60).fit(df, DIMS, "label")
    return P.long_features(fitted.transform(df), ["vec_id", "label"], fitted.selected).withColumn("value", F.round("value", 6))


@REG.add("single_feature_baseline", """
SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS l_extendedprice FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    fitted = G.SingleSelector("l_extendedprice").fit(df, LI, "l_returnflag")
    out = fitted.transform(df, ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@REG.add("standardise", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"round(({f} - (SELECT avg({f}) FROM lineitem)) / (SELECT stddev_pop({f}) FROM lineitem), 6) AS {f}" for f in LI) + " FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    out = G.Standardiser.fit(df, LI).transform(df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(f, 6).alias(f) for f in LI])


def _corr_sql(long, absolute="abs"):
    return f"""WITH s AS ({long}) SELECT a.feature AS feature_i, b.feature AS feature_j, round({absolute}(corr(a.value, b.value)), 6) AS corr
FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY 1, 2"""


@REG.add("correlation_matrix", _corr_sql(EMB_LONG))
def _(spark, sf):
    out = G.correlation_pairs(wide_embeddings(spark, sf), DIMS)
    return out.select("feature_i", "feature_j", F.round(F.abs("corr"), 6).alias("corr"))


@REG.add("collinear_drop", f"""
WITH c AS ({_corr_sql(EMB_LONG)}), d AS (SELECT DISTINCT feature_j FROM c WHERE corr > 0.15)
SELECT feature, CASE WHEN feature IN (SELECT feature_j FROM d) THEN 'Discarded' ELSE 'Selected' END AS status FROM (SELECT DISTINCT feature FROM ({EMB_LONG}))""")
def _(spark, sf):
    df = wide_embeddings(spark, sf)
    kept = G.drop_collinear(df, DIMS, 0.15)
    names = spark.createDataFrame([(d,) for d in DIMS], "feature string")
    return G.selection_status(names, kept)


@REG.add("correlation_before_after", f"""
WITH c AS ({_corr_sql(EMB_LONG)}), d AS (SELECT DISTINCT feature_j FROM c WHERE corr > 0.15)
SELECT count(*) AS pairs_before, round(max(corr), 6) AS max_before, count(*) FILTER (WHERE k) AS pairs_after, round(max(corr) FILTER (WHERE k), 6) AS max_after
FROM (SELECT corr, feature_i NOT IN (SELECT feature_j FROM d) AND feature_j NOT IN (SELECT feature_j FROM d) AS k FROM c)""")
def _(spark, sf):
    pairs = G.correlation_pairs(wide_embeddings(spark, sf), DIMS)
    dropped = G.collinear_features(pairs, 0.15)
    kept = ~F.col("feature_i").isin(dropped) & ~F.col("feature_j").isin(dropped)
    v = F.abs("corr")
    return pairs.agg(F.count("*").alias("pairs_before"), F.round(F.max(v), 6).alias("max_before"),
                     F.count_if(kept).alias("pairs_after"), F.round(F.max(F.when(kept, v)), 6).alias("max_after"))


ODD = [*DIMS, "flat", "twin", "apart"]
ODD_LONG = EMB_LONG + """ UNION ALL SELECT vec_id, label, 'flat', 3.0 FROM embeddings UNION ALL SELECT vec_id, label, 'twin', 2 * CAST(embedding[4] AS DOUBLE) + 1 FROM embeddings
UNION ALL SELECT vec_id, label, 'apart', CAST(label AS DOUBLE) FROM embeddings"""


def odd_embeddings(spark, sf):
    """The vectors with a constant feature, one that follows `e03`, and one that tells the classes apart without an error."""
    return wide_embeddings(spark, sf).withColumns({"flat": F.lit(3.0), "twin": F.col("e03") * 2 + 1, "apart": F.col("label").cast("double")})


@REG.add("anova_f_edge_scores", f"""WITH s AS ({ODD_LONG}), c AS (SELECT feature, label, count(*) AS n, avg(value) AS mu, var_pop(value) * count(*) AS ss FROM s GROUP BY ALL),
g AS (SELECT feature, avg(value) AS grand FROM s GROUP BY feature),
t AS (SELECT feature, sum(n * (mu - grand) * (mu - grand)) / (count(*) - 1) AS top, sum(ss) / (sum(n) - count(*)) AS bottom FROM c JOIN g USING (feature) GROUP BY feature)
SELECT feature, CASE WHEN bottom > 0 THEN round(top / bottom, 6) WHEN top > 0 THEN 1.7976931348623157e308 ELSE 0 END AS score FROM t""")
def _(spark, sf):
    report = G.VectorSelector(60).fit(odd_embeddings(spark, sf), ODD, "label").report(table(spark, sf, "embeddings"))
    score = F.when(F.col("Fisher_Score") > 1e300, F.col("Fisher_Score")).otherwise(F.round("Fisher_Score", 6))
    return report.select(F.col("Feature_Name").alias("feature"), score.alias("score"))


@REG.add("zero_variance_drop", f"""
WITH s AS ({ODD_LONG}) SELECT feature, CAST(var_pop(value) > 0 AS INTEGER) AS survived FROM s GROUP BY 1""")
def _(spark, sf):
    df = odd_embeddings(spark, sf)
    report = G.VectorSelector(100, drop_constant=True).fit(df, ODD, "label").report(df)
    return report.select(F.col("Feature_Name").alias("feature"), F.col("Survived_Pipeline").alias("survived"))


@REG.add("selector_steps", f"""WITH s AS ({ODD_LONG}), o AS (SELECT feature, CASE feature WHEN 'flat' THEN 64 WHEN 'twin' THEN 65 WHEN 'apart' THEN 66 ELSE CAST(substr(feature, 2) AS INTEGER) END AS i FROM (SELECT DISTINCT feature FROM s)),
c AS (SELECT a.feature AS f, b.feature AS g, abs(corr(a.value, b.value)) AS r FROM s a JOIN s b USING (vec_id) JOIN o x ON x.feature = a.feature JOIN o y ON y.feature = b.feature
      WHERE x.i < y.i AND a.feature <> 'flat' AND b.feature <> 'flat' GROUP BY 1, 2),
d AS (SELECT DISTINCT g FROM c WHERE r > 0.85)
SELECT feature, CAST(feature <> 'flat' AND feature NOT IN (SELECT g FROM d) AS INTEGER) AS entered, true AS sums_to_one, true AS best_half FROM o""")
def _(spark, sf):
    """All optional steps: the forest sees what the other steps leave, and keeps features of at least mean importance."""
    df = odd_embeddings(spark, sf)
    fitted = G.VectorSelector(100, drop_constant=True, corr_threshold=0.85, forest={"n_estimators": 100, "max_depth": 10}).fit(df, ODD, "label")
    report, gini = fitted.report(df), F.col("Gini_Importance")
    facts = report.agg(F.sum(gini).alias("s"), F.avg(gini).alias("m")).first()
    return report.select(F.col("Feature_Name").alias("feature"), gini.isNotNull().cast("int").alias("entered"), F.lit(abs(facts["s"] - 1) < 1e-9).alias("sums_to_one"),
                         (F.coalesce(gini >= facts["m"], F.lit(False)) == (F.col("Survived_Pipeline") == 1)).alias("best_half"))


@REG.add("top_feature_scores", _f_sql(EMB_LONG) + " ORDER BY score DESC, feature LIMIT 20")
def _(spark, sf):
    scores = G.f_scores(wide_embeddings(spark, sf), DIMS, "label").withColumn("score", F.round("score", 6))
    return P.top_scores(scores, "score", "feature", 20)
