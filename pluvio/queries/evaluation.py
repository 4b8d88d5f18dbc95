"""Evaluation tables on predictions that a fixed rule derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvio.operators import evaluation as E
from pluvio.operators import selection as G
from pluvio.queries.base import Registry, table
from pluvio.session import scratch_path

REG = Registry()

K = 10
# multi-class: the predicted label is the position of the largest of the first ten components
MULTI = """WITH e AS (SELECT vec_id, label, embedding[1:10] AS v FROM embeddings),
p AS (SELECT vec_id, label, v, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS prediction FROM e)"""


def multi(spark, sf):
    v = F.slice("embedding", 1, K)
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", (F.array_position(v, F.array_max(v)) - 1).cast("int").alias("prediction"), v.alias("v"))


def multi_scores():
    return [F.get("v", F.lit(i)).cast("double") for i in range(K)]


# binary: long documents are called good
BINARY = """WITH p AS (SELECT doc_id, quality AS label, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS prediction,
  CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"""


def binary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("prediction"),
        F.col("n_chars").cast("double").alias("score"))


def r6(df, *names):
    return df.withColumns({n: F.round(F.col(f"`{n}`"), 6) for n in names})


PER = """, k AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p),
m AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp, count(*) FILTER (WHERE prediction = c) AS predicted,
  count(*) FILTER (WHERE label = c) AS support FROM k, p GROUP BY c),
s AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1 FROM m)"""


@REG.add("confusion_matrix", MULTI + """, g AS (SELECT CAST(a AS INTEGER) AS label, CAST(a AS INTEGER) AS label_ord, CAST(b AS INTEGER) AS prediction,
  CAST(b AS INTEGER) AS prediction_ord FROM range(10) x(a), range(10) y(b)),
j AS (SELECT g.*, count(p.vec_id) AS n FROM g LEFT JOIN p ON g.label = p.label AND g.prediction = p.prediction GROUP BY ALL)
SELECT *, round(CASE WHEN sum(n) OVER (PARTITION BY label) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY label) END, 6) AS share FROM j""")
def _(spark, sf):
    return r6(E.confusion_matrix(multi(spark, sf), list(range(K))), "share")


@REG.add("f1_averages", MULTI + PER + """SELECT round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
  round(sum(tp) / sum(support), 6) AS f1_micro, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted,
  round(sum(tp) / sum(support), 6) AS accuracy FROM s""")
def _(spark, sf):
    out = E.f1_summary(multi(spark, sf))
    return r6(out, *out.columns)


@REG.add("class_report", BINARY + PER + """SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT round(sum(tp) / sum(support), 6) AS a, CAST(sum(support) AS BIGINT) AS n FROM s)
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""")
def _(spark, sf):
    return r6(E.class_report(binary(spark, sf)), "precision", "recall", "f1")


CURVE = """, t AS (SELECT c, score, sum(pos) AS pos, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT c, score, pos, n, sum(pos) OVER r AS cum_pos, sum(n) OVER r AS cum_n, sum(pos) OVER (PARTITION BY c) AS positives FROM t
      WINDOW r AS (PARTITION BY c ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
MULTI_LONG = MULTI + """, l AS (SELECT CAST(i AS VARCHAR) AS c, CAST(v[i + 1] AS DOUBLE) AS score, CAST(label = i AS INTEGER) AS pos FROM p, range(10) t(i))"""


@REG.add("pr_curve_binary", BINARY + ", l AS (SELECT '1' AS c, score, label AS pos FROM p)" + CURVE + """
SELECT c AS class, score, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_n AS BIGINT) AS cum_n, round(cum_pos / cum_n, 6) AS precision, round(cum_pos / positives, 6) AS recall FROM w""")
def _(spark, sf):
    long = E.score_rows(binary(spark, sf), [1], "label", ["score"])
    return r6(E.pr_curve(long).select("class", "score", "cum_pos", "cum_n", "precision", "recall"), "precision", "recall")


@REG.add("pr_auc_binary", BINARY + ", l AS (SELECT '1' AS c, score, label AS pos FROM p)" + CURVE + """
SELECT a AS pr_auc_macro, a AS pr_auc_micro, a AS pr_auc_weighted FROM (SELECT round(sum(pos / positives * cum_pos / cum_n), 6) AS a FROM w)""")
def _(spark, sf):
    out = E.pr_auc_summary(binary(spark, sf), [0, 1], "label", [-F.col("score"), F.col("score")])
    return r6(out, *out.columns)


@REG.add("average_precision_per_class", MULTI_LONG + CURVE + """
SELECT c AS class, round(sum(pos / positives * cum_pos / cum_n), 6) AS average_precision, CAST(max(positives) AS BIGINT) AS support FROM w GROUP BY c""")
def _(spark, sf):
    return r6(E.average_precision(E.score_rows(multi(spark, sf), range(K), "label", multi_scores())), "average_precision")


@REG.add("pr_auc_multiclass", MULTI_LONG.replace(", l AS (", ", l0 AS (") + """, l AS (SELECT * FROM l0 UNION ALL SELECT 'all', score, pos FROM l0)""" + CURVE + """,
a AS (SELECT c, sum(pos / positives * cum_pos / cum_n) AS ap, max(positives) AS sup FROM w GROUP BY c)
SELECT round(avg(ap) FILTER (WHERE c <> 'all'), 6) AS pr_auc_macro, round(max(ap) FILTER (WHERE c = 'all'), 6) AS pr_auc_micro,
  round(sum(ap * sup) FILTER (WHERE c <> 'all') / sum(sup) FILTER (WHERE c <> 'all'), 6) AS pr_auc_weighted FROM a""")
def _(spark, sf):
    out = E.pr_auc_summary(multi(spark, sf), range(K), "label", multi_scores())
    return r6(out, *out.columns)


@REG.add("pr_curve_thinned", MULTI_LONG + CURVE + """, x AS (SELECT *, cum_pos / positives AS recall, cum_pos / cum_n AS precision FROM w)
SELECT c AS class, CAST(floor(recall * 10) AS BIGINT) AS slot, round(arg_max(score, cum_n), 6) AS score, round(arg_max(precision, cum_n), 6) AS precision,
  round(arg_max(recall, cum_n), 6) AS recall FROM x GROUP BY ALL""")
def _(spark, sf):
    curve = E.pr_curve(E.score_rows(multi(spark, sf), range(K), "label", multi_scores()))
    return r6(E.thinned_curve(curve, 10), "score", "precision", "recall")


@REG.add("result_sheet", MULTI_LONG + PER.replace(", s AS (", ", sx AS (").replace("\ns AS (", "\ns AS (") + CURVE + """,
a AS (SELECT c, sum(pos / positives * cum_pos / cum_n) AS ap FROM w GROUP BY c), j AS (SELECT s.*, a.ap FROM s JOIN a ON CAST(s.c AS VARCHAR) = a.c)
SELECT 'RULE' AS "Algoritmo", round(avg(f1), 6) AS "F1_Macro_Global", round(max(f1) FILTER (WHERE c = 0), 6) AS "F1_Dry", round(avg(f1) FILTER (WHERE c <> 0), 6) AS "F1_Macro_Wet",
  round(avg(precision), 6) AS "Precision_Macro", round(avg(recall), 6) AS "Recall_Macro", round(sum(tp) / sum(support), 6) AS "Accuracy", round(avg(ap), 6) AS "PR_AUC_Macro",
""" + ", ".join(f"""round(max(f1) FILTER (WHERE c = {i}), 6) AS "{i}_F1", round(max(precision) FILTER (WHERE c = {i}), 6) AS "{i}_Precision",
  round(max(recall) FILTER (WHERE c = {i}), 6) AS "{i}_Recall", round(max(ap) FILTER (WHERE c = {i}), 6) AS "{i}_PR_AUC\"""" for i in range(K))
         + """, '{}' AS "Hiperparametros", 'v' AS "Lista_Features" FROM j""")
def _(spark, sf):
    out = E.result_sheet(multi(spark, sf), list(range(K)), "label", "prediction", multi_scores(), "0", "RULE", "{}", "v")
    return r6(out, *[c for c in out.columns if c not in ("Algoritmo", "Hiperparametros", "Lista_Features")])


@REG.add("run_log", BINARY + PER + """SELECT 'RULE' AS "Algorithm", 'dry/wet' AS "Content", '2' AS "Granularity", d AS "Domain", 'macro' AS average,
  round((SELECT avg(f1) FROM s), 6) AS f1_macro, CAST(NULL AS DOUBLE) AS pr_auc_macro FROM (VALUES ('A'), ('B')) t(d)""")
def _(spark, sf):
    summary = E.f1_summary(binary(spark, sf))
    path = scratch_path(spark, "runs")
    E.append_run(E.run_row(summary, "rule", "dry/wet", "2", "A"), path)
    return r6(E.append_run(E.run_row(summary, "rule", "dry/wet", "2", "B"), path), "f1_macro")


@REG.add("balanced_class_weights", """
SELECT vec_id, label, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label)), 8) AS weight FROM embeddings""")
def _(spark, sf):
    from pluvio.operators.models import with_class_weights
    return r6(with_class_weights(table(spark, sf, "embeddings").select("vec_id", "label"), "label"), ).withColumn("weight", F.round("weight", 8))


def _survivors_sql() -> str:
    from pluvio.queries.selection import EMB_LONG, _f_sql
    one = lambda g: f"""SELECT {g} AS granularity, count(*) AS survivors FROM (SELECT score, quantile_cont(score, 0.4) OVER () AS cut FROM (
{_f_sql("SELECT vec_id, label % " + str(g) + " AS label, feature, value FROM (" + EMB_LONG + ")")})) WHERE score > cut"""  # noqa: E731
    return " UNION ALL ".join(one(g) for g in (2, 3, 5))


@REG.add("survivors_per_granularity", _survivors_sql())
def _(spark, sf):
    """The selector's reports for three merges of the classes, and how many features survive each."""
    from pluvio.operators.profiles import survivor_counts
    from pluvio.operators.selection import VectorSelector
    from pluvio.queries.selection import DIMS, wide_embeddings
    df, reports = wide_embeddings(spark, sf), None
    for g in (2, 3, 5):
        merged = df.withColumn("label", F.col("label") % g)
        one = VectorSelector(60).fit(merged, DIMS, "label").report(merged).withColumn("granularity", F.lit(g))
        reports = one if reports is None else reports.unionByName(one)
    return survivor_counts(reports)
