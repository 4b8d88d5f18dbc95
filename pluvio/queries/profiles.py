"""Summary tables on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvio.functions import scalars as S
from pluvio.operators import profiles as P
from pluvio.queries.base import Registry, table

REG = Registry()

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def monthly(spark, sf):
    return table(spark, sf, "orders").select(
        F.date_format(S.month_key("o_orderdate"), "yyyy-MM").alias("month"), "o_orderpriority", "o_totalprice")


def _cells(classes, col, expr='count(*) FILTER (WHERE {c} = \'{v}\') AS "{v}"'):
    return ", ".join(expr.format(c=col, v=v) for v in classes)


@REG.add("class_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return P.class_counts(table(spark, sf, "events"), "event_type")


@REG.add("class_composition", """
WITH dim(event_type, ord) AS (VALUES ('view', 0), ('click', 1), ('hail', 2), ('error', 3)),
     c AS (SELECT d.event_type, d.ord, count(e.event_id) AS n FROM dim d LEFT JOIN events e USING (event_type) GROUP BY 1, 2)
SELECT event_type, ord, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(n / sum(n) OVER (), 6) AS share, round(n * 100 / sum(n) OVER (), 4) AS percent FROM c""")
def _(spark, sf):
    out = P.composition(table(spark, sf, "events"), "event_type", ["view", "click", "hail", "error"])
    return out.withColumns({"share": F.round("share", 6), "percent": F.round("percent", 4)})


@REG.add("month_class_crosstab", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, {_cells(PRIORITIES + ["6-NONE"], "o_orderpriority")} FROM orders GROUP BY 1""")
def _(spark, sf):
    return P.crosstab(monthly(spark, sf), "month", "o_orderpriority", PRIORITIES + ["6-NONE"])


QUANTITY = f"""SELECT CASE WHEN grouping(month) = 1 THEN 'TOTAL' ELSE month END AS month, CAST(grouping(month) AS INTEGER) AS is_total,
  {_cells(PRIORITIES, "o_orderpriority")}, count(*) AS "Row Total"
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority FROM orders) GROUP BY GROUPING SETS ((month), ())"""


@REG.add("monthly_quantity_matrix", QUANTITY)
def _(spark, sf):
    out = P.quantity_matrix(monthly(spark, sf), "month", "o_orderpriority", PRIORITIES)
    return out.withColumn("is_total", F.col("is_total").cast("int"))


def _percent_sql(classes):
    listed = ", ".join(f"'{v}'" for v in classes)
    cells = ", ".join(f"round(count(*) FILTER (WHERE o_orderpriority = '{v}') * 100 / count(*), 4) AS \"{v}\"" for v in classes)
    return f"""SELECT CASE WHEN grouping(month) = 1 THEN 'TOTAL %' ELSE month END AS month, {cells},
  round(count(*) * 100 / max(count(*)) OVER (), 4) AS "Month/Total %"
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority FROM orders WHERE o_orderpriority IN ({listed}))
GROUP BY GROUPING SETS ((month), ())"""


@REG.add("monthly_percent_matrix", _percent_sql(PRIORITIES))
def _(spark, sf):
    return P.percent_matrix(monthly(spark, sf), "month", "o_orderpriority", PRIORITIES).drop("is_total")


@REG.add("monthly_percent_matrix_rain_only", _percent_sql(PRIORITIES[:4]))
def _(spark, sf):
    return P.percent_matrix(monthly(spark, sf), "month", "o_orderpriority", PRIORITIES[:4]).drop("is_total")


@REG.add("majority_class", """
SELECT event_type AS majority, n AS n_max FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1)
ORDER BY n DESC, event_type LIMIT 1""")
def _(spark, sf):
    return P.majority_class(table(spark, sf, "events"), "event_type", ["view", "click", "error"])


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul"]


@REG.add("month_status_grid", """
WITH m(month_name, ord) AS (VALUES ('Jan', 0), ('Feb', 1), ('Mar', 2), ('Apr', 3), ('May', 4), ('Jun', 5), ('Jul', 6)),
     s(status) AS (VALUES ('Wet (Rain)'), ('Dry (No Rain)'), ('Unknown'))
SELECT m.month_name, m.ord, s.status, count(e.event_id) AS n FROM m CROSS JOIN s
LEFT JOIN (SELECT event_id, strftime(ts, '%b') AS month_name, CASE WHEN value > 20 THEN 'Wet (Rain)' ELSE 'Dry (No Rain)' END AS status FROM events) e
  ON e.month_name = m.month_name AND e.status = s.status GROUP BY 1, 2, 3""")
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.date_format("ts", "MMM").alias("month_name"),
                                           F.when(F.col("value") > 20, "Wet (Rain)").otherwise("Dry (No Rain)").alias("status"))
    return P.grid_counts(ev, "month_name", MONTHS, "status", ["Wet (Rain)", "Dry (No Rain)", "Unknown"])


@REG.add("rare_event_share", """
SELECT count(value) AS total, count(*) FILTER (WHERE value >= 4.17) AS n_rare, max(value) AS max_value,
       round(count(*) FILTER (WHERE value >= 4.17) * 100 / count(value), 4) AS percent_rare FROM events""")
def _(spark, sf):
    return P.rare_event_share(table(spark, sf, "events"), "value").withColumn("percent_rare", F.round("percent_rare", 4))


def _box_sql(by, value, source):
    return f"""WITH s AS (SELECT {by}, {value} AS x FROM {source}),
q AS (SELECT {by}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY {by})
SELECT s.{by}, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*) AS n,
  round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM s JOIN q ON s.{by} = q.{by} GROUP BY ALL"""


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


def rounded(df, names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@REG.add("box_stats_by_month", _box_sql("month", "o_totalprice", "(SELECT strftime(o_orderdate, '%Y-%m') AS month, o_totalprice FROM orders)"))
def _(spark, sf):
    return rounded(P.box_stats(monthly(spark, sf), ["month"], "o_totalprice"), BOX)


@REG.add("box_stats_by_type", _box_sql("event_type", "value", "events"))
def _(spark, sf):
    return rounded(P.box_stats(table(spark, sf, "events"), ["event_type"], "value"), BOX)


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG_SQL = " UNION ALL ".join(f"SELECT l_returnflag, '{f}' AS feature, {f} AS value FROM lineitem" for f in LI)


@REG.add("box_stats_features_by_class", f"""
WITH s AS ({LONG_SQL}), q AS (SELECT l_returnflag, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM s GROUP BY ALL)
SELECT l_returnflag, feature, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*) AS n,
  round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM s JOIN q USING (l_returnflag, feature) GROUP BY ALL""")
def _(spark, sf):
    long = P.long_features(table(spark, sf, "lineitem"), ["l_returnflag"], LI)
    return rounded(P.box_stats(long, ["l_returnflag", "feature"], "value"), BOX)


@REG.add("scaled_quartiles_by_class", f"""
WITH s AS ({LONG_SQL}), m AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM s GROUP BY feature)
SELECT l_returnflag, feature, round(quantile_cont((value - mu) / sd, 0.25), 5) AS q1, round(quantile_cont((value - mu) / sd, 0.5), 5) AS median,
  round(quantile_cont((value - mu) / sd, 0.75), 5) AS q3 FROM s JOIN m USING (feature) GROUP BY ALL""")
def _(spark, sf):
    from pluvio.operators.ranks import exact_quantiles
    from pluvio.operators.selection import Standardiser
    li = table(spark, sf, "lineitem")
    scaled = Standardiser.fit(li, LI).transform(li)
    long = P.long_features(scaled, ["l_returnflag"], LI)
    q = exact_quantiles(long, ["l_returnflag", "feature"], "value", [0.25, 0.5, 0.75])
    pick = lambda p, n: F.round(F.max(F.when(F.col("prob") == p, F.col("quantile"))), 5).alias(n)
    return q.groupBy("l_returnflag", "feature").agg(pick(0.25, "q1"), pick(0.5, "median"), pick(0.75, "q3"))


RUNS_SQL = """(SELECT upper(o_orderpriority) AS "Algorithm", 'G' || CAST(year(o_orderdate) % 3 AS VARCHAR) AS "Granularity",
  CASE WHEN o_custkey % 2 = 0 THEN 'site A' ELSE 'site B' END AS "Domain", o_totalprice / 1000000 AS f1 FROM orders)"""


def _runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.upper("o_orderpriority").alias("Algorithm"), F.concat(F.lit("G"), (F.year("o_orderdate") % 3).cast("string")).alias("Granularity"),
        F.when(F.col("o_custkey") % 2 == 0, "site A").otherwise("site B").alias("Domain"), (F.col("o_totalprice") / 1000000).alias("f1"))


@REG.add("result_pivot", f"""
SELECT "Algorithm", {", ".join(f"round(avg(f1) FILTER (WHERE \"Granularity\" = '{g}'), 6) AS {g}" for g in ["G0", "G1", "G2"])} FROM {RUNS_SQL} GROUP BY 1""")
def _(spark, sf):
    means = _runs(spark, sf).groupBy("Algorithm", "Granularity").agg(F.avg("f1").alias("f1"))
    return rounded(P.result_pivot(means, "Algorithm", "Granularity", ["G0", "G1", "G2"], "f1"), ["G0", "G1", "G2"], 6)


@REG.add("domain_means", f"""
SELECT "Algorithm", round(a, 6) AS "site A", round(b, 6) AS "site B", round(a - b, 6) AS gap FROM (
SELECT "Algorithm", avg(f1) FILTER (WHERE "Domain" = 'site A') AS a, avg(f1) FILTER (WHERE "Domain" = 'site B') AS b FROM {RUNS_SQL} GROUP BY 1)""")
def _(spark, sf):
    return rounded(P.domain_means(_runs(spark, sf), ["site A", "site B"], "f1"), ["site A", "site B", "gap"], 6)


@REG.add("distinct_labels", """
SELECT event_type, (SELECT count(DISTINCT event_type) FROM events) AS n_classes FROM events GROUP BY 1""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_type").distinct().withColumn("n_classes", ev.agg(F.countDistinct("event_type").alias("n")).scalar())


@REG.add("split_summary", """
WITH s AS (SELECT CASE WHEN value < 20 THEN 'train' WHEN value < 100 THEN 'val' ELSE 'test' END AS split, event_type FROM events)
SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type,
  count(*) AS n, round(count(*) / max(count(*)) OVER (), 2) AS share FROM s GROUP BY ROLLUP (split, event_type)""")
def _(spark, sf):
    v = F.col("value")
    ev = table(spark, sf, "events").withColumn("split", F.when(v < 20, "train").when(v < 100, "val").otherwise("test"))
    return P.split_summary(ev, "split", "event_type")


@REG.add("months_in_order", """
SELECT strftime(m, '%Y-%m-%d') AS month_key, strftime(m, '%b %Y') AS month_label FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)""")
def _(spark, sf):
    return P.month_order(table(spark, sf, "orders"), "o_orderdate").withColumn("month_key", F.date_format("month_key", "yyyy-MM-dd"))


@REG.add("fixed_month_range_counts", """
SELECT strftime(m, '%b %Y') AS month_label, count(o_orderkey) AS n FROM range(TIMESTAMP '2001-03-01', TIMESTAMP '2002-02-01', INTERVAL 1 MONTH) t(m)
LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    counts = o.groupBy(S.month_key("o_orderdate").alias("month_key")).agg(F.count("*").alias("c"))
    return (P.month_range(o, "2001-03-01", "2002-01-01").join(counts, "month_key", "left")
            .select("month_label", F.coalesce("c", F.lit(0)).cast("long").alias("n")))
