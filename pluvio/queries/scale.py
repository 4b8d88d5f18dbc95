"""The bucket methods for groups beyond one task, forced on the given tables and checked against plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvio.operators import evaluation as E
from pluvio.operators import ranks as R
from pluvio.operators import sampling as B
from pluvio.operators import segments as S
from pluvio.queries.base import Registry, table
from pluvio.queries.sampling import _split_sql
from pluvio.queries.signal import _segment_sql

REG = Registry()

# rows of a bucket, and of a group that is ranked whole, here; the library's defaults are larger
HOT = 20


@REG.add("bucketed_quantiles", """
SELECT o_orderpriority, p AS prob, round(quantile_cont(o_totalprice, [0.01, 0.25, 0.5, 0.9, 0.99])[i], 4) AS quantile
FROM orders, (VALUES (1, 0.01::DOUBLE), (2, 0.25::DOUBLE), (3, 0.5::DOUBLE), (4, 0.9::DOUBLE), (5, 0.99::DOUBLE)) t(i, p) GROUP BY o_orderpriority, i, p""")
def _(spark, sf):
    out = R.exact_quantiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", [0.01, 0.25, 0.5, 0.9, 0.99], accuracy=HOT)
    return out.withColumn("quantile", F.round("quantile", 4))


@REG.add("bucketed_row_numbers", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS row_idx FROM events")
def _(spark, sf):
    return R.number_rows(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "row_idx", HOT, 64).drop("ts")


@REG.add("bucketed_segments", _segment_sql(16, 8).replace("(i - 16) // 8 + 1", "CAST(floor((i - 16) / 8.0) AS BIGINT) + 1"))
def _(spark, sf):
    out = S.segment_ordered_rows(table(spark, sf, "events"), ["user_id"], "ts", "value", 16, 8, hot_rows=HOT)
    return out.withColumns({"rms": F.round("rms", 7), "mae": F.round("mae", 7)})


@REG.add("bucketed_running_totals", """
SELECT event_type, value, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY value DESC) AS BIGINT) AS cum_n FROM events GROUP BY event_type, value""")
def _(spark, sf):
    tied = table(spark, sf, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    return R.running_totals(tied, ["event_type"], "value", ["n"], True, HOT).drop("n")


@REG.add("bucketed_average_precision", """
WITH l AS (SELECT event_type AS c, value AS score, CAST(user_id % 4 = 0 AS INTEGER) AS pos FROM events),
t AS (SELECT c, score, sum(pos) AS pos, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT c, pos, sum(pos) OVER r AS cp, sum(n) OVER r AS cn, sum(pos) OVER (PARTITION BY c) AS total FROM t WINDOW r AS (PARTITION BY c ORDER BY score DESC))
SELECT c AS class, round(sum(pos / total * cp / cn), 6) AS average_precision, CAST(max(total) AS BIGINT) AS support FROM w GROUP BY c""")
def _(spark, sf):
    long = table(spark, sf, "events").select(F.col("event_type").alias("class"), F.col("value").alias("score"),
                                             (F.col("user_id") % 4 == 0).cast("int").alias("positive"))
    return E.average_precision(long, HOT).withColumn("average_precision", F.round("average_precision", 6))


@REG.add("split_by_cut_hashes", _split_sql(["o_orderstatus", "o_orderpriority"], 0.2, 0.15, "orders", "o_orderkey"))
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return B.split_dataset(orders, ["o_orderkey"], 0.2, 0.15, ["o_orderstatus", "o_orderpriority"])
