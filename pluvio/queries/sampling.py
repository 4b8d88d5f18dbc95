"""Balancing, splitting and random picks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvio.operators import sampling as B
from pluvio.queries.base import Registry, table

REG = Registry()


def _undersample_sql(anchors, pool):
    a, p = (", ".join(f"'{v}'" for v in vs) for vs in (anchors, pool))
    return f"""WITH e AS (SELECT event_id, event_type, md5(event_id || '|42') AS shuffle_key FROM events),
k AS (SELECT count(*) AS n FROM e WHERE event_type IN ({a}))
SELECT * FROM e WHERE event_type IN ({a}) UNION ALL
SELECT event_id, event_type, shuffle_key FROM (SELECT *, row_number() OVER (ORDER BY shuffle_key) AS rn FROM e WHERE event_type IN ({p})) WHERE rn <= (SELECT n FROM k)"""


@REG.add("undersample_large_pool", _undersample_sql(["error", "signup"], ["view", "click", "purchase"]))
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return B.undersample_1_to_1(ev, "event_type", ["error", "signup"], ["view", "click", "purchase"], ["event_id"])


@REG.add("undersample_small_pool", _undersample_sql(["view", "click", "purchase"], ["error", "signup"]))
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return B.undersample_1_to_1(ev, "event_type", ["view", "click", "purchase"], ["error", "signup"], ["event_id"])


def _split_sql(cols, test, val, source="documents", key="doc_id"):
    by, name = ", ".join(cols), " || '|' || ".join(cols)
    return f"""WITH s AS (SELECT {by}, {name} AS name, count(*) AS n FROM {source} GROUP BY {by}),
a AS (SELECT *, n * (sum(n) OVER () - ceil(sum(n) OVER () * {test}::DOUBLE)) / sum(n) OVER () AS x, sum(n) OVER () - ceil(sum(n) OVER () * {test}::DOUBLE) AS keep FROM s),
b AS (SELECT *, floor(x + 1e-9) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x + 1e-9), 9) DESC, name) <= keep - sum(floor(x + 1e-9)) OVER () THEN 1 ELSE 0 END AS kept FROM a),
c AS (SELECT {by}, name, n - kept AS n_test, kept AS m, ceil(({val}::DOUBLE / (1.0::DOUBLE - {test}::DOUBLE)) * sum(kept) OVER ()) AS take, sum(kept) OVER () AS tot FROM b),
d AS (SELECT *, m * (tot - take) / tot AS x FROM c),
f AS (SELECT *, floor(x + 1e-9) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x + 1e-9), 9) DESC, name) <= (tot - take) - sum(floor(x + 1e-9)) OVER () THEN 1 ELSE 0 END AS kept FROM d),
r AS (SELECT {key}, {by}, row_number() OVER (PARTITION BY {by} ORDER BY md5({key} || '|42')) AS rn FROM {source})
SELECT {key}, {by}, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + (m - kept) THEN 'val' ELSE 'train' END AS split FROM r JOIN f USING ({by})"""


@REG.add("stratified_split", _split_sql(["lang"], 0.1, 0.1))
def _(spark, sf):
    return B.split_dataset(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], 0.1, 0.1, ["lang"])


@REG.add("stratified_split_two_columns", _split_sql(["o_orderstatus", "o_orderpriority"], 0.2, 0.15, "orders", "o_orderkey"))
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return B.split_dataset(orders, ["o_orderkey"], 0.2, 0.15, ["o_orderstatus", "o_orderpriority"])


@REG.add("plain_split", """
SELECT event_id, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + ceil((0.1::DOUBLE / (1.0::DOUBLE - 0.1::DOUBLE)) * (n - t)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '|7')) AS rn, count(*) OVER () AS n, ceil(count(*) OVER () * 0.1::DOUBLE) AS t FROM events)""")
def _(spark, sf):
    return B.split_dataset(table(spark, sf, "events").select("event_id"), ["event_id"], 0.1, 0.1, seed=7)


@REG.add("balanced_copies", """
WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IN ('fr', 'es', 'de') GROUP BY 1),
d AS (SELECT c.lang, n, i, CAST('0x' || substr(md5(c.lang || '|' || i || '|42'), 1, 8) AS BIGINT) % n AS pos
      FROM c, (SELECT max(n) AS n_max FROM c) m, range(100000) t(i) WHERE i < m.n_max - n),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42')) - 1 AS pos FROM documents)
SELECT doc_id, lang, false AS should_augment, CAST(0 AS BIGINT) AS copy_ordinal FROM documents
UNION ALL SELECT doc_id, r.lang, true, i + 1 FROM r JOIN d ON r.lang = d.lang AND r.pos = d.pos""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return B.balance_with_copies(docs, "lang", ["fr", "es", "de"], ["doc_id"])


@REG.add("shuffle_order", "SELECT event_id, md5(event_id || '|42') AS shuffle_key FROM events")
def _(spark, sf):
    return B.shuffle_key(table(spark, sf, "events").select("event_id"), ["event_id"])


@REG.add("one_random_row_per_class", """
SELECT event_type, arg_min(event_id, md5(event_id || '|42')) AS event_id, arg_min(value, md5(event_id || '|42')) AS value FROM events GROUP BY 1""")
def _(spark, sf):
    return B.one_per_class(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", ["event_id"])


@REG.add("hash_positions", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '|42')) - 1 AS row_idx FROM events""")
def _(spark, sf):
    from pluvio.functions.scalars import hash_bucket, seeded_hash
    from pluvio.operators.ranks import number_by_hash
    ev = table(spark, sf, "events").select("event_id", "event_type", seeded_hash(["event_id"], 42).alias("h"))
    return number_by_hash(ev, ["event_type"], "h", hash_bucket("h")).drop("h")
