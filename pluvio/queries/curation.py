"""Curation, labels, catalog and row functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvio.functions import scalars as S
from pluvio.operators import curation as C
from pluvio.operators import experiment as X
from pluvio.operators.flatmap import flat_map_rows
from pluvio.plans.curation import DISCARD_RULES
from pluvio.queries.base import Registry, table
from pluvio.sources import catalog as K
from pluvio.sources import tables as R

REG = Registry()

URL_PATTERN = (r"(?P<scheme>https?)://(?P<host>[^/]+)/(?P<lang>[a-z]{2})/(?P<num>\d+)"
               r"(?:\.html)?/?(?:\?page=(?P<page_no>\d+))?")
URL_SQL = r"'(https?)://([^/]+)/([a-z]{2})/(\d+)(?:\.html)?/?(?:\?page=(\d+))?'"


@REG.add("regex_named_groups", f"""
SELECT page_id, nullif(regexp_extract(url, {URL_SQL}, 1), '') AS scheme,
       nullif(regexp_extract(url, {URL_SQL}, 2), '') AS host, nullif(regexp_extract(url, {URL_SQL}, 3), '') AS lang,
       nullif(regexp_extract(url, {URL_SQL}, 4), '') AS num, nullif(regexp_extract(url, {URL_SQL}, 5), '') AS page_no
FROM pages""")
def _(spark, sf):
    return C.extract_groups(table(spark, sf, "pages").select("page_id", "url"), "url", URL_PATTERN).drop("url")


@REG.add("path_base_name", r"""
SELECT page_id, regexp_extract(url, '([^/\\]+)[/\\]*$', 1) AS base FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.base_name("url").alias("base"))


@REG.add("recorder_clean", r"""
SELECT c_custkey, coalesce(nullif(regexp_extract(c_name, '(SMM\d+)', 1), ''), c_name) AS recorder FROM customer""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.clean_recorder("c_name").alias("recorder"))


@REG.add("dashed_number_and_rate", r"""
SELECT o_orderkey, v AS mm_5min, round_even(v * 12, 2) AS mm_hr
FROM (SELECT o_orderkey, try_cast(translate(substr(o_orderpriority, 1, 2) || CAST(o_custkey % 1000 AS VARCHAR), '-', '.') AS DOUBLE) AS v
      FROM orders)""")
def _(spark, sf):
    text = F.concat(F.substring("o_orderpriority", 1, 2), (F.col("o_custkey") % 1000).cast("string"))
    v = C.dashed_number(text)
    return table(spark, sf, "orders").select("o_orderkey", v.alias("mm_5min"), S.hourly_rate(v).alias("mm_hr"))


@REG.add("numeric_coerce", r"""
SELECT event_id, try_cast(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", S.to_number(F.regexp_extract("props", r"(\d+)", 1)).alias("k"), S.to_number("event_type").alias("bad"))


@REG.add("timestamp_from_parts", """
SELECT event_id, strftime(try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', year(ts), month(ts), day(ts) + 3, hour(ts), minute(ts), second(ts)),
       '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS rebuilt FROM events""")
def _(spark, sf):
    part = lambda fmt: F.date_format("ts", fmt)
    day = F.lpad((F.dayofmonth("ts") + 3).cast("string"), 2, "0")
    rebuilt = C.timestamp_from_parts(part("yyyy"), part("MM"), day, part("HH"), part("mm"), part("ss"))
    return table(spark, sf, "events").select("event_id", F.date_format(rebuilt, "yyyy-MM-dd HH:mm:ss").alias("rebuilt"))


@REG.add("period_of_day", """
SELECT CASE WHEN h < 6 THEN 'overnight' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'night' END AS period,
       count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT hour(ts) AS h, value FROM events) GROUP BY 1""")
def _(spark, sf):
    return (table(spark, sf, "events").groupBy(S.period_of_day(F.hour("ts")).alias("period"))
            .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


@REG.add("robust_boolean", """
SELECT event_id, CASE WHEN k = 1 THEN true WHEN k = 0 THEN false END AS flag
FROM (SELECT event_id, try_cast(regexp_extract(props, '(\\d)\\}', 1) AS DOUBLE) AS k FROM events)""".replace("\\\\", "\\"))
def _(spark, sf):
    digit = F.regexp_extract("props", r"(\d)\}", 1)
    return table(spark, sf, "events").select("event_id", C.robust_boolean(digit).alias("flag"))


MERGE_SQL = """
WITH gt AS (
  SELECT doc_id, arg_min(lang, o) AS gt_lang, arg_min(quality, o) AS quality, arg_min(toxic, o) AS toxic
  FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'xx' END AS lang, quality, toxic, 1 AS o FROM labels
        UNION ALL SELECT doc_id, 'zz', quality + 10, toxic + 10, 2 FROM labels) GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.gt_lang, d.lang) AS lang, d.source, d.n_chars, g.quality AS q, g.toxic FROM documents d LEFT JOIN gt g USING (doc_id)"""


@REG.add("label_merge", MERGE_SQL.replace("arg_min(lang, o)", "arg_min_null(lang, o)"))
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels")
    first = lab.select("doc_id", F.when(F.col("quality") == 1, "xx").alias("lang"), "quality", "toxic",
                       F.lit("kept").alias("source"), F.lit(1).alias("ordinal"))
    second = lab.select("doc_id", F.lit("zz").alias("lang"), (F.col("quality") + 10).alias("quality"),
                        (F.col("toxic") + 10).alias("toxic"), F.lit("kept").alias("source"), F.lit(2).alias("ordinal"))
    out = C.merge_labels(docs, first.unionByName(second), key="doc_id", renames={"quality": "q"},
                         no_overwrite=["source"], ordinal="ordinal")
    return out.drop("ordinal")


@REG.add("sanitise_category", """
SELECT o_orderkey, nullif(CASE WHEN v = 'no rain' THEN 'no-rain' ELSE v END, 'nan') AS category,
       round_even(mm * 12, 2) AS mm_hr, mm AS mm_5min
FROM (SELECT o_orderkey, lower(trim(CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN ' No Rain ' WHEN '5-LOW' THEN 'NaN'
             ELSE o_orderpriority END)) AS v, o_totalprice / 1000 AS mm FROM orders)""")
def _(spark, sf):
    p = F.col("o_orderpriority")
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.when(p == "4-NOT SPECIFIED", " No Rain ").when(p == "5-LOW", "NaN").otherwise(p).alias("category"),
        (F.col("o_totalprice") / 1000).alias("mm_5min"), F.lit(True).alias("rain"))
    return C.sanitise(raw)


RULES = ["value < 1", "event_type = 'error' and value > 100", "nullif(user_id, 3) is null"]


@REG.add("discard_rules", """
SELECT event_id, event_type, value FROM events
WHERE NOT (value < 1) AND NOT (event_type = 'error' AND value > 100) AND NOT (user_id = 3)""")
def _(spark, sf):
    return C.discard(table(spark, sf, "events"), RULES).select("event_id", "event_type", "value")


@REG.add("discard_audit", """
SELECT CASE WHEN value < 1 THEN 1 WHEN event_type = 'error' AND value > 100 THEN 2 WHEN user_id = 3 THEN 3 ELSE 0 END AS rule,
       count(*) AS rows FROM events GROUP BY 1""")
def _(spark, sf):
    return C.discard_audit(table(spark, sf, "events"), RULES)


@REG.add("label_normalise", """
SELECT o_orderpriority, trim(translate(lower(o_orderpriority), '-_', '  ')) AS label, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    return (table(spark, sf, "orders").groupBy("o_orderpriority", S.normalise_label("o_orderpriority").alias("label"))
            .agg(F.count("*").alias("n")))


# Order priorities standing for the five rain classes.
AS_RAIN = {"5-LOW": "No-Rain", "4-NOT SPECIFIED": "light", "3-MEDIUM": "Moderate", "2-HIGH": "HEAVY", "1-URGENT": "violent"}
RAIN_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AS_RAIN.items()) + " END"
NORM_SQL = f"trim(translate(lower({RAIN_SQL}), '-_', '  '))"


def rain_orders(spark, sf):
    return table(spark, sf, "orders").withColumn("category", S.literal_map(AS_RAIN, "o_orderpriority"))


def _granularity_sql(content: str, granularity: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.class_map(content, granularity).items())
    where = {"wet": "WHERE y IS DISTINCT FROM 'no rain'", "dry": "WHERE y = 'no rain'"}.get(content, "")
    return (f"SELECT '{content}/{granularity}' AS setting, CASE y {cases} END AS target, count(*) AS n, round(sum(p), 2) AS amount "
            f"FROM (SELECT {NORM_SQL} AS y, o_totalprice AS p FROM orders) {where} GROUP BY 1, 2")


SETTINGS = [("dry", 1), ("wet", 2), ("wet", 3), ("wet", 4), ("dry/wet", 2), ("dry/wet", 3), ("dry/wet", 4), ("dry/wet", 5)]


@REG.add("granularity_maps", " UNION ALL ".join(_granularity_sql(c, g) for c, g in SETTINGS))
def _(spark, sf):
    # the orders are read once: rules look at the label only, so they run on the counts per label
    counts = rain_orders(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("amount"))
    parts = None
    for content, granularity in SETTINGS:
        one = (X.apply_rules(counts, "category", content, granularity).groupBy("target")
               .agg(F.sum("n").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
               .select(F.lit(f"{content}/{granularity}").alias("setting"), "target", "n", "amount"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@REG.add("custom_class_map", f"""
SELECT o_orderkey, CASE y WHEN 'no rain' THEN 'calm' WHEN 'heavy' THEN 'storm' WHEN 'violent' THEN 'storm' END AS target
FROM (SELECT o_orderkey, {NORM_SQL} AS y FROM orders)""")
def _(spark, sf):
    out = X.apply_rules(rain_orders(spark, sf), custom={"No_Rain": "calm", " HEAVY": "storm", "violent": "storm"})
    return out.select("o_orderkey", "target")


@REG.add("label_quality", f"""
SELECT y AS label, t AS target, count(*) AS rows, t IS NULL AS unmapped,
       (SELECT count(DISTINCT CASE o_orderpriority WHEN '5-LOW' THEN 'calm' WHEN '2-HIGH' THEN 'storm' END) FROM orders) AS classes_found,
       (SELECT count(DISTINCT CASE o_orderpriority WHEN '5-LOW' THEN 'calm' WHEN '2-HIGH' THEN 'storm' END) FROM orders) < 5 AS fewer_than_requested
FROM (SELECT {NORM_SQL} AS y, CASE {NORM_SQL} WHEN 'no rain' THEN 'calm' WHEN 'heavy' THEN 'storm' END AS t FROM orders) GROUP BY 1, 2""")
def _(spark, sf):
    out = X.apply_rules(rain_orders(spark, sf), custom={"no-rain": "calm", "heavy": "storm"})
    return X.label_quality(out, granularity=5)


@REG.add("column_roles", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS category FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_returnflag": "category", "l_shipdate": "timestamp", "l_linestatus": "recorder"})
    roles = X.column_roles(li.columns, "category", [m for m in X.METADATA if m != "category"] + ["l_partkey", "l_suppkey"])
    return li.select(*roles["features"], *roles["target"])


@REG.add("display_label", """
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'No Rain' WHEN '4-NOT SPECIFIED' THEN 'Light'
       WHEN '3-MEDIUM' THEN 'Moderate' WHEN '2-HIGH' THEN 'Heavy' ELSE 'Violent' END AS shown FROM orders""")
def _(spark, sf):
    return rain_orders(spark, sf).select("o_orderkey", S.title_case(F.translate("category", "-", " ")).alias("shown"))


@REG.add("month_labels", """
SELECT strftime(o_orderdate, '%b %Y') AS month_label, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_key, count(*) AS n
FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    return (table(spark, sf, "orders")
            .groupBy(S.month_label("o_orderdate").alias("month_label"), F.date_format(S.month_key("o_orderdate"), "yyyy-MM-dd").alias("month_key"))
            .agg(F.count("*").alias("n")))


@REG.add("hash_ids", """
SELECT c_custkey, substr(sha256(c_name || '_' || coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), '') || '_' || c_mktsegment), 1, 16) AS audio_id
FROM customer""")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", S.hash_id("c_name", F.nullif(F.col("c_nationkey"), F.lit(3)), "c_mktsegment").alias("audio_id"))


@REG.add("season_filter", """
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%b') AS month_name FROM orders WHERE month(o_orderdate) BETWEEN 1 AND 7 AND o_totalprice > 0""")
def _(spark, sf):
    return C.season_filter(table(spark, sf, "orders"), "o_orderdate", "o_totalprice").select("o_orderkey", "o_totalprice", "month_name")


@REG.add("daily_status", """
SELECT CASE WHEN o_totalprice - 100000 > 0 THEN 'Wet (Rain)' ELSE 'Dry (No Rain)' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    return (table(spark, sf, "orders").groupBy(C.daily_status(F.col("o_totalprice") - 100000).alias("status"))
            .agg(F.count("*").alias("n")))


@REG.add("membership", """
SELECT event_id, user_id, event_type FROM events
WHERE event_type IN ('view', 'click') AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    ev = C.in_list(table(spark, sf, "events"), "event_type", ["view", "click"])
    return C.in_list(ev, "user_id", wanted).select("event_id", "user_id", "event_type")


@REG.add("catalog_insert_absent", """
WITH known AS (SELECT substr(sha256(c_name || '_' || c_mktsegment || '_'), 1, 16) AS audio_id, c_name AS file_name,
                      24000 AS sample_rate, '/a/' || c_name AS file_path, CAST(NULL AS DOUBLE) AS balance FROM customer WHERE c_nationkey < 10),
     fresh AS (SELECT DISTINCT substr(sha256(c_name || '_' || c_mktsegment || '_'), 1, 16) AS audio_id, c_name AS file_name,
                      48000 AS sample_rate, '/b/' || c_name AS file_path, c_acctbal AS balance FROM customer WHERE c_nationkey >= 5)
SELECT * FROM known UNION ALL SELECT * FROM fresh WHERE audio_id NOT IN (SELECT audio_id FROM known)""")
def _(spark, sf):
    cust = table(spark, sf, "customer")
    row = lambda sr, root: [S.hash_id("c_name", "c_mktsegment").alias("audio_id"), F.col("c_name").alias("file_name"),
                            F.lit(sr).alias("sample_rate"), F.concat(F.lit(root), "c_name").alias("file_path")]
    known = cust.filter("c_nationkey < 10").select(*row(24000, "/a/"))
    fresh = cust.filter("c_nationkey >= 5").select(*row(48000, "/b/"), F.col("c_acctbal").alias("balance"))
    return K.register(known, fresh.unionAll(fresh))


@REG.add("catalog_round_trip", """
SELECT substr(sha256(c_name || '__'), 1, 16) AS audio_id, c_name AS file_name, 24000 AS sample_rate, '/a/' || c_name AS file_path FROM customer""")
def _(spark, sf):
    from pluvio.session import scratch_path
    cust = table(spark, sf, "customer").select(S.hash_id("c_name").alias("audio_id"), F.col("c_name").alias("file_name"),
                                               F.lit(24000).alias("sample_rate"), F.concat(F.lit("/a/"), "c_name").alias("file_path"))
    root = scratch_path(spark, "catalog")
    K.save_catalog(K.register(K.load_catalog(spark, root), cust), root)
    return K.load_catalog(spark, root)


@REG.add("catalog_incremental", """
SELECT n.version, n.rows, c.rows AS stored FROM (SELECT 1 AS version, count(*) AS rows FROM customer WHERE c_nationkey < 10 UNION ALL SELECT 2, count(*) FROM customer WHERE c_nationkey >= 10
UNION ALL SELECT 3, 1) n, (SELECT count(*) + 1 AS rows FROM customer) c""")
def _(spark, sf):
    """Four saves, of which the last has nothing new: every part holds the new rows alone."""
    from pluvio.session import scratch_path
    cust = table(spark, sf, "customer")
    rows = cust.select(S.hash_id("c_name").alias("audio_id"), F.col("c_name").alias("file_name"), F.lit(24000).alias("sample_rate"), F.concat(F.lit("/a/"), "c_name").alias("file_path"), "c_nationkey")
    root = scratch_path(spark, "catalog")
    K.save_catalog(rows.filter("c_nationkey < 10"), root)
    K.save_catalog(rows, root)
    K.save_catalog(rows.unionByName(rows.limit(1).withColumns({"audio_id": F.lit("one more"), "device": F.lit("d")}), allowMissingColumns=True), root)
    K.save_catalog(rows, root)
    return K.manifest(spark, root).select(F.col("version").cast("int").alias("version"), "rows").withColumn("stored", F.lit(K.load_catalog(spark, root).count()))


@REG.add("split_tables_round_trip", """
SELECT event_id, event_type, CASE WHEN value < 20 THEN 'train' WHEN value < 100 THEN 'val' ELSE 'test' END AS split FROM events""")
def _(spark, sf):
    from pluvio.session import scratch_path
    v = F.col("value")
    ev = table(spark, sf, "events").select("event_id", "event_type", F.when(v < 20, "train").when(v < 100, "val").otherwise("test").alias("split"))
    path = scratch_path(spark, "splits")
    R.write_splits(ev, path)
    return R.read_splits(spark, path, ev.schema)


@REG.add("split_files_csv", """
SELECT event_id, event_type, CASE WHEN value < 20 THEN 'train' WHEN value < 100 THEN 'val' ELSE 'test' END AS split FROM events""")
def _(spark, sf):
    """One CSV folder per split, read back with the split as a column."""
    from pluvio.session import scratch_path
    v, ev = F.col("value"), table(spark, sf, "events")
    parts = {"train": v < 20, "val": (v >= 20) & (v < 100), "test": v >= 100}
    paths = {name: scratch_path(spark, name) for name in parts}
    for name, rows in parts.items():
        ev.filter(rows).select("event_id", "event_type").write.option("header", True).csv(paths[name])
    return R.read_split_files(spark, paths, ev.select("event_id", "event_type").schema)


@REG.add("checkpoint_in_a_chain", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, false AS reads_the_source FROM events WHERE value > 10 GROUP BY 1""")
def _(spark, sf):
    """A chain that goes on from a written file: what is read below no longer names the source."""
    from pluvio.session import scratch_path
    ev = table(spark, sf, "events").filter("value > 10").transform(R.save_checkpoint, scratch_path(spark, "checkpoint"))
    plan = ev._jdf.queryExecution().optimizedPlan().toString()
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("reads_the_source", F.lit("Filter" in plan))


@REG.add("unlabelled_category", """
SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, 'unlabeled') AS category FROM documents""")
def _(spark, sf):
    name = F.concat(F.lit("rec"), "doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("_"), "lang")).otherwise(""), F.lit(".wav"))
    docs = table(spark, sf, "documents").select("doc_id", name.alias("file_name"))
    return C.extract_filename_metadata(docs, r"rec\d+(?:_(?P<category>[a-z]+))?\.wav").select("doc_id", "category")


@REG.add("semicolon_daily_csv", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS data, round(sum(o_totalprice), 2) AS valor FROM orders GROUP BY 1""")
def _(spark, sf):
    from pluvio.session import scratch_path
    daily = (table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("data"))
             .agg(F.round(F.sum("o_totalprice"), 2).alias("valor")))
    path = scratch_path(spark, "daily")
    daily.write.option("sep", ";").option("header", True).csv(path)
    return R.read_daily_rainfall(spark, path).select(F.date_format("data", "yyyy-MM-dd").alias("data"), "valor")


@REG.add("event_sheets_union", """
SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS data_hora,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS precipitacao, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    from pluvio.session import scratch_path
    amount = F.when(F.col("o_custkey") % 7 == 0, F.lit("n/d")).otherwise(F.col("o_totalprice").cast("string"))
    o = table(spark, sf, "orders")
    early, late = o.filter("o_orderdate < timestamp'1998-01-01'"), o.filter("o_orderdate >= timestamp'1998-01-01'")
    a, b, c = (scratch_path(spark, n) for n in ("sheet-a", "sheet-b", "sheet-c"))
    early.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("DATA"), amount.alias("PRECIPITAÇÃO (mm)")).write.option("header", True).csv(a)
    late.select(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm").alias("Data"), amount.alias("Chuva")).write.option("header", True).csv(b)
    late.select("o_orderkey").write.option("header", True).csv(c)
    out = R.read_event_sheets(spark, [
        R.SheetSource(a, "DATA", "PRECIPITAÇÃO (mm)", "yyyy-MM-dd HH:mm:ss"),
        R.SheetSource(b, "Data", "Chuva", "dd/MM/yyyy HH:mm"), R.SheetSource(c, "Data", "Chuva", "dd/MM/yyyy HH:mm")])
    return (out.groupBy(F.date_format("data_hora", "yyyy-MM-dd HH:mm:ss").alias("data_hora"), "precipitacao").agg(F.count("*").alias("n")))


@REG.add("label_file_formats", """
SELECT quality, toxic, 2 * count(*) AS n FROM labels GROUP BY 1, 2""")
def _(spark, sf):
    from pluvio.session import scratch_path
    lab = table(spark, sf, "labels")
    csv, pq = scratch_path(spark, "labels") + ".csv", scratch_path(spark, "labels") + ".parquet"
    lab.write.option("header", True).csv(csv)
    lab.write.parquet(pq)
    both = R.read_labels(spark, csv, lab.schema).unionByName(R.read_labels(spark, pq, lab.schema))
    return both.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@REG.add("flat_map_rows", """
SELECT event_id, k, round(value * (k + 1), 4) AS scaled FROM events, range(3) t(k) WHERE k < event_id % 4""")
def _(spark, sf):
    def copies(pdf):
        import numpy as np
        out = pdf.loc[pdf.index.repeat(np.minimum(pdf["event_id"] % 4, 3))]
        k = out.groupby(level=0).cumcount()
        return out.assign(k=k, scaled=(out["value"] * (k + 1)).round(4))[["event_id", "k", "scaled"]]
    return flat_map_rows(table(spark, sf, "events").select("event_id", "value"), copies, "event_id long, k long, scaled double")


@REG.add("flat_map_skip", "SELECT event_id, round(100 / value, 6) AS inverse FROM events WHERE value > 1 AND event_id % 5 > 0")
def _(spark, sf):
    """Rows that fail are left out, and only these."""
    return flat_map_rows(table(spark, sf, "events").select("event_id", "value"), _inverse, "event_id long, inverse double", on_error="skip")


@REG.add("flat_map_capture", """
SELECT CASE WHEN event_id % 5 > 0 THEN event_id END AS event_id, CASE WHEN event_id % 5 > 0 THEN round(100 / value, 6) END AS inverse, CASE WHEN event_id % 5 = 0 THEN 'ValueError: no fifth row' END AS _error
FROM events WHERE value > 1 OR event_id % 5 = 0""")
def _(spark, sf):
    """Rows that fail stay with their message."""
    return flat_map_rows(table(spark, sf, "events").select("event_id", "value"), _inverse, "event_id long, inverse double", on_error="capture")


def _inverse(pdf):
    if (pdf["event_id"] % 5 == 0).any():
        raise ValueError("no fifth row")
    large = pdf[pdf["value"] > 1]
    return large.assign(inverse=(100 / large["value"]).round(6))[["event_id", "inverse"]]


@REG.add("curation_chain", """
WITH m AS (SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 'unlabeled' WHEN quality = 1 AND toxic = 1 THEN 'heavy'
                  WHEN quality = 1 THEN 'light' ELSE 'no-rain' END AS category,
                  CAST(CASE WHEN quality = 0 THEN 0 ELSE d.n_chars / 1000.0 END AS DOUBLE) AS mm_5min, toxic = 1 OR quality = 1 AS wet
           FROM documents d LEFT JOIN labels l USING (doc_id)),
     c AS (SELECT *, round_even(mm_5min * 12, 2) AS mm_hr FROM m WHERE category <> 'unlabeled'
           AND NOT (wet AND mm_5min = 0) AND NOT (NOT wet AND mm_5min > 0))
SELECT doc_id, category, mm_5min, mm_hr FROM c""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") / 1000).alias("mm_5min"), F.lit("unlabeled").alias("category"))
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    gt = table(spark, sf, "labels").select(
        "doc_id", F.when(q & t, "Heavy").when(q, " light").otherwise("No Rain").alias("rain_class"),
        F.when(~q, F.lit(0.0)).alias("total_rain"), (t | q).alias("wet"))
    return (docs.transform(C.merge_labels, gt, key="doc_id").transform(C.sanitise).transform(C.discard, DISCARD_RULES)
            .select("doc_id", "category", "mm_5min", "mm_hr"))
