"""Benchmark decontamination by winnowing, with DataFrame functions only.

The shared span that must be found is WINDOW words long. K-grams of words are hashed, and of every
WINDOW - K + 1 consecutive k-grams the least hash is the fingerprint: a span of WINDOW words shared by a document
and an item has the same k-grams on both sides, hence the same fingerprint, so no such span can be missed.
Fingerprints of documents and items are joined and every hit is extended over the words of its whole window.
Items shorter than WINDOW words have one window, all their words, which is its own fingerprint.

Before the shuffle, documents keep the windows whose fingerprint is in a bit table made from the benchmark. The
table has FILTER_BITS bits at any size of the benchmark; a fuller table only lets more windows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import staged

WINDOW, K, FILTER_BITS = 13, 5, 1 << 18
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between the words, once A-Z are in lower case
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters a-z and all characters beyond ASCII, A-Z in lower case."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SPLIT)
    return F.filter(parts, lambda w: w != "")


def _positions(n: Column) -> Column:
    """0 .. n - 1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _gram(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(n)])


def _whole(n: int):
    """The fingerprint of a run of n words that is a window by itself."""
    return lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), _gram(F.col("h"), i, n)).alias("mark"))


def _span(n: int):
    return lambda x: F.struct(x["at"].alias("at"), F.lit(n).alias("length"), x["mark"].alias("mark"), F.slice("words", x["at"] + 1, n).alias("span"))


def _windows(df: DataFrame, lengths: list[int], keep=None) -> DataFrame:
    """Adds `windows` (at, length, mark, span): the windows of the word array `words` and their fingerprints.

    `lengths` are the short lengths to form besides WINDOW; `keep` is a test of `mark` that drops windows early.
    """
    keep = keep or (lambda mark: F.lit(True))
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = F.transform(_positions(F.size("words") - K + 1), lambda i: _gram(F.col("h"), i, K))
    df = df.withColumn("grams", grams)
    steps = WINDOW - K + 1
    least = F.transform(_positions(F.size("words") - WINDOW + 1),
                        lambda i: F.struct(i.alias("at"), F.least(*[F.get(F.col("grams"), i + j) for j in range(steps)]).alias("mark")))
    marked = [(WINDOW, least)]
    for n in lengths:
        marked.append((n, F.transform(_positions(F.size("words") - n + 1), _whole(n))))
    found = [F.transform(F.filter(marks, lambda x: keep(x["mark"])), _span(n)) for n, marks in marked]
    return df.withColumn("windows", F.concat(*found)).drop("h", "grams")


def _bit_table(marks: DataFrame) -> Column:
    """An array of FILTER_BITS / 64 longs with the bits of the given marks set; its size does not depend on them."""
    place = F.pmod("mark", F.lit(FILTER_BITS))
    bits = (marks.select(place.alias("p")).distinct().groupBy((F.col("p") / 64).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")))
    table = [0] * (FILTER_BITS // 64)
    for word, value in bits.collect():
        table[word] = value
    return F.array(*[F.lit(v).cast("long") for v in table])


def _tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The distinct windows of all items (window, mark, span), the items of each (window, item), and the lengths of short items.

    Windows are staged before they are unfolded: the optimizer would otherwise test their number by making them again.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    items = staged(items.where(F.size("words") > 0), "items")
    lengths = sorted(r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # 12 at most
    long_items = _windows(items.where(F.size("words") >= WINDOW), [])
    short_items = _windows(items.where(F.size("words") < WINDOW), lengths).withColumn(
        "windows", F.filter("windows", lambda w: w["length"] == F.size("words")))
    made = staged(long_items.union(short_items).select("item", "windows"), "item-windows")
    spans = made.select("item", F.explode("windows").alias("w")).select("item", "w.mark", "w.span")
    spans = staged(spans.distinct(), "spans")
    distinct = staged(spans.select("mark", "span").distinct().withColumn("window", F.monotonically_increasing_id()), "distinct-spans")
    return distinct, staged(spans.join(distinct, ["mark", "span"]).select("window", "item"), "window-items"), lengths


def _item_lists(hits: DataFrame, window_items: DataFrame) -> DataFrame:
    """(d, t, n_items, items_sha256) of the rows (doc_id, tag) with hits.

    Rows with the same set of windows have the same items, so the items of a set are gathered once, however many
    rows share a passage.
    """
    sets = hits.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    sets = staged(sets.withColumn("set", F.md5(F.concat_ws(",", "windows"))), "window-sets")
    pairs = sets.dropDuplicates(["set"]).select("set", F.explode("windows").alias("window")).join(window_items, "window").select("set", "item").distinct()
    lists = pairs.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    lists = lists.select("set", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    return sets.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "set").join(lists, "set").drop("set")


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`contamination`, with the `tag` of each row's text."""
    spans, window_items, lengths = _benchmark_windows(benchmark)
    table = _bit_table(spans)

    def keep(mark):
        place = F.pmod(mark, F.lit(FILTER_BITS))
        return F.getbit(F.get(table, (place / 64).cast("int")), (place % 64).cast("int")) == 1

    keyed = docs.select("doc_id", _tag(F.col("text")).alias("tag"), words(F.col("text")).alias("words"))
    keyed = _windows(keyed, lengths, keep).select("doc_id", "tag", F.size("words").cast("long").alias("n_words"), "windows")
    keyed = staged(keyed, "windows")
    found = keyed.where(F.size("windows") > 0).select("doc_id", "tag", F.explode("windows").alias("w"))
    found = found.select("doc_id", "tag", "w.at", "w.length", F.col("w.mark").alias("m"), F.col("w.span").alias("s")).distinct()
    hits = staged(found.join(spans, (F.col("m") == F.col("mark")) & (F.col("s") == F.col("span")))
                  .select("doc_id", "tag", "at", "length", "window"), "hits")
    # Words covered by a document's hit windows: each adds what reaches beyond the furthest end so far.
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("at", "length"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["length"]).alias("end"),
                              (s["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(s["end"], x["at"]))).alias("n")),
        lambda s: s["n"])
    judged = hits.groupBy("doc_id", "tag").agg(covered.cast("long").alias("n_hit"))
    items = _item_lists(hits, window_items)
    judged = judged.join(items, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))).select("d", "t", "n_hit", "n_items", "items_sha256")
    judged = staged(judged, "judged")
    out = keyed.select("doc_id", "tag", "n_words").join(judged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    none = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", none)
    return out.select("doc_id", "tag", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`.

    `docs` has doc_id and text, `benchmark` item_id and text; other columns are ignored, and item ids are compared
    as strings. A document word is hit when it lies in an occurrence of an item's window of 13 words, or of a whole
    shorter item. contaminated: n_hit > 0 and 20 * n_hit >= n_words. items_sha256 is of the sorted, comma-joined ids.
    Null, empty and wordless texts have no words and no hits, wordless items no window; items without id are
    ignored. Repeated rows each get their row; rows are matched by doc_id and text, so a repeated or null
    doc_id with another text is judged on its own. Empty tables give no rows, or rows without hits.
    """
    return _judged(docs, benchmark).drop("tag")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated.

    Every row is judged by its own doc_id and text, so of rows that share a doc_id, or have none, only contaminated ones go.
    """
    bad = _judged(docs.select("doc_id", "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("__bad"), F.col("tag").alias("__tag")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]) & (_tag(docs["text"]) == bad["__tag"]), "left_anti")
