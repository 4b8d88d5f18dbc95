"""Filter interaction audit over a sparse document-term matrix.

Tasks cut their documents into shards and number each shard's words by a dictionary of its own, ordered by BUCKETS hash
buckets, so that what moves is one list of words per shard and bucket, and a frequent word is in it once a shard and not once a
document. Each bucket's words are numbered together, the buckets' sizes give offsets, and the global ids replace
the shards' own: every shard is then a CSR matrix over one vocabulary. Row sums (words) and nonzero counts (distinct
words) decide the filters A and B, the flags that texts carry decide C to E, and counts of the combinations of
failures are all that the 120 orders of the filters need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map, staged

SHARD_DOCS, SHARD_BYTES = 4096, 16 << 20  # a shard ends at either; one longer text is a shard by itself
BUCKETS = 4096  # of words, by hash; a task numbers one after another
SALTS = 16  # tasks over which the copies of one text are spread
FILTERS = "ABCDE"
# Limits of the filters.
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_ROWS = "array<struct<doc_id:bigint,part:string,digest:binary,failed:int>>"
_ROW_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("failed", pa.int32())]))
_CSR = "shard long, rows " + _ROWS + ", starts binary, terms binary, counts binary"


def _text_flags(text: str, data: bytes) -> int:
    """Bits of the filters that a text fails by its characters: C, capitals, and D, signs."""
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (100 * capitals > CAPITAL_PERCENT * len(text)) << 2 | (len(data.translate(None, SIGNS)) < len(data)) << 3


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    """A CSR matrix over its own dictionary: row i has the terms[starts[i]:starts[i + 1]], as often as counts says."""

    def __init__(self, buckets: int):
        self.buckets, self.numbers, self.rows, self.terms, self.counts, self.size = buckets, _Numbers(), [], [], [], 0

    def add(self, row: dict, data: bytes) -> None:
        words = data.split()  # of bytes: at the six ASCII blanks
        terms, counts = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), return_counts=True)
        self.rows.append(row)
        self.terms.append(terms)
        self.counts.append(counts.astype(np.int32))
        self.size += len(data)

    def batch(self, number: int) -> pa.RecordBatch:
        """One row. The words are numbered anew by bucket; `lists` has the words of each bucket, a line a word: no word holds a line break."""
        words = list(self.numbers)
        bucket = np.fromiter((crc32(w) % self.buckets for w in words), np.int32, len(words))
        order = np.argsort(bucket, kind="stable")
        own = np.empty(len(words), np.int32)
        own[order] = np.arange(len(words), dtype=np.int32)
        some, first = np.unique(bucket[order], return_index=True)
        lists = [{"bucket": b, "words": b"\n".join([words[i] for i in order[lo:hi]])} for b, lo, hi in zip(some.tolist(), first, [*first[1:], len(words)])]
        arrays = {"starts": np.concatenate(([0], np.cumsum([len(t) for t in self.terms]))).astype("<i8"),
                  "terms": own[np.concatenate(self.terms)].astype("<i4"), "counts": np.concatenate(self.counts).astype("<i4")}
        return pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "rows": pa.array([self.rows], _ROW_TYPE),
                                           **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()},
                                           "lists": pa.array([lists], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))})


def _shards(most_docs: int, most_bytes: int, buckets: int):
    def run(batches):
        part, made, shard = TaskContext.get().partitionId(), 0, _Shard(buckets)
        for batch in batches:
            for doc_id, lang, text in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), batch["text"].to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                digest = hashlib.blake2b(data, digest_size=16).digest()
                shard.add({"doc_id": doc_id, "part": lang or "", "digest": digest, "failed": _text_flags(text or "", data)}, data)
                if len(shard.rows) >= most_docs or shard.size >= most_bytes:
                    yield shard.batch(part << 32 | made)
                    made, shard = made + 1, _Shard(buckets)
        if shard.rows:
            yield shard.batch(part << 32 | made)
    return run


def _number(batches):
    """(shard, bucket, nth) with the numbers of a list's words in its bucket, and after each bucket (bucket, words) with its vocabulary."""
    def vocabulary() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"shard": pa.nulls(1, pa.int64()), "bucket": pa.array([last], pa.int32()), "nth": pa.nulls(1, pa.binary()),
                                           "words": pa.array([b"\n".join(numbers)], pa.binary()), "n": pa.array([len(numbers)], pa.int64())})
    last, numbers = None, _Numbers()
    for batch in batches:
        buckets, nth, done = batch["bucket"].to_pylist(), [], []
        for bucket, words in zip(buckets, batch["words"].to_pylist()):
            if bucket != last:
                if last is not None:
                    done.append(vocabulary())
                last, numbers = bucket, _Numbers()
            own = words.split(b"\n")
            nth.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)).astype("<i4").tobytes())
        n = len(buckets)
        yield pa.RecordBatch.from_pydict({"shard": batch["shard"], "bucket": batch["bucket"], "nth": pa.array(nth, pa.binary()), "words": pa.nulls(n, pa.binary()), "n": pa.nulls(n, pa.int64())})
        yield from done
    if last is not None:
        yield vocabulary()


def _relabel(begins: dict[int, int]):
    """Shards with the terms' global ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for parts, own in zip(batch["ids"].to_pylist(), batch["terms"].to_pylist()):
                parts = sorted(parts or (), key=lambda p: p["bucket"])
                number = np.concatenate([np.zeros(0, np.int64), *[begins[p["bucket"]] + np.frombuffer(p["nth"], "<i4").astype(np.int64) for p in parts]])
                terms.append(number[np.frombuffer(own, "<i4")].astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": batch["shard"], "rows": batch["rows"].cast(_ROW_TYPE), "starts": batch["starts"], "terms": pa.array(terms, pa.binary()), "counts": batch["counts"]})
    return run


def _words_of(begins: dict[int, int]):
    def run(batches):
        for batch in batches:
            for bucket, words in zip(batch["bucket"].to_pylist(), batch["words"].to_pylist()):
                own = pa.array(words.split(b"\n"), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict({"word": own, "term": pa.array(begins[bucket] + np.arange(len(own), dtype=np.int64))})
    return run


def _numbered_shards(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Shards with the numbers of their words by bucket, the buckets' vocabularies, and the first global id of each bucket."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    local = staged(arrow_map(rows, _shards(SHARD_DOCS, SHARD_BYTES, BUCKETS), _CSR + ", lists array<struct<bucket:int,words:binary>>"), "shards")
    lists = local.select("shard", F.explode("lists").alias("l")).select("shard", "l.bucket", "l.words").repartition("bucket").sortWithinPartitions("bucket")
    codes = staged(arrow_map(lists, _number, "shard long, bucket int, nth binary, words binary, n long"), "codes")
    vocabulary = codes.where("shard is null")
    sizes = dict(sorted((r["bucket"], r["n"]) for r in vocabulary.select("bucket", "n").collect()))  # BUCKETS rows at most
    begins = dict(zip(sizes, accumulate(sizes.values(), initial=0)))
    ids = codes.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("bucket", "nth")).alias("ids"))
    return local.drop("lists").join(ids, "shard", "left"), vocabulary.select("bucket", "words"), begins


def document_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of `docs` (doc_id, lang, text): its vocabulary (word, term) and its CSR shards.

    Words are `[^\\x20\\x09-\\x0D]+`, case-sensitive; terms are numbered from 0 without gaps. A shard has `rows`, one
    struct a document, and the little-endian arrays `starts` (64 bits), `terms` (64 bits) and `counts` (32 bits).
    Null and empty texts are rows without terms. An empty table gives no shards and no words.
    """
    numbered, vocabulary, begins = _numbered_shards(docs)
    return arrow_map(vocabulary, _words_of(begins), "word string, term long"), arrow_map(numbered, _relabel(begins), _CSR)


def _judged(batches):
    """One row per document of a shard: row sums and nonzero counts decide A and B."""
    for batch in batches:
        for i in range(len(batch)):
            at, counts = np.frombuffer(batch["starts"][i].as_py(), "<i8"), np.frombuffer(batch["counts"][i].as_py(), "<i4")
            n = np.diff(np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[at])
            nonzero = np.diff(at)
            rows = batch["rows"][i].values
            failed = np.asarray(rows.field("failed")) | (n < FEW_WORDS) | (100 * nonzero < DISTINCT_PERCENT * n).astype(np.int32) << 1
            yield pa.RecordBatch.from_pydict({c: rows.field(c) for c in ("doc_id", "part", "digest")}
                                             | {"n_words": pa.array(n, pa.int64()), "n_distinct": pa.array(nonzero, pa.int64()), "failed": pa.array(failed, pa.int32())})


def filter_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, n_words, n_distinct, failed for every row of `docs`: bit 0 of `failed` is filter A, bit 4 is E.

    A text fails E when a smaller doc_id has the same text; null counts as empty, and a row without doc_id never fails E.
    """
    numbered, _, begins = _numbered_shards(docs)
    matrix = _relabel(begins)
    facts = staged(arrow_map(numbered, lambda batches: _judged(matrix(batches)), "doc_id long, part string, digest binary, n_words long, n_distinct long, failed int"), "facts")
    known = facts.where("doc_id is not null")
    copied = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = copied.select(F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    marked = known.withColumn("salt", salt).join(spread, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    columns = ["doc_id", "part", "n_words", "n_distinct"]
    return (marked.select(*columns, F.col("failed").bitwiseOR(F.shiftleft(repeated, 4)).alias("failed"))
            .union(facts.where("doc_id is null").select(*columns, "failed")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (lang) and each of the 120 orders of the filters A to E, what every step keeps and removes.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; all 600
    rows of a part that has a document, zeros included. `docs` has doc_id, lang and text, `labels` doc_id, quality and
    toxic; other columns are ignored. A null lang is the part ''. Of repeated labels any with quality 1 (toxic 1) counts;
    labels without doc_id, and documents without one, meet nothing. Repeated rows count each. No documents give no rows.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    failures = staged(filter_failures(docs), "failures")
    zero = F.lit(0).alias("good"), F.lit(0).alias("toxic")
    rows = (failures.where("doc_id is not null").join(known, "doc_id", "left").select("part", "failed", F.coalesce("good", zero[0]).alias("good"), F.coalesce("toxic", zero[1]).alias("toxic"))
            .union(failures.where("doc_id is null").select("part", "failed", *zero)))
    combinations = staged(rows.groupBy("part", "failed", "good", "toxic").agg(F.count(F.lit(1)).alias("n")), "combinations")

    orders = ["".join(p) for p in permutations(FILTERS)]
    own = [1 << FILTERS.index(f) for order in orders for f in order]
    earlier = [sum(1 << FILTERS.index(f) for f in order[:i]) for order in orders for i in range(len(FILTERS))]
    place = F.col("place")
    steps = combinations.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(own) - 1)))).withColumns(
        {"own": F.get(F.lit(own), place), "earlier": F.get(F.lit(earlier), place)})
    fails, before = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("earlier")) != 0

    def total(of, name: str):
        return F.sum(F.when(of, F.col("n")).otherwise(0)).alias(name)

    out = steps.groupBy("part", "place", "own").agg(
        total(~fails & ~before, "kept"), total(fails & ~before, "removed"), total(fails & before, "redundant"), total(F.col("failed") == F.col("own"), "unique_fails"),
        total(fails & ~before & (F.col("good") == 1), "good_lost"), total(fails & ~before & (F.col("toxic") == 1), "toxic_lost"))
    per_order = F.lit(len(FILTERS))
    return out.select("part", F.get(F.lit(orders), F.floor(place / per_order).cast("int")).alias("filter_order"), (place % per_order + 1).cast("int").alias("step"),
                      "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "own")).alias("shapley"))
