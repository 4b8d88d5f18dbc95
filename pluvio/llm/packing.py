"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing only looks at lengths, and lengths have at most `capacity` values. The distributed part counts
pieces by length; the driver packs that histogram (at most `capacity` numbers, whatever the number of documents)
with a segment tree over remaining capacities; and every piece finds its place from its ordinal among the pieces of
its length. Bins that have had the same history are handled as one run of bin numbers, so the plan is short.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map, staged
from pluvio.llm.tokens import encoder

CAPACITY = 2048


class OpenBins:
    """Runs of open bins by remaining capacity, with a segment tree that finds the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)  # some bin is open below this tree node
        self.runs = defaultdict(list)  # remaining capacity -> [(first bin, number of bins)]

    def _mark(self, at: int, value: bool) -> None:
        at += self.size
        self.some[at] = value
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def add(self, remaining: int, first: int, n: int) -> None:
        if remaining:
            self.runs[remaining].append((first, n))
            self._mark(remaining, True)

    def take(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        if not self.runs[remaining]:
            self._mark(remaining, False)
        return run

    def tightest(self, least: int) -> int | None:
        """Smallest remaining capacity of an open bin that is at least `least`."""
        at = least + self.size
        while not self.some[at]:
            while at > 1 and at % 2:  # go up until there is a right sibling
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first ordinal, pieces, first bin, pieces a bin, offset of the first in its bin).

    The pieces of a row fill bins first bin, first bin + 1, ..., `pieces a bin` after one another in each. This is
    best-fit decreasing piece by piece: once a piece is in the tightest bin, that bin is the tightest for the next of its
    length as long as it still fits.
    """
    bins, opened, plan = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            left, remaining = total - done, bins.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins.take(remaining)
            each = remaining // length
            full, last = divmod(min(left, n * each), each)  # bins that take `each` pieces, and what one more takes
            if full:
                plan.append((length, done, full * each, first, each, capacity - remaining))
                bins.add(remaining - each * length, first, full)
            if last:
                plan.append((length, done + full * each, last, first + full, last, capacity - remaining))
                bins.add(remaining - last * length, first + full, 1)
            rest = n - full - (last > 0)
            if rest:
                bins.add(remaining, first + full + (last > 0), rest)
            done += full * each + last
    return plan


def _pieces(path: str, capacity: int):
    """Pieces of each document, numbered within the task among the pieces of their length."""
    def run(batches):
        encode, part = encoder(path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "nth")}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(text or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    length = len(own) // 4
                    for c, v in zip(out, (doc_id, piece, at // 4, length, zlib.crc32(own), int(met[length]))):
                        out[c].append(v)
                    met[length] += 1
            rows = {c: pa.array(v, pa.int64()) for c, v in out.items()}
            yield pa.RecordBatch.from_pydict(rows | {"part": pa.array([part] * len(out["nth"]), pa.int32())})
    return run


def _place(plan: list[tuple[int, int, int, int, int, int]]):
    rows = np.array(sorted(plan), np.int64).reshape(-1, 6)
    bounds = {int(n): (int(lo), int(lo + c)) for n, lo, c in zip(*np.unique(rows[:, 0], return_index=True, return_counts=True))}

    def run(batches):
        for batch in batches:
            length, ordinal = (batch[c].to_numpy() for c in ("length", "ordinal"))
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                lo, hi = bounds[int(n)]
                own = length == n
                at[own] = lo + np.searchsorted(rows[lo:hi, 1], ordinal[own], "right") - 1
            nth = ordinal - rows[at, 1]
            columns = {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(rows[at, 3] + nth // rows[at, 4]),
                                                        "offset": pa.array(rows[at, 5] + nth % rows[at, 4] * length)})
    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of `docs` (doc_id, text).

    A document is its ids under the tokenizer file `path` (at the same place on every machine) and an id 0 after them;
    a null or empty text is that id alone. Longer documents than `capacity` are cut into pieces of it. Repeated rows and
    rows without doc_id are packed each on their own. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = staged(arrow_map(rows, _pieces(path, capacity), "doc_id long, piece long, start long, length long, ids_crc32 long, nth long, part int"), "pieces")
    # Where a task's pieces of one length begin among all: a running total over tasks, not over pieces.
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = staged(counts.select("length", "part", "n", F.coalesce(before, F.lit(0).cast("long")).alias("begin")), "begins")
    histogram = {r["length"]: r["n"] for r in begins.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    placed = pieces.join(begins.drop("n"), ["length", "part"]).withColumn("ordinal", F.col("begin") + F.col("nth"))
    return arrow_map(placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ordinal"), _place(best_fit_plan(histogram, capacity)),
                     "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
