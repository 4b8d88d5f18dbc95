"""Periodic runs of the words of a text: suffix trees, lowest common ancestors and Lyndon roots.

A run is a stretch of words with smallest period q, at least LEAST words and twice q long, that no neighbour extends.
Of every run some period starts at a word i such that the longest Lyndon word from i, in one of the two orders of the
words, has q words. So each i gives two candidates, and a candidate is extended in both directions as far as the words q apart
agree. Longest Lyndon words end before the next smaller suffix, which the suffix order of the tree gives. Agreement
forwards is the string depth of the lowest common ancestor of two leaves in the Ukkonen tree, agreement
backwards the same in the tree of the reversal; both are minima over a stretch of the tree's Euler tour, read in constant time
from a sparse table. Of the tour only the least depth between neighbouring leaves is kept.

Every word of a run lies in a GRAM-word gram that the text holds twice: with a period of at least GRAM words each period
repeats its grams, and with a shorter one the run has LEAST - GRAM + 1 grams or more and all but the last q repeat. What
no repeated gram covers is in no run; the trees are of the stretches in between, which have no run in common with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map
from pluvio.llm.words import shingle_hashes, word_hashes

LEAST, GRAM = 12, 6
NARROWINGS = 4  # times that a stretch is looked at again for grams repeated within it; any number gives the same runs
SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers from 1; the end is the symbol 0, which comes before all others."""

    def __init__(self, sequence: Sequence[int]):
        self.s = [*sequence, 0]
        self.base = max(self.s) + 1
        self.begin, self.end, link, child = [0], [0], [0], {}
        s, n, base, begin, end = self.s, len(self.s), self.base, self.begin, self.end
        node = edge = length = waiting = 0  # the active point, and the suffixes not yet in the tree
        for i, symbol in enumerate(s):
            waiting, before = waiting + 1, 0
            while waiting:
                if not length:
                    edge = i
                key = node * base + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i), end.append(n), link.append(0)
                    if before:
                        link[before], before = node, 0
                else:
                    size = end[below] - begin[below]
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    middle = begin[below] + length
                    if s[middle] == symbol:
                        length += 1
                        if before:
                            link[before] = node
                        break
                    split = len(begin)
                    begin += begin[below], i
                    end += middle, n
                    link += 0, 0
                    begin[below] = middle
                    child[key], child[split * base + symbol], child[split * base + s[middle]] = split, split + 1, below
                    if before:
                        link[before] = split
                    before = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - waiting + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.children = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        parents, symbols = np.divmod(keys[order], base)
        self.first = np.searchsorted(parents, np.arange(len(begin) + 1)).tolist()
        self.ends_here = (symbols == 0).tolist()

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the suffixes in order, and for each the least string depth since the leaf before on the Euler tour.

        `descending` reverses the order of the symbols, except that the end stays before all of them.
        """
        n, begin, end, first, children = len(self.s), self.begin, self.end, self.first, self.children
        depth, starts, least = [0] * len(begin), [], []
        stack, low, back = [(0, 0)], 0, False
        while stack:
            node, above = stack.pop()
            if back:  # the tour came back to this node's parent
                low, back = above, False
            depth[node] = own = above + end[node] - begin[node]
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                starts.append(n - own)
                least.append(low)
                back = True
            else:
                below = children[lo:hi]
                if not descending:
                    below.reverse()
                elif self.ends_here[lo]:
                    below = below[1:] + below[:1]
                stack += [(c, own) for c in below]
        return np.array(starts), np.array(least)


class CommonPrefixes:
    """Lengths of the common prefixes of pairs of suffixes, each in constant time."""

    def __init__(self, starts: np.ndarray, least: np.ndarray):
        self.rank = np.empty(len(starts), np.int64)
        self.rank[starts] = np.arange(len(starts))
        self.levels = [least.astype(np.int32)]
        while 2 << len(self.levels) - 1 <= len(least):
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            own, table = level == k, self.levels[k]
            out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k)])
        return out


def _next_smaller(starts: np.ndarray) -> np.ndarray:
    """For every place the next one with a smaller suffix: where the longest Lyndon word from there ends."""
    n = len(starts) - 1
    rank = np.empty(n + 1, np.int64)
    rank[starts] = np.arange(n + 1)
    rank, stack, out = rank.tolist(), [n], [n] * n
    for i in range(n - 1, -1, -1):
        own = rank[i]
        while rank[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(sequence: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 1, in order of start and period."""
    n = len(sequence)
    tree = SuffixTree(sequence)
    starts, depths = tree.tour()
    ends = np.concatenate([_next_smaller(starts), _next_smaller(tree.tour(descending=True)[0])])
    del tree
    i = np.tile(np.arange(n), 2)
    some = 2 * (ends - i) <= n
    i, j = i[some], ends[some]
    forward = CommonPrefixes(starts, depths)(i, j)
    backward = np.zeros(len(i), np.int64)
    inner = i > 0
    backward[inner] = CommonPrefixes(*SuffixTree(sequence[::-1]).tour())(n - i[inner], n - j[inner])
    period = j - i
    length = period + forward + backward
    found = length >= np.maximum(least, 2 * period)
    return sorted(set(zip((i - backward)[found].tolist(), length[found].tolist(), period[found].tolist())), key=lambda r: (r[0], r[2]))


def _covered(hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of LEAST words or more that repeated grams cover."""
    grams = shingle_hashes(hashes, GRAM)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    yield from ((lo, hi) for lo, hi in zip(bounds[::2].tolist(), bounds[1::2].tolist()) if hi - lo >= LEAST)


def _stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a text that can hold runs, each without its neighbours."""
    parts = [(0, len(hashes))] if len(hashes) >= LEAST else []
    for _ in range(NARROWINGS):
        narrow = [(lo + a, lo + b) for lo, hi in parts for a, b in _covered(hashes[lo:hi])]
        if narrow == parts:
            break
        parts = narrow
    return parts


def word_runs(data: bytes) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words of UTF-8 bytes, their runs, and the words joined without the repeats of runs."""
    words, runs = data.split(), []
    for lo, hi in _stretches(word_hashes(data)) if len(words) >= LEAST else ():
        number: dict[bytes, int] = {}
        sequence = [number.setdefault(w, len(number) + 1) for w in words[lo:hi]]
        runs += [(lo + start, length, period) for start, length, period in runs_of(sequence)]
    if not runs:
        return len(words), runs, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return len(words), runs, b" ".join([w for w, n in zip(words, np.cumsum(edge).tolist()) if not n])


def _find(batches):
    for batch in batches:
        n_words, runs, collapsed = [], [], []
        for text in batch["text"].to_pylist():
            n, found, left = word_runs((text or "").encode("utf-8", "replace"))
            n_words.append(n)
            runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
            collapsed.append(left)
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_words": pa.array(n_words, pa.int64()), "runs": pa.array(runs, kind),
                                          "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, collapsed for every row of `docs` (doc_id, text; other columns are ignored).

    Words are `[^\\x20\\x09-\\x0D]+`. `runs` has start, length and period in words, by start and then period; `collapsed` are
    the words, joined by one space, that no run holds after its first period. Null, empty and blank texts have no words
    and no runs; repeated rows give a row each, a null doc_id stays null, an empty table gives no rows. The working
    memory grows with the longest repetitive stretch of a text, by about half a kilobyte a word.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _find, SCHEMA)


def run_digests(found: DataFrame) -> DataFrame:
    """One row per row of `periodic_runs`: the number of runs, the longest one, and digests of the runs and of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"),
                           F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return digests.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                          F.floor(F.try_divide(1000 * length, period)).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the crc32 h of their decimal id, get a periodic tail; the others stay.

    With g = h div 10 and n words, the words from a = g mod n on repeat the first p = 1 + (n - a) div (3 + g mod 8) of them.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times, tail = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"), (F.col("n") - F.col("a")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), tail)
    whole = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, whole).otherwise(F.col("text")).alias("text"))
