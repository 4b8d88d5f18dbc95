"""Gradient boosted trees for several classes: one softmax over all classes, one tree per class and round.

Features are cut into bins once. Every level of a round is one job: tasks add up gradients and curvatures per (class, node,
feature, bin), Spark sums the cells, and the driver, which gets classes * nodes * features * bins cells at most (some 20 MB for
five classes, 102 features and depth 6) whatever the number of rows, chooses the splits. Margins are stored with the rows every few rounds; in between, tasks apply the
latest trees themselves. Rows of a validation table take part as one more fold: they never enter a histogram, and their log-loss,
which comes with the first level of the next round, ends the fit when it stops falling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.session import scratch_path, ship_package

#: Rounds whose trees tasks apply themselves before margins are stored anew.
ROUNDS_PER_STAGE = 20
COLUMNS_PER_PASS = 50
LOSS_CELLS = 2  # the cells -1 (train) and -2 (validation) hold log-loss and rows
ROWS = "bins binary, label int, fold int, place long, margins binary"


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: the children of i are 2 i + 1 and 2 i + 2. A leaf has the feature -1; bins up to `cut` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches within so many levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


def softmax(margins: np.ndarray) -> np.ndarray:
    shifted = np.exp(margins - margins.max(1, keepdims=True))
    return shifted / shifted.sum(1, keepdims=True)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of edges below it. A missing value is in the first bin."""
    out = np.zeros(x.shape, np.uint8)
    for j, edge in enumerate(edges):
        column = x[:, j]
        out[:, j] = np.where(np.isnan(column), 0, np.searchsorted(edge, column, "left"))
    return out


@dataclass(frozen=True)
class BoostedModel:
    """Trees by round and class, the bin edges, and the mean log-loss after each round."""

    edges: list[np.ndarray]
    rounds: list[list[Tree]]
    classes: int
    depth: int
    train_loss: list[float] = field(default_factory=list)
    validation_loss: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = binned(x, self.edges), np.zeros((len(x), self.classes))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.place(bins, self.depth)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `probability` (a vector over the classes) and `prediction` (the first most likely class) to rows with `features`."""
        width = len(self.edges)

        @F.pandas_udf("array<double>")
        def likely(rows):
            import pandas as pd
            x = np.array(rows.tolist(), dtype=np.float64).reshape(-1, width)
            return pd.Series(list(softmax(self.margins(x))))

        ship_package(df.sparkSession)
        scored = df.withColumn("_p", likely(vector_to_array("features")))
        best = F.array_position("_p", F.array_max("_p")).cast("double") - 1
        return scored.withColumn("prediction", best).withColumn("probability", array_to_vector("_p")).drop("_p")


def feature_edges(values: DataFrame, width: int, max_bin: int) -> list[np.ndarray]:
    """At most max_bin - 1 edges per feature of the array column `x`, by quantile sketches, some columns at a time."""
    fractions, out = [i / max_bin for i in range(1, max_bin)], []
    for lo in range(0, width, COLUMNS_PER_PASS):
        some = range(lo, min(width, lo + COLUMNS_PER_PASS))
        cell = lambda j: F.expr(f"nullif(get(x, {j}), double('nan'))")
        row = values.agg(*[F.percentile_approx(cell(j), fractions, 10_000).alias(f"e{j}") for j in some]).first()
        out += [np.unique(np.array(row[f"e{j}"] or [], dtype=np.float64)) for j in some]
    return out


def _unpacked(batch: pa.RecordBatch, width: int, classes: int) -> tuple[np.ndarray, ...]:
    n = len(batch)
    bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(n, width)
    margins = np.frombuffer(b"".join(batch["margins"].to_pylist()), np.float64).reshape(n, classes)
    return bins, margins, *(batch[c].to_numpy(zero_copy_only=False) for c in ("label", "fold", "place"))


def _advanced(margins: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]], depth: int) -> np.ndarray:
    margins = margins.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.value[tree.place(bins, depth)]
    return margins


@dataclass(frozen=True)
class BoostedTrees:
    """Settings by their usual names; `patience` is the number of rounds without a better validation loss that ends the fit."""

    rounds: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    subsample: float = 1.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    max_bin: int = 64
    patience: int = 10
    seed: int = 42

    def __post_init__(self):
        if self.rounds < 1 or not 1 <= self.max_depth <= 10 or not 2 <= self.max_bin <= 256 or not 0 < self.subsample <= 1 or self.learning_rate <= 0:
            raise ValueError("need rounds >= 1, max_depth 1..10, max_bin 2..256, 0 < subsample <= 1 and learning_rate > 0")

    def fit(self, ready: DataFrame, validation: DataFrame | None = None) -> BoostedModel:
        """`ready` and `validation` have `features` (vector) and `label_index`."""
        spark = ship_package(ready.sparkSession)
        place = F.xxhash64(vector_to_array("features"), "label_index", F.lit(self.seed))
        columns = [vector_to_array("features").alias("x"), F.col("label_index").cast("int").alias("label"), place.alias("place")]
        train = ready.select(*columns, F.lit(0).alias("fold"))
        facts = train.agg(F.max("label").alias("top"), F.max(F.size("x")).alias("width")).first()
        if facts["top"] is None:
            raise ValueError("no rows to fit")
        classes, width = facts["top"] + 1, facts["width"]
        edges = feature_edges(train, width, self.max_bin)
        rows = train if validation is None else train.unionByName(validation.select(*columns, F.lit(1).alias("fold")))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blank = np.zeros(classes).tobytes()
            for batch in batches:
                x = np.array(batch["x"].to_pylist(), dtype=np.float64).reshape(-1, width)
                yield pa.RecordBatch.from_pydict({"bins": pa.array([b.tobytes() for b in binned(x, edges)], pa.binary()), "label": batch["label"], "fold": batch["fold"],
                                                  "place": batch["place"], "margins": pa.array([blank] * len(batch), pa.binary())})

        table = self._stored(rows.mapInArrow(cut, ROWS))
        stored, done, losses = 0, [], ([], [])
        while len(done) < self.rounds:
            if len(done) - stored >= ROUNDS_PER_STAGE:
                table, stored = self._stored(table.mapInArrow(self._moved(done[stored:], width, classes), ROWS)), len(done)
            trees, seen = self._round(table, done[stored:], len(done), width, classes)
            if done:
                for kept, loss in zip(losses, seen):
                    kept.append(loss)
                if validation is not None and int(np.argmin(losses[1])) + self.patience < len(losses[1]):
                    break
            if trees is None:
                break
            done.append(trees)
        else:
            for kept, loss in zip(losses, self._round(table, done[stored:], len(done), width, classes, last=True)[1]):
                kept.append(loss)
        best = len(done) if validation is None or not losses[1] else int(np.argmin(losses[1])) + 1
        return BoostedModel(edges, done[:best], classes, self.max_depth, losses[0], losses[1] if validation is not None else [])

    def _stored(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(rows.sparkSession, "boosting")
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(ROWS).parquet(path)

    def _moved(self, rounds: list[list[Tree]], width: int, classes: int) -> Callable:
        def run(batches):
            for batch in batches:
                bins, margins, *_ = _unpacked(batch, width, classes)
                moved = _advanced(margins, bins, rounds, self.max_depth)
                yield batch.set_column(batch.schema.get_field_index("margins"), "margins", pa.array([m.tobytes() for m in moved], pa.binary()))
        return run

    def _cells(self, pending: list[list[Tree]], growing: list[Tree], level: int, number: int, width: int, classes: int) -> Callable:
        """Histogram cells of one level: (cell, g, h), with cell = ((class * nodes + node) * width + feature) * max_bin + bin."""
        first, nodes, size = (1 << level) - 1, 1 << level, self.max_bin

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, classes, nodes * width * size))
            loss = np.zeros((2, LOSS_CELLS))
            for batch in batches:
                bins, margins, label, fold, place = _unpacked(batch, width, classes)
                p = softmax(_advanced(margins, bins, pending, self.max_depth))
                if level == 0:
                    cost = -np.log(np.maximum(p[np.arange(len(p)), np.clip(label, 0, classes - 1)], 1e-15))
                    for f in range(LOSS_CELLS):
                        loss[:, f] += cost[fold == f].sum(), (fold == f).sum()
                drawn = (place.view(np.uint64) ^ np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)
                own = (fold == 0) & (drawn.astype(np.float64) < self.subsample * 2.0**53)
                bins, p, label = bins[own], p[own], label[own]
                columns = np.arange(width) * size + bins
                for k in range(classes):
                    at = growing[k].place(bins, level) - first if level else np.zeros(len(bins), np.int64)
                    some = at >= 0  # the others ended in a leaf above
                    cell = (at[some, None] * (width * size) + columns[some]).ravel()
                    chance = p[some, k]
                    for i, value in enumerate((chance - (label[some] == k), np.maximum(2 * chance * (1 - chance), 1e-16))):
                        sums[i, k] += np.bincount(cell, np.repeat(value, width), nodes * width * size)
            k, cell = np.nonzero(sums[1])
            index = np.concatenate([k * (nodes * width * size) + cell, [-1, -2]])
            yield pa.RecordBatch.from_pydict({"cell": pa.array(index, pa.int64()), "g": np.concatenate([sums[0, k, cell], loss[0]]), "h": np.concatenate([sums[1, k, cell], loss[1]])})
        return run

    def _round(self, table: DataFrame, pending: list[list[Tree]], number: int, width: int, classes: int, last: bool = False):
        """The trees of one round, or None when no tree can split; and the mean losses before it."""
        total = (1 << self.max_depth + 1) - 1
        growing = [Tree(np.full(total, -1), np.zeros(total, np.int64), np.zeros(total)) for _ in range(classes)]
        losses, spread = (float("nan"), float("nan")), table.rdd.getNumPartitions() > 1
        for level in range(1 if last else self.max_depth):
            nodes, first = 1 << level, (1 << level) - 1
            cells = table.mapInArrow(self._cells(pending, growing, level, number, width, classes), "cell long, g double, h double")
            if spread:  # a single task has added up its cells already
                cells = cells.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            got = cells.toArrow()
            cell, g, h = (got[c].to_numpy() for c in ("cell", "g", "h"))
            if level == 0:
                losses = tuple(float(g[cell == -1 - f].sum() / max(h[cell == -1 - f].sum(), 1)) for f in range(LOSS_CELLS))
                if last:
                    break
            sums = np.zeros((2, classes * nodes * width * self.max_bin))
            sums[0][cell[cell >= 0]], sums[1][cell[cell >= 0]] = g[cell >= 0], h[cell >= 0]
            if not self._split(growing, sums.reshape(2, classes, nodes, width, self.max_bin), level, first):
                break
        if last or all(t.feature[0] < 0 for t in growing):
            return None, losses
        return growing, losses

    def _split(self, growing: list[Tree], sums: np.ndarray, level: int, first: int) -> bool:
        """Split the nodes of a level by the best gain; sets the leaf values of what is left and says whether anything was split."""
        left = sums.cumsum(-1)[..., :-1]
        whole = sums.sum(-1)
        right = whole[..., None] - left
        score = lambda gh: gh[0] ** 2 / (gh[1] + self.reg_lambda + 1e-16)
        weight = lambda gh: -self.learning_rate * gh[0] / (gh[1] + self.reg_lambda + 1e-16)
        gain = (score(left) + score(right) - score(whole)[..., None]) / 2 - self.gamma
        gain = np.where((left[1] >= self.min_child_weight) & (right[1] >= self.min_child_weight), gain, -np.inf)
        any_split = False
        for k, tree in enumerate(growing):
            for node in range(gain.shape[1]):
                at = first + node
                if level and tree.feature[(at - 1) // 2] < 0:
                    continue
                f, b = np.unravel_index(int(gain[k, node].argmax()), gain[k, node].shape)
                tree.value[at] = weight(whole[:, k, node, 0])
                if gain[k, node, f, b] > 1e-12:
                    tree.feature[at], tree.cut[at], any_split = f, b, True
                    tree.value[2 * at + 1], tree.value[2 * at + 2] = weight(left[:, k, node, f, b]), weight(right[:, k, node, f, b])
        return any_split
