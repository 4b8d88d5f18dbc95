"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Symbols are UTF-16 units, so ORDER of them fit one long. A character beyond the first plane, which has two, takes one that no text uses (`_given`):
every character of every script is one symbol. Only decimal digits are read as 0, since which number stands in a text says little about it
and widens the thresholds. Every document's n-grams are counted and sent once, in blocks of documents, to the shard of the n-gram. In the
shards they are joined with which documents are trusted, which gives the counts to train on, and then with the costs of the n-grams,
which gives each document's sum. Continuation counts, context totals, discounts and costs, with their back-off, are group-bys and
joins; no table of the model is on the driver or broadcast.
Thresholds come from trusted documents that the scoring model has not seen: two more models, each of half the trusted text.
Costs are kept in whole thousandths of a nat, so sums do not depend on their order.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map, staged

ORDER, UNIT = 4, 16
#: Bits and number of symbols of a small alphabet, units folded by their lowest bits; only its n-grams can be listed (`cost_table`).
BITS = 6
SYMBOLS = 1 << BITS
#: Share of the trusted documents of a language that lies below its threshold, by models that have not seen them.
QUANTILE = 0.98
#: Trusted documents from which a language has a threshold of its own: 0.98 ** 149 < 5 %, so the largest of fewer is no bound of the quantile.
LEAST = 149
#: A text of n characters may exceed its threshold by SPREAD / sqrt(n) nats: short texts vary more.
SPREAD = 1.0
FOLDS = 2  # the trusted texts of one are scored by the model of the other
SHARDS = 64  # of n-grams; their rows are streamed, so a shard may have any size
_PIECE = 1 << 20
_ENTRIES = 1 << 20  # (document, n-gram) rows of a block, about
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _symbols() -> np.ndarray:
    """The symbol of every UTF-16 unit: itself, for decimal digits of any script 0."""
    return np.array([48 if unicodedata.category(chr(unit)) == "Nd" else unit for unit in range(1 << UNIT)], np.uint16)


_SYMBOL = _symbols()
_FAR_DIGITS = np.array([point for point in range(1 << UNIT, 2 << UNIT) if unicodedata.category(chr(point)) == "Nd"], np.uint32)  # later planes have none
#: Characters beyond the first plane that are one symbol, in order, and their symbols.
_FAR = _FAR_DIGITS, np.full(len(_FAR_DIGITS), 48, np.uint16)


def _met(batches):
    """Characters beyond ASCII in the texts of a task, each once."""
    met = np.zeros(0x110000, bool)
    for batch in batches:
        for text in batch["text"].to_pylist():
            if text and not text.isascii():
                for at in range(0, len(text), _PIECE):
                    met[np.frombuffer(text[at:at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)] = True
    met[:128] = False
    yield pa.RecordBatch.from_pydict({"point": pa.array(np.flatnonzero(met), pa.int32())})


def _given(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_FAR` with the characters beyond the first plane among those met: each takes a unit that is not met. Were there more of them than such units, the last stay pairs."""
    points, symbols = _FAR
    far, free = np.setdiff1d(met[met >= 1 << UNIT], points), np.setdiff1d(np.arange(128, 1 << UNIT), met)
    free = free[_SYMBOL[free] == free]
    if len(far) > len(free):
        free = free[free >> 11 != 0xD800 >> 11]  # pairs need theirs
        far = far[:len(free)]
    points, symbols = np.concatenate([points, far]).astype(np.uint32), np.concatenate([symbols, free[:len(far)]]).astype(np.uint16)
    order = np.argsort(points)
    return points[order], symbols[order]


def _alone(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """`_given` for all texts of `docs`; distinct characters come to the driver, of which Unicode has 1.1 million."""
    return _given(arrow_map(docs.select("text"), _met, "point int").distinct().toArrow()["point"].to_numpy())


def _units(text: str, far: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The symbols of a text: its UTF-16 units, but one for each character in `far`."""
    units = _SYMBOL[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]
    if len(units) > len(text):
        points, symbols = far
        high = np.flatnonzero((units[:-1] >> 10 == 0xD800 >> 10) & (units[1:] >> 10 == 0xDC00 >> 10))
        point = ((units[high].astype(np.uint32) & 0x3FF) << 10 | units[high + 1] & 0x3FF) + 0x10000
        at = np.minimum(np.searchsorted(points, point), len(points) - 1)
        one = points[at] == point
        units[high[one]] = symbols[at[one]]
        units = np.delete(units, high[one] + 1)
    return units


def _tag(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _grams(text: str, bits: int = UNIT, far=_FAR):
    """Codes of the ORDER-grams that end at each symbol, in pieces of bounded size; line breaks stand before the text."""
    carry = np.full(ORDER - 1, 10, np.uint64)
    for at in range(0, len(text), _PIECE):
        line = np.concatenate([carry, (_units(text[at:at + _PIECE], far) & np.uint16((1 << bits) - 1)).astype(np.uint64)])
        code = line[:-(ORDER - 1)].copy()
        for j in range(1, ORDER):
            code = (code << np.uint64(bits)) | line[j:len(line) - (ORDER - 1) + j]
        carry = line[-(ORDER - 1):]
        yield code


def _summed_up(grams, counts):
    """Distinct n-grams in order, and the sums of their counts (rows of an array)."""
    grams, counts = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts[order], first, axis=0)


def _distinct(text: str, bits: int = UNIT, far=_FAR):
    """Distinct ORDER-grams of a text, in order, and how often each occurs."""
    found = [np.unique(codes, return_counts=True) for codes in _grams(text, bits, far)]
    if len(found) == 1:
        return found[0]
    return _summed_up(*zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def gram_counts(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """(gram, n): occurrences of every ORDER-gram over all rows of `texts` (text)."""
    def run(batches):
        for batch in batches:
            for text in batch["text"].to_pylist():
                found, n = _distinct(text or "", bits)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})
    return arrow_map(texts.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(order: int, bits: int):
    return F.col("gram").bitwiseAND(F.lit((1 << bits * order) - 1))


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """Discounts of counts 1, 2 and 3 or more for each model, from how many n-grams occur once to four times."""
    n = {}
    for r in counts.where("n <= 4").groupBy("model", "n").agg(F.count(F.lit(1)).alias("c")).collect():
        n.setdefault(r["model"], {})[r["n"]] = r["c"]
    return {model: _discounts_of(*(float(seen.get(i, 0)) for i in range(1, 5))) for model, seen in n.items()}


def _discounts_of(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def kneser_ney(counts: DataFrame, bits: int = BITS) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (model, gram, p) of the seen n-grams, and (model, ctx, back) of the seen contexts.

    `counts` (gram, n) may have a column `model`; the models are made side by side, each of its own counts. A symbol has `bits` bits.
    """
    if "model" not in counts.columns:
        counts = counts.withColumn("model", F.lit(0))
    tables = {ORDER: staged(counts.select("model", "gram", "n"), "grams")}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols that stand before an n-gram
        tables[order] = staged(tables[order + 1].groupBy("model", _suffix(order, bits).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    out, below = [], None
    for order in range(1, ORDER + 1):
        by_model = _discounts(tables[order])
        one, two, more = (F.coalesce(*[F.when(F.col("model") == m, d[i]) for m, d in by_model.items()], F.lit(default))
                          for i, default in enumerate(_discounts_of(0, 0, 0, 0)))
        row = tables[order].withColumn("ctx", F.shiftrightunsigned("gram", bits))
        # A discount never exceeds the count it is taken from.
        totals = row.groupBy("model", "ctx").agg(F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("n1"),
                                        F.sum((F.col("n") == 2).cast("long")).alias("n2"), F.sum((F.col("n") > 2).cast("long")).alias("n3"))
        back = (one * F.col("n1") + two * F.col("n2") + more * F.col("n3")) / F.col("total")
        totals = staged(totals.select("model", "ctx", "total", back.alias("back")), "contexts")
        taken = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        if below is None:
            lower = F.lit(1.0 / (1 << bits))
        else:
            row = row.withColumn("suffix", _suffix(order - 1, bits))
            lower, row = F.col("q"), row.join(below.select("model", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["model", "suffix"])
        seen = row.join(totals, ["model", "ctx"]).select("model", "gram", ((F.col("n") - taken) / F.col("total") + F.col("back") * lower).alias("p"))
        below = staged(seen, "model")
        out.append((below, totals.select("model", "ctx", "back")))
    return out


def cost_table(model: list[tuple[DataFrame, DataFrame]], which: int = 0) -> np.ndarray:
    """Thousandths of a nat for each of the SYMBOLS ** ORDER n-grams of the small alphabet, by one of the models: `costs`, listed."""
    dense = np.full(1, 1.0 / SYMBOLS, np.float32)
    for order, (seen, contexts) in enumerate(model, 1):
        back = np.ones(SYMBOLS ** (order - 1), np.float32)
        got = contexts.where(F.col("model") == which).select("ctx", "back").toArrow()
        back[got["ctx"].to_numpy()] = got["back"].to_numpy()
        shape = (SYMBOLS, SYMBOLS ** (order - 2), SYMBOLS) if order > 1 else (1, 1, SYMBOLS)
        lower = np.broadcast_to(dense.reshape(1, -1, SYMBOLS) if order > 1 else dense.reshape(1, 1, 1), shape)
        wide = (lower * back.reshape(shape[0], shape[1], 1)).reshape(-1)
        got = seen.where(F.col("model") == which).select("gram", "p").toArrow()
        wide[got["gram"].to_numpy()] = got["p"].to_numpy()
        dense = wide
    np.log(np.maximum(dense, np.float32(1e-25)), out=dense)
    dense *= np.float32(-1000)
    return np.minimum(np.rint(dense, out=dense), 65535).astype(np.uint16)


def costs(model: list[tuple[DataFrame, DataFrame]], wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """(model, gram, cost) for the distinct rows of `wanted` (model, gram): thousandths of a nat, unseen n-grams by their back-off."""
    asked = {ORDER: wanted}
    for order in range(ORDER - 1, 0, -1):  # what was seen needs no shorter n-gram
        unseen = asked[order + 1].join(model[order][0], ["model", "gram"], "left_anti")
        asked[order] = staged(unseen.select("model", _suffix(order, bits).alias("gram")).distinct(), "asked")
    below = None
    for order, (seen, contexts) in enumerate(model, 1):
        row = asked[order].join(seen, ["model", "gram"], "left").withColumn("ctx", F.shiftrightunsigned("gram", bits)).join(contexts, ["model", "ctx"], "left")
        if below is None:
            lower = F.lit(1.0 / (1 << bits))
        else:
            shorter = below.select("model", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            lower, row = F.col("q"), row.withColumn("suffix", _suffix(order - 1, bits)).join(shorter, ["model", "suffix"], "left")
        below = row.select("model", "gram", F.coalesce("p", F.coalesce("back", F.lit(1.0)) * lower).alias("p"))
        below = staged(below, "costs") if order < ORDER else below
    return below.select("model", "gram", F.round(F.log(F.greatest("p", F.lit(1e-25))) * -1000).cast("int").alias("cost"))


def _shard(grams: np.ndarray) -> np.ndarray:
    return ((grams * _MIX >> np.uint64(40)) % np.uint64(SHARDS)).astype(np.int64)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, bytes of one place side by side, compressed."""
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return np.array([len(body), len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], np.int64).tobytes() + pa.compress(body, "zstd", asbytes=True)


def _spread(packed: bytes) -> list[np.ndarray]:
    """The arrays of `_squeezed`, as unsigned numbers."""
    size, n = np.frombuffer(packed, np.int64, 2).tolist()
    shapes = np.frombuffer(packed, np.int64, 2 * n, 16).reshape(n, 2).tolist()
    body, at, out = np.frombuffer(pa.decompress(packed[16 * (n + 1):], size, "zstd"), np.uint8), 0, []
    for length, width in shapes:
        planes = body[at:at + length * width].reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += length * width
    return out


def _message(columns: dict) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _messages(batches):
    for batch in batches:
        for message in batch["message"].to_pylist():
            yield from pa.ipc.open_stream(message)


def _table(spark: SparkSession, messages: RDD, schema: str) -> DataFrame:
    return arrow_map(spark.createDataFrame(messages.map(lambda m: (m,)), "message binary", verifySchema=False), _messages, schema)


def _block(at: int, rows: list, grams: list, counts: list):
    """(part, block, message) of a block of documents: to each shard its n-grams with places and counts, and the rows to a part behind the shards."""
    block = TaskContext.get().partitionId() << 32 | at
    doc_id, lang, tag, fold, n_chars = zip(*rows)
    yield SHARDS + block % SHARDS, block, _message({
        "block": pa.array([block] * len(rows), pa.int64()), "place": pa.array(range(len(rows)), pa.int32()), "doc_id": pa.array(doc_id, pa.int64()), "lang": pa.array(lang, pa.string()),
        "tag": pa.array(tag, pa.int64()), "fold": pa.array(fold, pa.int32()), "n_chars": pa.array(n_chars, pa.int64())})
    doc = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(g) for g in grams])
    gram, n = np.concatenate(grams), np.concatenate(counts).astype(np.uint32)
    order = np.argsort(gram, kind="stable")
    order = order[np.argsort(_shard(gram[order]).astype(np.uint16), kind="stable")]
    gram, n, doc = gram[order], n[order], doc[order]
    cuts = np.searchsorted(_shard(gram), np.arange(SHARDS + 1))
    for shard, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            new = np.concatenate([[True], gram[a + 1:b] != gram[a:b - 1]])
            place = (np.cumsum(new) - 1).astype(np.uint64) * np.uint64(len(rows)) + doc[a:b]  # of the pair among all pairs of n-gram and document
            yield shard, block, _squeezed(np.array([len(rows)], np.uint32), gram[a:b][new], np.diff(place, prepend=np.uint64(0)), n[a:b])


def _blocks(batches, far):
    def sent():
        at, size, rows, grams, counts = 0, 0, [], [], []
        for batch in batches:
            for doc_id, text, lang, tag, fold in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "lang", "tag", "fold"))):
                found, n = _distinct(text or "", UNIT, far)
                rows.append((doc_id, lang, tag, fold, len(text or "")))
                grams.append(found)
                counts.append(n)
                size += len(found) + 1
                if size >= _ENTRIES:
                    yield from _block(at, rows, grams, counts)
                    at, size, rows, grams, counts = at + 1, 0, [], [], []
        if rows:
            yield from _block(at, rows, grams, counts)
    for part, block, message in sent():
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "message": pa.array([message], pa.binary())})


def _pairs(message: bytes):
    """Number of documents, n-grams, and for each (n-gram, document) the place of the n-gram, the document and the count."""
    many, grams, steps, n = _spread(message)
    at, doc = np.divmod(np.cumsum(steps, dtype=np.uint64), many[0].astype(np.uint64))
    return int(many[0]), grams, at.astype(np.int64), doc.astype(np.int64), n.astype(np.int64)


def _by_part(rows: DataFrame) -> RDD:
    """Rows (part, key, message) in the part they name, as (part, (kind of row, key, message)); kept by Spark as shuffle files for all later reads."""
    kind = rows.columns[1]
    return rows.rdd.map(lambda r: (r[0], (kind, r[1], r[2]))).partitionBy(2 * SHARDS, int)


def _rows_of(part: int, items):
    return (message for _, (_, _, message) in items) if part >= SHARDS else iter(())


def _shards(join):
    """`join` over the shards; the parts behind them hold the documents' rows."""
    return lambda part, items: join(item for _, item in items) if part < SHARDS else iter(())


def _told(batches):
    """To every shard: for each block whether and in which fold its documents are trusted."""
    for batch in batches:
        for told, marks in zip(batch["told"].to_pylist(), batch["marks"].to_pylist()):
            message = _squeezed((np.array(marks, np.int64) % (2 * FOLDS)).astype(np.uint8))
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(SHARDS), pa.int32()), "told": pa.array([told] * SHARDS, pa.int64()), "message": pa.array([message] * SHARDS, pa.binary())})


def _trained(items):
    """For each n-gram of a shard, how often it stands in the trusted texts of each fold: count rows joined with who is trusted."""
    told, grams, counts, size = {}, [], [], 0
    for kind, key, message in items:
        if kind == "told":
            told[key] = message
        elif kind == "block":
            _, gram, at, doc, n = _pairs(message)
            mark = _spread(told[key])[0][doc]
            grams.append(gram)
            counts.append(np.stack([np.bincount(at, n * (mark == FOLDS + i), len(gram)).astype(np.int64) for i in range(FOLDS)], axis=1))
            size += len(gram)
            if size > 1 << 20 and size > 2 * len(grams[0]):
                grams, counts = ([x] for x in _summed_up(grams, counts))
                size = len(grams[0])
    if grams:
        gram, count = _summed_up(grams, counts)
        for a in range(0, len(gram), 1 << 16):
            yield _message({"gram": pa.array(gram[a:a + (1 << 16)].view(np.int64))} | {f"n{i}": pa.array(count[a:a + (1 << 16), i]) for i in range(FOLDS)})


def _priced(batches):
    """Costs, packed by shard and model."""
    def sent(rows):
        table = pa.Table.from_batches(rows)
        model, gram, cost = (table[c].to_numpy() for c in ("model", "gram", "cost"))
        gram = gram.view(np.uint64)
        key = _shard(gram) * (FOLDS + 1) + model
        order = np.lexsort((gram, key))
        cuts = np.searchsorted(key[order], np.arange(SHARDS * (FOLDS + 1) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            some = order[cuts[i]:cuts[i + 1]]
            yield pa.RecordBatch.from_pydict({"part": pa.array([i // (FOLDS + 1)], pa.int32()), "price": pa.array([i % (FOLDS + 1)], pa.int64()),
                                              "message": pa.array([_squeezed(gram[some], cost[some].astype(np.uint32))], pa.binary())})
    rows, size = [], 0
    for batch in batches:
        rows.append(batch)
        size += len(batch)
        if size >= 1 << 20:
            yield from sent(rows)
            rows, size = [], 0
    if size:
        yield from sent(rows)


def _costed(items):
    """(block, sums of its documents' costs in this shard): count rows joined with the costs of their n-grams."""
    told, prices, known = {}, {}, None
    for kind, key, message in items:
        if kind == "told":
            told[key] = message
        elif kind == "price":
            prices.setdefault(key, []).append(_spread(message))
        elif kind == "block":
            if known is None:
                known = {}
                for which, parts in prices.items():
                    gram, cost = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(gram)
                    known[which] = gram[order], cost[order].astype(np.int64)
            many, gram, at, doc, n = _pairs(message)
            mark = _spread(told[key])[0][doc]
            total, unseen = _dear(known[FOLDS], gram, at, doc, n, many), np.zeros(many, np.int64)
            for i in range(FOLDS):
                own = mark == FOLDS + i
                if own.any():
                    unseen += _dear(known[i], gram, at[own], doc[own], n[own], many)
            yield key, _squeezed(total, unseen)


def _dear(known, gram, at, doc, n, many: int) -> np.ndarray:
    asked, at = np.unique(at, return_inverse=True)
    found = np.searchsorted(known[0], gram[asked])
    if not np.array_equal(known[0][np.minimum(found, len(known[0]) - 1)], gram[asked]):
        raise ValueError("an n-gram has no cost")
    return np.bincount(doc, known[1][found][at] * n, many).astype(np.int64)


def _added(items):
    sums = {}
    for block, message in items:
        parts = _spread(message)
        sums[block] = [a + b.view(np.int64) for a, b in zip(sums[block], parts)] if block in sums else [b.view(np.int64) for b in parts]
    for block, (total, unseen) in sums.items():
        yield _message({"block": pa.array(np.full(len(total), block), pa.int64()), "place": pa.array(np.arange(len(total)), pa.int32()), "millinats": pa.array(total), "unseen": pa.array(unseen)})


def _scored(docs: DataFrame, trusted: DataFrame, far=_FAR) -> DataFrame:
    """doc_id, lang, tag, n_chars, millinats, and for trusted rows `unseen`: millinats by the model of the folds the row is not in."""
    spark = docs.sparkSession
    blocks = _by_part(arrow_map(docs.select("doc_id", "text", "lang", "tag", "fold"), lambda batches: _blocks(batches, far), "part int, block long, message binary"))
    rows = staged(_table(spark, blocks.mapPartitionsWithIndex(_rows_of), "block long, place int, doc_id long, lang string, tag long, fold int, n_chars long"), "rows")
    mark = F.col("place") * (2 * FOLDS) + F.col("fold") + F.when(F.col("id").isNotNull(), FOLDS).otherwise(0)
    marks = rows.join(trusted, F.col("doc_id") == F.col("id"), "left").groupBy(F.col("block").alias("told")).agg(F.array_sort(F.collect_list(mark.cast("long"))).alias("marks"))
    told = _by_part(arrow_map(marks, _told, "part int, told long, message binary"))
    counts = staged(_table(spark, told.union(blocks).mapPartitionsWithIndex(_shards(_trained)), ", ".join(["gram long"] + [f"n{i} long" for i in range(FOLDS)])), "counts")
    folds = [F.col(f"n{i}") for i in range(FOLDS)]
    others = [sum((n for j, n in enumerate(folds) if j != i), F.lit(0)) for i in range(FOLDS + 1)]  # model i is of all folds but i, the last of all
    per_model = F.explode(F.array(*(F.struct(F.lit(i).alias("model"), n.alias("n")) for i, n in enumerate(others))))
    model = kneser_ney(counts.select("gram", per_model.alias("m")).select("m.model", "gram", "m.n").where("n > 0"), UNIT)
    asks = F.explode(F.filter(F.array(*(F.when(n > 0, i) for i, n in enumerate(folds)), F.lit(FOLDS)), lambda m: m.isNotNull()))
    wanted = counts.select(asks.alias("model"), "gram")
    prices = _by_part(arrow_map(costs(model, wanted, UNIT), _priced, "part int, price long, message binary"))
    sums = told.union(prices).union(blocks).mapPartitionsWithIndex(_shards(_costed)).partitionBy(SHARDS, int).mapPartitions(_added)
    sums = _table(spark, sums, "block long, place int, millinats long, unseen long")
    zero = F.lit(0).cast("long")
    return rows.join(sums, ["block", "place"], "left").select("doc_id", "lang", "tag", "n_chars", *(F.coalesce(c, zero).alias(c) for c in ("millinats", "unseen")))


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`quality`, with the `tag` of each row's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", _tag(F.col("text")).alias("tag"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    trusted = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
               .agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good")).where("good = 1"))
    trusted = staged(trusted.select("id").join(docs, F.col("id") == F.col("doc_id"), "left_semi"), "trusted")  # labels may be of more than these rows
    scored = staged(_scored(docs, trusted, _alone(docs)), "scored")
    known = scored.join(trusted, F.col("doc_id") == F.col("id")).where("n_chars > 0")
    spread, mean = SPREAD / F.sqrt("n_chars"), F.col("millinats") / F.col("n_chars") / 1000
    bounds = (F.percentile_approx(F.col("unseen") / F.col("n_chars") / 1000 - spread, QUANTILE, 10000).alias("limit"), F.min(mean + spread).alias("floor"))
    limits = staged(known.groupBy(F.col("lang").alias("l")).agg(*bounds, F.count(F.lit(1)).alias("known")).where(F.col("known") >= LEAST).drop("known"), "limits")
    overall = known.agg(*bounds).first()
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left")
    limit, floor = (F.coalesce(c, F.lit(overall[c]).cast("double")) for c in ("limit", "floor"))
    some = F.col("n_chars") > 0
    kept = some & F.coalesce((mean - spread <= limit) & (mean + spread >= floor), F.lit(True))
    return out.select("doc_id", "lang", "tag", "n_chars", "millinats", F.when(some, F.exp(mean)).alias("perplexity"),
                      F.exp(limit).alias("threshold"), F.when(some, kept).otherwise(False).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, millinats, perplexity, threshold, kept for every row of `docs` (doc_id, text, lang).

    Trusted text is every document that `labels` (doc_id, quality, toxic) marks as quality 1 and toxic 0, all of it.
    `perplexity` is per character. `threshold` is the QUANTILE of the trusted documents' perplexity in the same language, each
    under the model of the FOLDS it is not in (equal texts are in one fold); a language, or null, with fewer than LEAST
    trusted documents takes that of all trusted ones, since its own quantile is not known. A text is kept when its
    perplexity, less the spread of a text of its length, is within the threshold, and when it is not more predictable than
    every trusted document, as digits or one repeated sign are. Null and empty texts have a null perplexity and are not
    kept: there is nothing to trust. Without any trusted text all other documents are kept and
    have a null threshold. A document with conflicting labels is not trusted; repeated rows are scored each.
    """
    return _judged(docs, labels).drop("tag")


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier keeps.

    Every row is judged by its own doc_id, text and lang, so of rows that share a doc_id, or have none, only those go that are not kept.
    """
    gone = _judged(docs, labels).where("not kept").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("lang").alias("__lang")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (_tag(docs["text"]) == gone["__tag"]) & docs["lang"].eqNullSafe(gone["__lang"])
    return docs.join(gone, same, "left_anti")
