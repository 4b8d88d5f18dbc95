"""BPE encoding by content-defined chunks, and decoding.

A rolling hash over 8 bytes cuts texts where their content says so, so that passages that documents share are cut alike
wherever they stand. Chunks that occur more than once in the whole table are encoded once. A text that holds any of them takes
their ids; between two chunks the word that the cut went through is encoded again, in a window that grows to the next blank
on either side, over further chunks if need be, and the ids of a chunk are used only as far as they agree with those of its own
cut words. Texts without a shared chunk are encoded where they are, and so are the stretches between shared chunks.

Which chunks are shared is counted over all documents by 64-bit marks. Before anything is moved, tasks test their chunks in a
bit table of the shared marks, of eight bits a mark and MOST_BITS in all; a fuller table lets more chunks
through and changes no result. Ids are taken over only for a chunk whose 128-bit digest is the same. No text moves but that of
the shared chunks, once a task; ids move in 16 bits where the vocabulary allows.

A text's ids are those of its parts between ASCII blanks, one after another: no token, special string or
composed character spans a blank, and the file's normaliser and its pre-tokens look at nothing beyond one. So ids that end or begin
at a blank are those of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map, staged
from pluvio.llm.tokens import encoder, library
from pluvio.llm.words import mix

CUT_BITS, LEAST_BYTES = 9, 64  # a cut follows one of 2 ** CUT_BITS windows, this far from the cut before
BLOCK = 1 << 20  # bytes hashed at once
BITS_A_MARK, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 27  # 16 MB at most, whatever the corpus
SEEN = 1 << 18  # chunks that a task remembers to have handed on; a forgotten one goes out again
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(17)) >> np.uint64(32)).astype(np.uint32)
_blank = re.compile(rb"[\x20\x09-\x0D]").search


def _rolled(data: bytes) -> np.ndarray:
    """For each byte the hash of the 8 bytes that end with it, four bits a byte further on."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4):
        h[step:] = h[step:] + (h[:-step] << np.uint32(4 * step))
    return h


def chunk_bounds(data: bytes) -> list[int]:
    """0, the cuts of UTF-8 bytes, and their length; cuts are between characters."""
    bounds = [0]
    for at in range(0, len(data), BLOCK):
        before = min(at, 7)
        part = data[at - before:at + BLOCK]
        hit = at - before + 1 + np.flatnonzero(_rolled(part) < np.uint32(1 << 32 - CUT_BITS))
        for end in hit[hit > at].tolist():
            if LEAST_BYTES <= end - bounds[-1] and end < len(data) and data[end] & 0xC0 != 0x80:
                bounds.append(end)
    return bounds + [len(data)] if data else [0]


def _each_chunk(text: str | None) -> Iterator[tuple[bytes, bytes]]:
    data = (text or "").encode("utf-8", "replace")
    bounds = chunk_bounds(data)
    return ((data[lo:hi], hashlib.blake2b(data[lo:hi], digest_size=16).digest()) for lo, hi in zip(bounds, bounds[1:]))


def chunks(text: str | None) -> list[tuple[bytes, bytes]]:
    """(bytes, digest) of the chunks of a text; null and empty texts have none."""
    return list(_each_chunk(text))


def _mark(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _rest(digest: bytes) -> int:
    return int.from_bytes(digest[8:], "little", signed=True)


def _key(text: str) -> int:
    return _mark(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())


def _marks(batches):
    """The key of every text and the marks of its chunks."""
    for batch in batches:
        texts = batch["text"].to_pylist()
        yield pa.RecordBatch.from_pydict({"key": pa.array([_key(t or "") for t in texts], pa.int64()),
                                          "marks": pa.array([[_mark(d) for _, d in chunks(t)] for t in texts], pa.list_(pa.int64()))})


class Shared:
    """Bit table of the marks of shared chunks: says no only for marks that are none."""

    def __init__(self, broadcast, bits: int):
        self.broadcast, self.bits, self.table = broadcast, bits, None

    def __call__(self, mark: int) -> bool:
        if self.table is None:
            self.table = self.broadcast.value
        slot = mark & self.bits - 1
        return bool(self.table[slot >> 3] >> (slot & 7) & 1)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "bits": self.bits, "table": None}


def _bit_table(shared: DataFrame) -> Shared:
    """At most MOST_BITS / 64 numbers come to the driver."""
    wanted = BITS_A_MARK * max(shared.count(), 1)
    bits = min(max(1 << (wanted - 1).bit_length(), LEAST_BITS), MOST_BITS)
    slot = F.col("mark").bitwiseAND(bits - 1)
    words = (shared.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return Shared(shared.sparkSession.sparkContext.broadcast(table.astype("<i8").tobytes()), bits)


def _shared_chunks(is_shared: Shared):
    """(mark, rest, chunk) of the chunks that may be shared, each once as long as the task remembers it."""
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            digests, found = [], []
            for text in batch["text"].to_pylist():
                for chunk, digest in chunks(text):
                    if digest not in seen and is_shared(_mark(digest)):
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        digests.append(digest)
                        found.append(chunk)
            yield pa.RecordBatch.from_pydict({"mark": pa.array(map(_mark, digests), pa.int64()), "rest": pa.array(map(_rest, digests), pa.int64()), "chunk": pa.array(found, pa.binary())})
    return run


def _shared_places(is_shared: Shared):
    """(key, mark) of a text's chunks that may be shared."""
    def run(batches):
        for batch in batches:
            keys, marks = [], []
            for key, own in zip(batch["key"].to_pylist(), batch["marks"].to_pylist()):
                some = {m for m in own if is_shared(m)}
                keys += [key] * len(some)
                marks += some
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "mark": pa.array(marks, pa.int64())})
    return run


@lru_cache(maxsize=2)
def _short(path: str):
    """(encode, kind): ids as bytes of 16 bits where the vocabulary allows, else of 32."""
    encode, kind = encoder(path), "<u2" if max(library(path).get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"
    if kind == "<u4":
        return lambda data: encode(data.decode()), kind
    return lambda data: np.frombuffer(encode(data.decode()), "<u4").astype("<u2").tobytes(), kind


def _encode_chunks(path: str):
    def run(batches):
        encode, _ = _short(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"mark": batch["mark"], "rest": batch["rest"], "ids": pa.array([encode(c) for c in batch["chunk"].to_pylist()], pa.binary())})
    return run


def plan(found: list[tuple[bytes, bytes]], is_shared: Callable[[int], bool], encode: Callable[[bytes], bytes]) -> list[dict]:
    """How a text's ids are put together: `ids` that are known here, and shared chunks by `rest` with the ids of their cut words.

    The cut words around a shared chunk are encoded with what stands beyond the cut; `head` and `tail` are the ids that they have in the chunk.
    """
    parts, open_window = [], []
    for chunk, digest in found:
        first = _blank(chunk) if is_shared(_mark(digest)) else None
        if first is None:  # not shared, or without a blank: the window grows over it
            open_window.append(chunk)
            continue
        last = len(chunk) - _blank(chunk[::-1]).start()
        head, tail = chunk[:first.start()], chunk[last:]
        parts.append({"ids": encode(b"".join([*open_window, head]))})
        parts.append({"mark": _mark(digest), "rest": _rest(digest), "head": encode(head), "tail": encode(tail)})
        open_window = [tail]
    return parts + [{"ids": encode(b"".join(open_window))}]


def assemble(parts: list[dict], known: dict[tuple[int, int], bytes]) -> bytes:
    """The ids of a text from its plan and the ids of the shared chunks by mark and rest."""
    out = []
    for part in parts:
        if part.get("mark") is None:
            out.append(part["ids"])
            continue
        ids, head, tail = known[part["mark"], part["rest"]], part["head"], part["tail"]
        if not (ids.startswith(head) and ids.endswith(tail) and len(head) + len(tail) <= len(ids)):
            raise ValueError("a chunk's ids do not agree with those of its cut words")
        out.append(ids[len(head):len(ids) - len(tail)])
    return b"".join(out)


def _ids_column(found: list[bytes], kind: str) -> pa.Array:
    width = int(kind[-1])
    lengths = np.array([len(ids) // width for ids in found], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(np.frombuffer(b"".join(found), kind).astype(np.int32)))


def _encode_alone(path: str, is_shared: Shared):
    """Rows whose text holds no chunk that may be shared."""
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            alone = [i for i, t in enumerate(texts) if not any(is_shared(_mark(d)) for _, d in _each_chunk(t))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(alone, pa.int64())), "ids": _ids_column([encode(texts[i] or "") for i in alone], "<u4")})
    return run


_PARTS = "array<struct<mark:bigint,rest:bigint,head:binary,tail:binary,ids:binary>>"
_PART_TYPE = pa.list_(pa.struct([("mark", pa.int64()), ("rest", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("ids", pa.binary())]))


def _plan_shared(path: str, is_shared: Shared):
    """The other rows: the key of the text and its plan."""
    def run(batches):
        encode, _ = _short(path)
        for batch in batches:
            ids, keys, plans = [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found = chunks(text)
                if any(is_shared(_mark(d)) for _, d in found):
                    ids.append(doc_id)
                    keys.append(_key(text))
                    plans.append(plan(found, is_shared, encode))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "plan": pa.array(plans, _PART_TYPE)})
    return run


def _assemble_rows(path: str):
    def run(batches):
        _, kind = _short(path)
        for batch in batches:
            found = []
            for own, shared in zip(batch["plan"].to_pylist(), batch["parts"].to_pylist()):
                found.append(assemble(own, {(p["mark"], p["rest"]): p["ids"] for p in shared or ()}))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "ids": _ids_column(found, kind)})
    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) for every row of `docs` (doc_id, text; other columns are ignored).

    `path` is a lower-casing BPE file with word ends, at the same place on every machine; no special tokens are
    added, special strings inside texts are handled as the library does. Null and empty texts have no ids, repeated
    rows are given each, a null doc_id stays null, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = staged(arrow_map(rows.select("text"), _marks, "key long, marks array<long>"), "marks")
    shared = staged(marked.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"), "shared")
    is_shared = _bit_table(shared)
    handed = arrow_map(rows.select("text"), _shared_chunks(is_shared), "mark long, rest long, chunk binary")
    once = handed.groupBy("mark", "rest").agg(F.first("chunk").alias("chunk"))
    encoded = staged(arrow_map(once, _encode_chunks(path), "mark long, rest long, ids binary"), "encoded")
    texts = marked.groupBy("key").agg(F.first("marks").alias("marks"))
    places = arrow_map(texts, _shared_places(is_shared), "key long, mark long")
    parts = places.join(encoded, "mark").groupBy("key").agg(F.collect_list(F.struct("mark", "rest", "ids")).alias("parts"))
    planned = arrow_map(rows, _plan_shared(path, is_shared), f"doc_id long, key long, plan {_PARTS}").join(parts, "key", "left")
    return (arrow_map(rows, _encode_alone(path, is_shared), "doc_id long, ids array<int>")
            .union(arrow_map(planned.select("doc_id", "plan", "parts"), _assemble_rows(path), "doc_id long, ids array<int>")))


@lru_cache(maxsize=2)
def _spelled(path: str) -> list[str]:
    """The string of every id; ids that the file leaves out have none."""
    names = library(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(names.values()) + 1)
    for name, number in names.items():
        out[number] = name
    return out


def _decode(path: str):
    def run(batches):
        spelled = pa.array(_spelled(path), pa.string())
        for batch in batches:
            lists = batch["ids"].fill_null([])
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a null is no id")
            words = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), spelled.take(flat))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "ids": batch["ids"], "decoded": pc.binary_join(words, " ")})
    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded for rows of doc_id and ids. A file without a decoder spells the tokens with blanks between; null ids give ''."""
    if library(path).decoder is not None:
        raise ValueError("only files without a decoder are spelled here")
    return arrow_map(encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), _decode(path), "doc_id long, ids array<int>, decoded string")


def token_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with blanks between) and decoded_sha256 for rows of `decode_documents`."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
