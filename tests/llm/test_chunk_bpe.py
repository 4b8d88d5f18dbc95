import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import EDGE, LONG
from tokenizers import Tokenizer

from pluvio.llm import chunk_bpe
from pluvio.llm.chunk_bpe import assemble, chunk_bounds, chunks, decode_documents, encode_documents, plan, token_digests

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def hard_texts():
    rng = np.random.default_rng(9)
    units = ["Word", "the", "re-use", "don't", "we'll", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "é", "é", "́", "ﬁ", "İ", "Σ", "ΑΣ", "\U0001f600", "日本語", "क्षि", "١٢٣",
             " ", " ", "\x0b", "\x1c", "12345", "...!!", "A" * 70, "한", "Ångström", "'", "s", "'S", "\x00"]
    for n in (0, 1, 5, 40, 300, 1500):
        for gap in ("", " ", "\n \t", "　", "\r\n"):
            yield gap.join(rng.choice(units, n).tolist())


def test_cuts_follow_the_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 5000, np.uint8).tobytes()
    own = [{data[lo:hi] for lo, hi in zip(b, b[1:])} for data in (rng.integers(97, 123, n, np.uint8).tobytes() + shared for n in (10, 777)) for b in [chunk_bounds(data)]]
    assert len(own[0] & own[1]) >= 0.8 * len(own[0] - own[1] | own[0] & own[1]) - 3
    big = (LONG * 12).encode()
    assert len(big) > 2 * chunk_bpe.BLOCK and chunk_bounds(b"") == [0]
    whole = chunk_bounds(big)
    chunk_bpe_block, chunk_bpe.BLOCK = chunk_bpe.BLOCK, 1 << 30
    try:
        assert whole == chunk_bounds(big)
    finally:
        chunk_bpe.BLOCK = chunk_bpe_block


def assembled(text, every):
    """The ids of a text of which every so manieth chunk is shared."""
    encode, kind = chunk_bpe._short(PATH)
    found = chunks(text)
    some = {chunk_bpe._mark(d) for _, d in found[::every]}
    known = {(chunk_bpe._mark(d), chunk_bpe._rest(d)): encode(c) for c, d in found}
    return np.frombuffer(assemble(plan(found, some.__contains__, encode), known), kind).tolist()


def test_assembled_ids_equal_the_library(library):
    for text in hard_texts():
        assert b"".join(c for c, _ in chunks(text)).decode() == text
        for every in (1, 2, 3):
            assert assembled(text, every) == ids_of(library, text)
    text = " ".join(f"Wörd{i} don't" for i in range(3000)) + "x" * 9000 + " end"
    assert len(chunks(text)) > 50 and assembled(text, 1) == assembled(text, 2) == ids_of(library, text)
    with pytest.raises(ValueError):
        assemble([{"mark": 1, "rest": 2, "head": b"ab", "tail": b""}], {(1, 2): b"cdef"})


def test_query_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in token_digests(decode_documents(encode_documents(docs, PATH), PATH)).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(library, r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                 hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_edge_cases(spark, edge, nothing, library):
    out = encode_documents(edge, PATH).collect()
    assert len(out) == len(EDGE)
    want = sorted((str(i), ids_of(library, t)) for i, t in EDGE)
    assert sorted((str(r.doc_id), r.ids) for r in out) == want
    assert encode_documents(nothing, PATH).collect() == [] and decode_documents(encode_documents(nothing, PATH), PATH).collect() == []
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(hard_texts())] * 2, "doc_id long, text string")
    for r in decode_documents(encode_documents(odd, PATH), PATH).collect():
        text = next(t for i, t in enumerate(hard_texts()) if i == r.doc_id)
        assert r.ids == ids_of(library, text) and r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_full_bit_table_and_equal_keys_change_nothing(spark, library, monkeypatch):
    """Every chunk passes as shared, and all texts share one key: only work changes."""
    monkeypatch.setattr(chunk_bpe.Shared, "__call__", lambda self, mark: True)
    texts = [LONG[:20000], "Some line that two texts hold, " * 40 + "end", "x " + "Some line that two texts hold, " * 40, None, "", LONG[5000:20000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.ids) for r in encode_documents(docs, PATH).collect()) == [(i, ids_of(library, t)) for i, t in enumerate(texts)]


def test_decode_makes_no_python_list_of_ids():
    from pluvio.llm import chunk_bpe as C
    spelled = C._spelled(PATH)
    ids = [[5, 6, 7], [], None, list(range(300)), [0]]

    class Column:  # an Arrow column that refuses to become Python numbers
        def __init__(self, array):
            self.array = array

        def fill_null(self, value):
            return self.array.fill_null(value)

        def to_pylist(self):
            raise AssertionError("ids as Python lists")

        def __arrow_array__(self, type=None, **more):
            return self.array

    column = pa.array(ids, pa.list_(pa.int32()))
    for lo, n in ((0, 5), (1, 4), (3, 0)):
        batch = dict(doc_id=pa.array(range(n), pa.int64()), ids=Column(column.slice(lo, n)))
        out = next(C._decode(PATH)([batch]))
        assert out["decoded"].to_pylist() == [" ".join(spelled[i] for i in own or ()) for own in ids[lo:lo + n]]


def test_alone_texts_stop_at_the_first_shared_chunk(monkeypatch):
    from pluvio.llm import chunk_bpe as C
    text, asked = " ".join(f"word{i}" for i in range(5000)), []
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]})
    out = next(C._encode_alone(PATH, lambda mark: asked.append(mark) or True)([batch]))
    assert out.num_rows == 0 and len(asked) == 1
    digests = []
    real = C.hashlib.blake2b
    monkeypatch.setattr(C.hashlib, "blake2b", lambda *a, **k: digests.append(1) or real(*a, **k))
    next(C._encode_alone(PATH, lambda mark: True)([batch]))
    assert len(digests) == 1  # was one for every chunk
