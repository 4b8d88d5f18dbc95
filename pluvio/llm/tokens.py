"""Tokenizers inside tasks: whole-token shortcuts, caches of bounded size, and the library itself for all other text."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pluvio.llm.common import arrow_map

CACHE = 300_000  # pre-tokens in each of a worker's two generations of remembered results
#: Texts of these characters are split here; a text with any other character goes to the library as a whole.
#: tests/llm/test_text_operators.py holds every one of them against the library.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u0148\u014a-\u017e"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\\t\\n\\r "
_plain = re.compile("[\\t\\n\\r\x20-\x7e\xa1-\xac\xae-\u0148\u014a-\u017e]*").fullmatch
_byte_pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
                          f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+").findall
_word_pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+").findall


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class _Cache(dict):
    """What `make` gives for a key, remembered in two generations: a key that is not met for a whole one is dropped."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Byte of each character that stands for one in byte-level vocabularies: printable Latin-1 stands for itself."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> dict[bytes, int]:
    """Ids of the byte strings of a byte-level vocabulary that its own merges make one token of.

    Proved by running the merges on every vocabulary string: a string that is in the vocabulary may still be
    reached by no order of merges, and then counts as several tokens. A word's end is the byte 0xFF, which no
    UTF-8 text has.
    """
    tokenizer, byte_of = library(path), _byte_of()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    end = tokenizer.model.end_of_word_suffix or "\0"
    out = {}
    for string, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if string not in special:
            bare = string.removesuffix(end)
            piece = bytes([byte_of[c] for c in bare])
            ended = bare != string
            if ended or end == "\0":
                got = tokenizer.model.tokenize(bare)
                whole = len(got) == 1 and got[0].id == number
            else:  # the inside of a word: its merges must not depend on what follows, so no word end is set
                whole = True
            if whole:
                out[piece + b"\xff" * ended] = number
    return out


@lru_cache(maxsize=4)
def _merger(path: str):
    """A function piece -> ids by the file's merges, and the ids of whole tokens.

    Merges are ranked by the token that they make: inside the bounds of a whole token its own merges are the only
    ones that can come first, so ranks of tokens and ranks of pairs give the same result.
    """
    tokenizer, whole = library(path), whole_tokens(path)
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    end, byte_of = tokenizer.model.end_of_word_suffix, _byte_of()
    ranks = {bytes([b]): b for b in range(256)}
    if end:
        ranks |= {bytes([b, 255]): 256 + b for b in range(255)}
    for i, pair in enumerate(merges):
        string = "".join(pair.split(" ") if isinstance(pair, str) else pair)
        bare = string.removesuffix(end) if end else string
        piece = bytes([byte_of[c] for c in bare]) + b"\xff" * (bare != string)
        if piece in whole:
            ranks.setdefault(piece, 512 + i)
    id_of = {rank: whole[piece] for piece, rank in ranks.items() if piece in whole}
    engine = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

    def merge(piece: bytes) -> list[int]:
        return [id_of[r] for r in engine._encode_single_piece(piece)]
    return merge, whole


@lru_cache(maxsize=2)
def _counter(path: str):
    """A function text -> number of tokens."""
    tokenizer = library(path)
    merge, whole = _merger(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def pieces(text: str) -> int:
        """Whole tokens count as one at once; only the rest is merged."""
        return sum([1 if p in whole else len(merge(p)) for p in map(str.encode, _byte_pieces(text))])

    cache = _Cache(lambda part: pieces(" " + part))

    def count(text: str) -> int:
        if not _plain(text) or any(s in text for s in special):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        if text[-1:] == " " or any(s in text for s in ("  ", " \n", " \t", " \r")):
            return pieces(text)
        first, *rest = text.split(" ")  # a single space before a word always begins a pre-token
        return pieces(first) + sum(map(cache.__getitem__, rest))
    return count


def _count_batches(path: str):
    def run(batches):
        count = _counter(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                                              "n_tokens": pa.array([count(t) for t in texts], pa.int64())})
    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` (doc_id, text; other columns are ignored).

    Pre-tokens that are whole tokens count as one without a merge; only the rest is merged, each once while it is
    remembered. `path` is a byte-level BPE file at the same place on every machine. Null and empty texts have no
    bytes and no tokens; repeated rows are counted each, and a null doc_id stays null.
    """
    counted = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _count_batches(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function text -> little-endian unsigned 32-bit ids of a lower-casing BPE file with word ends."""
    tokenizer = library(path)
    merge, whole = _merger(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    raw = {number: np.uint32(number).tobytes() for number in tokenizer.get_vocab(with_added_tokens=True).values()}
    single = {piece: raw[number] for piece, number in whole.items()}

    def ids(part: str) -> bytes:
        found = []
        for piece in _word_pieces(part):
            ended = piece.encode() + b"\xff"
            one = single.get(ended)
            found += [one] if one else [raw[i] for i in merge(ended)]
        return b"".join(found)

    cache = _Cache(ids)

    def encode(text: str) -> bytes:
        if _plain(text) and not any(s in text for s in special):
            return b"".join(map(cache.__getitem__, text.lower().split()))
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return encode
