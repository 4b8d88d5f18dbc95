"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map
from pluvio.llm.words import SPACE, shingle_hashes, word_hashes

LOST = 0.5  # a document goes when more than this share of its word characters stood in failing lines
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CLOSED = re.compile(rb"""(?:[.!?:;]|\xe2\x80\xa6|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)(?:["')\]]|\xe2\x80\x9d|\xe2\x80\x99|\xc2\xbb)*$""")
_INNER = re.compile(rb"[.!?:;,][\x20\x09]")  # a long line with these is prose that lacks only its last sign
_SEPARATORS = re.compile(rb"[|>]|\xc2\xbb|\xe2\x80\xa2|\xc2\xb7|\xe2\x80\xba")
_BOILERPLATE = re.compile(rb"cookie|javascript|privacy policy|terms of (?:use|service)|all rights reserved|lorem ipsum|sign in|log in"
                          rb"|subscribe|newsletter|click here|read more|share (?:this|on)|follow us|skip to|add to cart|back to top")
_SHORT_LINE = 25  # boilerplate phrases count in lines of up to this many words; prose may mention them


def line_fails(line: bytes, words: list[bytes]) -> str:
    """The first rule that a line with words fails, or an empty string."""
    n = len(words)
    if n <= _SHORT_LINE and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    separators = len(_SEPARATORS.findall(line))
    if separators >= 3 and 5 * separators >= n:
        return "navigation"
    signs = sum(line.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    if 10 * signs > len(line) and signs >= 3:
        return "symbols"
    if n >= 3 and line.upper() == line and line.lower() != line:
        return "capitals"
    if n >= 12 and 4 * len(set(words)) < n:
        return "repetition"
    if _CLOSED.search(line.rstrip()) or n >= 10 and _INNER.search(line):
        return ""
    return "punctuation"


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost word characters, cleaned text of one text."""
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    word_chars = points - int(SPACE[raw].sum())
    hashes = word_hashes(data)
    repeated = 0
    if len(hashes) >= 4:
        _, inverse, times = np.unique(shingle_hashes(hashes, 3), return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        inside = np.zeros(len(hashes), bool)
        for j in range(3):
            inside[j:len(again) + j] |= again
        repeated = int(inside.sum())
    seen, duplicates, lost, kept = set(), 0, 0, []
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        seen.add(line)
        duplicates += again
        if again or line_fails(line, words):
            lost += sum(len(w.decode("utf-8", "replace")) for w in words)
        else:
            kept.append(line)
    return len(hashes), word_chars, int(_SYMBOLS[raw].sum()), duplicates, repeated, lost, b"\n".join(kept).decode("utf-8", "replace")


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")


def _clean(batches):
    for batch in batches:
        rows = [measure(t or "") for t in batch["text"].to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {c: pa.array(v, pa.int64()) for c, v in zip(_NAMES, columns)}
                                         | {"clean_text": pa.array(columns[6], pa.string())})


def clean_lines(docs: DataFrame) -> DataFrame:
    """Counts, verdict and cleaned text of every row of `docs` (doc_id, text; other columns are ignored).

    Lines are parts between \\n. Lines with a word go when they repeat an earlier line or fail a rule: navigation and other
    boilerplate, symbols, capitals, one word over and over, or no closing punctuation. `base_failed`: fewer than 50 words, or more
    than half of them in 3-word windows that occur again. `kept`: not base_failed, and at most LOST of the word characters were
    in lines that went. Null and empty texts have zeros and fail; repeated rows are judged each, a null doc_id stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _NAMES) + ", clean_text string"
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (arrow_map(rows, _clean, schema).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= LOST * F.col("word_chars"))))
