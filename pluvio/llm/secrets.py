"""Secret scans: base patterns, and windows of high entropy in candidate strings."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns. Bytes keep "either case" to ASCII letters.
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # whole runs, like [0-9a-f]+ with the shorter ones dropped

WINDOW = 20  # characters whose entropy is looked at together
#: Least entropy of a window in bits a character, by the narrowest class that holds the window.
FLOOR = {"hex": 2.9, "alnum": 3.6, "base64": 3.75}
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Strings that look random but are not secrets: one kind of letters only, numbers, words joined by signs,
#: UUIDs, dates and placeholders. Callers may pass more patterns; what can match a string in several ways takes time that grows
#: by the power of its length, so the words between signs are never empty here and no word is of two kinds.
_WORD = rb"(?:[a-z]+|[A-Z][a-z]*|[A-Z]{2,}|[0-9]{1,8})"
ALLOWED = (rb"[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9_=+/-]+", rb"%b?(?:[-_/+=]+%b)*[-_/+=]*" % (_WORD, _WORD),
           rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", rb".*(?:example|placeholder|dummy|x{6}|0{8}|1234567890).*")
_HEXSET, _ALNUM = frozenset(b"0123456789abcdefABCDEF"), frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
# The tokens of a run by class: a window lies in a hex or an alnum token, or in what stands between `=` signs.
_TOKENS = {"hex": re.compile(rb"[0-9a-fA-F]{%d,}" % WINDOW), "alnum": re.compile(rb"[A-Za-z0-9]{%d,}" % WINDOW),
           "base64": re.compile(rb"[A-Za-z0-9+/_-]+=*")}
_NAMES = re.compile(rb"(?:(?:[A-Z]?[a-z]+|[A-Z]+)[/_-]+)*")  # words of a path or a name before a token
_PART = [0.0] + [c * log2(c) for c in range(1, WINDOW + 2)]  # the new character is counted before the old one goes


def entropy_spans(string: bytes) -> list[tuple[int, int]]:
    """Unions of all windows of a token whose entropy reaches the floor of the token's class.

    Counts change by one character in and one out a step, and so does the sum of c * log2(c).
    """
    kind = "hex" if _HEXSET.issuperset(string) else "alnum" if _ALNUM.issuperset(string) else "base64"
    count, total, spans = [0] * 256, 0.0, []
    for end, new in enumerate(string, 1):
        total += _PART[count[new] + 1] - _PART[count[new]]
        count[new] += 1
        if end > WINDOW:
            old = string[end - WINDOW - 1]
            total += _PART[count[old] - 1] - _PART[count[old]]
            count[old] -= 1
        if end >= WINDOW and log2(WINDOW) - total / WINDOW >= FLOOR[kind] - 1e-9:
            if spans and end - WINDOW <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - WINDOW, end))
    return spans


def _tokens(run: bytes) -> list[tuple[int, int]]:
    """The tokens of a run, whatever class; the words before a base64 token do not belong to it."""
    out = {m.span() for kind in ("hex", "alnum") for m in _TOKENS[kind].finditer(run)}
    for m in _TOKENS["base64"].finditer(run):
        start = _NAMES.match(run, m.start(), m.end()).end()
        if m.end() - start >= WINDOW:
            out.add((start, m.end()))
    return sorted(out)


def hits(run: bytes, allowed: re.Pattern) -> list[tuple[int, int]]:
    """Unions of the tokens of a run that are not allowed and hold a window that reaches the floor of its class.

    A key is covered whole, though single windows of it stay below the floor, and whatever name or path stands before it.
    """
    out = []
    for start, end in _tokens(run):
        token = run[start:end]
        if not entropy_spans(token) or allowed.fullmatch(token):
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans in code points, in order; base spans are never suppressed."""
    data = text.encode("utf-8", "replace")
    lower, found = data.lower(), []
    if any(w in lower for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    base = sorted(found)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))  # reach: the furthest end so far
    for m in _CANDIDATE.finditer(data):
        string = m[0]
        if string.isalpha() and string.islower():
            continue
        for start, end in hits(string, allowed):
            start, end = start + m.start(), end + m.start()
            before = bisect_right(starts, start)
            if not before or reach[before - 1] < end:  # else inside a base span
                found.append((start, 3, end))
    if found and len(data) != len(text):  # byte offsets to code points
        points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        found = [(int(points[s]), k, int(points[e])) for s, k, e in found]
    return sorted(found)


def _scan(patterns: tuple[bytes, ...]):
    def run(batches):
        allowed = re.compile(b"|".join(b"(?:%s)" % p for p in patterns), re.S)
        for batch in batches:
            out = {"n": [[], [], [], []], "sha": [], "spans": []}
            for text in batch["text"].to_pylist():
                spans = find_spans(text or "", allowed)
                for kind in range(4):
                    out["n"][kind].append(sum(k == kind for _, k, _ in spans))
                named = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
                base = [x for x, (_, k, _) in zip(named, spans) if k < 3]
                out["sha"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
                out["spans"].append(",".join(named))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in zip(KINDS, out["n"])}
                                             | {"base_sha256": pa.array(out["sha"], pa.string()), "spans": pa.array(out["spans"], pa.string())})
    return run


def find_secrets(docs: DataFrame, allowed: tuple[bytes, ...] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans for every row of `docs` (doc_id, text).

    `spans` lists kind:start:end in code points, by start and then kind; an entropy span inside a base span is left out.
    Null and empty texts have no spans. Repeated rows are scanned each, a null doc_id stays null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, _scan(allowed), "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


MARK = "[SECRET]"


def _redact(patterns: tuple[bytes, ...]):
    def run(batches):
        allowed = re.compile(b"|".join(b"(?:%s)" % p for p in patterns), re.S)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for i, text in enumerate(texts):
                parts, at = [], 0
                for start, _, end in find_spans(text, allowed) if text else ():
                    if start >= at:
                        parts += [text[at:start], MARK]
                    at = max(at, end)
                if at:
                    texts[i] = "".join(parts) + text[at:]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))
    return run


def redacted(docs: DataFrame, allowed: tuple[bytes, ...] = ALLOWED) -> DataFrame:
    """`docs`, all rows and columns, with every span of the texts replaced by MARK; spans that overlap become one."""
    return arrow_map(docs, _redact(allowed), docs.schema)
