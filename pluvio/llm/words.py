"""Words, word hashes and shingle hashes of one text, vectorised with NumPy. Used inside tasks only."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 20  # bytes hashed at once; bounds the working memory of very long texts
_POWERS: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chunks(data: bytes):
    """Slices of at most about _CHUNK bytes that end at white space; one longer word stays whole."""
    at = 0
    while len(data) - at > _CHUNK:
        view = SPACE[np.frombuffer(data, np.uint8, _CHUNK, at)]
        cut = _CHUNK - int(np.argmax(view[::-1])) if view.any() else 0
        while not cut:
            start = at + _CHUNK
            rest = SPACE[np.frombuffer(data, np.uint8, min(_CHUNK, len(data) - start), start)]
            if rest.any():
                cut = _CHUNK + int(np.argmax(rest)) + 1
            elif start + len(rest) >= len(data):
                cut = len(data) - at
            else:
                more = start + len(rest)
                while more < len(data) and not SPACE[data[more]]:
                    more += 1
                cut = more - at
        yield data[at:at + cut]
        at += cut
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, in order."""
    out = []
    with np.errstate(over="ignore"):
        for piece in _chunks(data):
            raw = np.frombuffer(piece, np.uint8)
            if not len(raw):
                continue
            inside = np.empty(len(raw) + 2, bool)
            inside[0] = inside[-1] = False
            inside[1:-1] = ~SPACE[raw]
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[::2], edges[1::2]
            if not len(starts):
                continue
            up, down = _powers(len(raw))
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=total[1:])
            h = (total[ends] - total[starts]) * down[starts]
            out.append(mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text gives its whole sequence as one, no words give none."""
    if not len(words):
        return words
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        h = words[:len(words) - k + 1].copy()
        for j in range(1, k):
            h = h * np.uint64(0x2545F4914F6CDD1D) + words[j:len(words) - k + 1 + j]
        return mix(h + np.uint64(k))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; null and empty texts have none."""
    found = np.sort(shingle_hashes(word_hashes(lower_bytes(text or "")), k))
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def lower_bytes(text: str) -> bytes:
    """UTF-8 bytes with A-Z in lower case and every other character as it is."""
    return text.encode("utf-8", "replace").lower()
