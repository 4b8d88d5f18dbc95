import hashlib
import zlib

import numpy as np
from conftest import EDGE

from pluvio.llm.repeats import CommonPrefixes, SuffixTree, periodic_runs, run_digests, runs_of, with_periodic_tails, word_runs


def brute_runs(s, least=12):
    """Maximal stretches for every period, of which the smallest period is kept."""
    n, found = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((i, k, q) for (i, k), q in found.items() if not any(k >= 2 * p and all(s[x] == s[x + p] for x in range(i, i + k - p)) for p in range(1, q)))


def expected(text, least=12):
    words = [w for w in (text or "").encode().split()]
    number = {}
    runs = brute_runs([number.setdefault(w, len(number)) for w in words], least)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return len(words), sorted(runs, key=lambda r: (r[0], r[2])), b" ".join(w for i, w in enumerate(words) if i not in gone)


def sequences():
    rng = np.random.default_rng(5)
    for n in range(1, 40):
        yield [1] * n
        yield [i % 3 + 1 for i in range(n)]
    for _ in range(400):
        n, k = int(rng.integers(1, 90)), int(rng.integers(1, 4))
        yield rng.integers(1, k + 1, n).tolist()
    for _ in range(100):
        part = rng.integers(1, 6, int(rng.integers(1, 25))).tolist()
        yield rng.integers(1, 6, 7).tolist() + part * int(rng.integers(2, 5)) + part[:3] + rng.integers(1, 6, 9).tolist()


def test_runs_against_brute_force():
    for s in sequences():
        for least in (2, 12):
            assert runs_of(s, least) == sorted(brute_runs(s, least), key=lambda r: (r[0], r[2])), s


def test_tree_and_common_prefixes():
    rng = np.random.default_rng(6)
    for _ in range(50):
        s = rng.integers(1, 4, int(rng.integers(2, 60))).tolist()
        starts, least = SuffixTree(s).tour()
        assert starts.tolist() == sorted(range(len(s) + 1), key=lambda i: s[i:])
        down = SuffixTree(s).tour(descending=True)[0]
        assert down.tolist() == sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]])
        a, b = np.array([(i, j) for i in range(len(s)) for j in range(i)]).T
        want = [next((k for k in range(len(s) - i) if s[i + k] != s[j + k]), len(s) - i) for i, j in zip(a, b)]
        assert CommonPrefixes(starts, least)(a, b).tolist() == want


def test_texts_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(150):
        part = [f"w{x}" for x in rng.integers(0, 9, int(rng.integers(1, 30)))]
        noise = lambda: [f"n{x}" for x in rng.integers(0, 30, int(rng.integers(0, 60)))]
        text = " \t\n"[int(rng.integers(3))].join(noise() + part * int(rng.integers(2, 9)) + noise() + part + noise() + part * 2)
        assert word_runs(text.encode()) == expected(text)
    exact = " ".join(f"w{i}" for i in range(6))
    assert word_runs(f"{exact} {exact}".encode())[1] == [(0, 12, 6)]  # the shortest run of its period, whose middle gram does not repeat


def digest(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    n, runs, left = expected(b" ".join(words).decode())
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r) for r in run_digests(periodic_runs(with_periodic_tails(docs))).collect()}
    short = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 4000]
    assert len(short) > 100 and any(got[r.doc_id][1] for r in short)
    for r in short:
        assert got[r.doc_id] == digest(r.doc_id, r.text)


def test_edge_cases(edge, nothing):
    out = run_digests(periodic_runs(with_periodic_tails(edge))).collect()
    assert len(out) == len(EDGE) and sum(r.doc_id is None for r in out) == 1
    got = {r.doc_id: r for r in out}
    empty = hashlib.sha256(b"").hexdigest()
    for i in (1, 2, 3):
        assert (got[i].n_runs, got[i].start, got[i].exponent_milli, got[i].runs_sha256, got[i].collapsed_sha256) == (0, None, None, empty, empty)
    assert run_digests(periodic_runs(with_periodic_tails(nothing))).collect() == []


def test_long_stretch():
    n, runs, left = word_runs(b"a b " * 100_000)
    assert (n, runs, left) == (200_000, [(0, 200_000, 2)], b"a b")
