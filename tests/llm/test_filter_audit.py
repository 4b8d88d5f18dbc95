import itertools
import re
from collections import Counter

import numpy as np
import pytest
from conftest import EDGE, LONG

from pluvio.llm import filter_audit as A

ASCII_BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    """Failure sets, one text at a time; rows are (doc_id, lang, text)."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, lang, text in rows:
        text = text or ""
        words = ASCII_BLANKS.findall(text)
        own = set("A" if len(words) < 100 else "") | set("B" if 100 * len(set(words)) < 80 * len(words) else "")
        own |= set("C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else "") | set("D" if re.search(r"[#$%&*|]", text) else "")
        out.append((i, lang or "", own | set("E" if i is not None and i > least[text] else "")))
    return out


def expected(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    known, out, removals = failures(rows), {}, Counter()
    for part in {p for _, p, _ in known}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, p, f in known if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                hit = [(i, f) for i, f in left if name in f]
                redundant = sum(name in f for _, f in gone)
                left = [(i, f) for i, f in left if name not in f]
                gone += hit
                removals[part, name] += len(hit)
                out[part, order, step] = (len(left), len(hit), redundant, sum(f == {name} for _, p, f in known if p == part),
                                          sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit))
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 as shard", "'x' as words", "2 as failed")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as text")
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in A.audit(docs, known).collect()}


def texts(n):
    rng = np.random.default_rng(n)
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, rng.choice([40, 400]), int(rng.choice([5, 99, 100, 130])))]
        if rng.random() < 0.3:
            words = [w.upper() * 3 for w in words]
        if rng.random() < 0.3:
            words[0] = rng.choice(list("#$%&*|"))
        yield i + 1, rng.choice(["en", "de", None, ""]), rng.choice([" ", "\n", " \x0b\t"]).join(words)


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_DOCS", 7)
    rows = [(i, None if lang is None else str(lang), str(t)) for i, lang, t in texts(120)]
    rows += [(200 + i, "en", rows[i % 9][2]) for i in range(40)] + [(300, "fr", None), (301, "fr", ""), (302, "fr", " \n"), (None, "fr", rows[0][2]), (None, None, None), rows[3], rows[3], (303, "fr", LONG), (304, "fr", LONG), (305, "ja", "日本\x0b語 日本")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 220)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (7, None, None)]
    assert result(spark, rows, labels) == expected(rows, labels)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_matrix(spark, edge, monkeypatch, buckets):
    monkeypatch.setattr(A, "SHARD_DOCS", 3)
    monkeypatch.setattr(A, "BUCKETS", buckets)
    vocabulary, shards = A.document_terms(edge)
    word_of = {r.term: r.word for r in vocabulary.collect()}
    assert sorted(word_of) == list(range(len(word_of))) and len(set(word_of.values())) == len(word_of)
    got = []
    for r in shards.collect():
        starts, terms, counts = np.frombuffer(r.starts, "<i8"), np.frombuffer(r.terms, "<i8"), np.frombuffer(r.counts, "<i4")
        for row, lo, hi in zip(r.rows, starts, starts[1:]):
            assert len(set(terms[lo:hi].tolist())) == hi - lo
            got.append((row.doc_id or -1, Counter({word_of[t]: c for t, c in zip(terms[lo:hi].tolist(), counts[lo:hi].tolist())})))
    want = [(i or -1, Counter(ASCII_BLANKS.findall(t or ""))) for i, t in EDGE]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_edges(spark, edge, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(nothing, labels).collect() == [] and A.audit(edge, labels).count() == 600
    assert A.document_terms(nothing)[0].collect() == []
    failed = {r.doc_id: r.failed for r in A.filter_failures(edge).where("doc_id is not null").collect()}
    assert failed[1] == 1 and failed[2] == 1 | 16 and failed[7] == 1 | 16 and failed[8] & 16 == 0  # rows of one id are no copies of each other
