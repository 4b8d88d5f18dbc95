import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from pluvio.llm import near_dedup as N
from pluvio.llm.components import components


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def expected(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    at = {i: i for i in sets}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            at[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def texts(n, seed):
    """Groups of near copies at all distances from an original, texts that share a passage, and single ones."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(40)]
    for _ in range(n):
        base = [word() for _ in range(rng.randint(60, 140))]
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 6, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
        out.append(passage + [word() for _ in range(rng.randint(5, 40))])
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("small,full,depth", [(64, 4096, 12), (3, 6, 3)])
def test_against_brute_force(spark, monkeypatch, small, full, depth):
    """With the usual limits, and with limits so low that nodes branch and are left over at the last level."""
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "FULL", full)
    monkeypatch.setattr(N, "MAX_DEPTH", depth)
    rows = texts(25, 7)
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected(rows, 3, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_edge_cases(edge, nothing):
    out = N.near_duplicates(edge, 3, 85, 100).collect()
    assert len(out) == edge.count()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 6, False), (None, 1, None, True)} <= got
    assert {(r.doc_id, r.component_id) for r in out} >= {(4, 4), (5, 4)}
    assert N.near_duplicates(nothing).collect() == []
    kept = N.first_of_each_group(edge, k=3, num=85, den=100)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 9]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 300)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: x for link in links for x in link}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_shared_counts():
    import numpy as np
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 5000, 8000)]
    full = N.shared_counts(sets)
    assert all(full[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(4) if i != j)


@pytest.mark.parametrize("small,full,group", [(12, 4, 5), (12, 60, 64), (2000, 4096, 5)])
def test_large_nodes_and_groups(spark, monkeypatch, small, full, group):
    """Nodes that are cut and branch on, hundreds of near copies around one text, and groups that are judged in parts."""
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "FULL", full)
    monkeypatch.setattr(N, "GROUP", group)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "MAX_DEPTH", 5)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    near = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(90)] = f"x{rng.randrange(999)}"
        near.append(" ".join(copy))
    rows = texts(6, 8) + [(1000 + i, t) for i, t in enumerate(near)]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected(rows, 3, 85, 100)


def test_shared_ids_are_one_document(spark):
    rows = [(3, "x y z"), (5, "x y z"), (5, " ".join(f"b{i}" for i in range(60))), (7, " ".join(f"b{i}" for i in range(61))), (5, "c d e"), (9, "c d e f"), (10, "c d e")]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(3, 3, True)] + [(5, 3, False)] * 3 + [(7, 3, False), (9, 9, True), (10, 3, False)]
    kept = N.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85, den=100)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9]


def test_repeated_rows(spark):
    """A thousand rows of two documents cost and give no more than a thousand rows."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"a{i}" for i in range(81))
    out = N.near_duplicates(spark.createDataFrame([(1, a), (2, b)] * 500 + [(None, a)] * 20, "doc_id long, text string"), 3, 85, 100).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True)] * 20 + [(1, 1, True)] * 500 + [(2, 1, False)] * 500


def test_sides_part_no_candidates(spark):
    """Members of a pair that agrees in enough positions share a side, whatever the pivot."""
    import numpy as np
    import pyarrow as pa
    rng, least = np.random.default_rng(4), 84
    pivot = rng.integers(0, 256, N.WIDTH, np.uint8)
    pairs = []
    for _ in range(3000):
        one = np.where(rng.random(N.WIDTH) < rng.random(), pivot, rng.integers(0, 256, N.WIDTH, np.uint8))
        two = one.copy()
        two[rng.permutation(N.POSITIONS)[:N.POSITIONS - least]] = rng.integers(0, 256)
        pairs += [one.tobytes(), two.tobytes()]
    batch = pa.RecordBatch.from_pydict({"node": pa.array([7] * len(pairs), pa.int64()), "rep": pa.array(range(len(pairs)), pa.int64()), "sketch": pa.array(pairs, pa.binary()),
                                        "p": pa.array([pivot.tobytes()] * len(pairs), pa.binary())})
    side = {}
    for out in N._sides(least)([batch]):
        for node, rep in zip(out["node"].to_pylist(), out["rep"].to_pylist()):
            side.setdefault(rep, set()).add(node)
    assert all(side[i] & side[i + 1] for i in range(0, len(pairs), 2)) and any(len(side[i]) == 1 for i in side)


def test_merged_components(spark):
    from pluvio.llm.components import merged_components
    rng = random.Random(9)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(240)]
    known = components(spark.createDataFrame(links[:80], "a long, b long"))
    for part in (links[80:160], links[160:], links[:5]):
        known = merged_components(known, spark.createDataFrame(part, "a long, b long"))
    want = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    got = [(r.id, r.component) for r in known.collect()]
    assert len(got) == len(dict(got)) and {i: c for i, c in got if i in want and (i != c or want[i] != i)} == {i: c for i, c in want.items() if i != c}


def test_families_of_a_node_meet_themselves_only():
    families, each = 20, 16
    a, b = np.arange(families * each), 10_000 + np.arange(families * each)
    close = (a % families)[:, None] == (a % families)[None, :]
    groups = list(N._rectangles(a, b, close, 64))
    assert sum(map(len, groups)) == 2 * families * each  # squares in the order of the lists: five times as many
    met = np.zeros_like(close)
    for g in groups:
        met[np.ix_(g[g < 10_000], g[g >= 10_000] - 10_000)] = True
    assert (met == close).all()
    rng = np.random.default_rng(5)
    for share, size in ((0.001, 8), (0.01, 8), (0.3, 16), (1.0, 7), (0.0, 4)):
        close, met = rng.random((120, 90)) < share, np.zeros((120, 90), bool)
        for g in N._rectangles(np.arange(120), 1000 + np.arange(90), close, size):
            assert len(g) <= 2 * size
            met[np.ix_(g[g < 1000], g[g >= 1000] - 1000)] = True
        assert (met | ~close).all()


def test_sides_carry_components():
    sketch = np.zeros((2, N.WIDTH), np.uint8)
    sketch[1] = 1
    column = pa.array([row.tobytes() for row in sketch], pa.binary())
    pivot = pa.array([sketch[0].tobytes()] * 2, pa.binary())
    batch = pa.RecordBatch.from_pydict({"node": pa.array([5, 5]), "rep": pa.array([1, 2]), "comp": pa.array([8, 9]), "sketch": column, "p": pivot})
    rows = [r for out in N._sides(88)([batch]) for r in out.to_pylist()]
    assert sorted((r["rep"], r["comp"]) for r in rows) == [(1, 8), (2, 9)]


def test_unrelated_texts_seldom_meet():
    """Texts that share a passage are at a similarity of about a quarter; by one token a quarter of their pairs would meet in each root's children."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    some = [passage + " " + " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(60)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "tag": [0] * 60, "text": some})
    described = next(N._describe(3)([batch]))
    children = next(N._root_children([pa.RecordBatch.from_pydict({"rep": described["doc_id"], "sketch": described["sketch"]})]))
    _, n = np.unique(children["node"].to_numpy(), return_counts=True)
    assert (n * (n - 1) // 2).sum() < 0.12 * len(np.unique(children["slot"])) * 60 * 59 / 2


def test_pairs_of_large_nodes_are_judged_once():
    """A pair that met in an earlier child is left to it, unless one of its sides branches on."""
    sketch = np.zeros((2, N.WIDTH), np.uint8).tobytes()
    for met, branching, groups in ((True, 0, 0), (True, 1, 1), (False, 0, 1)):
        member = [{"rep": i, "comp": i, "branching": branching, "sketch": sketch[:N.WIDTH - 1] + bytes([0]) if met else sketch[:N.POSITIONS] + bytes([i] * (N.WIDTH - N.POSITIONS))} for i in (1, 2)]
        batch = pa.RecordBatch.from_pydict({"slot": [1], "members": [member[:1]], "others": [member[1:]]})
        assert sum(len(out) for out in N._between(88, 256)([batch])) == groups


def test_few_links_are_not_dealt_to_tasks(spark, monkeypatch):
    from pluvio.llm import components as module
    plans, write = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(4)
    known = module.merged_components(module.components(links), spark.createDataFrame([(40, 90), (91, 92)], "a long, b long").repartition(4))
    assert {(r.id, r.component) for r in known.collect()} == {(i, 0) for i in [*range(41), 90]} | {(91, 91), (92, 91)}
    assert len(plans) > 4 and not [p for p in plans if "Exchange hashpartitioning" in p]
