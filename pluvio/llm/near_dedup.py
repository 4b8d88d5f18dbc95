"""Near-duplicate documents by a Chosen Path set similarity join.

Every distinct shingle set gets POSITIONS minwise tokens. Each of TREES roots picks two token positions and sends each
member to the child of its tokens there. Two sets of similarity s share such a child with probability s * s, so they part at
all roots with probability (1 - s * s) ** TREES: 6e-8 at 0.85, 2e-6 at 0.8. One token alone is shared by more and more
unrelated texts as the corpus grows, two are not. Deeper nodes pick BRANCHES positions from their own hash, one token a child, and
lose a pair with q = (1 - s + s * q) ** BRANCHES at most, which makes (1 - s * s + s * s * q) ** TREES: 2e-7 and 7e-6.

What moves is a sketch: the low bytes of all tokens, and a hash of the tokens of each root. Pairs that agree in
clearly fewer positions than the threshold asks for (five standard deviations) are no candidates; all others are judged on their full sets.

Nodes with at most SMALL members are compared exhaustively, each by one task. Candidates that hang together are judged as one group
when there are few; of many, such as hundreds of near copies, each is first judged with a leader that it is a candidate of, and
what that leaves apart is compared once more. Members that are known to be connected are never compared.

In larger nodes two pivots (the text with most copies, and one by hash) are compared with every member, which
connects most of a group of near copies. Each node is then cut by the agreement with its pivot: members of a candidate pair differ in it
by at most the positions in which they may disagree, so that the near and the far side, which overlap by this, hold all candidates
between them, and the pivot's group does not meet what is far from it. A side whose members are all connected is done; one whose
members outside its largest component, times all its members, are at most FULL * FULL is compared exhaustively in blocks, and others
branch on. At MAX_DEPTH all that is left is compared in blocks, so there is no cap. A pair that meets in several roots'
children is put forward in the first of them that does not branch on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import arrow_map, is_empty, prefilter, staged
from pluvio.llm.components import components, merged_components
from pluvio.llm.words import mix, shingle_set

POSITIONS, TREES, BRANCHES, MAX_DEPTH = 128, 13, 2, 12
SMALL, FULL = 1024, 4096  # members of a node that one task compares; bound of the exhaustive comparison of larger ones
GROUP, BLOCK = 64, 1024  # members judged together on their full sets; members of a list of a large node
SQUARE = 256  # members of each side of a square of a large node's candidates, where these hang together
DEVIATIONS = 5  # by which a pair at the threshold may agree in fewer positions: 3e-7 do so, as few as the trees lose
WIDTH = POSITIONS + 4 * TREES


def _multipliers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _tokens(found: np.ndarray) -> np.ndarray:
    """Minwise tokens: the smallest of 32 hash bits over the set, for each position."""
    best, by = np.full(POSITIONS, 0xFFFFFFFF, np.uint64), _multipliers()[:, None]
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 4096):
            best = np.minimum(best, (by * found[None, at:at + 4096]).min(1) >> np.uint64(32))
    return best.astype(np.uint32)


def _describe(k: int):
    def run(batches):
        for batch in batches:
            out = {"n_shingles": [], "key": [], "sketch": []}
            for text in batch["text"].to_pylist():
                found = shingle_set(text, k)
                tokens = _tokens(found)
                out["n_shingles"].append(len(found))
                out["key"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                out["sketch"].append((tokens & 0xFF).astype(np.uint8).tobytes() + _leads(tokens).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "tag": batch["tag"], "n_shingles": pa.array(out["n_shingles"], pa.int64()),
                                              "key": pa.array(out["key"], pa.binary()), "sketch": pa.array(out["sketch"], pa.binary())})
    return run


def _places(node: np.ndarray, b: int) -> np.ndarray:
    """The token position by which a node sends its members to its b-th child; an odd stride keeps them apart."""
    first = mix(node * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    step = (first >> np.uint64(32)) % np.uint64(POSITIONS // 2)
    return ((first + np.uint64(b) * (np.uint64(2) * step + np.uint64(1))) % np.uint64(POSITIONS)).astype(np.int64)


def _leads(tokens: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the two tokens of each root, no two roots with a position in common."""
    one, two = tokens[:TREES].astype(np.uint64), tokens[TREES:2 * TREES].astype(np.uint64)
    with np.errstate(over="ignore"):
        return (mix((one << np.uint64(32)) | two) >> np.uint64(32)).astype(np.uint32)


def _sketches(column: pa.Array) -> np.ndarray:
    """One line of WIDTH bytes a row: the low bytes of the tokens, then the hashes of the roots' tokens."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _child(node: np.ndarray, b: int, at: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node + np.uint64(b + 1) * np.uint64(0xD6E8FEB86659FD93)) + (token << np.uint64(8)) + at.astype(np.uint64)).view(np.int64)


def _root_children(batches):
    """(rep, sketch) to its child of each root, by the hash of the root's two tokens; `slot` is the number of the root."""
    with np.errstate(over="ignore"):
        for batch in batches:
            n, nodes, slots = len(batch), [], []
            lead = _sketches(batch["sketch"])[:, POSITIONS:].copy().view(np.uint32).astype(np.uint64)
            for slot in range(TREES):
                nodes.append(_child(np.full(n, slot, np.uint64), 0, np.full(n, slot), lead[:, slot]))
                slots.append(np.full(n, slot, np.int32))
            yield pa.RecordBatch.from_pydict({"node": np.concatenate(nodes), "slot": np.concatenate(slots), "rep": pa.array(batch["rep"].to_pylist() * TREES, pa.int64())})


def _children(batches):
    """(node, rep, sketch) to its BRANCHES children, by the low bytes of the tokens: equal tokens have equal bytes."""
    with np.errstate(over="ignore"):
        for batch in batches:
            node = batch["node"].to_numpy(zero_copy_only=False).view(np.uint64)
            sketch, rows, children = _sketches(batch["sketch"]), np.arange(len(node)), []
            for b in range(BRANCHES):
                at = _places(node, b)
                children.append(_child(node, b, at, sketch[rows, at].astype(np.uint64)))
            yield pa.RecordBatch.from_pydict({"node": np.concatenate(children), "slot": np.zeros(len(node) * BRANCHES, np.int32),
                                              "rep": pa.array(batch["rep"].to_pylist() * BRANCHES, pa.int64())})


def _lists(column: pa.ListArray):
    """Per row: reps, components, slots of nodes that branch on (bits) and sketches of a list of structs."""
    flat, offsets = column.flatten(), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    rep, comp, branching = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "branching"))
    sketch = _sketches(flat.field("sketch"))
    return [(rep[lo:hi], comp[lo:hi], branching[lo:hi], sketch[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:])]


def _candidates(one, two, slot: int, least: int) -> np.ndarray:
    """For the members of two lists: whether a pair of different components agrees in at least `least` positions.

    A pair that met in a root's child of a lower slot is left to that one, unless a side of that one branches on (its slot is in the bits `branching`).
    """
    (_, comp, branching, sketch), (_, its, _, other) = one, two
    close = comp[:, None] != its[None, :]
    for at in range(0, len(comp), max(1, (1 << 22) // (POSITIONS * max(len(its), 1)))):
        rows = slice(at, at + max(1, (1 << 22) // (POSITIONS * max(len(its), 1))))
        if close[rows].any():
            close[rows] &= (sketch[rows, None, :POSITIONS] == other[None, :, :POSITIONS]).sum(2, dtype=np.uint8) >= least
    if slot and close.any():
        i, j = np.nonzero(close)
        met = sketch[i, POSITIONS:].copy().view(np.uint32)[:, :slot] == other[j, POSITIONS:].copy().view(np.uint32)[:, :slot]
        met &= (branching[i, None] >> np.arange(slot)) & 1 == 0
        met = met.any(1)
        close[i[met], j[met]] = False
    return close


def _connected(linked: np.ndarray) -> np.ndarray:
    """For each member the least one that any link leads to."""
    first = np.arange(len(linked))
    while True:
        new = np.minimum(np.where(linked, first[None, :], len(linked)).min(1, initial=len(linked)), first)
        if (new == first).all():
            return first
        first = new


def _stars(linked: np.ndarray, some: np.ndarray, size: int):
    """Groups of at most `size` of the members `some`, that hang together: leaders with candidates that no leader had before."""
    left = np.zeros(len(linked), bool)
    left[some] = True
    for leader in some[np.argsort(-linked[some].sum(1), kind="stable")]:
        if not left[leader]:
            continue
        ball = np.flatnonzero(linked[leader] & left)
        left[leader] = left[ball] = False
        if not len(ball):
            ball = np.flatnonzero(linked[leader])[:1]
        for at in range(0, len(ball), size - 1):
            yield np.append(ball[at:at + size - 1], leader)


def _joined(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the lines and the columns of candidate pairs the least line that they hang together with; all have a candidate."""
    line = np.arange(len(close))
    while True:
        column = np.where(close, line[:, None], len(line)).min(0, initial=len(line))
        new = np.minimum(np.where(close, column[None, :], len(line)).min(1, initial=len(line)), line)
        if (new == line).all():
            return line, column
        line = new


def _rectangles(rep: np.ndarray, other: np.ndarray, close: np.ndarray, size: int):
    """Groups that hold all candidate pairs of two lists: what hangs together is one, or squares of `size` where it is larger.

    Families that share a node thus meet themselves only; squares over all members would grow with the product of the lists.
    """
    i, j = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    rep, other, close = rep[i], other[j], close[np.ix_(i, j)]
    line, column = _joined(close)
    for root in np.unique(line):
        own, its = np.flatnonzero(line == root), np.flatnonzero(column == root)
        yield from _squares(rep[own], other[its], close[np.ix_(own, its)], size)


def _squares(rep: np.ndarray, other: np.ndarray, close: np.ndarray, size: int):
    """Groups that hold all candidate pairs, by squares of the members that have any."""
    i, j = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    for a in range(0, len(i), size):
        for b in range(0, len(j), size):
            hit = close[np.ix_(i[a:a + size], j[b:b + size])]
            if hit.any():
                yield np.concatenate([rep[i[a:a + size][hit.any(1)]], other[j[b:b + size][hit.any(0)]]])


def _batch_of(groups: list[np.ndarray], **more) -> pa.RecordBatch:
    """A row a group; its number is a hash of its members, so that equal groups are judged once."""
    groups = [np.unique(g) for g in groups]
    numbers = [int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "little", signed=True) if len(g) else 0 for g in groups]
    return pa.RecordBatch.from_pydict({"group": pa.array(numbers, pa.int64()), "reps": pa.array([g.tolist() for g in groups], pa.list_(pa.int64()))} | more)


def _compare(least: int, last: bool, size: int):
    """(group, reps, open) for nodes of at most SMALL members. Candidates that hang together are one group, or, if they are many, several.

    Without `last` many are grouped around leaders, and a row with the node in `open` says that it is to be compared again once
    these are judged. With it, the groups hold every candidate pair.
    """
    def run(batches):
        for batch in batches:
            groups, again = [], []
            for rows in (batch.slice(i, 64) for i in range(0, len(batch), 64)):
                for node, slot, members in zip(rows["node"].to_pylist(), rows["slot"].to_pylist(), _lists(rows["members"])):
                    close = _candidates(members, members, slot, least)
                    some = np.flatnonzero(close.any(1))
                    close, rep = close[np.ix_(some, some)], members[0][some]
                    first = _connected(close)
                    for root in np.unique(first):
                        own = np.flatnonzero(first == root)
                        if len(own) <= size:
                            groups.append(rep[own])
                        elif last:
                            groups += _squares(rep[own], rep[own], np.triu(close[np.ix_(own, own)]), size)
                        else:
                            groups += [rep[g] for g in _stars(close, own, size)]
                            again.append(node)
            yield _batch_of(groups + [np.zeros(0, np.int64)] * len(again), open=pa.array([None] * len(groups) + again, pa.int64()))
    return run


def _between(least: int, size: int):
    """(group, reps, open) with all candidate pairs of two lists of a large node; nothing is left open."""
    def run(batches):
        for batch in batches:
            groups = []
            for rows in (batch.slice(i, 8) for i in range(0, len(batch), 8)):
                for slot, members, others in zip(rows["slot"].to_pylist(), _lists(rows["members"]), _lists(rows["others"])):
                    groups += _rectangles(members[0], others[0], _candidates(members, others, slot, least), size)
            yield _batch_of(groups, open=pa.nulls(len(groups), pa.int64()))
    return run


def _pivot_pairs(least: int, size: int):
    """(group, reps, open): blocks of a large node's members that are candidates of one of its pivots, with this pivot."""
    def run(batches):
        for batch in batches:
            groups = []
            for rows in (batch.slice(i, 8) for i in range(0, len(batch), 8)):
                for members, pivots in zip(_lists(rows["members"]), _lists(rows["others"])):
                    close = _candidates(members, pivots, 0, least)
                    for j in range(close.shape[1]):
                        ball = np.flatnonzero(close[:, j])
                        groups += [np.append(members[0][ball[at:at + size - 1]], pivots[0][j]) for at in range(0, len(ball), size - 1)]
            yield _batch_of(groups, open=pa.nulls(len(groups), pa.int64()))
    return run


def _sides(least: int):
    """The rows, with the node of the near side, the far side or both, by the agreement of `sketch` and the pivot's `p`."""
    far = least - 4
    near = far - (POSITIONS - least)

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                node = batch["node"].to_numpy(zero_copy_only=False).view(np.uint64)
                agree = (_sketches(batch["sketch"])[:, :POSITIONS] == _sketches(batch["p"])[:, :POSITIONS]).sum(1)
                parts = [(agree >= near, np.uint64(0x8CB92BA72F3D8DD7)), (agree <= far, np.uint64(0xABCC5167CCAD925F))]
                both = pa.array(np.concatenate([np.flatnonzero(own) for own, _ in parts]))
                yield pa.RecordBatch.from_pydict({"node": np.concatenate([mix(node[own] + by).view(np.int64) for own, by in parts]),
                                                  **{c: batch[c].take(both) for c in ("slot", "rep", "comp", "sketch") if c in batch.schema.names}})
    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets, by products of their incidence matrix, some columns at a time."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    some = times[column] > 1  # what only one set has is in no intersection of two
    rank = np.cumsum(times > 1) - 1
    owner, column = owner[some], rank[column[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _confirm(k: int, num: int, den: int):
    """Links within each group, judged on the full sets; each member is given with the first one that links lead to."""
    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch["members"]:
                rep = members.values.field("rep").to_numpy()
                order = np.argsort(rep, kind="stable")
                texts = members.values.field("text")
                rep, sets = rep[order], [shingle_set(texts[int(i)].as_py(), k) for i in order]
                size = np.array([len(s) for s in sets], np.int64)
                shared = shared_counts(sets)
                first = _connected(den * shared >= num * (size[:, None] + size[None, :] - shared))
                other = rep[first] != rep
                a += rep[first][other].tolist()
                b += rep[other].tolist()
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect, in each group of candidates, what the links between full sets connect.

    Each class is judged by the text of one row, which its (own, tag) names.
    """
    once = groups.groupBy("group").agg(F.first("reps").alias("reps"))  # the same members meet in several nodes
    members = staged(once.select("group", F.explode("reps").alias("rep")), "candidates")
    ids = staged(members.select("rep").distinct().join(classes.select("rep", "own", "tag"), "rep"), "wanted")
    rows = prefilter(docs.select(F.col("doc_id").alias("own"), "tag", "text"), "own", ids, "own")
    texts = rows.join(ids, ["own", "tag"]).dropDuplicates(["rep"]).select("rep", "text")  # dealt as the join below needs them
    whole = members.join(texts, "rep").groupBy("group").agg(F.collect_list(F.struct("rep", "text")).alias("members"))
    return staged(arrow_map(whole.select("members"), _confirm(k, num, den), "a long, b long"), "links")


class _Links:
    """The components that the links found so far make."""

    def __init__(self, judge):
        self.judge, self.components = judge, None

    def add(self, links: DataFrame) -> None:
        if not is_empty(links):
            self.components = staged(components(links) if self.components is None else merged_components(self.components, links), "components")

    def judged(self, groups: DataFrame) -> None:
        if not is_empty(groups):
            self.add(self.judge(groups))

    def of(self, members: DataFrame) -> DataFrame:
        """`members` with `comp`, the component of `rep`."""
        if self.components is None:
            return members.withColumn("comp", F.col("rep"))
        known = self.components.select(F.col("id").alias("rep"), "component")
        return members.join(known, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


_CANDIDATES = "group long, reps array<long>, open long"
_MEMBER = ("rep", "comp", "branching", "sketch")


def _listed(rows: DataFrame, *keys: str, name: str = "members") -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*_MEMBER)).alias(name))


def _compare_small(members: DataFrame, sketches: DataFrame, known: _Links, least: int) -> None:
    """Judge all candidates of the nodes of `members` (node, slot, rep), which have at most SMALL members each."""
    for last in (False, True):
        rows = known.of(members).join(prefilter(sketches, "rep", members, "rep"), "rep")
        lists = _listed(rows, "node", "slot").where(F.size("members") > 1)
        found = staged(arrow_map(lists, _compare(least, last, GROUP), _CANDIDATES), "groups")
        known.judged(found.where("open is null").select("group", "reps"))
        again = found.where("open is not null").select(F.col("open").alias("node"))
        if last or is_empty(again):
            return
        members = staged(members.join(again.distinct(), "node"), "again")


def _sizes(seen: DataFrame) -> DataFrame:
    """(node, top, outside, inside) of nodes of several components: the largest, and the members outside and inside it."""
    each = seen.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("m"))
    sizes = each.groupBy("node").agg(F.max_by("comp", "m").alias("top"), (F.sum("m") - F.max("m")).alias("outside"), F.max("m").alias("inside"))
    return staged(sizes.where("outside > 0"), "sizes")


def _chunk(rows: DataFrame, size) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("rep", "node"), F.ceil(size / BLOCK)))


def _compare_large(members: DataFrame, sketches: DataFrame, known: _Links, least: int, deepest: bool) -> DataFrame | None:
    """Judge what can be judged of the nodes of `members` (node, slot, rep, n), which are large; (node, slot, rep, sketch) of what is to branch on.

    `sketches` has rep, copies and sketch of all reps. Near copies share most of the roots' children; each pair is judged in the first of them.
    """
    none = F.lit(0).alias("branching")
    rows = staged(members.join(prefilter(sketches.select("rep", "copies", "sketch"), "rep", members, "rep"), "rep"), "large-nodes")
    order, one = F.xxhash64("rep", "node"), F.struct("rep", "sketch")
    best = staged(rows.groupBy("node").agg(F.max_by(one, F.struct("copies", order)).alias("one"), F.max_by(one, order).alias("two")), "pivots")
    pivots = best.select("node", F.explode(F.array_distinct(F.array("one", "two"))).alias("p")).select("node", "p.rep", "p.sketch")
    listed = _listed(known.of(pivots).withColumn("branching", none), "node", name="others")
    chunks = _listed(_chunk(known.of(rows).withColumn("branching", none), F.col("n")), "node", "block").join(listed, "node")
    known.judged(staged(arrow_map(chunks.select("members", "others"), _pivot_pairs(least, GROUP), _CANDIDATES), "groups"))

    sided = known.of(rows.select("node", "slot", "rep", "sketch")).join(best.select("node", F.col("one.sketch").alias("p")), "node")
    sided = sided.select("node", "slot", "rep", "comp", "sketch", "p")  # with components already: a member of both sides asks for its own once
    seen = staged(arrow_map(sided, _sides(least), "node long, slot int, rep long, comp long, sketch binary"), "seen")
    some = seen.join(_sizes(seen), "node")
    cheap = F.lit(True) if deepest else F.col("outside") * (F.col("outside") + F.col("inside")) <= FULL * FULL
    left = None if deepest else staged(some.where(~cheap).select("node", "slot", "rep", "sketch"), "branching")
    left = None if left is None or is_empty(left) else left
    some = _with_branching(some.where(cheap), left)
    outsiders = _listed(_chunk(some.where(F.col("comp") != F.col("top")), F.col("outside")), "node", "block", name="others").drop("block")
    chunks = _listed(_chunk(some, F.col("outside") + F.col("inside")), "node", "slot", "block").join(outsiders, "node")
    known.judged(staged(arrow_map(chunks.select("slot", "members", "others"), _between(least, SQUARE), _CANDIDATES), "groups"))
    return left


def _with_branching(rows: DataFrame, left: DataFrame | None) -> DataFrame:
    """`rows` with the bits of the slots in which `rep` is in `left` (slot, rep), whose pairs are not judged in these nodes."""
    if left is None:
        return rows.withColumn("branching", F.lit(0))
    slots = left.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1, slot)")).alias("slots"))
    return rows.join(slots, "rep", "left").withColumn("branching", F.coalesce("slots", F.lit(0))).drop("slots")


def _classes(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct shingle sets (key, rep, own, tag, copies, sketch), and links (a, b) between those that share a doc_id.

    `rep` is the smallest doc_id that has the set; where several sets have the same, all but one get a number above 2 ** 62.
    """
    real = described.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("key").agg(F.min(F.struct("doc_id", "tag")).alias("m"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    classes = staged(classes.select("key", F.col("m.doc_id").alias("own"), F.col("m.tag").alias("tag"), "copies", "sketch"), "classes")
    name = F.xxhash64("key")
    several = staged(real.groupBy("doc_id").agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y").select("doc_id"), "several")
    if is_empty(several):
        return classes.withColumn("rep", F.col("own")), several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    firsts = classes.groupBy("own").agg(F.min(name).alias("first"))
    other = F.lit(1 << 62).bitwiseOR(name.bitwiseAND((1 << 62) - 1))
    classes = staged(classes.join(firsts, "own").withColumn("rep", F.when(name == F.col("first"), F.col("own")).otherwise(other)).drop("first"), "classes")
    sets = real.join(several, "doc_id").select("doc_id", "key").distinct().join(classes.select("key", "rep"), "key")
    first = sets.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return classes, staged(sets.join(first, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct(), "same-ids")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text; other columns are ignored).

    Two documents are linked when den * |A and B| >= num * |A or B| over their sets of distinct k-word shingles;
    a text of fewer words is one shingle. `component_id` is the smallest doc_id reachable over links and `kept`
    says that it is the row's own. Null, empty and blank texts have no shingles, link with nothing and are kept.
    Rows that share a doc_id are one document: what one of their texts links to, all do, and all have one component.
    A row without doc_id joins no other row, has a null component_id and is kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    described = staged(arrow_map(docs, _describe(k), "doc_id long, tag long, n_shingles long, key binary, sketch binary"), "described")
    classes, same_ids = _classes(described)
    known = _Links(lambda groups: _verified(docs, classes, groups, k, num, den))
    known.add(same_ids)
    least = int(POSITIONS * num / den - DEVIATIONS * (POSITIONS * num / den * (1 - num / den)) ** 0.5)

    sketches = classes.select("rep", "copies", F.lit(0).alias("branching"), "sketch")
    members = arrow_map(classes.select("rep", "sketch"), _root_children, "node long, slot int, rep long")
    for depth in range(1, MAX_DEPTH + 1):
        # A node of one member has nothing to compare; most end here.
        sizes = staged(members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nodes")
        members = staged(members.join(sizes, "node"), "members")
        large, branching, own = members.where(F.col("n") > SMALL), None, sketches
        if not is_empty(large):
            branching = _compare_large(large.select("node", "slot", "rep", "n"), sketches, known, least, depth == MAX_DEPTH)
            own = _with_branching(sketches, branching) if depth == 1 else sketches  # deeper nodes have no slot
        _compare_small(members.where(F.col("n") <= SMALL).select("node", "slot", "rep"), own, known, least)
        if branching is None:
            break
        members = arrow_map(branching, _children, "node long, slot int, rep long").distinct()

    base = described.select("doc_id", "n_shingles", "key").join(classes.select("key", "rep"), "key", "left")
    if known.components is not None:
        base = base.join(known.components.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        base = base.withColumn("component", F.lit(None).cast("long"))
    group = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    group = F.when(F.col("doc_id").isNotNull(), group)
    return base.select("doc_id", "n_shingles", group.alias("component_id"),
                       (F.col("doc_id").isNull() | (F.col("doc_id") == group)).alias("kept"))


def first_of_each_group(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs`, all columns, that `near_duplicates` keeps: one document of each group.

    Rows without doc_id, and rows without words, stay. Of rows that repeat a kept doc_id all stay, since they are one document.
    """
    dropped = near_duplicates(docs, **settings).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["__dropped"], "left_anti")
