"""Connected components of a link table by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import is_empty, staged

MAX_ROUNDS = 200
FEW = 1 << 17  # rows of 16 bytes that one partition holds, so that a short table is not dealt to hundreds of tasks in every round


def _dealt(rows: int):
    """What a round does with its tables: a table that grows from at most FEW rows stays in one partition, others are shuffled."""
    return (lambda df: df.coalesce(1)) if rows <= FEW else (lambda df: df)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b); `component` is the least id reachable.

    Each round maps every vertex to the neighbour (or itself) that comes first in a hash order,
    and joins vertices that were mapped alike. A random order shrinks chains and stars by a constant factor a
    round, so the number of rounds is logarithmic. Self links and repeated links are allowed.
    """
    dealt = _dealt(links.count())
    edges = dealt(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    maps = []
    for _ in range(MAX_ROUNDS):
        rank = F.xxhash64("b")
        best = edges.groupBy("a").agg(F.min_by("b", rank).alias("best"), F.min(rank).alias("rank"))
        own = F.xxhash64("a")
        maps.append(dealt(staged(best.select("a", F.when(F.col("rank") < own, F.col("best")).otherwise(F.col("a")).alias("p")), "parent")))
        left = maps[-1].select("a", F.col("p").alias("pa"))
        right = maps[-1].select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = dealt(staged(edges.join(left, "a").join(right, "b").where("pa <> pb")
                             .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges"))
        if is_empty(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    if is_empty(maps[0]):
        return maps[0].select(F.col("a").alias("id"), F.col("p").alias("component"))
    label = maps[0].select(F.col("a").alias("id"), F.col("p").alias("at"))
    for parent in maps[1:]:  # a vertex that has no link left is at its component's last place
        label = label.join(parent, label["at"] == parent["a"], "left").select("id", F.coalesce("p", "at").alias("at"))
    label = dealt(staged(label, "label"))
    return label.join(label.groupBy("at").agg(F.min("id").alias("component")), "at").select("id", "component")


def merged_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """`components` of the links that made `known` (id, component) and of `links` (a, b), by contracting only what is new."""
    def of(column: str, name: str) -> DataFrame:
        return known.select(F.col("id").alias(column), F.col("component").alias(name))
    dealt, whole = _dealt(links.count()), _dealt(known.count())
    known = whole(known)
    mapped = (dealt(links).join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
              .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct())
    mapped = staged(mapped, "new-links")
    if is_empty(mapped):
        return known
    fresh = dealt(staged(components(mapped), "fresh")).select(F.col("id").alias("at"), F.col("component").alias("to"))
    moved = known.join(fresh, known["component"] == fresh["at"], "left").select("id", F.coalesce("to", "component").alias("component"))
    return moved.union(fresh.join(known, fresh["at"] == known["id"], "left_anti").select(F.col("at").alias("id"), F.col("to").alias("component")))
