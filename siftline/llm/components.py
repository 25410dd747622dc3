"""Connected components of a graph given as a table of edges, and groups cut into blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds after which the search gives up with an error; it needs about log2 of the longest path.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id that an edge (a, b) names: the smallest id that it reaches.

    Large-star and small-star rounds: every id points to the smallest of its neighbours, until nothing changes. A hub's
    edges are spread by the key of their other ends in the next step, and are summed before they are shuffled. Each
    round is written to the shared folder; the last stays there until scratch is cleared.
    """
    rounds = Scratch(edges.sparkSession)
    pairs = rounds.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        pairs = rounds.write(_small_star(_large_star(pairs)), "edges")
        rounds.clear(keep=1)
        now = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == before:
            scratch.paths += rounds.paths
            stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return stars.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components haven't settled in {MAX_ROUNDS} rounds")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each id's larger neighbours point to the smallest of its neighbours and itself."""
    both = pairs.union(pairs.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each id and its smaller neighbours point to the smallest of them."""
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def in_blocks(members: DataFrame, group: str, member: str, size: int, scratch: Scratch) -> DataFrame:
    """Cuts groups of more than `size` members into blocks, and deals out pairs of blocks.

    Adds `task`, such that any two members of a group meet in some task, and `block`, the row's block there. Rows of one
    block meet again in tasks of other blocks, so a task compares rows of one block only where `own` is true. A task
    holds about 2 * size rows at most, whatever the group's size. members is read twice and should be narrow: payloads
    are joined to the result.
    """
    large = scratch.write(members.groupBy(group).agg(F.count("*").alias("__n")).filter(F.col("__n") > size), "large-groups")
    if large.isEmpty():
        dealt = members.withColumn("block", F.lit(0)).withColumn("__other", F.lit(0))
    else:
        cut = members.join(large.hint("merge"), group, "left").withColumn("__k", F.coalesce(F.ceil(F.col("__n") / size), F.lit(1)).cast("int"))
        dealt = cut.withColumn("block", F.pmod(F.xxhash64(member), F.col("__k")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    return (
        dealt.withColumn("task", F.struct(F.col(group).alias("g"), F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j")))
        .withColumn("own", F.col("block") == F.col("__other"))
        .drop("__n", "__k", "__other")
    )


def grouped(df: DataFrame, key: str) -> DataFrame:
    """Rows with equal keys (long) in one task, next to each other."""
    return df.repartition(F.col(key)).sortWithinPartitions(key)


def whole_groups(batches, key: str):
    """(table, bounds): consecutive rows that make up whole groups, and where these begin and end; a group at least."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        keys = np.asarray(b.column(key))
        if keys[0] == keys[-1] and len(held) > 1 and keys[0] == held[-2].column(key)[-1].as_py():
            continue  # the group goes on
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if rows - (b.num_rows - cut):
            yield _bounds(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]), key)
        held, rows = [b.slice(cut)], b.num_rows - cut
    if held:
        yield _bounds(pa.Table.from_batches(held), key)


def _bounds(t: pa.Table, key: str):
    keys = t.column(key).to_numpy()
    return t, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))


def spanning_edges(n: int, like, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest with the components of the graph in which i and x are joined where like(i, others)[x] holds.

    like: gives a mask over an array of places. sides: where given, only members of different sides are compared.
    Each member meets those that nothing has reached so far, so a close group costs about one pass.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(1, n)
    todo = [0]
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
            continue
        i = todo.pop()
        others = rest if sides is None else rest[sides[rest] != sides[i]]
        if not len(others):
            continue
        found = others[like(i, others)]
        if len(found):
            out += [(i, int(x)) for x in found]
            todo += found.tolist()
            rest = np.setdiff1d(rest, found, assume_unique=True)
    return out
