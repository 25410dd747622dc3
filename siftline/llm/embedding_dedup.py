"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with a cosine of at least c are at a squared distance of at most 2 - 2c. They are rotated to the principal
axes of a sample, which are dealt to blocks in turn, so that each block starts with coordinates that spread wide, and
where vectors are alike in all directions the rotation does no harm. The coordinates are split into blocks, each with a share of the budget in proportion to its dimensions, so
that a pair within the whole budget is within the share of some block. Each block is range-joined on a grid of cells as
wide as its share allows: near pairs are in the same or in touching cells. A pair found is verified in double precision,
in the first block in which it is within the share, so the union over blocks has it once.

Tasks return counts and a forest of links, never pairs. Cells with many vectors are cut into blocks of rows that meet
two by two. Equal vectors are one node.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table, written
from .components import connected_components, grouped, in_blocks, whole_groups

COSINE = 0.9
#: Dimensions of a block of coordinates, about.
BLOCK_DIMS = 16
#: Rows of a block of a large cell, and of a tile of the distance matrix.
CELL_ROWS, TILE = 30_000, 1024
#: Added to squared distances before they are compared in single precision, and to shares in double precision.
SLACK32, SLACK = 1e-4, 1e-12
#: Vectors, about, from which the principal axes come, and the longest vectors that are turned to them.
SAMPLE, MOST_AXES = 20_000, 1024
#: Coordinates of a block that the grid cuts, by number of vectors.
GRID = ((500_000, 1), (20_000_000, 2), (None, 3))


@cache
def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int, each: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dims, max(1, round(dims / each)) + 1).round().astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def grid_dims(rows: int) -> int:
    return next(g for most, g in GRID if most is None or rows <= most)


def principal_axes(vectors: DataFrame, vector_col: str, each: int) -> dict[int, np.ndarray]:
    """For each length met in a sample of about SAMPLE vectors, the rotation to principal axes, dealt to blocks in turn.

    The rotation decides how many pairs meet, not which are found: any rotation gives the same links.
    """
    small_batches(vectors.sparkSession, 2000)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for v in b.column(0):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                norm = np.sqrt((x * x).sum()) if x is not None and 0 < len(x) <= MOST_AXES else 0.0
                if 0 < norm < np.inf:
                    x = x / norm
                    total[len(x)] = total.get(len(x), 0) + np.outer(x, x)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["dims", "moments"])

    n = max(1, vectors.count())
    some = vectors.select(vectors[vector_col].cast("array<double>").alias("v")).sample(min(1.0, SAMPLE / n), seed=3)
    out = {}
    for r in some.coalesce(1).mapInArrow(run, "dims int, moments binary").collect():
        d = r["dims"]
        axes = np.linalg.eigh(np.frombuffer(bytes(r["moments"]), np.float64).reshape(d, d))[1][:, ::-1]
        bounds = block_bounds(d, each)
        order, left, at = np.zeros(d, int), [list(range(lo, hi)) for lo, hi in bounds], 0
        for k in range(max(map(len, left))):
            for places in left:
                if k < len(places):
                    order[places[k]] = at
                    at += 1
        out[d] = axes[:, order]
    return out


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, axes: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, row_id, dims and unit (rotated unit vector as doubles); null where a vector links with nothing."""
    small_batches(vectors.sparkSession, 2000)
    src = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))

    def run(batches):
        for b in batches:
            dims, unit = [], []
            for v in b.column("v"):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                most = np.abs(x).max() if x is not None and len(x) else 0.0
                if not (0 < most < np.inf):
                    dims.append(None)
                    unit.append(None)
                    continue
                x = x / most
                dims.append(len(x))
                turn = axes[len(x)] if len(x) in axes else rotation(len(x))
                unit.append((x / np.sqrt((x * x).sum()) @ turn + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())], ["vec_id", "dims", "unit"])

    kind = src.schema["vec_id"].dataType.simpleString()
    return src.mapInArrow(run, f"vec_id {kind}, dims int, unit binary").withColumn("row_id", F.monotonically_increasing_id())


def placed(nodes: DataFrame, cosine: float, grid: int, each: int) -> DataFrame:
    """Each node in its cell of each block (home), and in half of the touching cells as a guest."""

    def run(batches):
        ahead = [o for o in itertools.product((-1, 0, 1), repeat=grid) if o > (0,) * grid]
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("at", "key", "block_no", "home")}
            dims = np.asarray(b.column("dims"))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(b.column("unit").take(pa.array(rows)).to_pylist()), np.float64).reshape(len(rows), d)
                for k, (lo, hi) in enumerate(block_bounds(int(d), each)):
                    g = min(grid, hi - lo)
                    width = np.sqrt(share(cosine, int(d), lo, hi)) * (1 + 1e-9)
                    width = max(width, 1e-5)  # a cell's number has 18 bits
                    cell = np.floor(x[:, lo : lo + g] / width).astype(np.int64)
                    for o in [(0,) * grid, *ahead]:
                        if any(o[g:]):
                            continue
                        c = cell + np.array(o[:g])
                        key = np.full(len(rows), k, np.int64)
                        for i in range(g):
                            key = key << 18 | c[:, i] + (1 << 17)
                        out["at"].append(rows)
                        out["key"].append(key)
                        out["block_no"].append(np.full(len(rows), k))
                        out["home"].append(np.full(len(rows), not any(o)))
            if out["at"]:
                at = pa.array(np.concatenate(out["at"]))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(at) for c in ("row_id", "dims")), pa.array(np.concatenate(out["key"])), pa.array(np.concatenate(out["block_no"]).astype(np.int32)), pa.array(np.concatenate(out["home"]))],
                    ["row_id", "dims", "key", "block_no", "home"],
                )

    return nodes.select("row_id", "dims", "unit").mapInArrow(run, "row_id long, dims int, key long, block_no int, home boolean")


def share(cosine: float, dims: int, lo: int, hi: int) -> float:
    return (2 - 2 * cosine) * (hi - lo) / dims


def _links(x: np.ndarray, block_no: int, home: np.ndarray, sides: np.ndarray | None, cosine: float, each: int):
    """(i, j) of verified pairs that are within their share first in this block, tile by tile."""
    n, dims = x.shape
    bounds = block_bounds(dims, each)
    lo, hi = bounds[block_no]
    least = share(cosine, dims, lo, hi)
    y = x[:, lo:hi]
    square = (y * y).sum(axis=1, keepdims=True)
    # One product gives the squared distances: |p|^2 * 1 + 1 * |q|^2 - 2pq.
    left = np.hstack([y, square, np.ones_like(square)]).astype(np.float32)
    right = np.hstack([-2 * y, np.ones_like(square), square]).astype(np.float32)
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            at = np.flatnonzero(left[a : a + TILE] @ right[b : b + TILE].T <= least + SLACK32)
            i, j = np.divmod(at, min(TILE, n - b))
            i, j = i + a, j + b
            ok = (i < j) & (home[i] | home[j])
            if sides is not None:
                ok &= sides[i] != sides[j]
            i, j = i[ok], j[ok]
            for k in range(block_no + 1):
                if not len(i):
                    break
                p, q = bounds[k]
                within = ((x[i, p:q] - x[j, p:q]) ** 2).sum(axis=1) <= share(cosine, dims, p, q) + SLACK
                i, j = (i[within], j[within]) if k == block_no else (i[~within], j[~within])
            if len(i):
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                if ok.any():
                    yield i[ok], j[ok]


def min_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; label[x] is the smallest member of x's class, in place."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def linked(tasks: DataFrame, cosine: float, each: int) -> DataFrame:
    """(row_id, root, n): links of a node found in a task, and the smallest row id that they reach there."""

    def run(batches):
        for t, bounds in whole_groups(batches, "task_key"):
            ids, copies, dims, block_no, home, block, own = (t.column(c).to_numpy() for c in ("row_id", "copies", "dims", "block_no", "home", "block", "own"))
            unit = t.column("unit").combine_chunks()
            out: list[list] = [[], [], []]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                order = lo + np.argsort(ids[lo:hi], kind="stable")
                x = np.frombuffer(b"".join(unit.take(pa.array(order)).to_pylist()), np.float64).reshape(hi - lo, dims[lo])
                label, n = np.arange(hi - lo), np.zeros(hi - lo, np.int64)
                for i, j in _links(x, int(block_no[lo]), home[order], None if own[lo] else block[order], cosine, each):
                    n += np.bincount(i, copies[order[j]], hi - lo).astype(np.int64) + np.bincount(j, copies[order[i]], hi - lo).astype(np.int64)
                    min_labels(label, i, j)
                hit = np.flatnonzero(n)
                out[0].append(ids[order[hit]])
                out[1].append(ids[order[label[hit]]])
                out[2].append(n[hit])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["row_id", "root", "n"])

    columns = ("row_id", "copies", "dims", "block_no", "home", "block", "own", "unit")
    return grouped(tasks.select(F.xxhash64("task").alias("task_key"), *columns), "task_key").mapInArrow(run, "row_id long, root long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", block_dims: int = BLOCK_DIMS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row; see the module for the method.

    n_links counts the other rows with a cosine of at least `cosine`, copies included. component_id is the smallest
    vec_id reachable by links, kept tells whether it is the row's own. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different lengths don't link with each other. Repeated rows are
    vectors of their own. An empty table gives an empty result. cosine must be above 0 and at most 1.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.write(unit_rows(vectors, id_col, vector_col, principal_axes(vectors, vector_col, block_dims)), "units")
    nodes = rows.filter("unit IS NOT NULL").groupBy("unit").agg(F.min("row_id").alias("node"), F.count("*").alias("copies"), F.first("dims").alias("dims"))
    nodes = scratch.write(nodes, "vectors")
    by_row = nodes.withColumnRenamed("node", "row_id")
    spread = placed(by_row, cosine, grid_dims(nodes.count()), block_dims)
    spread = scratch.write(spread.select("row_id", F.struct("dims", "key").alias("cell"), "block_no", "home"), "cells")
    tasks = in_blocks(spread, "cell", "row_id", CELL_ROWS, scratch).join(by_row.hint("merge"), "row_id")
    found = scratch.write(linked(tasks, cosine, block_dims), "links")
    count = found.groupBy("row_id").agg(F.sum("n").alias("n")).withColumnRenamed("row_id", "node")
    component = connected_components(found.select(F.col("row_id").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("id", "node")
    by_node = nodes.select("unit", "node", "copies").join(count, "node", "left").join(component, "node", "left")
    # A vector that many rows share is a skewed key of the left side, which is split at run time; those without a link stay out.
    linked_rows = rows.filter("unit IS NOT NULL").join(by_node.hint("merge"), "unit").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    alone = rows.filter("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("row_id").alias("root"))
    all_rows = written(linked_rows.unionByName(alone), "vector-roots")
    scratch.clear()
    least = all_rows.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return all_rows.join(least.hint("merge"), "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
