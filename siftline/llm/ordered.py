"""Order over tables of any size: range-sorted copies with the number of each range, running sums, dense numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Blocks whose sums are added up in one window; sums of such runs of blocks are then added up in turn.
RUN_BITS = 10


def ranged(df: DataFrame, by: list, name: str, scratch: Scratch, rows: int | None = None, range_rows: int = 1_000_000) -> DataFrame:
    """df written in order of `by`, with `pid`, the number of the range that a row is in. rows: how many there are, where known.

    Ranges follow from a sample that differs from run to run, so they are written before anything is made of them.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(*by) if rows is None or rows <= least * range_rows else df.repartitionByRange(-(-rows // range_rows), *by)
    return scratch.write(dealt.withColumn("pid", F.spark_partition_id()), name)


def running(df: DataFrame, by: list[str], block: str, order: list, values: dict[str, Column], of_group: DataFrame | None = None) -> DataFrame:
    """Adds, under each name in values, the sum of that value over the rows that come before, of the same `by`.

    Rows go by block (a whole number, not null), then by order. Windows see one block, or up to 1024 sums of blocks, so a
    hot group is no task of its own. The columns of `by` hold no nulls. of_group: columns to be added for each group, a
    row for each; they meet the sums of blocks, not the rows.
    """
    first = Window.unboundedPreceding
    sums = df.groupBy(*by, block).agg(*(F.sum(v).alias(f"__{n}") for n, v in values.items())).withColumn("__run", F.shiftright(F.col(block).cast("long"), RUN_BITS))
    add = lambda names, w: [F.coalesce(F.sum(F.col(a)).over(w), F.lit(0)).alias(b) for a, b in names.items()]
    in_run = Window.partitionBy(*by, "__run").orderBy(block).rowsBetween(first, -1)
    within = sums.select(*by, block, "__run", *add({f"__{n}": f"__in_{n}" for n in values}, in_run))
    runs = sums.groupBy(*by, "__run").agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in values))
    over_runs = Window.partitionBy(*by).orderBy("__run").rowsBetween(first, -1) if by else Window.orderBy("__run").rowsBetween(first, -1)
    starts = runs.select(*by, "__run", *add({f"__{n}": f"__run_{n}" for n in values}, over_runs))
    if of_group is not None:
        starts = starts.join(of_group, by)
    more = [c for c in of_group.columns if c not in by] if of_group is not None else []
    heads = within.join(starts, [*by, "__run"]).select(*by, block, *((F.col(f"__in_{n}") + F.col(f"__run_{n}")).alias(f"__{n}") for n in values), *more)
    in_block = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(first, -1)
    own = [(F.coalesce(F.sum(v).over(in_block), F.lit(0)) + F.col(f"__{n}")).alias(n) for n, v in values.items()]
    return df.join(heads, [*by, block]).select(*df.columns, *more, *own)


def numbered(df: DataFrame, name: str, scratch: Scratch, out: str = "name") -> DataFrame:
    """df written with dense numbers from 0, in no particular order; no shuffle."""
    got = scratch.write(df.withColumn("__id", F.monotonically_increasing_id()), name)
    part = F.shiftright("__id", 33)
    counts = got.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each task that wrote
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    at = F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)
    return got.withColumn("__part", part).join(F.broadcast(starts), "__part").select(*df.columns, at.alias(out))
