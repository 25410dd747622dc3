"""Interval joins: spans of a line that share a byte with other spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a bucket. A span stands in every bucket that it touches.
WIDTH = 64


def _buckets(start: str, end: str, width: int) -> Column:
    """Whole numbers of buckets; an empty span touches the one it stands in."""
    at = lambda c: F.floor(c / width).cast("long")
    return F.explode(F.sequence(at(F.col(start)), F.greatest(at(F.col(start)), at(F.col(end) - 1))))


def overlapping(spans: DataFrame, others: DataFrame, keys: list[str], start: str = "col_start", end: str = "col_end", width: int = WIDTH) -> DataFrame:
    """The rows of spans, each once, that share a byte with a row of others of the same keys; columns as in spans.

    Both are cut into buckets of `width` bytes and meet by keys and bucket in an equi-join, so a line of any number of spans
    is dealt over many tasks. Others are distinct before they meet: a bucket then holds fewer than width * width of them.
    Intervals are half-open. Null keys or ends meet nothing; equal rows of spans come out once.
    """
    mine = spans.withColumn("__bucket", _buckets(start, end, width))
    theirs = others.select(*keys, F.col(start).alias("__start"), F.col(end).alias("__end")).distinct().withColumn("__bucket", _buckets("__start", "__end", width))
    shares = (mine[start] < theirs["__end"]) & (theirs["__start"] < mine[end])
    on = reduce(lambda a, b: a & b, (mine[k] == theirs[k] for k in [*keys, "__bucket"]), shares)
    return mine.join(theirs, on, "left_semi").drop("__bucket").distinct()
