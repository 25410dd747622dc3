"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Each source is a queue in which its documents stand in shuffled order, as many times over as they may be taken. An entry's
virtual finish time is the number of the source's tokens up to and with it, divided by the source's weight. All queues
are sorted together by that time, over ranges, and cut where the budget is used up: at any cut, sources have given tokens in
proportion to their weights, but for those that have nothing left. Running sums go by blocks of the shuffled order, so a
source of any size is dealt over many tasks; what reaches the driver is single rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .ordered import ranged, running

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"
#: Equal rows (id, source, size) that stand together in the queue; groups of them are shuffled one by one.
TOGETHER = 100
#: Rows of a source, about, that one window adds up.
BLOCK_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of docs: how many of its words the mix takes.

    Sources in order of code points (null last, the empty name first) weigh weights[0], weights[1], .., over and over.
    The mix takes `budget` times all words, at most `most` times those there are. No source gives more than `most` times its
    size; what it can't give goes to the others by weight. The document at which the budget is used up is taken in part,
    so that the sum is exact, and each source is within one document of its target but for what others fall short.

    Null and empty texts have size 0, as have texts without a word; they take nothing. Rows with a null id are shuffled by
    size. Equal rows (id, source, size) are interchangeable. The order depends on ids, sizes and the seed alone, so runs
    agree. An empty table gives an empty result; other columns play no part. scratch: holds the tables that the result reads.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    size = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("src"), docs[source_col].isNull().alias("none"), size.alias("size"))
    equal = rows.groupBy("doc_id", "src", "none", "size").agg(F.count("*").alias("n"))
    sets = equal.select("*", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / TOGETHER).cast("long"))).alias("part"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "part"))
    sets = sets.select("doc_id", "src", "none", "size", "part", F.least(F.lit(TOGETHER), F.col("n") - F.col("part") * TOGETHER).alias("copies"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("u"))
    sets = scratch.write(sets, "mix-rows")

    sizes = sets.groupBy("src", "none").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"), F.count("*").alias("sets"))
    sizes = ranged(sizes, ["none", "src"], "mix-sources", scratch)
    sources = running(sizes, [], "pid", ["none", "src"], {"place": F.lit(1)})
    share = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.select("src", "none", "place", "source_size", "rows", "sets", share.alias("weight"), (F.col("source_size") * most / share).alias("full_at"))
    sources = ranged(sources, ["full_at", "place"], "mix-full", scratch)
    total = sources.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_size", "rows", "sets", "weight"))).first()
    words = min(int(total["source_size"] * budget), total["source_size"] * most)
    # Sources that are full are the first in this order; the level is what the rest of the budget gives for each unit of
    # the rest of the weights, and is highest once all full ones are left out.
    level = running(sources, [], "pid", ["full_at", "place"], {"given": F.col("source_size") * most, "passed": F.col("weight")})
    level = level.agg(F.max((F.lit(words) - F.col("given")) / (F.lit(total["weight"]) - F.col("passed")))).first()[0] or 0.0
    sources = sources.select("src", "none", "place", "source_size", "weight", F.least((F.col("source_size") * most).cast("double"), F.lit(level) * F.col("weight")).alias("target"))

    bits = max(0, math.ceil(math.log2(max(1, total["sets"]) / BLOCK_ROWS)))
    laid = running(sets.withColumn("block", F.shiftright("u", 60 - bits)), ["src", "none"], "block", ["u", "doc_id", "size", "part"], {"before": F.col("size") * F.col("copies")}, sources)
    laid = laid.select("doc_id", "src", "none", "size", "copies", "before", "place", "source_size", "weight", "target")
    laid = scratch.write(laid, "mix-laid")
    each = laid.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    up_to = lambda turn: turn * F.col("source_size") + F.col("before") + F.col("copy") * F.col("size")

    taken = F.lit(0).cast("long")
    if words:
        turns = each.filter("size > 0").select("place", "size", "weight", F.explode(F.array(*(up_to(F.lit(k)) for k in range(most)))).alias("at"))
        queue = turns.select((F.col("at") / F.col("weight")).alias("finish"), "place", "at", "size")
        queue = ranged(queue, ["finish", "place", "at"], "mix-queue", scratch, most * total["rows"])
        of_range = queue.groupBy("pid").agg(F.sum("size").alias("n"))  # a row for each range
        ends = of_range.select("pid", F.sum("n").over(Window.orderBy("pid")).alias("end"), "n")
        last = ends.filter(F.col("end") >= words).orderBy("pid").first()
        here = queue.filter(F.col("pid") == last["pid"])  # one range, whose size is bounded
        here = here.withColumn("end", F.sum("size").over(Window.orderBy("finish", "place", "at")) + (last["end"] - last["n"]))
        cut = here.filter(F.col("end") >= words).orderBy("end").first()
        part = words - (cut["end"] - cut["size"])

        def takes(turn: int):
            at = up_to(F.lit(turn))
            mine = F.struct((at / F.col("weight")).alias("a"), F.col("place").alias("b"), at.alias("c"))
            end = F.struct(F.lit(cut["finish"]).alias("a"), F.lit(cut["place"]).cast("long").alias("b"), F.lit(cut["at"]).cast("long").alias("c"))
            return F.when(mine < end, F.col("size")).when(mine == end, F.lit(part)).otherwise(0)

        taken = F.when(F.col("size") > 0, sum((takes(k) for k in range(most)), F.lit(0))).otherwise(0).cast("long")
    return each.select("doc_id", F.when(~F.col("none"), F.col("src")).alias("source"), "size", "source_size", "target", taken.alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
copied AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM sized),
keyed AS (SELECT doc_id, source, size, copy // {TOGETHER} AS part, copy,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || copy // {TOGETHER}), 1, 15) AS BIGINT) AS u FROM copied),
sums AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
sources AS (SELECT *, CAST([5, 2, 1][CAST(place % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * 3 / CAST([5, 2, 1][CAST(place % 3 + 1 AS INT)] AS DOUBLE) AS full_at FROM sums),
budget AS (SELECT sum(source_size) AS words, sum(weight) AS weights FROM sources),
levels AS (SELECT max((words - given) / (weights - passed)) AS level FROM budget, (SELECT
  coalesce(sum(source_size * 3) OVER w, 0) AS given, coalesce(sum(weight) OVER w, 0) AS passed FROM sources WINDOW w AS (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
laid AS (SELECT k.*, s.source_size, s.place, s.weight, least(CAST(s.source_size * 3 AS DOUBLE), level * s.weight) AS target,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY u, doc_id, k.size, part, copy) AS upto FROM keyed k JOIN sources s ON k.source IS NOT DISTINCT FROM s.source, levels),
queue AS (SELECT *, turn * source_size + upto AS spot, (turn * source_size + upto) / weight AS finish FROM laid, range(3) t(turn) WHERE size > 0),
ends AS (SELECT *, sum(size) OVER (ORDER BY finish, place, spot ROWS UNBOUNDED PRECEDING) AS total FROM queue),
takes AS (SELECT doc_id, source, size, copy, sum(greatest(0, least(size, words - (total - size)))) AS taken FROM ends, budget GROUP BY ALL)
SELECT l.doc_id, l.size, CAST(l.source_size AS BIGINT) AS source_size, l.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM laid l LEFT JOIN takes t ON l.doc_id IS NOT DISTINCT FROM t.doc_id AND l.source IS NOT DISTINCT FROM t.source AND l.size = t.size AND l.copy = t.copy
"""
