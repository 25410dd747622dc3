"""The trie of conversation prefixes by prefix doubling: which conversations start alike, how far, and what sharing saves.

Turns that no other conversation has at the same place end what a conversation shares, so only turns before the first such
one are named. Blocks of 1, 2, 4, .. turns that start at multiples of their length get dense names, each from the names
of its halves, in a logarithmic number of joins; a prefix of d turns is put together from the blocks of d's binary digits,
a digit in each round, and named by the smallest conversation that has it. A node is then a (depth, name) pair. Sums over
subtrees need no walk: a node belongs to the smallest conversation in it, the nodes of one conversation are the last
ones of its path, so a subtree's sums are sums over its members of what each owns from there on.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .ordered import numbered, ranged, running

#: Turns of a path whose sums are made in one window, and ids (as a power of two) that are joined into one string.
STRETCH_BITS, IDS_BITS = 10, 12
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def in_order(conversations: DataFrame, scratch: Scratch, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), digest and chars of each turn, by turn (null first), then role, then digest.

    Null roles and texts count as empty. Rows with a null id belong to no conversation. Texts aren't shuffled: digests are.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(conversations[id_col].cast("long").alias("conv_id"), conversations[turn_col].alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = scratch.write(rows.filter(F.col("conv_id").isNotNull()), "trie-turns")
    order = ["conv_id", "turn", "role", "digest"]
    rows = ranged(rows, order, "trie-ordered", scratch)
    return running(rows, ["conv_id"], "pid", order[1:], {"pos": F.lit(1)}).select("conv_id", "pos", "digest", "chars")


def rebuilt(turns: DataFrame, scratch: Scratch, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns after the change of heads, and (conv_id, length) of each conversation.

    A conversation c starts with the first h turns of c - c % family, h being crc32(c) % most; its own come after its first h.
    """
    turns = scratch.write(turns, "trie-numbered")
    head = F.sort_array(F.collect_list(F.struct("pos", "digest", "chars")))  # fewer than `most`
    heads = turns.filter((F.col("pos") < most - 1) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    each = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("*", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"))
    each = each.join(heads, "base", "left").select("conv_id", "n", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h")).alias("head"))
    each = scratch.write(each.withColumn("lead", F.size("head")), "trie-heads")
    own = turns.join(each.select("conv_id", "h", "lead"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "chars")
    first = each.select("conv_id", F.inline("head")).select("conv_id", "pos", "digest", "chars")
    return own.unionByName(first), each.select("conv_id", (F.col("lead") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))


def _shared(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame, int]:
    """Names of single turns up to where a conversation is alone: (conv_id, at, name, chars), and the most turns of one."""
    often = turns.groupBy("pos", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("pos", "digest")
    names = numbered(often, "trie-turn-names", scratch)
    known = scratch.write(turns.join(names, ["pos", "digest"], "left").select("conv_id", F.col("pos").alias("at"), "name", "chars"), "trie-known")
    stops = known.filter(F.col("name").isNull()).groupBy("conv_id").agg(F.min("at").alias("stop"))
    kept = known.filter(F.col("name").isNotNull()).join(stops, "conv_id", "left").filter(F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    kept = scratch.write(kept.select("conv_id", "at", "name", "chars"), "trie-level-0")
    return kept, known, (kept.agg(F.max("at")).first()[0] or 0) + 1


def _blocks(level: DataFrame, deepest: int, scratch: Scratch) -> list[DataFrame]:
    """(conv_id, at, name) of blocks of 1, 2, 4, .. turns."""
    out = [level.select("conv_id", "at", "name")]
    k = 1
    while 1 << k <= deepest:
        halves = out[-1].groupBy("conv_id", F.shiftright("at", k).alias("place")).agg(F.min_by("name", "at").alias("a"), F.max_by("name", "at").alias("b"), F.count("*").alias("n"))
        halves = scratch.write(halves.filter("n = 2").drop("n"), f"trie-pairs-{k}")
        names = numbered(halves.select("place", "a", "b").distinct(), f"trie-names-{k}", scratch)
        out.append(scratch.write(halves.join(names, ["place", "a", "b"]).select("conv_id", F.shiftleft("place", k).alias("at"), "name"), f"trie-level-{k}"))
        k += 1
    return out


def _prefixes(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(conv_id, depth, name, n): of shared prefixes, the smallest conversation that has it and how many have it."""
    last = None  # the last block of each prefix: one of as many turns as the lowest digit of the depth says
    for k, level in enumerate(levels):
        rows = level.filter(F.shiftright("at", k) % 2 == 0).select("conv_id", "at", (F.col("at") + (1 << k)).alias("depth"), F.col("name").alias("block"))
        last = rows if last is None else last.unionByName(rows)
    last = scratch.write(last.withColumn("digits", F.bit_count("depth")), "trie-last-blocks")
    done, before = None, None
    for digits in range(1, len(levels) + 1):
        rows = last.filter(F.col("digits") == digits).drop("digits")
        if before is None:
            rows = rows.withColumn("head", F.lit(0).cast("long"))
        else:
            heads = before.select("conv_id", F.col("depth").alias("at"), F.col("name").alias("head"))
            rows = scratch.write(rows.join(heads, ["conv_id", "at"]), f"trie-made-{digits}")
        names = rows.groupBy("depth", "head", "block").agg(F.min("conv_id").alias("name"), F.count("*").alias("n"))
        before = scratch.write(rows.join(names, ["depth", "head", "block"]).select("conv_id", "depth", "name", "n"), f"trie-prefixes-{digits}")
        done = before if done is None else done.unionByName(before)
    return done


def digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: of the members (column end) of each node, as a stream in order of ids.

    A digest of all ids of one node is a chain by definition; what it is fed is joined by up to 4096 ids before, elsewhere.
    """
    small_batches(ends.sparkSession)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("end")), lambda x: x.cast("string")), ",")
    joined = ends.groupBy("conv_id", "depth", F.shiftright("end", IDS_BITS).alias("piece")).agg(ids.alias("ids"))

    def run(batches):
        at, sha = None, None
        for b in batches:
            done: list[tuple] = []
            for node, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (node, depth) != at:
                    if at:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (node, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield _rows(done)
        if at:
            yield _rows([(*at, sha.hexdigest())])

    dealt = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")
    return dealt.select("conv_id", "depth", "ids").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])


def trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes (NODES) of turns (conv_id, pos, digest, chars; each place once) of conversations (conv_id, length), root first.

    Conversations without a turn are in lengths alone, and end at the root. No conversations: no nodes. scratch holds the
    tables that the result reads.
    """
    turns, lengths = scratch.write(turns, "trie-sequences"), scratch.write(lengths, "trie-lengths")
    n, top = lengths.agg(F.count("*"), F.min("conv_id")).first()
    level, _, deepest = _shared(turns, scratch)
    paths = _prefixes(_blocks(level, deepest, scratch), scratch)
    own = F.col("name") == F.col("conv_id")
    costs = level.select("conv_id", (F.col("at") + 1).alias("depth"), "chars")
    paths = paths.join(costs, ["conv_id", "depth"]).withColumn("saved", F.when(own, (F.col("n") - 1) * F.col("chars")).otherwise(0)).withColumn("stretch", -F.shiftright("depth", STRETCH_BITS))
    paths = running(scratch.write(paths, "trie-paths"), ["conv_id"], "stretch", [F.desc("depth")], {"below": F.col("saved")})
    paths = scratch.write(paths.select("conv_id", "depth", "name", "n", (F.col("below") + F.col("saved")).alias("saved")), "trie-sums")

    # Each conversation's path is others' up to `joins`, where it leaves the nodes of `parent`; from there on it is its own.
    foreign = F.when(~own, F.col("depth"))
    tails = paths.groupBy("conv_id").agg(F.max("depth").alias("shared"), F.max(foreign).alias("joins"), F.max_by(F.when(~own, F.col("name")), foreign).alias("parent"))
    each = lengths.join(tails, "conv_id", "left").select("conv_id", "length", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("joins", F.lit(0)).alias("joins"), F.coalesce("parent", F.lit(top)).alias("parent"))
    each = scratch.write(each.withColumn("owns", (F.col("length") > F.col("joins")) | (F.col("conv_id") == F.lit(top))), "trie-conversations")
    joined = each.filter(F.col("owns") & (F.col("conv_id") != F.lit(top))).groupBy(F.col("parent").alias("conv_id"), F.col("joins").alias("depth")).agg(F.count("*").alias("joined"))
    joined = scratch.write(joined, "trie-joined")
    leaves = each.filter("owns").select("conv_id", F.col("length").alias("depth")).join(joined, ["conv_id", "depth"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    leaves = scratch.write(leaves, "trie-leaves")

    shared = paths.join(leaves, "conv_id", "left").groupBy(F.col("name").alias("conv_id"), "depth").agg(F.max("n").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = lengths.sparkSession.range(1 if n else 0).select(F.lit(top).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(n).alias("n_convs"))
    sums = leaves.agg(F.count("*").alias("n_leaves"))  # the saved tokens of all: each conversation's first sum holds its own
    all_saved = paths.filter("depth = 1").agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    root = root.select("*", F.lit(sums.first()[0]).alias("n_leaves"), F.lit(all_saved.first()[0]).alias("saved_tokens"))
    ends = each.filter("length > 0 AND length <= shared").select("conv_id", F.col("length").alias("depth")).join(paths, ["conv_id", "depth"]).select(F.col("name").alias("conv_id"), "depth", F.col("conv_id").alias("end"))
    ends = ends.unionByName(each.filter("length = 0").select(F.lit(top).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("end")))
    inner = shared.unionByName(root).join(joined, ["conv_id", "depth"], "left").join(digests(ends), ["conv_id", "depth"], "left").join(each, "conv_id")
    goes_on = (F.col("depth") < F.col("length")).cast("long")
    inner = _node(inner, F.col("n_convs"), goes_on + F.coalesce("joined", F.lit(0)), F.col("n_leaves"), F.col("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)))
    alone = each.filter("length > shared").select("*", F.explode(F.sequence(F.col("shared") + 1, F.col("length"))).alias("depth"))
    one = F.lit(1).cast("long")
    ends_here = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NOTHING)
    return inner.unionByName(_node(alone, one, goes_on, one, F.lit(0).cast("long"), ends_here))


def _node(rows: DataFrame, n: Column, children: Column, leaves: Column, saved: Column, ends: Column) -> DataFrame:
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("joins") + 1, F.col("parent")).otherwise(F.col("conv_id"))
    return rows.select("conv_id", "depth", parent.alias("parent_conv_id"), n.alias("n_convs"), children.alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens"), ends.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, scratch: Scratch | None = None, **columns: str) -> DataFrame:
    """The trie of conversations as they are; columns: as of in_order."""
    scratch = scratch or Scratch(conversations.sparkSession)
    turns = scratch.write(in_order(conversations, scratch, **columns), "trie-numbered")
    return trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("length")), scratch)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return trie(*rebuilt(in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"), scratch), scratch), scratch)


#: CRC-32 of a decimal, bit by bit: a byte joins the register, then eight steps follow, each marked by -1.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r // 2, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END) END))"
ORACLE_SQL = f"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, CAST({_CRC} % 6 AS BIGINT) AS h, list(sha256(length(role) || ':' || role || text) ORDER BY pos) AS own, list(length(text) ORDER BY pos) AS own_chars FROM turns GROUP BY c),
paths AS (SELECT a.c, coalesce(b.own[1:a.h], []) || a.own[a.h + 1:] AS p, coalesce(b.own_chars[1:a.h], []) || a.own_chars[a.h + 1:] AS chars FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 100),
members AS (SELECT c, d, p[1:d] AS node, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS n_chars, len(p) = d AS ends FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM paths)),
nodes AS (SELECT node, d, min(c) AS conv_id, count(*) AS n, max(n_chars) AS n_chars, coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS joined FROM members GROUP BY node, d),
children AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
above AS (SELECT node[1:k] AS node, coalesce(n_children, 0) = 0 AS leaf, (n - 1) * n_chars AS saved FROM (SELECT nodes.*, n_children, unnest(range(d + 1)) AS k FROM nodes LEFT JOIN children USING (node))),
sums AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY node)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(v.joined) AS ends_sha256
FROM nodes v JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes u ON v.d > 0 AND u.node = v.node[1:v.d - 1]
"""
