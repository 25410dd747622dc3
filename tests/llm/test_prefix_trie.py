"""The trie against plain Python and its SQL."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
from siftline.llm import prefix_trie
from siftline.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, heads=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    convs = {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}
    if heads:
        first = lambda c: zlib.crc32(str(c).encode()) % 6
        convs = {c: convs.get(c - int(math.fmod(c, 100)), [])[: first(c)] + v[first(c) :] for c, v in convs.items()}
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        sub = {k: v for k, v in nodes.items() if k[: len(node)] == node}
        has_child = {k[:-1] for k in nodes if k}
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(node))))
        saved = sum((len(v) - 1) * len(k[-1][1]) for k, v in sub.items() if k)
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(k) == len(node) + 1 for k in sub), sum(k not in has_child for k in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == prefix_trie.NODES
    return sorted(map(tuple, df.collect()), key=repr)


def some(seed=0, n=40, longest=14):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        base = random.Random(c % 3)
        turns = [base.choice("abcé") * 2 for _ in range(r.randrange(longest))]
        if turns and r.random() < 0.7:
            turns[r.randrange(len(turns))] += str(c)
        rows += [(c * 37 % 250, t, "user" if t % 2 else None, x) for t, x in enumerate(turns)]
    return rows


@pytest.mark.parametrize("heads", [False, True])
def test_against_brute_force(spark, heads):
    rows = [*some(), (7000, None, "x", None), (7000, None, "", "y"), (7000, 1, "", "z"), (None, 1, "user", "lost"), (100, 0, "a", "q"), (101, 0, "a", "q"), (-5, 3, "user", "😀")]
    df = spark.createDataFrame(rows, SCHEMA)
    scratch = Scratch(spark)
    turns = prefix_trie.in_order(df, scratch)
    out = prefix_trie.trie(*prefix_trie.rebuilt(turns, scratch), scratch) if heads else prefix_trie.conversation_trie(df)
    assert got(out) == brute(rows, heads)


def test_long_copies_and_extra_columns(spark):
    long = [(c, t, "u", f"{t % 7}") for c in (3, 4, 5) for t in range(45)] + [(9, t, "u", f"{t % 7}") for t in range(30)] + [(9, 31, "u", "other")]
    copies = [(c, t, "a", "hello") for c in range(1000, 1300) for t in range(3)]
    rows = long + copies + [(1, 5, None, None)] * 3
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], f"{SCHEMA}, pos int, depth int, name int, pid int")
    assert got(prefix_trie.conversation_trie(df)) == brute(rows, False)


def test_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH_BITS", 1)
    monkeypatch.setattr(prefix_trie, "IDS_BITS", 2)
    assert got(prefix_trie.conversation_trie(spark.createDataFrame(some(3), SCHEMA))) == brute(some(3), False)


@pytest.mark.parametrize("rows", [[], [(5, None, None, None)], [(None, 1, "a", "b")]])
def test_few_rows(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(prefix_trie.query(spark, str(tmp_path))) == brute(rows)


def test_sql(spark, tmp_path):
    spark.createDataFrame(some(5, 80), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.sql(prefix_trie.ORACLE_SQL).fetchall(), key=repr)
    assert got(prefix_trie.query(spark, str(tmp_path))) == want
