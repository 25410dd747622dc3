"""The mix against plain Python, its SQL, and odd tables."""

import hashlib

import duckdb
import pytest
from siftline.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def plain(rows, weights=(5, 2, 1), most=3):
    """(doc_id, source, size, source_size, target, taken), sorted."""
    sizes, docs = {}, []
    seen = {}
    for i, text, source in rows:
        n = len((text or "").split())
        sizes[source] = sizes.get(source, 0) + n
        copy = seen[i, source, n] = seen.get((i, source, n), -1) + 1
        u = int(hashlib.md5(f"mix:{'' if i is None else i}:{n}:{copy // 100}".encode()).hexdigest()[:15], 16)
        docs.append((u, i or 0, n, copy, i, source))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    total, free, target = sum(sizes.values()), set(names), {}
    while free:
        rest = total - sum(target.values())
        full = [s for s in free if rest * w[s] / sum(w[x] for x in free) >= most * sizes[s]]
        if not full:
            target |= {s: rest * w[s] / sum(w[x] for x in free) for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        free -= set(full)
    queue, at = [], dict.fromkeys(names, 0)
    for k, (_, _, n, _, _, source) in sorted(enumerate(docs), key=lambda x: x[1][:4]):
        at[source] += n
        queue += [((t * sizes[source] + at[source]) / w[source], names.index(source), t * sizes[source] + at[source], k) for t in range(most) if n]
    taken, left = [0] * len(docs), total
    for _, _, _, k in sorted(queue):
        take = min(docs[k][2], left)
        taken[k] += take
        left -= take
    return sorted(((i, s, n, sizes[s], round(target[s], 6), t) for (_, _, n, _, i, s), t in zip(docs, taken, strict=True)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def some(n=300):
    out = [(k, " ".join(["w"] * (k * k % 97)), "abcde"[k % 5] if k % 3 else "a") for k in range(n)]
    return [*out, (None, "x y", "a"), (None, None, None), (7000, "one\ttwo\u00a0x\x0bthree", None), (7001, "", ""), (7002, " \n ", "b"), (7003, "v " * 5000, "c")]


def test_against_plain_python(spark):
    rows = some()
    df = spark.createDataFrame(rows, SCHEMA)
    out = got(mixing.mix(df))
    assert out == plain([(i, (t or "").replace("\u00a0", "_"), s) for i, t, s in rows])
    assert sum(r[-1] for r in out) == sum(r[2] for r in out) and all(r[-1] <= 3 * r[2] for r in out)
    assert got(mixing.mix(df.repartition(7))) == out


def test_small_blocks_give_the_same(spark, monkeypatch):
    want = got(mixing.mix(spark.createDataFrame(some(), SCHEMA)))
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    assert got(mixing.mix(spark.createDataFrame(some(), SCHEMA))) == want


def test_repeated_rows_and_one_hot_source(spark):
    rows = [(1, "a b c", "x")] * 450 + [(None, "a b", "x")] * 250 + [(k, "c d e f", "y") for k in range(20)] + [(5, "q", "z")] * 3
    assert got(mixing.mix(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a")], [(1, "a b c d", "a")]])
def test_few_rows(spark, rows):
    assert got(mixing.mix(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_clashing_columns(spark):
    clash = ["size", "src", "none", "place", "pid", "block", "u", "taken", "target", "before", "at", "n", "part", "copies"]
    df = spark.createDataFrame([(*r, *["?"] * len(clash)) for r in some(40)], f"{SCHEMA}, " + ", ".join(f"{c} string" for c in clash))
    assert got(mixing.mix(df)) == plain([(i, (t or "").replace("\u00a0", "_"), s) for i, t, s in some(40)])


def test_sql_and_plan(spark, tmp_path):
    spark.createDataFrame(some(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = mixing.query(spark, str(tmp_path))
    want = con.sql(mixing.ORACLE_SQL).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
