"""Phrases against plain Python, its SQL, and odd tables."""

import random
import re
from collections import Counter

import duckdb
import pytest
from siftline.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top, percent=100):
    count, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            c = count.setdefault(lang, Counter())
            c.update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, c in count.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def some(n=120, seed=0):
    r = random.Random(seed)
    words = ["the", "cat", "SAT", "é", "a", "on x", "naïve", "x-y"] + [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(60)) + r.choice(["the cat sat on the mat, ", "a a a a a a a ", "x y z! q "]) * 3
        rows.append((k, text, r.choice(["en", "fr", None, "en"])))
    return [*rows, (n, None, "en"), (n + 1, "", "de"), (n + 2, " .,;", None), (1, "the cat", "en"), (1, "the cat", "en")]


@pytest.mark.parametrize("percent", [100, 60])
def test_against_brute_force(spark, percent):
    df = spark.createDataFrame(some(), SCHEMA)
    for least, top in ((4, 40), (25, 3)):
        assert got(collocations.collocations(df, least, top, percent)) == brute(some(), least, top, percent)


def test_small_cells_and_automata_change_nothing(spark, monkeypatch):
    for name, value in {"CELL_BITS": 17, "WORDS_A_CELL": 1, "FLUSH_KEYS": 500, "FLUSH_WORDS": 50, "AUTOMATON_BYTES": 300, "WORDS_A_FILE": 20, "KEPT_WORDS": 30}.items():
        monkeypatch.setattr(collocations, name, value)
    rows = some(40, 1)
    assert got(collocations.collocations(spark.createDataFrame(rows, SCHEMA), 3, 100)) == brute(rows, 3, 100)


def test_few_cells_only_add_candidates(spark):
    """A sketch in which all cells are full lets everything pass; counts stay exact."""
    sketch = collocations.Sketch("unused", 1)
    part, cell = sketch.cells(collocations.mix(collocations.np.arange(1000, dtype="u8")), 1)
    assert (part == 0).all() and len(set(cell.tolist())) > 990
    rows = [(k, "aa bb cc dd ee ff " * 3, "x") for k in range(50)]
    assert got(collocations.collocations(spark.createDataFrame(rows, SCHEMA), 100, 2000)) == brute(rows, 100, 2000)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a. b. a. b", "x")] * 3, [(1, "one two", None)]])
def test_few_rows(spark, rows):
    assert got(collocations.collocations(spark.createDataFrame(rows, SCHEMA), 2)) == brute(rows, 2, 2000)


def test_clashing_columns(spark):
    clash = ["phrase", "n", "a", "l", "r", "rank", "score", "word", "id", "file", "all"]
    df = spark.createDataFrame([(*r, *["?"] * len(clash)) for r in some(30)], f"{SCHEMA}, " + ", ".join(f"`{c}` string" for c in clash))
    assert got(collocations.collocations(df, 5, 50)) == brute(some(30), 5, 50)


def test_scores_beyond_64_bits(spark):
    """The same arithmetic as of the query, on counts that no test table has."""
    a, n, left, right = 9 * 10**12, 8 * 10**13, 9 * 10**12, 9 * 10**12
    assert 1000 * a * n > 2**64 and left * right > 2**64
    row = spark.createDataFrame([(a, n, left, right)], "a long, `all` long, l long, r long").select(collocations.score_of("a", "all", "l", "r").alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


def test_sql(spark, tmp_path):
    rows = some(400, 2)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(collocations.ORACLE_SQL).fetchall())
    assert len(want) > 10 and got(collocations.query(spark, str(tmp_path))) == want
