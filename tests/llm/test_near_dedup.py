import random

import numpy as np
from siftline.llm import near_dedup as nd
from siftline.llm.common import Scratch, WordHashes
from siftline.llm.components import connected_components


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, similar=0.8):
    s = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= similar * len(s[i] | s[j]) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def corpus():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([3, 20, 80, 200]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    passage = rng.choices(words, k=40)
    rows += [" ".join(rng.choices(words, k=60) + passage + rng.choices(words, k=60)) for _ in range(20)]
    rows += ["", None, "   ", "", "one", "One", "one two", rows[0].upper() + "\n"]
    rows += ["hot copy of the same text again and again"] * 50
    return [(1000 - i, t) for i, t in enumerate(rows)]


def test_matches_brute_force(spark):
    rows = corpus()
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted(set(want.values()))


def test_blocks_of_large_groups_agree(spark, monkeypatch):
    monkeypatch.setattr(nd, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(nd, "GROUP_BLOCK", 2)
    rows = corpus()
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_unequal_repeats_lose_no_link(spark):
    """Near copies of which one repeats a passage many times: the sets stay similar, whatever the counts."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        words = ["d%dw%d" % (k, i) for i in range(220)]
        passage, rest = words[:94], words[94:]
        changed = list(rest)
        changed[rng.choice([10, 60, 100])] = "changed"
        rows += [(2 * k, " ".join(passage * rng.choice([30, 200]) + rest)), (2 * k + 1, " ".join(passage + changed[:-10]))]
    want = brute(rows)
    assert len(set(want.values())) == 60
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_empty_and_repeated_rows(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS bands", "1 AS row_id", "2 AS class_id")
    got = nd.near_duplicates(df).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    same, own = "a b c d e f", "g h i j k l m"
    rows = [(1, same, "x"), (1, same, "y"), (2, same.upper(), "x"), (3, own, "x"), (3, own, "x"), (3, "n o p q r s", "x"), (3, same, "x"), (4, own, "x"), (5, "t u v w x", "x"), (6, "", "x"), (6, None, "x"), (7, same, "x")]
    for null in ([], [(None, same, "x"), (None, "y z", "x"), (None, "y z", "y"), (None, "", "x")]):
        df = spark.createDataFrame(rows + null, "doc_id long, text string, source string")
        got = nd.drop_near_duplicates(df)
        assert got.columns == df.columns
        texts = [(r.text or "").lower() for r in got.collect()]
        assert sorted(texts) == sorted([same, own, "n o p q r s", "t u v w x", "", ""] + (["y z", ""] if null else []))
    twice = nd.drop_near_duplicates(df.union(df)).collect()
    assert sorted((r.text or "").lower() for r in twice if (r.text or "").strip()) == sorted([same, own, "n o p q r s", "t u v w x", "y z"])


def test_estimates_probability_jaccard():
    """On weighted items the share of equal registers is near the sum over i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    x, y = np.array([1, 2, 3, 0.5, 4]), np.array([2, 2, 1, 1, 4.0])
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(5))
    items = np.arange(1, 6, dtype=np.uint64) * np.uint64(7919)
    won = nd.prob_min_hash(np.repeat([0, 1], 5), np.tile(items, 2), np.concatenate([x, y]), 2, 20000)
    assert abs((won[0] == won[1]).mean() - want) < 0.02


def test_shingles_of_short_and_long_texts():
    row, items, count = nd.shingles(["a b", "", "a b c d e f", "x " * 9, "A B"], WordHashes())
    assert np.bincount(row, minlength=5).tolist() == [1, 0, 2, 1, 1]
    assert count[row == 3].tolist() == [5] and items[0] == items[-1]


def test_scripts_without_blanks(spark):
    rng = random.Random(8)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000))
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(300))
    other = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000))
    rows = [(1, text), (2, text[:900] + "X" + text[901:]), (3, "é " + text[:1000] + " " + text[1000:]), (4, other), (5, thai), (6, thai[:150] + "ก" + thai[151:]), (7, "é è ê ë à"), (8, "é è ê ë á")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (203, 201), (300, 300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200, 203: 200}
