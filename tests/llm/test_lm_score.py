"""The model against counts and formulas in plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from siftline.llm import lm_score


def brute(train, texts):
    sent = [["<s>", *[w.lower() for w in t.split()], "</s>"] for t in train]
    uni = Counter(w for s in sent for w in s[1:])
    pairs = Counter(p for s in sent for p in zip(s, s[1:], strict=False))
    hist, follow = defaultdict(Counter), Counter()
    for (u, v), c in pairs.items():
        hist[u][v] = c
        follow[v] += 1
    coc = lambda xs: [sum(x == k for x in xs) for k in (1, 2, 3, 4)]
    d, dw = lm_score.discounts(*coc(pairs.values())), lm_score.discounts(*coc(follow.values()))
    n_words, n_pairs = len(uni), len(pairs)

    def word(v):
        spare = sum(dw[min(m, 3)] for m in follow.values())
        return (max(follow[v] - dw[min(follow[v], 3)], 0) + spare / (n_words + 1)) / n_pairs

    def p(u, v):
        if u not in hist:
            return word(v)
        total = sum(hist[u].values())
        return max(hist[u][v] - d[min(hist[u][v], 3)], 0) / total + sum(d[min(c, 3)] for c in hist[u].values()) / total * word(v)

    n = sum(uni.values())
    out = []
    for t in texts:
        s = ["<s>", *[w.lower() for w in (t or "").split()], "</s>"]
        out.append((len(s) - 1, sum(uni[w] > 0 for w in s[1:]), sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (n_words + 1))) for w in s[1:]), sum(math.log10(p(u, v)) for u, v in zip(s, s[1:], strict=False))))
    return out, p, uni


TRAIN = ["a b a b c", "A b d e", "the cat sat on the mat", "the cat ran", "a a a a a a a", "b c b c d", "", "é é x", "the mat"] * 2 + ["z " * 300, "one two"]


def test_matches_brute_force(spark):
    texts = ["a b c", "new words only", "", None, "the cat sat", "z z z a", "é x " * 50]
    model = lm_score.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    got = lm_score.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    want, p, uni = brute(TRAIN, texts)
    for g, w in zip(got, want, strict=True):
        assert (g.n_tokens, g.n_known) == w[:2]
        assert g.base_score == pytest.approx(w[2], rel=1e-12)
        assert g.score == pytest.approx(w[3], rel=1e-12)
    for u in ("a", "the", "<s>"):  # probabilities of all words and the unknown one
        assert sum(p(u, v) for v in uni) + p(u, "no such word") == pytest.approx(1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm_score.train(none)
    assert model.tokens == 0
    assert lm_score.score(none, model).count() == 0
    row = lm_score.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row.base_score, row.score) == (0.0, 0.0)


def test_a_lost_array_is_an_error(spark):
    import os

    from siftline.llm.common import Store

    model = lm_score.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRAIN)], "doc_id long, text string")
    assert lm_score.score(docs, model).count() == len(TRAIN)
    folder = Store(model.folder).path
    for name in os.listdir(folder):
        if name.startswith("pairs-"):
            os.remove(f"{folder}/{name}")
    with pytest.raises(Exception, match="No such file"):
        lm_score.score(docs, model).collect()


def test_parts_and_hot_words_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_BYTES", 16)
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    parts, hot = lm_score.plan_parts(train)
    assert parts > 40 and len(hot) > 3
    docs = spark.createDataFrame(list(enumerate(TRAIN)), "doc_id long, text string")
    got = lm_score.score(docs, lm_score.train(train)).orderBy("doc_id").collect()
    for g, w in zip(got, brute(TRAIN, TRAIN)[0], strict=True):
        assert (g.n_tokens, g.n_known) == w[:2] and g.score == pytest.approx(w[3], rel=1e-12)


def test_few_handles_for_many_parts(spark, monkeypatch):
    import os
    import resource

    monkeypatch.setattr(lm_score, "PART_BYTES", 60)
    monkeypatch.setattr(lm_score, "OPEN_PARTS", 8)
    texts = [" ".join(f"w{k * j % 900}" for j in range(40)) for k in range(40)]
    model = lm_score.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(model.with_words) > 80
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    used = len(os.listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (used + 20, hard))
    try:
        got = lm_score.Scorer(model)(texts)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    for score, w in zip(got["score"], brute(texts, texts)[0], strict=True):
        assert score == pytest.approx(w[3], rel=1e-12)
