import random

import numpy as np
import pytest
from siftline.llm import language_id as li

WORDS = {"en": "the and of with this from that are was have not but", "de": "der die und nicht ist ein schön über für groß mit von", "fr": "le la et les des est une pour être déjà où avec"}


def rows(n, seed):
    rng = random.Random(seed)
    return [(" ".join(rng.choices(WORDS[x].split(), k=rng.choice([4, 30, 400]))), x) for x in rng.choices(list(WORDS), k=n)]


@pytest.fixture(scope="module")
def net():
    return li.train(*map(list, zip(*rows(300, 1), strict=True)))


def test_held_out_accuracy(net):
    held = rows(300, 2)
    lang, score = li.predict_batch(net, [t for t, _ in held])
    assert np.mean([a == b for a, (_, b) in zip(lang, held, strict=True)]) > 0.98
    assert all(0 <= s <= 1 for s in score)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = li.start(["a", "b"], rng)
    net.params = [p.astype(np.float64) for p in net.params]
    x, y = rng.integers(0, 256, (4, 20)), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(4), y]).mean()
    grads = li.gradients(net, x, y)
    for p, g in zip(net.params, grads, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape) if p.ndim == 1 or p.shape[0] != 256 else (int(rng.choice(x.ravel())), int(rng.integers(p.shape[1])))
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_windows_cover_whole_texts():
    for n in (0, 1, 127, 128, 129, 252, 253, 5000):
        data = bytes(97 + i % 26 for i in range(n))
        w = li.cut(data)
        assert w.shape[1] == li.WINDOW
        step = li.WINDOW - max(li.WIDTHS) + 1
        joined = w[0].tobytes() + b"".join(x[-step:].tobytes() for x in w[1:])
        assert joined[:n] == data and set(joined[n:]) <= {32}
        assert len(w) == 1 or step * (len(w) - 2) + li.WINDOW < n


def test_edge_cases(spark, net):
    texts = [None, "", "123 !", "the and", "the and", "der die und " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id AS score", "text", "1 AS lang_pred")
    got = {r.score_key: (r.lang_pred, r.score) for r in li.predict(df, net, id_col="score").collect()}
    assert [got[i][0] for i in range(6)] == ["und", "und", "und", "en", "en", "de"]
    assert li.predict(df, None, id_col="score").filter("lang_pred != 'und'").count() == 0
    empty = spark.createDataFrame([], "text string, lang string, doc_id long")
    assert li.fit(empty) is None and li.predict(empty, net).count() == 0
    assert li.fit(spark.createDataFrame([("abc", None), (None, "en"), ("12", "en")], "text string, lang string")) is None


def test_only_letters_make_a_text_lettered(net):
    assert li.predict_batch(net, ["\u00b2 \u00bd \u2460 5 _", "\u00aa"])[0][0] == li.UNKNOWN
    assert li.predict_batch(net, ["\u00e9"])[0][0] != li.UNKNOWN


def test_one_rule_for_all_lengths(spark):
    labelled = spark.createDataFrame(rows(300, 3), "text string, lang string")
    net = li.fit(labelled)
    assert len(net.floors) == li.LEVELS + 1 and list(net.floors) == sorted(net.floors) and net.floors[0] > 0
    assert net.least(np.array([1, 50, 10**6]), 0.5).max() <= 0.5
    texts = [t for t, _ in rows(200, 9)] + ["the", "12", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in li.keep_known(df, net, 0.5).collect()}
    assert len(kept & set(range(200))) >= 199 and 201 not in kept and 202 not in kept
    assert {r.doc_id for r in li.keep_known(df, None, 0.5).collect()} == set(range(201))


def test_equal_texts_learn_the_language_most_rows_name(spark):
    df = spark.createDataFrame([("ab", "de"), ("ab", "fr"), ("ab", "fr"), ("cd", "b"), ("cd", "a")], "text string, lang string")
    assert {(r.text, r.lang) for r in li.sample(df).collect()} == {("ab", "fr"), ("cd", "a")}


def test_query_leaves_the_held_out_fold_out(spark, tmp_path):
    data = [(i, t, "de" if i % 7 == 0 else x) for i, (t, x) in enumerate(rows(120, 5))]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = li.query(spark, str(tmp_path)).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == 120


def test_query_matches_a_plain_loop_over_windows(spark, tmp_path):
    """Windows one by one, filters by sums, each text's mean weighted by letters: lang_pred and score of the query."""
    data = [(i, t, x) for i, (t, x) in enumerate(rows(80, 6))] + [(100, None, "en"), (101, "12", None), (102, "Ça où déjà! " * 40, None), (103, "the", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    net = li.fit(li.training_rows(docs))
    embed, out, bias = (p.astype(np.float64) for p in (net.params[0], net.params[-2], net.params[-1]))

    def of_window(codes):
        features = []
        for k, width in enumerate(li.WIDTHS):
            kernel = net.params[1 + 2 * k].astype(np.float64).reshape(width, li.EMBED, li.FILTERS)
            tops = [sum(embed[codes[at + j]] @ kernel[j] for j in range(width)) for at in range(li.WINDOW - width + 1)]
            features.append(np.maximum(np.max(tops, axis=0) + net.params[2 + 2 * k], 0))
        z = np.exp(np.concatenate(features) @ out + bias)
        return z / z.sum()

    def plain(text):
        codes = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").encode()]
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        total, weight, at = 0, 0, 0
        while True:
            window = (codes[at : at + li.WINDOW] + [32] * li.WINDOW)[: li.WINDOW]
            letters = sum(c != 32 for c in window)
            total, weight = total + letters * of_window(window), weight + letters
            if at + li.WINDOW >= len(codes):
                break
            at += li.WINDOW - max(li.WIDTHS) + 1
        p = total / weight
        return net.classes[int(p.argmax())], float(p.max())

    got = {r.doc_id: (r.lang_pred, r.score) for r in li.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for doc_id, text, _ in data:
        lang, score = plain(text)
        assert got[doc_id][0] == lang and got[doc_id][1] == pytest.approx(score, abs=1e-4)
