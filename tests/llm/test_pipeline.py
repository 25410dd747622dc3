"""The pipeline against plain Python on a small table."""

import random
import zlib

import corpus_pipeline
import numpy as np
from siftline.llm import bpe, language_id, packing, secret_scan
from tests.llm.test_near_dedup import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of with this from that are was have not but".split(), "de": "der die und nicht ist ein schön über für groß mit von".split()}


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choices(WORDS[lang], k=rng.choice([8, 60, 300])))
        rows.append((i, text, lang, "s", len(text)))
    add = lambda text, lang="en": rows.append((len(rows), text, lang, "s", len(text or "")))
    add(rows[5][1])
    add(rows[5][1].upper())
    add("the and of with this\npassword = 'hunter2hunter2' and token: abcdef123456abcdef123456ff " + " ".join(rng.choices(WORDS["en"], k=90)))
    add("1234 5678 ... !!!")
    add("")
    add(None)
    add("the of " * 6000)
    return rows


def test_pipeline_matches_plain_python(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    labelled = [(r[1], r[2]) for r in rows if r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    from pyspark.sql import functions as F

    order = {r[0]: r[1] for r in spark.createDataFrame(labelled, "text string, lang string").select("text", F.xxhash64("text")).collect()}
    labelled = sorted({order[t]: (t, x) for t, x in sorted(labelled, key=lambda x: x[1], reverse=True)}.values(), key=lambda x: order[x[0]])
    net = language_id.train(*map(list, zip(*labelled, strict=True)))
    lang, score = language_id.predict_batch(net, [r[1] or "" for r in rows])
    docs = [r for r, x, s in zip(rows, lang, score, strict=True) if x != "und" and (s >= 0.5 or len(r[1]) < 400)]
    root = brute([(r[0], r[1]) for r in docs])
    docs = [r for r in docs if root[r[0]] == r[0]]

    from tokenizers import Tokenizer

    tok, scan = Tokenizer.from_file(bpe.vocabulary(packing.WORDS)), secret_scan.Scanner()
    want = set()
    for r in docs:
        text, at, parts = r[1], 0, []
        for a, b, _ in scan(text):
            if a >= at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        text = "".join(parts) + text[at:]
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want |= {(r[0], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    ids = {r.doc_id for r in got}
    assert {123, 124, 125} & ids == set() and 122 in ids and not {120, 121} & ids


def test_stages_keep_columns_and_take_empty_tables(spark):
    for rows in ([], [(None, "the and of with this from that", None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0)]):
        docs = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", score string")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "x password=abcdefgh y", "en", "s", 21), (2, None, None, None, None), (3, "clean", "en", "s", 5)], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.without_secrets(spark, docs, "").collect()}
    assert got == {1: ("x [SECRET] y", 12), 2: (None, None), 3: ("clean", 5)}


def test_lazy_chains_side_by_side(spark):
    """All four stages without anything written in between, two chains at a time."""
    rows = corpus()[:60]
    docs = spark.createDataFrame(rows, COLUMNS)
    chains = [docs, docs.filter("doc_id % 2 = 0")]
    for _, stage in corpus_pipeline.STAGES:
        chains = [stage(spark, d, "") for d in chains]
    whole, half = (len({r.doc_id for r in d.collect()}) for d in chains)
    assert whole > half > 0
