import random
import re

import pytest
from siftline.llm import license_scan as ls

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    w, found = words_of(text), []
    for label, phrase in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def texts():
    rng = random.Random(6)
    parts = ["under", "the", "MIT", "mit", "license", "License,", "Apache", "apache license version 2.0", "cc by-nc", "CC BY NC", "é", "日本", "_", "-", "\n", "version", "2", "under the MIT license", "ſ", "cc"]
    out = [" ".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300)]
    return [*out, "", None, "cc by nc cc by nc", "cc-by-nc " * 20_000, "mit", "This work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, free of charge, to any person"]


def test_matches_brute_force(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in ls.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[len(rows) - 2].labels == "gpl-3" and got[len(rows) - 2].score == pytest.approx(1)
    assert got[len(rows) - 1].labels == "mit" and 0 < got[len(rows) - 1].score < 1


def brute_labels(text, index):
    """By trying every start of every template."""
    w, out = [x.encode() for x in words_of(text)], []
    for k, t in enumerate(index.templates):
        anchors = {i for ps in index.postings.values() for kk, i in ps if kk == k}
        ws = [x.encode() for x in t.words]
        good = [s for s in range(-len(ws), len(w)) if sum(0 <= s + i < len(w) and w[s + i] == ws[i] for i in anchors) >= index.need[k]]
        drift, groups = 0 if t.base else ls.DRIFT, []
        for s in good:
            if groups and s - groups[-1][-1] <= drift:
                groups[-1].append(s)
            else:
                groups.append([s])
        for g in groups:
            at = [[i for i in range(max(0, g[0] + a - drift), g[-1] + a + drift + 1) if w[i : i + b - a] == ws[a:b]] for a, b in t.keys]
            if all(at):
                starts = {*g, *(x[0] - a for x, (a, _) in zip(at, t.keys, strict=True))}
                hit = [any(0 <= s + i < len(w) and w[s + i] == x for s in starts) for i, x in enumerate(ws)]
                score = sum(index.idf[x] for x, h in zip(t.words, hit, strict=True) if h) / sum(index.idf[x] for x in t.words)
                if score >= ls.LEAST:
                    out.append((t.label, score))
    return ",".join(sorted({x for x, _ in out})), max((s for _, s in out), default=0.0)


def test_labels_and_scores_match_brute_force(spark, tmp_path):
    rng, rows = random.Random(3), []
    for t in ls.TEMPLATES:
        rows.append(" ".join(t.words))
        for _ in range(6):  # words put in, left out and changed
            w = list(t.words)
            for _ in range(rng.randint(0, 6)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["other"], [w[i], "new"]])
            rows.append("some words before " * rng.randint(0, 3) + " ".join(w) + " and after")
    rows += ["", "the cat sat"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    index = ls.Index(ls.TEMPLATES, *ls.document_frequency(docs, {w for t in ls.TEMPLATES for w in t.words}))
    got = {r.doc_id: r for r in ls.query(spark, str(tmp_path)).collect()}
    for i, text in enumerate(rows):
        labels, score = brute_labels(text, index)
        assert got[i].labels == labels and got[i].score == pytest.approx(score), text
    whole = [got[7 * k] for k in range(len(ls.TEMPLATES))]
    assert all(t.label in r.labels.split(",") and r.score == pytest.approx(1) for t, r in zip(ls.TEMPLATES, whole, strict=True))


def test_edits_outside_the_key_phrases(spark):
    mit = next(" ".join(t.words) for t in ls.TEMPLATES if t.label == "mit" and len(t.words) > 50)
    edited = mit.replace("copies of the software", "some copies of our software").replace("merge publish", "publish")
    got = ls.scan_licenses(spark.createDataFrame([(1, edited), (2, mit.replace("hereby granted", "now given"))], "doc_id long, text string")).orderBy("doc_id").collect()
    long = [m for m in got[0].matches if m.label == "mit" and 0.9 < m.score < 1]
    assert long and not [m for m in got[1].matches if m.label == "mit"]


def test_openings_and_bare_mentions(spark):
    rows = {
        "": ["unlike the mozilla public license it is fine", "we read the GNU Lesser General Public License and the Eclipse Public License", "the zlib license, the artistic license", "cc by hand"],
        "gpl-3": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."],
        "lgpl": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU Lesser General Public License, version 3"],
        "mpl-2": ["Mozilla Public License Version 2.0 1. Definitions"],
        "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "(licensed under CC-BY 4.0)"],
        "cc-by-sa": ["licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
        "boost-1": ["// Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"],
        "zlib": [ls._ZLIB, ls._ZLIB.replace("an acknowledgment in the product documentation would be appreciated", "thanks would be nice")],
        "bsd": [ls._BSD.format(ls._ENDORSE), ls._BSD.format("").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS")],
    }
    flat = [(label, text) for label, texts in rows.items() for text in texts]
    filler = [(1000 + i, "the software is under this license of the public and the work") for i in range(40)]
    got = ls.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(flat)] + filler, "doc_id long, text string"))
    labels = {r.doc_id: ",".join(sorted({m.label for m in r.matches})) for r in got.collect()}
    assert [(labels[i], t) for i, (_, t) in enumerate(flat)] == flat
    assert len({t.label for t in ls.TEMPLATES}) >= 20


def test_document_frequency_counts_rows(spark):
    df = spark.createDataFrame([("mit mit",), ("MIT!",), (None,), ("x",)], "text string")
    assert ls.document_frequency(df, {"mit", "gnu"}) == (4, {"mit": 2})


def test_empty_table(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
