"""Guards, flags, counts, taggers, dedupe, plans."""

import pytest
from pyspark.sql import functions as F
from siftline.operators import recognizers as rec
from siftline.operators import tagger
from siftline.operators.suppress import Rule, Rules
from siftline.plans import fixtures
from siftline.plans.scan import Options, findings, places, scan

MAIL = rec.by_entity("EMAIL_ADDRESS", "URL")


def docs(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")


def test_blank_null_and_long_texts_are_skipped(spark):
    fits, over = "a@b.org " + "x" * 999_992, "a@b.org " + "x" * 999_993
    for most, n in ((1_000_000, 0), (None, 1)):
        out = scan(docs(spark, None, "", " \u00a0\n\t", fits, over), options=Options(recognizers=MAIL, max_bytes=most)).orderBy("file").collect()
        assert [r.skipped for r in out] == [True, True, True, False, not n]
        assert [len(r.findings) for r in out] == [0, 0, 0, 1, n]


def test_registered_queries_scan_texts_above_the_limit_of_files(spark, tmp_path):
    from siftline.plans.queries import QUERIES

    text = "word " * 240_000 + "\na@b.org"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "", text)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([("c", 0, "user", text)], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, file in (("email_address_findings", "1"), ("stream_findings", "1"), ("page_findings", "1"), ("chat_findings", "c:0")):
        rows = QUERIES[name](spark, str(tmp_path)).filter(F.col("file") == file).collect()
        got = [(r.entity_type, r.text) for r in rows if name != "chat_findings" or r.line_num <= 2]  # its turns go on below
        assert got == [("EMAIL_ADDRESS", "a@b.org")], name
    for name in ("documents_by_type", "scan_defaults"):
        assert [(r.entity_type, r.n) for r in QUERIES[name](spark, str(tmp_path)).collect()] == [("EMAIL_ADDRESS", 1)], name
    assert [(r.n, r.skipped) for r in QUERIES["ignored_counts"](spark, str(tmp_path)).filter("file = '1'").collect()] == [(1, False)]


def test_opt_in_needs_a_flag(spark):
    text = f"'{'0a1b2c3d4e5f6789' * 2}'"
    for flags, n in (({}, 0), ({"SECRET_HEX_HIGH_ENTROPY": True}, 1), ({"SECRET_HEX_HIGH_ENTROPY": 0.4}, 1), ({"SECRET_HEX_HIGH_ENTROPY": 0.9}, 0), ({"SECRET_HEX_HIGH_ENTROPY": False}, 0)):
        o = Options(recognizers=rec.by_entity("SECRET_HEX_HIGH_ENTROPY"), rules=Rules(flags=flags))
        assert findings(scan(docs(spark, text), options=o)).count() == n


def test_a_flag_switches_a_recognizer_off_before_it_runs():
    o = Options(rules=Rules(flags={"EMAIL_ADDRESS": False, "US_PHONE": False}))
    names = [r.entity for r in o.enabled(rec.STRICT)]
    assert "EMAIL_ADDRESS" not in names and "PHONE_NUMBER" in names


def test_counts_of_ignored(spark):
    text = "a@b.org c@d.org http://x.org/ http://y.org/"
    rules = Rules((Rule(entity_type="EMAIL_ADDRESS", text="a@b.org"),), {})
    out = scan(docs(spark, text), options=Options(recognizers=MAIL, rules=rules, entities=("email_address",))).first()
    assert [f.text for f in out.findings] == ["c@d.org"] and out.ignored_count == 3
    flagged = scan(docs(spark, text), options=Options(recognizers=MAIL, rules=Rules(flags={"URL": 0.9}))).first()
    assert len(flagged.findings) == 2 and flagged.ignored_count == 0  # what a flag drops isn't counted


def test_dedupe_keeps_the_highest_score_and_all_types(spark):
    p = r"\b[A-Z]\d{6}\b"
    r = tuple(rec.plain(e, p, score=s) for e, s in (("A", 0.2), ("A", 0.9), ("B", 0.5), ("A", 0.4)))
    got = findings(scan(docs(spark, "x Z123456"), options=Options(recognizers=r))).collect()
    assert [(f.entity_type, round(f.score, 1)) for f in got] == [("A", 0.9), ("B", 0.5)]


TAGGED = "AB1234567 then C12345678\nno shapes\nQ7654321 a@b.org"


def tags(spark, rows):
    return tagger.table_tagger(spark.createDataFrame([("f0", *r) for r in rows], tagger.TAGS))


def test_tags_confirm_by_line_type_and_overlap(spark):
    o = Options(recognizers=rec.by_entity("US_DRIVER_LICENSE", "US_PASSPORT", "EMAIL_ADDRESS"))
    at = lambda *rows: sorted((f.line_num, f.entity_type) for f in findings(scan(docs(spark, TAGGED), options=o, tagger=tags(spark, rows))).collect())
    mail = (3, "EMAIL_ADDRESS")
    assert at((1, 8, 12, "US_DRIVER_LICENSE", "7 t", 0.9)) == [(1, "US_DRIVER_LICENSE"), mail]
    assert at((1, 9, 12, "US_DRIVER_LICENSE", " th", 0.9)) == [mail]  # touching is no overlap
    assert at((1, 0, 9, "US_PASSPORT", "AB1234567", 0.9), (2, 0, 9, "US_DRIVER_LICENSE", "no shapes", 0.9), (3, 9, 16, "PERSON", "a@b.org", 0.9)) == [(1, "US_PASSPORT"), mail]


def test_thresholds_bind_the_tag_not_the_candidate(spark):
    for score, n in ((0.6, 1), (0.8, 2)):
        o = Options(recognizers=rec.by_entity("US_DRIVER_LICENSE", "EMAIL_ADDRESS"), rules=Rules(flags={"US_DRIVER_LICENSE": 0.7}))
        got = findings(scan(docs(spark, TAGGED), options=o, tagger=tags(spark, [(1, 0, 9, "US_DRIVER_LICENSE", "AB1234567", score)]))).collect()
        assert len(got) == n and all(f.score == 0.5 for f in got if f.entity_type == "US_DRIVER_LICENSE")


def test_only_lines_with_candidates_are_tagged(spark):
    seen = lambda lines: lines.select("file", "line_num", F.lit(0).alias("col_start"), F.lit(2).alias("col_end"), F.lit("PERSON").alias("entity_type"), F.col("line_content").alias("text"), F.lit(0.9).cast("float").alias("score"))
    o = Options(recognizers=rec.by_entity("US_DRIVER_LICENSE", "EMAIL_ADDRESS"), rules=Rules((Rule(entity_type="PERSON"),)))
    for confirm, n in ((True, 2), (False, 3)):
        assert scan(docs(spark, TAGGED), options=o, tagger=seen, confirm=confirm).first().ignored_count == n


def test_label_decoding():
    d = tagger.decode_labels
    assert d("O B-PER I-PER O I-LOC I-ORG B-ORG".split()) == [(1, 2, "PER"), (4, 4, "LOC"), (5, 5, "ORG"), (6, 6, "ORG")]
    assert d("U-PER B-LOC L-LOC L-ORG I-PER L-PER".split()) == [(0, 0, "PER"), (1, 2, "LOC"), (3, 3, "ORG"), (4, 5, "PER")]
    assert d([]) == [] and d(["B-PER"]) == [(0, 0, "PER")]


def test_spans_to_tags_shift_by_the_indent():
    line = "  \u00e9 Anna B"
    offsets = [(0, 2), (3, 7), (8, 9)]
    assert tagger.spans_to_tags(line, [(1, 2, "PER"), (0, 0, "MISC"), (2, 2, "LOC")], offsets) == [(5, 11, "PERSON", "Anna B", 0.85)]


def test_model_tagger_batches_and_survives_failures(spark):
    def load():
        def predict(lines):
            if any("bad" in x for x in lines):
                raise ValueError("no")
            return [[(0, 2, "PERSON", x[:2], 0.9), (0, 1, "PERSON", x[:1], 0.1)] for x in lines]

        return predict

    t = tagger.model_tagger(load, batch=1, threshold=0.5)
    got = findings(scan(docs(spark, "Anna\nbad\nab\nBob Lee"), options=Options(recognizers=()), tagger=t, confirm=False)).collect()
    assert [(f.line_num, f.text) for f in got] == [(1, "An"), (4, "Bo")]


def test_the_scan_has_no_shuffle_and_no_python(spark):
    plan = findings(scan(docs(spark, "a@b.org")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapInArrow" not in plan


def test_columns_that_clash_and_other_ids(spark):
    df = spark.createDataFrame([(7, "a@b.org", "x", 1)], "doc_id long, body string, text string, findings int")
    got = findings(scan(df, "doc_id", "body", Options(recognizers=MAIL))).collect()
    assert [(f.file, f.text) for f in got] == [("7", "a@b.org")]


def test_empty_table(spark):
    assert scan(docs(spark, "x").limit(0)).count() == 0


def test_fixtures_hold_no_credential_literal():
    source = open(fixtures.__file__, encoding="utf-8").read()
    assert "AKIA" not in source.replace('"AK" + "IA"', "") and "ghp_" not in source


@pytest.mark.parametrize("name", ["UNKNOWN"])
def test_unknown_entities_are_refused(name):
    with pytest.raises(ValueError):
        rec.by_entity(name)


def test_texts_that_hold_the_marks_of_matches(spark):
    """A pattern runs once on a text and marks its matches there; texts that hold such marks have the same findings."""
    texts = ["a@b.org\nx http://h.org/p 8.8.8.8 c@d.org", "a@b.org \x01c@d.org\x01 \n\x01password = \"hunter2real\"", "\x02key: 1::8\x02 secret: abcdefgh http://h.org/\x02a", "password=abcd1234, secret: 'it\nis'\x01"]
    docs = spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)] + [(f"{k}, other", x.replace("\x01", "\x03").replace("\x02", "\x04")) for k, x in enumerate(texts)], "file string, text string")
    out = places(scan(docs))
    rows = sorted((r.file, r.line_num, r.col_start, r.col_end, r.entity_type, r.score, r.text.replace("\x03", "\x01").replace("\x04", "\x02")) for r in out.collect())
    plain, other = [r for r in rows if "," not in r[0]], [(r[0].split(",")[0], *r[1:]) for r in rows if "," in r[0]]
    assert plain == other and len(plain) >= 10
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" in plan and "array_sort" not in plan
