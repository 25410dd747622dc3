"""Files in, reports out, and streams."""

import os

from pyspark.sql import functions as F
from siftline.functions.text import glob_to_regex  # noqa: F401
from siftline.operators import recognizers as rec
from siftline.operators.suppress import Rule, Rules
from siftline.plans.scan import Options, findings, scan
from siftline.sinks import report
from siftline.sources import files
from siftline.sources import rules as io
from siftline.streaming import triage

MAIL = Options(recognizers=rec.by_entity("EMAIL_ADDRESS", "URL"))


def tree(root):
    make = {
        "a.py": "x = 'a@b.org'",
        "pkg/__init__.py": "m = 'init@b.org'",
        ".env": "MAIL env@b.org",
        ".github/ci.yml": "ci@b.org",
        "_under.txt": "under@b.org",
        "node_modules/x.js": "no@b.org",
        "pic.PNG": "no@b.org",
        ".png": "dot@b.org",
        "logs/keep.log": "keep@b.org",
        "logs/drop.log": "no@b.org",
        "deep/ignored/x.txt": "no@b.org",
        "deep/x.tmp": "no@b.org",
        "deep/y.tmp": "y@b.org",
        "build": "no@b.org",
        ".gitignore": "*.log\n!logs/keep.log\nignored/\n# comment\n",
        "deep/.gitignore": "/x.tmp\n",
        "empty.txt": "",
        "bad.txt": b"\xf0\x90\x8d \xc0\xaf bad@b.org",
    }
    for name, text in make.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_walk_and_read(spark, tmp_path):
    tree(tmp_path)
    names = {os.path.relpath(p, tmp_path) for p in files.walk([tmp_path])}
    want = {"a.py", "pkg/__init__.py", ".env", ".github/ci.yml", "_under.txt", ".png", "logs/keep.log", "deep/y.tmp", ".gitignore", "deep/.gitignore", "empty.txt", "bad.txt"}
    assert names == want
    assert not any(os.path.relpath(p, tmp_path).startswith(".") for p in files.walk([tmp_path], include_hidden=False))
    rules = Rules((Rule(type="file", path=f"{tmp_path}/a*"),))
    texts = {os.path.relpath(r.file, tmp_path): r.text for r in files.source_tree(spark, [tmp_path], rules).collect()}
    assert texts["a.py"] is None and texts["empty.txt"] is None and texts[".env"] == "MAIL env@b.org"
    assert texts["bad.txt"] == "� �� bad@b.org"
    found = findings(scan(files.source_tree(spark, [tmp_path]), options=MAIL))
    assert {r.text for r in found.collect()} == {f"{x}@b.org" for x in ("a", "init", "env", "ci", "under", "dot", "keep", "y", "bad")}
    gone = files.read_files(spark, [str(tmp_path / "none.txt")]).first()
    assert gone.text is None


def test_lake_files(spark, tmp_path):
    tree(tmp_path)
    (tmp_path / "big.txt").write_text("big@b.org " * 200_000)
    df = files.lake_files(spark, f"file://{tmp_path}")
    names = {os.path.relpath(r.file.removeprefix("file:"), tmp_path) for r in df.collect()}
    assert "a.py" in names and "pic.PNG" not in names and "node_modules/x.js" not in names and "big.txt" not in names and "empty.txt" not in names
    assert "PushedFilters: [GreaterThanOrEqual(length,1)" in df._jdf.queryExecution().toString() or "length" in df._jdf.queryExecution().executedPlan().toString()


def test_only_changed(spark):
    all_files = spark.createDataFrame([("a.py", "x"), ("b.py", "y"), ("c.png", "z")], "file string, text string")
    changed = spark.createDataFrame([("a.py",), ("a.py",), ("",), ("c.png",), ("gone.py",)], "file string")
    assert [r.file for r in files.only_changed(all_files, changed).collect()] == ["a.py"]


def found_table(spark):
    docs = spark.createDataFrame([("d/f.py", "one\ntwo\nthree\nx a@b.org \"q\" a@b.org\nfive"), ("g.py", "http://x.org/a\\b"), ("h.py", "clean"), ("i.py", None)], "file string, text string")
    return docs, scan(docs, options=MAIL)


def test_lines(spark):
    _, out = found_table(spark)
    found = findings(out).orderBy("file", "col_start")
    assert [r.value for r in report.plain_lines(found).collect()] == ['d/f.py:4:3: EMAIL_ADDRESS (score: 1.00) "a@b.org"', 'd/f.py:4:15: EMAIL_ADDRESS (score: 1.00) "a@b.org"', 'g.py:1:1: URL (score: 0.60) "http://x.org/a\\\\b"']
    assert report.annotations(found).first().value == '::error file=d/f.py,line=4,col=3,endColumn=10,title=PHI/PII (EMAIL_ADDRESS)::Found EMAIL_ADDRESS with score 1.00: "a@b.org"'
    assert {r.value for r in report.status_lines(out).collect()} == {"d/f.py: 2 findings", "g.py: 1 finding", "h.py: ok"}
    assert {r.value for r in report.status_lines(out, only_issues=True).collect()} == {"d/f.py: 2 findings", "g.py: 1 finding"}
    assert tuple(report.totals(out).first()) == (3, 1, 3, 0)
    assert report.exit_code(out) == 1 and report.exit_code(out.filter("file = 'h.py'")) == 0
    assert tuple(report.totals(out.limit(0)).first()) == (0, 0, 0, 0)


def test_context(spark):
    docs, out = found_table(spark)
    r = report.with_context(findings(out), docs).filter("file = 'd/f.py'").first()
    assert (r.context_before, r.context_after) == (["one", "two", "three"], ["five"])
    r = report.with_context(findings(out), docs, 1).filter("file = 'd/f.py'").first()
    assert (r.context_before, r.context_after) == (["three"], ["five"])
    r = report.with_context(findings(out), docs, 0).filter("file = 'g.py'").first()
    assert (r.context_before, r.context_after) == ([], [])


def test_rules_from_findings_silence_them(spark):
    docs, out = found_table(spark)
    for kind in ("line", "file", "folder", "global"):
        rows = report.rule_rows(findings(out), kind).collect()
        assert len(rows) == 2
        rules = Rules(tuple(Rule(**{k: v for k, v in r.asDict().items() if v is not None}) for r in rows))
        assert report.exit_code(scan(docs, options=Options(recognizers=MAIL.recognizers, rules=rules))) == 0
    assert [r.text for r in report.rule_rows(findings(out), "host").collect()] == ["*.x.org"]
    odd = spark.createDataFrame([("pages/[id].x", "a?*@b.org x@[b.org a*b@c.org")], "file string, text string")
    rules = Rules(tuple(report.accept_all(findings(scan(odd, options=MAIL)))))
    assert rules.rules and report.exit_code(scan(odd, options=Options(recognizers=MAIL.recognizers, rules=rules))) == 0


def test_new_since(spark):
    _, out = found_table(spark)
    found = findings(out)
    assert report.new_since(found, found).count() == 0 and report.new_since(found, found.filter("entity_type = 'URL'")).count() == 2


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("a@b.org and a@b.org")
    (src / "b.png").write_text("no@b.org")
    rules = str(tmp_path / "rules.toml")
    got: list = []
    keep = lambda out, n: got.extend(r.text for r in findings(out).collect())
    run = lambda: triage.triage(triage.file_stream(spark, f"file://{src}"), f"file://{tmp_path}/state", rules, keep, accept=True, options=MAIL).awaitTermination()
    run()
    assert got == ["a@b.org", "a@b.org"] and [r.text for r in io.load_rules(rules).rules] == ["a@b.org"]
    got.clear()
    (src / "c.txt").write_text("c@b.org")
    run()
    assert got == ["c@b.org"] and len(io.load_rules(rules).rules) == 2
    got.clear()
    open(rules, "w").write("[[ignored]]\nnonsense = 1\n")
    (src / "d.txt").write_text("d@b.org")
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        run()
    assert got == ["d@b.org"]


def test_first_seen_and_windows(spark, tmp_path):
    rows = [("f", "a@b.org", "2024-01-01 00:01:00"), ("f", "a@b.org", "2024-01-01 00:02:00"), ("g", "a@b.org", "2024-01-01 00:12:00")]
    spark.createDataFrame(rows, "file string, text string, ts string").selectExpr("file", "text", "cast(ts as timestamp) ts").write.parquet(f"{tmp_path}/in")
    schema = "file string, text string, ts timestamp"
    docs = triage.table_stream(spark, f"{tmp_path}/in", schema)
    found = docs.select(F.col("file"), F.lit("EMAIL_ADDRESS").alias("entity_type"), "text", "ts")
    for k, (df, n) in enumerate(((triage.first_seen(found), 2), (triage.first_seen(found, "ts"), 2), (triage.stream_findings(docs, options=MAIL), 3))):
        q = df.writeStream.format("memory").queryName(f"seen{k}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"seen{k}").count() == n
    q = triage.counts_by_window(found, "ts", "10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]
