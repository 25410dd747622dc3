"""Plain Python against native expressions, the view for SQL, the trace, and the command line."""

import random

from siftline.__main__ import main
from siftline.operators import recognizers as rec
from siftline.operators import tagger
from siftline.operators.suppress import Rule, Rules
from siftline.plans import fixtures
from siftline.plans.scan import Options, findings, findings_view, scan, trace
from tests import plain
from tests.test_recognizers import ACCEPT, REJECT


def texts():
    rng = random.Random(8)
    words = [t for _, t, _ in ACCEPT] + [t for _, t in REJECT] + ["phone:", "ssn", "password", "=", ":", "@", ".", "-", "+1", "é", "日", "\n", "\r\n", " ", " ", "12", "345", "6789", "http://", "a.b", "::", "1.2", "/", "'", '"', "x" * 4]
    out = fixtures.texts() + [t for _, t, _ in ACCEPT] + [t for _, t in REJECT]
    return out + ["".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(400)]


def test_native_and_plain_agree(spark):
    rows = [(str(i), t) for i, t in enumerate(texts())]
    got: dict[str, list] = {}
    for r in findings(scan(spark.createDataFrame(rows, "file string, text string"))).collect():
        got.setdefault(r.file, []).append((r.line_num, r.col_start, r.col_end, r.entity_type, r.text, round(r.score, 4)))
    for file, text in rows:
        want = [(*f[:5], round(f[5], 4)) for f in plain.find(text)]
        assert sorted(got.get(file, [])) == sorted(want), text


def test_view_for_sql(spark):
    spark.createDataFrame([(1, "x a@b.org\n8.8.8.8"), (2, None)], "id int, body string").createOrReplaceTempView("bodies")
    findings_view(spark, "found_in_bodies", "bodies", "id", "body")
    got = spark.sql("SELECT b.id, f.* FROM bodies b JOIN found_in_bodies f ON f.file = b.id ORDER BY line_num").collect()
    assert [(r.id, r.line_num, r.col_start, r.entity_type) for r in got] == [(1, 1, 2, "EMAIL_ADDRESS"), (1, 2, 0, "IP_ADDRESS")]


def test_table_function_for_sql(spark):
    from siftline.plans.scan import scan_function

    texts = fixtures.texts()
    spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)] + [("none", None), ("blank", " ")], "file string, body string").createOrReplaceTempView("bodies")
    for o in (Options(), Options(rules=Rules((Rule(entity_type="URL"), Rule(match="^a")), {"EMAIL_ADDRESS": False, "SECRET_HEX_HIGH_ENTROPY": True}))):
        scan_function(spark, "found_in", o)
        got = spark.sql("SELECT file, f.* FROM bodies, LATERAL found_in(body) f").collect()
        want = findings(scan(spark.table("bodies"), "file", "body", o)).drop("line_content").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 30


def test_trace(spark):
    docs = spark.createDataFrame([("f", "a@b.org c@b.org http://x.org/ AB1234567")], "file string, text string")
    o = Options(recognizers=rec.by_entity("EMAIL_ADDRESS", "URL", "US_DRIVER_LICENSE"), rules=Rules((Rule(text="a@b.org"),), {"URL": 0.9}))
    got = {r.text: (r.tier, r.decision) for r in trace(docs, options=o).collect()}
    assert got == {"a@b.org": ("strict", "suppressed"), "c@b.org": ("strict", "kept"), "http://x.org/": ("strict", "flagged off"), "AB1234567": ("broad", "awaits a tag")}


def test_zero_shot_tagger(spark):
    def load():
        return lambda lines, labels: [[(0, 4, "person", 0.9), (0, 2, "person", 0.2), (1, 2, "animal", 0.9), (3, 99, "location", 0.9)] for _ in lines]

    docs = spark.createDataFrame([("f", "Anna\nab\n" + "x" * 2001)], "file string, text string")
    got = findings(scan(docs, options=Options(recognizers=()), tagger=tagger.zero_shot_tagger(load), confirm=False)).collect()
    assert [(r.line_num, r.entity_type, r.text) for r in got] == [(1, "PERSON", "Anna")]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.txt").write_text("mail a@b.org")
    (tmp_path / "b.txt").write_text("clean")
    assert main(["."], spark) == 1
    assert capsys.readouterr().out.splitlines() == ["./a.txt: 1 finding", "./b.txt: ok", './a.txt:1:6: EMAIL_ADDRESS (score: 1.00) "a@b.org"']
    assert main(["--format", "github", "--entities", "url", "-v"], spark) == 0
    assert "kept" in capsys.readouterr().err
    (tmp_path / "list").write_text("b.txt\n\npic.png\n")
    assert main(["--changed", "list", "--only-issues"], spark) == 0
    assert main(["--fix-accept-all", "a.txt"], spark) == 1
    assert (tmp_path / ".baselines" / "phi.toml").exists() and main(["a.txt"], spark) == 0
    assert main(["format"], spark) == 0
    (tmp_path / "old.yaml").write_text("ignored:\n  a.txt:\n    type: file\n")
    assert main(["migrate", "old.yaml", "new.toml"], spark) == 0 and main(["--baselines", "new.toml", "a.txt"], spark) == 0
    (tmp_path / "bad.toml").write_text("[[ignored]]\nx = 1\n")
    assert main(["--baselines", "bad.toml", "a.txt"], spark) == 2
    assert main(["--model", "tagger", "a.txt"], spark) == 2


def test_pictures_and_counts_on_the_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.txt").write_text("one\nmail a@b.org\nthree")
    assert main(["--format", "tui", "--debug", "a.txt"], spark) == 1
    said = capsys.readouterr()
    assert "│ mail a@b.org" in said.out and "└── EMAIL_ADDRESS (σ 1.0)" in said.out and "files_scanned: 1" in said.err
    (tmp_path / "my_model.py").write_text("def load():\n    return lambda lines, labels: [[(0, 4, 'person', 0.6)] for _ in lines]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    for least, n in (("0.5", 1), ("0.7", 0)):
        assert main(["--model", "tagger", "--zero-shot", "my_model:load", "--threshold", least, "--format", "github", "a.txt"], spark) == n
    assert main(["--model", "tagger", "--zero-shot", "no_such:load", "a.txt"], spark) == 2
