"""Suppression, and rules files."""

import pytest
from pyspark.sql import functions as F
from siftline.functions.text import glob_to_regex, url_host
from siftline.operators.suppress import Rule, RuleError, Rules, is_file_skipped, is_suppressed, parse_lines
from siftline.sources import rules as io

M = "EMAIL_ADDRESS"
#: (rule, (file, line, type, text), suppressed)
CASES = [
    (Rule(text="Admin@Example.com"), ("f", 1, M, "admin@example.com"), True),
    (Rule(text="Admin@Example.com", ignorecase=False), ("f", 1, M, "admin@example.com"), False),
    (Rule(entity_type="URL", text="x"), ("f", 1, M, "x"), False),
    (Rule(entity_type="us_ssn"), ("f", 1, "US_SSN", "x"), False),
    (Rule(entity_type="US_SSN"), ("f", 1, "US_SSN", "x"), True),
    (Rule(text="@example.com"), ("f", 1, M, "u@EXAMPLE.com"), True),
    (Rule(text="@example.com"), ("f", 1, M, "u@sub.example.com"), False),
    (Rule(text="@example.com"), ("f", 1, "URL", "u@example.com"), False),
    (Rule(text="@*.local"), ("f", 1, M, "user@svc.local"), True),
    (Rule(text="@*.local"), ("f", 1, M, "user@local"), False),
    (Rule(text="admin@"), ("f", 1, M, "Admin@any.org"), True),
    (Rule(text="admin@"), ("f", 1, M, "xadmin@any.org"), False),
    (Rule(match="^test"), ("f", 1, "X", "TESTING"), True),
    (Rule(match="^test", ignorecase=False), ("f", 1, "X", "TESTING"), False),
    (Rule(match="est"), ("f", 1, "X", "testing"), True),
    (Rule(match=r"^\p{L}+@"), ("f", 1, "X", "é@x"), True),
    (Rule(match=r"(?P<n>user)@"), ("f", 1, "X", "user@x"), True),
    (Rule(match=r"^[[:alpha:]]+$"), ("f", 1, "X", "user"), True),
    (Rule(match=r"^[^[:digit:]]+$"), ("f", 1, "X", "user1"), False),
    (Rule(match=r"user(?=@)"), ("f", 1, "X", "user@x"), False),
    (Rule(match=r"(u)\1"), ("f", 1, "X", "uu"), False),
    (Rule(path="a/b.py", text="x"), ("./a/b.py", 1, "X", "x"), True),
    (Rule(path="./a/b.py", text="x"), ("a/b.py", 1, "X", "x"), True),
    (Rule(path="a/b.py", text="x"), ("c.py", 1, "X", "x"), False),
    (Rule(path="a/*.py"), ("a/deep/er/b.py", 1, "X", "x"), True),
    (Rule(path="**/test/**"), ("a/b/test/c/d.py", 1, "X", "x"), True),
    (Rule(path="**/test/**"), ("test/d.py", 1, "X", "x"), True),
    (Rule(path="**/test/**"), ("a/testing/d.py", 1, "X", "x"), False),
    (Rule(path="f", line="1,5,8..29"), ("f", 12, "X", "x"), True),
    (Rule(path="f", line="1,5,8..29"), ("f", 6, "X", "x"), False),
    (Rule(line="1"), ("f", 1, "X", "x"), False),
    (Rule(scope="file"), ("f", 1, "X", "x"), False),
    (Rule(scope="global", path="other"), ("f", 1, "X", "x"), True),
    (Rule(scope="nonsense", path="f"), ("f", 1, "X", "x"), True),
    (Rule(scope="line", path="f"), ("f", 1, "X", "x"), False),
    (Rule(text="foo*"), ("f", 1, "X", "FOObar"), True),
    (Rule(text="foo*", ignorecase=False), ("f", 1, "X", "FOObar"), False),
    (Rule(text="foo*", textglob=False), ("f", 1, "X", "foobar"), False),
    (Rule(text="foo*", textglob=False), ("f", 1, "X", "FOO*"), True),
    (Rule(text="fo?[a-c]"), ("f", 1, "X", "foob"), True),
    (Rule(text="fo[!a-c]"), ("f", 1, "X", "foa"), False),
    (Rule(text="a[b"), ("f", 1, "X", "A[B"), True),
    (Rule(text="*.github.com"), ("f", 1, "URL", "https://github.com/x"), True),
    (Rule(text="*.github.com"), ("f", 1, "URL", "https://u@API.github.com:80/x"), True),
    (Rule(text="*.github.com"), ("f", 1, "URL", "https://notgithub.com/x"), False),
    (Rule(text="*.github.com", textglob=False), ("f", 1, "URL", "https://api.github.com"), True),
    (Rule(text="*.github.com"), ("f", 1, "X", "https://api.github.com/x"), False),
    (Rule(type="file", path="f"), ("f", 1, "X", "x"), False),
    (Rule(entity_type="X", text="ÄB"), ("f", 1, "X", "äB"), False),
]


@pytest.fixture(scope="module")
def decisions(spark):
    rows = [(i, *f) for i, (_, f, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, file string, line_num int, entity_type string, text string")
    f = F.struct("line_num", "entity_type", "text")
    out = F.lit(False)
    for i, (r, _, _) in enumerate(CASES):
        out = F.when(F.col("i") == i, is_suppressed(F.col("file"), f, Rules((r,)))).otherwise(out)
    return {r.i: r.s for r in df.select("i", out.alias("s")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(decisions, i):
    assert decisions[i] == CASES[i][2], CASES[i]


def test_whole_files(spark):
    rules = Rules((Rule(type="file", path="./docs/*.md"), Rule(type="file", path="a.py"), Rule(path="b.py")))
    df = spark.createDataFrame([("docs/x.md",), ("./docs/y/z.md",), ("./a.py",), ("b.py",)], "f string")
    assert [r[0] for r in df.select(is_file_skipped(F.col("f"), rules)).collect()] == [True, True, True, False]


def test_line_specs():
    assert parse_lines(" 1, 5 ,8..29,") == [(1, 1), (5, 5), (8, 29)]
    for bad in ("", ",", "x", "5..2", "1..", "..", "-1", "1...3"):
        with pytest.raises(RuleError):
            parse_lines(bad)


def test_globs():
    assert glob_to_regex("[") is None and glob_to_regex("a**") is None and glob_to_regex("***") is None
    assert glob_to_regex("a.b") == "(?s)^a\\.b\\z"


def test_hosts(spark):
    rows = ["github.com", "https://github.com/foo", "https://user@github.com", "github.com:8080", "HTTPS://GitHub.com.", "https:///x", "a://b@c@d.org?x"]
    df = spark.createDataFrame([(x,) for x in rows], "u string")
    assert [r[0] for r in df.select(url_host(F.col("u"))).collect()] == ["github.com"] * 5 + [None, "d.org"]


TOML = """
[entities]
URL = false
IP_ADDRESS = 0.5

[[ignored]]
entity_type = "URL"
file = "b"
pattern = "x.*"

[[ignored]]
type = "file"
path = "z"

[[ignored]]
entity_type = "EMAIL_ADDRESS"
scope = "file"
path = "a"
text = "q\\"uo\\\\te"
"""


def test_toml_round_trip(tmp_path):
    rules = io.parse_toml(TOML)
    assert rules.flags == {"URL": False, "IP_ADDRESS": 0.5}
    path = str(tmp_path / "x" / "r.toml")
    io.save_rules(rules, path)
    back = io.load_rules(path)
    assert back.flags == rules.flags
    assert [r.type or r.entity_type for r in back.rules] == ["file", "EMAIL_ADDRESS", "URL"]
    assert back.rules[1].scope is None and back.rules[1].text == 'q"uo\\te' and back.rules[2].match == "x.*"
    first = open(path).read()
    io.format_rules(path)
    assert open(path).read() == first and "\n\n\n[[ignored]]" in first
    assert io.load_rules(str(tmp_path / "none.toml")) == Rules()


@pytest.mark.parametrize("text", ['[[ignored]]\nfoo = "x"', "[other]\n", '[[ignored]]\ntext = "a"\nmatch = "b"', '[[ignored]]\nline = "5..2"\npath = "x"', '[[ignored]]\npath = "a"\nfile = "b"', "[[ignored]]\ntext = 1", '[entities]\nA = "x"'])
def test_bad_rules_files(text):
    with pytest.raises(RuleError):
        io.parse_toml(text)


def test_a_pattern_that_cannot_be_read_drops_its_rule():
    with pytest.warns(UserWarning):
        assert Rules((Rule(match="("),)).matchers == ()
    with pytest.warns(UserWarning):
        Rules((Rule(),))


def test_yaml_and_migration(tmp_path):
    source, target = tmp_path / "phi.yaml", tmp_path / "out" / "phi.toml"
    source.write_text("ignored:\n  some/file.py:\n    type: file\n  k2:\n    file: a.py\n    line: 12\n    entity_type: URL\n    text: x\n  k1:\n    line: '3..4'\n    file: b.py\n")
    assert io.migrate(str(source), str(target)) == 3
    rules = io.load_rules(str(target)).rules
    assert {(r.type, r.path, r.line) for r in rules} == {("file", "some/file.py", None), (None, "a.py", "12"), (None, "b.py", "3..4")}
    assert set(io.load_rules(str(source)).rules) == set(rules)


def test_rules_path(tmp_path):
    base = tmp_path / ".baselines"
    assert io.rules_path("x.toml", str(tmp_path)) == "x.toml"
    assert io.rules_path(None, str(tmp_path)).endswith("phi.toml")
    base.mkdir()
    (base / "phi.yaml").write_text("")
    assert io.rules_path(None, str(tmp_path)).endswith("phi.yaml")
    (base / "phi.toml").write_text("")
    assert io.rules_path(None, str(tmp_path)).endswith("phi.toml")


def test_thousands_of_plain_rules(spark):
    made = [Rule(entity_type=M, path=f"./f{i}", text=f"U{i}@x.org") for i in range(3000)] + [Rule(entity_type="URL", text=f"http://h{i}.org/") for i in range(3000)]
    rows = [("f7", M, "u7@X.org", True), ("./f7", M, "u7@x.org", True), ("f8", M, "u7@x.org", False), ("f7", "URL", "u7@x.org", False), ("z", "URL", "HTTP://h2999.org/", True), ("z", "URL", "http://h3000.org/", False)]
    df = spark.createDataFrame(rows, "file string, entity_type string, text string, want boolean")
    f = F.struct(F.lit(1).alias("line_num"), "entity_type", "text")
    assert all(r.got == r.want for r in df.select("want", is_suppressed(F.col("file"), f, Rules(tuple(made))).alias("got")).collect())
