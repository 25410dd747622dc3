"""Rules as a table mean what the same rules mean as predicates; interval joins against loops; long lines."""

import random
import time

import pytest
from pyspark.sql import functions as F
from siftline.functions import text as t
from siftline.operators import recognizers as rec
from siftline.operators.overlap import overlapping
from siftline.operators.rule_table import RANGE_LINES, RULES, RuleTable, ignored_by_file, without_skipped, without_suppressed
from siftline.operators.suppress import Rule, Rules, is_file_skipped, is_suppressed
from siftline.plans.scan import Options, findings, places, scan
from siftline.schema import FINDINGS, FOUND_COLUMNS, RULE_FIELDS


def table(spark, rules):
    return spark.createDataFrame([tuple(getattr(r, n) for n in RULE_FIELDS) for r in rules], RULES)


def found(spark):
    texts = ["a@b.org", "A@B.org", "x", "http://h.org/a", "8.8.8.8", "é@é.fr", "we[i]rd"]
    files = ["a.py", "./d/f.py", "d/e/g.py", "h[1].x", "/abs/k", "d//z"]
    kinds = ["EMAIL_ADDRESS", "URL", "IP_ADDRESS"]
    rows = [(f, n, 3, 9, k, x, 1.0, x) for f in files for n in (1, 2, 40, 700) for k in kinds for x in texts]
    return spark.createDataFrame(rows, FINDINGS)


RULE_SETS = [
    (Rule(entity_type="URL"), Rule(text="A@b.ORG", path="d/f.py"), Rule(text="X", ignorecase=False), Rule(text="x", ignorecase=False, path="./a.py")),
    (Rule(path="d/**", entity_type="EMAIL_ADDRESS"), Rule(path="h[1].x", text="x"), Rule(path="a.py", line="1,40..41")),
    (Rule(path="**", text="8.8.8.8"), Rule(path="d/**", line=f"2..{RANGE_LINES + 9}"), Rule(scope="file", text="x"), Rule(scope="global", path="zzz", text="é@É.fr")),
    (Rule(entity_type="EMAIL_ADDRESS", text="@b.org"), Rule(match="^h"), Rule(text="we[i]rd", textglob=False), Rule(path="/abs/**")),
    (Rule(type="file", path="a.py"), Rule(type="file", path="d/**"), Rule(type="file", path="h*"), Rule(type="file")),
    (Rule(scope="line", path="a.py"), Rule(scope="odd", path="a.py", line=" 2 , ,"), Rule(line="1"), Rule(path="d//**", text="x")),
    (),
]


@pytest.mark.parametrize("rules", RULE_SETS)
def test_as_predicates_say(spark, rules):
    df = found(spark)
    say = is_suppressed(F.col("file"), F.struct(*FOUND_COLUMNS), Rules(rules))
    rows = table(spark, [*rules, *rules]) if rules else spark.createDataFrame([], RULES)
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(RuleTable(rows).suppressed(df)) == key(df.withColumn("suppressed", say))
    assert key(without_skipped(df, rows)) == key(df.filter(~is_file_skipped(F.col("file"), Rules(rules))))


def test_bad_rules_are_errors(spark):
    for bad in ((None, None, None, "a", "5..2", None, None, None, None), (None, None, None, "a", "x", None, None, None, None), (None, None, None, None, None, "t", None, None, "m")):
        with pytest.raises(Exception, match="no line numbers|both"):
            without_suppressed(found(spark), spark.createDataFrame([bad], RULES)).collect()


def test_the_plan_does_not_grow_with_the_rules(spark):
    size = lambda n: len(without_suppressed(found(spark), spark.range(n).select(F.lit("URL").alias("entity_type"), F.concat(F.lit("f"), "id").alias("path"), F.lit("x").alias("text")))._jdf.queryExecution().analyzed().toString())
    assert abs(size(10) - size(100_000)) < 600
    many = spark.range(100_000).select(F.lit("IP_ADDRESS").alias("entity_type"), F.when(F.col("id") == 77, "a.py").otherwise(F.concat(F.lit("f"), "id")).alias("path"), F.lit("other").alias("id"))
    got = {r.file: (r.kept, r.ignored) for r in ignored_by_file(found(spark), many).collect()}
    assert got["a.py"] == (56, 28) and got["d//z"] == (84, 0)


def test_no_findings_and_one_hot_rule(spark):
    assert without_suppressed(found(spark).limit(0), table(spark, RULE_SETS[0])).count() == 0
    hot = table(spark, [Rule(entity_type="URL", text="x", path="a.py", line=str(n % 3)) for n in range(3000)])
    assert without_suppressed(found(spark), hot).count() == found(spark).count() - 2


def test_lines_that_share_a_key(spark):
    """A hundred rules of a file are few keys, and each still means its own line."""
    lines = [0, 1, 62, 63, 64, 65, 127, 128, *range(300, 392), 2**31 - 1]
    rules = (*(Rule(entity_type="URL", path=p, line=str(n)) for p in ("a.py", "d/**") for n in lines), Rule(path="d//z", line=" 126 .. 129 ,+5"))
    df = spark.createDataFrame([(f, n, 3, 9, k, "x", 1.0, "x") for f in ("a.py", "d/f.py", "d//z", "b") for n in (1, 2, 5, 61, 62, 63, 64, 66, 126, 127, 128, 129, 130, 299, 300, 391, 392, 2**31 - 1) for k in ("URL", "US_SSN")], FINDINGS)
    say = is_suppressed(F.col("file"), F.struct(*FOUND_COLUMNS), Rules(rules))
    made = RuleTable(table(spark, rules))
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(made.suppressed(df)) == key(df.withColumn("suppressed", say))
    assert made.keys.count() == 2 * 7 + 3


def test_findings_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = found(spark)
    counted = df.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(df.schema)
    assert without_suppressed(counted, table(spark, RULE_SETS[0])).count() and seen.value == df.count()


def test_overlaps_against_loops(spark):
    rng = random.Random(1)
    make = lambda n, wide: [(f"f{rng.randrange(2)}", rng.randrange(3), s, s + rng.randrange(wide), rng.choice("AB"), k) for k, s in enumerate(rng.randrange(400) for _ in range(n))]
    a, b = make(200, 90), make(60, 12)
    kind = "file string, line_num int, col_start int, col_end int, entity_type string, k int"
    got = overlapping(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind).drop("k"), ["file", "line_num", "entity_type"], width=16)
    want = [x for x in a if any((x[0], x[1], x[4]) == (y[0], y[1], y[4]) and x[2] < y[3] and y[2] < x[3] for y in b)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_line_of_many_spans(spark):
    """100,000 spans on one line and as many tags that touch every other one: no task sees all of them."""
    spans = spark.range(100_000).select(F.lit("f").alias("file"), F.lit(1).alias("line_num"), (F.col("id") * 10).alias("col_start"), (F.col("id") * 10 + 4).alias("col_end"), F.lit("T").alias("entity_type"))
    tags = spark.range(100_000).select(F.lit("f").alias("file"), F.lit(1).alias("line_num"), (F.col("id") * 10 + F.when(F.col("id") % 2 == 0, 3).otherwise(4)).alias("col_start"), (F.col("id") * 10 + 6).alias("col_end"), F.lit("T").alias("entity_type"))
    began, out = time.time(), overlapping(spans, tags, ["file", "line_num", "entity_type"])
    assert out.count() == 50_000 and time.time() - began < 60
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_megabyte_of_addresses_on_one_line(spark):
    text = "".join(f"user{k % 90 + 10}@xy.org " for k in range(60_000))
    docs = spark.createDataFrame([("one", "first\n" + text + "\nlast")], "file string, text string")
    out = scan(docs, options=Options(recognizers=rec.by_entity("EMAIL_ADDRESS")))
    rows = places(out).agg(F.count("*"), F.min("col_start"), F.max("col_end"), F.min("line_num"), F.max("line_num")).first()
    assert tuple(rows) == (60_000, 0, len(text) - 1, 2, 2)
    sums = findings(out).filter("col_start % 1700 = 0").agg(F.count("*"), F.min(F.length("line_content"))).first()
    assert tuple(sums) == (71, len(text))


def test_lines_between_findings_are_null(spark):
    df = spark.createDataFrame([("a\nb\nc\nd",)], "text string")
    got = df.select(t.lines_at(F.col("text"), F.array(F.lit(2), F.lit(4))).alias("x"), t.lines_at(F.col("text"), F.array().cast("array<int>")).alias("y")).first()
    assert got.x == [None, "b", None, "d"] and got.y == []
