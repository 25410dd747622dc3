"""The registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators import recognizers as rec
from siftline.operators import rule_table, tagger
from siftline.operators.overlap import overlapping
from siftline.operators.suppress import Rule, Rules
from siftline.shared import shared_folder, written
from siftline.sinks import report
from siftline.sources import manifest
from siftline.streaming import triage

from . import fixtures, oracle
from .scan import Options, findings, places, scan, scan_function

COLUMNS = ["file", "line_num", "col_start", "col_end", "entity_type", "text", "score"]
#: All that runs by default but CRYPTO, which has queries of its own.
COMPARED = tuple(dict.fromkeys(r.entity for r in rec.DEFAULT if r.tier == rec.STRICT and r.entity != "CRYPTO"))
PERSONAL = ("EMAIL_ADDRESS", "CREDIT_CARD", "PHONE_NUMBER", "US_SSN", "IP_ADDRESS", "URL")


#: Bytes of a table, as its files are, up to which its rows may be dealt out anew for a costly scan.
DEALT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """A table. For a costly scan, a small one that comes in fewer splits than there are cores is dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if not costly or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > DEALT_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return table(spark, sf_dir, "documents", costly).select(F.col("doc_id").cast("string").alias("file"), "text")


def with_fixtures(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return documents(spark, sf_dir, costly).unionByName(spark.createDataFrame(fixtures.rows(), "file string, text string"))


def options(*entities: str, **more) -> Options:
    return Options(recognizers=rec.by_entity(*entities), **more)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _entity_query(entity: str) -> None:
    r = rec.by_entity(entity)
    flags = {entity: True} if r[0].tier == rec.OPT_IN else {}
    r = tuple(replace(x, tier=rec.STRICT) if x.tier == rec.BROAD else x for x in r)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return places(scan(with_fixtures(spark, sf_dir), options=Options(recognizers=r, rules=Rules(flags=flags)))).select(*COLUMNS)

    sql = f"SELECT {', '.join(COLUMNS)} FROM ({oracle.findings_sql(('CRYPTO_CHECKED' if entity == 'CRYPTO' else entity,), oracle.docs_sql())})"
    register(f"{entity.lower()}_findings", sql)(run)


for _e in dict.fromkeys(r.entity for r in rec.DEFAULT):
    _entity_query(_e)


ALL_SQL = oracle.findings_sql(COMPARED, oracle.docs_sql())
PERSONAL_SQL = oracle.findings_sql(PERSONAL, oracle.docs_sql())


@register("all_findings", f"SELECT * FROM ({ALL_SQL})")
def all_findings(spark, sf_dir):
    return findings(scan(with_fixtures(spark, sf_dir), options=options(*COMPARED)))


@register("documents_by_type", f"SELECT entity_type, count(*) AS n, count(DISTINCT file) AS n_files FROM ({oracle.findings_sql(COMPARED, oracle.docs_sql(False))}) GROUP BY entity_type")
def documents_by_type(spark, sf_dir):
    """The flagship: the whole default scan but CRYPTO over documents, by type."""
    found = places(scan(documents(spark, sf_dir, True), options=options(*COMPARED)))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


@register("scan_defaults", f"SELECT entity_type, count(*) AS n FROM ({oracle.findings_sql((*COMPARED, 'CRYPTO_CHECKED'), oracle.docs_sql(False))}) GROUP BY entity_type")
def scan_defaults(spark, sf_dir):
    """Every default recognizer over documents: counts by type."""
    return places(scan(documents(spark, sf_dir, True), options=Options())).groupBy("entity_type").agg(F.count("*").alias("n"))


@register("crypto_candidates", f"SELECT {', '.join(COLUMNS)} FROM ({oracle.entity_sql('CRYPTO', oracle.docs_sql())})")
def crypto_candidates(spark, sf_dir):
    r = rec.plain("CRYPTO", rec.CRYPTO)
    return places(scan(with_fixtures(spark, sf_dir), options=Options(recognizers=(r,)))).select(*COLUMNS)


@register("lateral_scan", f"SELECT d.doc_id, {', '.join('f.' + c for c in COLUMNS[1:])} FROM documents d JOIN ({oracle.findings_sql(COMPARED, oracle.docs_sql(False))}) f ON f.file = CAST(d.doc_id AS VARCHAR)")
def lateral_scan(spark, sf_dir):
    """The scan as a table function, in a query that SQL users write."""
    scan_function(spark, "siftline_scan", options(*COMPARED))
    table(spark, sf_dir, "documents").createOrReplaceTempView("siftline_documents")
    return spark.sql("SELECT d.doc_id, f.* FROM siftline_documents d, LATERAL siftline_scan(d.text) f")


#: What a backtracking matcher, or work that grows with the square of the matches, would not survive: unit, times, and what
#: stands before and after. `#` in a unit is the number of the repetition.
LONG_TEXTS = (
    ("a.", 50_000, "x@", "b"),
    ("ab.", 33_333, "see: ", "1/ http://a.bc/d"),
    ("1x.", 33_333, "at: ab.", " 8.8.8.8/"),
    ("a+", 50_000, "", " y@z.org"),
    ("a-", 50_000, "z: ", ".org/x c@d.org"),
    ("a@b-", 25_000, "", "c.org"),
    ("-secret", 14_000, "", "= abcdefgh"),
    ("eyJ-", 25_000, "", " ey" + "Ja.ey" + "Jb.c"),
    ("user#@example.com\n", 5_000, "", ""),
    ("10.0.0.# 1.2.3.4\n", 4_000, "", ""),
)
#: Documents that stand together on one line, and the addresses that follow them there.
ON_ONE_LINE, ADDRESSES = 64, 3_000
_TIMES = "(SELECT string_agg(replace({}, '#', CAST(i % 250 AS VARCHAR)), '' ORDER BY i) FROM range({}) r(i))"
_UNITS = ", ".join(f"({k}, {oracle.literal(first)} || {_TIMES.format(oracle.literal(unit), n)} || {oracle.literal(last)})" for k, (unit, n, first, last) in enumerate(LONG_TEXTS))
_LONG = f"""SELECT CAST(g AS VARCHAR) AS file, line || ' ' || (SELECT string_agg('u' || CAST(i % 250 AS VARCHAR) || '@x.org ', '' ORDER BY i) FROM range({ADDRESSES}) r(i)) || chr(10) || unit AS text
FROM (SELECT doc_id // {ON_ONE_LINE} AS g, string_agg(replace(text, chr(10), ' '), ' ' ORDER BY doc_id, text) AS line FROM documents GROUP BY 1) JOIN (VALUES {_UNITS}) u(k, unit) ON k = g % {len(LONG_TEXTS)}"""
_LONG_TYPES = ("EMAIL_ADDRESS", "URL", "IP_ADDRESS", "SECRET_JWT", "SECRET_KEYWORD_ASSIGNMENT")


@register("long_texts", f"SELECT file, line_num, col_start, col_end, entity_type, length(text) AS chars, score FROM ({oracle.findings_sql(_LONG_TYPES, _LONG)})")
def long_texts(spark, sf_dir):
    """All documents, 64 on a line, with thousands of addresses on the same line and a long run on the next."""
    laid = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / ON_ONE_LINE).alias("g")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
    line = F.array_join(F.transform("docs", lambda d: F.replace(d["text"], F.lit("\n"), F.lit(" "))), " ")
    times = lambda unit, n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.replace(unit, F.lit("#"), (i % 250).cast("string"))), "")
    kinds = F.array(*(F.struct(F.lit(u).alias("unit"), F.lit(n).alias("n"), F.lit(a).alias("first"), F.lit(z).alias("last")) for u, n, a, z in LONG_TEXTS))
    laid = laid.select(F.col("g").cast("string").alias("file"), line.alias("line"), F.get(kinds, (F.col("g") % len(LONG_TEXTS)).cast("int")).alias("k"))
    docs = laid.select("file", F.concat("line", F.lit(" "), times(F.lit("u#@x.org "), F.lit(ADDRESSES)), F.lit("\n"), "k.first", times(F.col("k.unit"), F.col("k.n")), "k.last").alias("text"))
    return places(scan(docs, options=options(*_LONG_TYPES))).select("file", "line_num", "col_start", "col_end", "entity_type", F.length("text").cast("long").alias("chars"), "score")


_PAGES = "SELECT CAST(page_id AS VARCHAR) AS file, coalesce(url, '') || chr(10) || coalesce(html, '') AS text FROM pages"


@register("page_findings", f"SELECT * FROM ({oracle.findings_sql(PERSONAL, _PAGES)})")
def page_findings(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", True)
    text = F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    return findings(scan(pages.select(F.col("page_id").cast("string").alias("file"), text.alias("text")), options=options(*PERSONAL)))


_CHAT = f"SELECT conv_id || ':' || turn AS file, coalesce(c.text, '') || chr(10) || x AS text FROM conversations c JOIN (VALUES {', '.join(f'({k}, {oracle.literal(x)})' for k, x in enumerate(fixtures.texts()))}) t(k, x) ON k = (turn * 5 + length(coalesce(c.text, ''))) % {len(fixtures.texts())}"


@register("chat_findings", f"SELECT * FROM ({oracle.findings_sql(COMPARED, _CHAT)})")
def chat_findings(spark, sf_dir):
    """Turns of conversations, each with a text below it that holds something to find."""
    rows, texts = table(spark, sf_dir, "conversations"), F.array(*map(F.lit, fixtures.texts()))
    more = F.get(texts, ((F.col("turn") * 5 + F.length(F.coalesce("text", F.lit("")))) % len(fixtures.texts())).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), more)
    return findings(scan(rows.select(F.concat_ws(":", "conv_id", "turn").alias("file"), text.alias("text")), options=options(*COMPARED)))


@register("first_recognizer_wins_ties", f"SELECT file, line_num, col_start, col_end, entity_type, max(score) AS score, count(*) > 0 AS kept FROM ({ALL_SQL}) GROUP BY ALL")
def dedupe_query(spark, sf_dir):
    """The same recognizers twice: each place and type stays one finding."""
    o = options(*COMPARED)
    twice = replace(o, recognizers=o.recognizers + o.recognizers)
    return places(scan(with_fixtures(spark, sf_dir), options=twice)).select("file", "line_num", "col_start", "col_end", "entity_type", "score", F.lit(True).alias("kept"))


FLAGS = {"URL": 0.7, "EMAIL_ADDRESS": False, "CREDIT_CARD": 1.0, "IP_ADDRESS": True}


@register("entity_flags", f"SELECT {', '.join(COLUMNS)} FROM ({PERSONAL_SQL}) WHERE entity_type <> 'EMAIL_ADDRESS' AND NOT (entity_type = 'URL' AND score < CAST(0.7 AS FLOAT))")
def entity_flags(spark, sf_dir):
    return places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL, rules=Rules(flags=FLAGS)))).select(*COLUMNS)


@register("named_entities", f"SELECT file, len(list_filter(list(entity_type), lambda x: x = 'US_SSN')) AS n, len(list_filter(list(entity_type), lambda x: x <> 'US_SSN')) AS ignored_count FROM ({PERSONAL_SQL}) GROUP BY file")
def named_entities(spark, sf_dir):
    """Only one type is asked for; the others count as ignored."""
    out = scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL, entities=("us_ssn",)))
    rows = out.select("file", F.size("findings").cast("long").alias("n"), "ignored_count")
    return rows.filter("n + ignored_count > 0")


#: A query for each way in which rules match: the rules, and SQL of what they suppress.
SUPPRESSIONS: dict[str, tuple[tuple[Rule, ...], str]] = {
    "global": ((Rule(entity_type="IP_ADDRESS", text="8.8.8.8"), Rule(text="123-45-6789")), "(entity_type = 'IP_ADDRESS' AND text = '8.8.8.8') OR text = '123-45-6789'"),
    "file": ((Rule(path="./fixtures/0.txt"), Rule(scope="file", text="8.8.8.8")), "file = 'fixtures/0.txt'"),
    "line": ((Rule(path="fixtures/22.txt", line="2..3,9"), Rule(scope="line", path="fixtures/0.txt")), "file = 'fixtures/22.txt' AND line_num BETWEEN 2 AND 3"),
    "glob": ((Rule(path="fixtures/1*", entity_type="EMAIL_ADDRESS"), Rule(text="https://*.COM/p?th"), Rule(text="*", textglob=False)), "(file LIKE 'fixtures/1%' AND entity_type = 'EMAIL_ADDRESS') OR regexp_matches(lower(text), '^https://.*[.]com/p.th$')"),
    "regex": ((Rule(match="EXAMPLE[.]"), Rule(match="^USER", ignorecase=False)), "regexp_matches(lower(text), 'example[.]')"),
    "email": ((Rule(entity_type="EMAIL_ADDRESS", text="@example.com"), Rule(text="@*.co"), Rule(text="a@")), "entity_type = 'EMAIL_ADDRESS' AND (text ILIKE '%@example.com' OR regexp_matches(text, '@[^@]*[.]co$') OR text ILIKE 'a@%')"),
    "url": ((Rule(text="*.example.com"),), "entity_type = 'URL' AND regexp_matches(lower(text), '^(https?://)?([a-z0-9.-]*[.])?example[.]com([/:?#]|$)') OR regexp_matches(lower(text), '[.]example[.]com$')"),
    "whole_file": ((Rule(type="file", path="fixtures/?.txt"), Rule(type="file", path="fixtures/22.txt")), "regexp_matches(file, '^fixtures/.[.]txt$') OR file = 'fixtures/22.txt'"),
}


def _suppression(name: str, rules: tuple[Rule, ...], where: str) -> None:
    def run(spark, sf_dir):
        return places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL, rules=Rules(rules)))).select(*COLUMNS)

    register(f"suppress_by_{name}", f"SELECT {', '.join(COLUMNS)} FROM ({PERSONAL_SQL}) WHERE NOT ({where})")(run)


for _name, (_rules, _where) in SUPPRESSIONS.items():
    _suppression(_name, _rules, _where)

def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rules of each document and some more, as a table: lines, files, folders, texts, whole files and patterns."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    path = F.col("doc_id").cast("string")
    lines = ids.select(F.when(F.col("doc_id") % 2 == 0, "EMAIL_ADDRESS").otherwise("URL").alias("entity_type"), path.alias("path"), F.explode(F.sequence(F.lit(1), F.lit(100))).alias("k"))
    lines = lines.select("entity_type", "path", (F.col("k") * 3).cast("string").alias("line"))
    files = ids.filter("doc_id % 5 = 0").select(F.lit("IP_ADDRESS").alias("entity_type"), F.concat(F.lit("./"), path).alias("path"))
    texts = ids.select(F.concat(F.lit("USER"), path, F.lit("@example.com")).alias("text"))
    whole = ids.filter("doc_id % 7 = 0").select(F.lit("file").alias("type"), path.alias("path"))
    few = spark.createDataFrame([("fixtures/**", "US_SSN", None), ("fixtures/7.txt", "URL", "1..900")], "path string, entity_type string, line string")
    few = few.unionByName(spark.createDataFrame([("^8[.]8",)], "match string"), allowMissingColumns=True)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [lines, files, texts, whole, few])


_IS_DOC = "regexp_matches(file, '^[0-9]+$')"
_BY_RULES = f"""((entity_type = CASE WHEN {_IS_DOC} AND CAST(file AS BIGINT) % 2 = 0 THEN 'EMAIL_ADDRESS' ELSE 'URL' END AND {_IS_DOC} AND line_num % 3 = 0 AND line_num <= 300)
 OR (entity_type = 'IP_ADDRESS' AND {_IS_DOC} AND CAST(file AS BIGINT) % 5 = 0) OR lower(text) IN (SELECT 'user' || doc_id || '@example.com' FROM documents)
 OR (entity_type = 'US_SSN' AND starts_with(file, 'fixtures/')) OR (entity_type = 'URL' AND file = 'fixtures/7.txt') OR starts_with(text, '8.8'))"""
_NOT_WHOLE = f"NOT ({_IS_DOC} AND CAST(file AS BIGINT) % 7 = 0)"


@register("suppress_by_rule_table", f"SELECT {', '.join(COLUMNS)} FROM ({PERSONAL_SQL}) WHERE {_NOT_WHOLE.replace('CAST(file', 'TRY_CAST(file')} AND NOT {_BY_RULES.replace('CAST(file', 'TRY_CAST(file')}")
def suppress_by_rule_table(spark, sf_dir):
    """Over 100 rules for each document, joined."""
    rules = rule_table.RuleTable(document_rules(spark, sf_dir))
    # Whole-file rules meet what is found, not the texts, which would be shuffled for that.
    found = written(places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL))), "found")
    return rule_table.without_suppressed(rule_table.without_skipped(found, rules), rules).select(*COLUMNS)


@register("ignored_by_rule_table", f"SELECT file, count(*) FILTER (NOT s) AS kept, count(*) FILTER (s) AS ignored FROM (SELECT file, coalesce({_BY_RULES.replace('CAST(file', 'TRY_CAST(file')}, false) AS s FROM ({PERSONAL_SQL})) GROUP BY file")
def ignored_by_rule_table(spark, sf_dir):
    return rule_table.ignored_by_file(places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL))), document_rules(spark, sf_dir))


_MOVED = "(line_num * 5 + col_start) % 13 - 6"


@register(
    "confirm_by_overlap",
    f"""SELECT {', '.join(COLUMNS)} FROM ({PERSONAL_SQL}) f WHERE EXISTS (SELECT 1 FROM ({PERSONAL_SQL}) g WHERE g.file = f.file AND g.line_num = f.line_num AND g.entity_type = f.entity_type
    AND f.col_start < g.col_start + ({_MOVED.replace('line_num', 'g.line_num').replace('col_start', 'g.col_start')}) * 3 + 4 AND g.col_start + ({_MOVED.replace('line_num', 'g.line_num').replace('col_start', 'g.col_start')}) * 3 < f.col_end)""",
)
def confirm_by_overlap(spark, sf_dir):
    """Findings that share a byte with a span of their type: spans of four bytes, near where findings start."""
    found = places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL))).select(*COLUMNS)
    start = F.col("col_start") + ((F.col("line_num") * 5 + F.col("col_start")) % 13 - 6) * 3
    spans = found.select("file", "line_num", "entity_type", start.alias("col_start"), (start + 4).alias("col_end"))
    return overlapping(found, spans, ["file", "line_num", "entity_type"])


_IGNORE = Rules((Rule(entity_type="URL"), Rule(entity_type="EMAIL_ADDRESS", text="@example.com")))
_IS_IGNORED = "(entity_type = 'URL' OR (entity_type = 'EMAIL_ADDRESS' AND text ILIKE '%@example.com'))"
_COUNTS_SQL = f"""SELECT d.file, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(ignored, 0) AS BIGINT) AS ignored_count, NOT regexp_matches(coalesce(d.text, ''), '\\S') AS skipped
FROM ({oracle.docs_sql()}) d LEFT JOIN (SELECT file, count(*) FILTER (NOT {_IS_IGNORED}) AS n, count(*) FILTER ({_IS_IGNORED}) AS ignored FROM ({PERSONAL_SQL}) GROUP BY file) f ON d.file = f.file"""


@register("ignored_counts", _COUNTS_SQL)
def ignored_counts(spark, sf_dir):
    out = scan(with_fixtures(spark, sf_dir, True), options=options(*PERSONAL, rules=_IGNORE))
    return out.select("file", F.size("findings").cast("long").alias("n"), "ignored_count", "skipped")


@register("status_lines", f"SELECT file || ': ' || CASE WHEN n = 0 AND ignored_count = 0 THEN 'ok' ELSE concat_ws(', ', CASE WHEN n = 1 THEN '1 finding' WHEN n > 1 THEN n || ' findings' END, CASE WHEN ignored_count > 0 THEN ignored_count || ' ignored' END) END AS value FROM ({_COUNTS_SQL}) WHERE NOT skipped")
def status_lines(spark, sf_dir):
    return report.status_lines(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL, rules=_IGNORE)))


@register("scan_totals", f"SELECT count(*) FILTER (NOT skipped) AS files_scanned, count(*) FILTER (skipped) AS files_skipped, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(ignored_count) AS BIGINT) AS ignored FROM ({_COUNTS_SQL})")
def scan_totals(spark, sf_dir):
    return report.totals(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL, rules=_IGNORE)))


_QUOTED = "'\"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(13), chr(92) || 'r') || '\"'"


@register("plain_lines", f"SELECT file || ':' || line_num || ':' || (col_start + 1) || ': ' || entity_type || ' (score: ' || printf('%.2f', score) || ') ' || {_QUOTED} AS value FROM ({ALL_SQL})")
def plain_lines(spark, sf_dir):
    return report.plain_lines(all_findings(spark, sf_dir))


@register("annotations", f"SELECT '::error file=' || file || ',line=' || line_num || ',col=' || (col_start + 1) || ',endColumn=' || (col_end + 1) || ',title=PHI/PII (' || entity_type || ')::Found ' || entity_type || ' with score ' || printf('%.2f', score) || ': ' || {_QUOTED} AS value FROM ({ALL_SQL})")
def annotations(spark, sf_dir):
    return report.annotations(all_findings(spark, sf_dir))


@register(
    "context_window",
    f"""SELECT f.file, line_num, col_start, entity_type, coalesce(array_to_string(string_split(d.text, chr(10))[greatest(1, line_num - 3):line_num - 1], chr(10)), '') AS context_before,
    coalesce(array_to_string(string_split(d.text, chr(10))[line_num + 1:line_num + 3], chr(10)), '') AS context_after FROM ({PERSONAL_SQL}) f JOIN ({oracle.docs_sql()}) d ON f.file = d.file""",
)
def context_window(spark, sf_dir):
    rows = findings(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL, context=report.CONTEXT_LINES)), report.CONTEXT_LINES)
    return rows.select("file", "line_num", "col_start", "entity_type", F.array_join("context_before", "\n").alias("context_before"), F.array_join("context_after", "\n").alias("context_after"))


@register(
    "findings_cube",
    f"""SELECT entity_type, lang, source, count(*) AS n, count(DISTINCT file) AS n_files FROM ({oracle.findings_sql(PERSONAL, oracle.docs_sql(False))}) f
    JOIN documents d ON f.file = CAST(d.doc_id AS VARCHAR) GROUP BY CUBE (entity_type, lang, source)""",
)
def findings_cube(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", True)
    return report.by_group(places(scan(docs, "doc_id", options=options(*PERSONAL))), docs, ["lang", "source"])


@register(
    "most_frequent_texts",
    f"""SELECT entity_type, text, n, n_files, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, text) AS rank
    FROM (SELECT entity_type, text, count(*) AS n, count(DISTINCT file) AS n_files FROM ({PERSONAL_SQL}) GROUP BY ALL)) WHERE rank <= 10""",
)
def most_frequent_texts(spark, sf_dir):
    return report.ranked(places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL))))


@register("new_findings", f"SELECT {', '.join(COLUMNS)} FROM ({PERSONAL_SQL}) WHERE NOT starts_with(file, 'fixtures/1')")
def new_findings(spark, sf_dir):
    found = places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL)))
    return report.new_since(found, found.filter(F.col("file").startswith("fixtures/1"))).select(*COLUMNS)


_RULE_SQL = {
    "line": "entity_type, file AS path, CAST(line_num AS VARCHAR) AS line, text",
    "file": "entity_type, file AS path, CAST(NULL AS VARCHAR) AS line, text",
    "folder": "entity_type, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') || '/**' ELSE '**' END AS path, CAST(NULL AS VARCHAR) AS line, text",
    "global": "entity_type, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS line, text",
    "host": "entity_type, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS line, '*.' || lower(regexp_extract(text, '^(?:[a-zA-Z]+://)?([^/?#:]*)', 1)) AS text",
}


def _rule_rows(kind: str, columns: str) -> None:
    def run(spark, sf_dir):
        return report.rule_rows(places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL))), kind)

    where = "entity_type = 'URL'" if kind == "host" else "true"
    register(f"rules_by_{kind}", f"SELECT DISTINCT {columns} FROM ({PERSONAL_SQL}) WHERE {where}")(run)


for _kind, _columns in _RULE_SQL.items():
    _rule_rows(_kind, _columns)


#: What a tagger would say of the fixtures' licence shapes.
TAGS = [("fixtures/21.txt", 1, 8, 12, "US_DRIVER_LICENSE", "AB12", 0.9), ("fixtures/21.txt", 1, 17, 20, "US_PASSPORT", "and", 0.9), ("fixtures/21.txt", 2, 8, 19, "US_DRIVER_LICENSE", "D1234567890", 0.6), ("fixtures/21.txt", 2, 0, 7, "US_PASSPORT", "X123456", 0.4)]
_TAG_ROWS = ", ".join(f"('{f}', {n}, {a}, {b}, '{e}', '{x}', CAST({s} AS FLOAT))" for f, n, a, b, e, x, s in TAGS)
_BROAD_SQL = oracle.findings_sql(("US_DRIVER_LICENSE", "US_PASSPORT"), oracle.docs_sql())


@register(
    "tagger_confirms",
    f"""SELECT {', '.join(COLUMNS)} FROM ({oracle.findings_sql(('EMAIL_ADDRESS',), oracle.docs_sql())}) UNION ALL SELECT {', '.join('b.' + c for c in COLUMNS)} FROM ({_BROAD_SQL}) b
    WHERE EXISTS (SELECT 1 FROM (VALUES {_TAG_ROWS}) t(file, line_num, col_start, col_end, entity_type, text, score) WHERE t.file = b.file AND t.line_num = b.line_num AND t.entity_type = b.entity_type
      AND t.score >= CAST(0.5 AS FLOAT) AND b.col_start < t.col_end AND t.col_start < b.col_end)""",
)
def tagger_confirms(spark, sf_dir):
    tags = tagger.table_tagger(spark.createDataFrame(TAGS, tagger.TAGS))
    o = options("EMAIL_ADDRESS", "US_DRIVER_LICENSE", "US_PASSPORT", rules=Rules(flags={"US_PASSPORT": 0.5, "US_DRIVER_LICENSE": 0.5}))
    return places(scan(with_fixtures(spark, sf_dir), options=o, tagger=tags)).select(*COLUMNS)


@register("tagger_alone", f"SELECT {', '.join(COLUMNS)} FROM ({oracle.findings_sql(('US_SSN',), oracle.docs_sql())}) UNION ALL SELECT * FROM (VALUES {_TAG_ROWS}) t({', '.join(COLUMNS)})")
def tagger_alone(spark, sf_dir):
    tags = tagger.table_tagger(spark.createDataFrame(TAGS, tagger.TAGS))
    return places(scan(with_fixtures(spark, sf_dir), options=options("US_SSN"), tagger=tags, confirm=False)).select(*COLUMNS)


def _streamed(found: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over what is there, into the shared folder, and reads the result (deleted when the driver ends)."""
    out = shared_folder(spark, "stream")
    q = found.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/data")


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return triage.table_stream(spark, f"{sf_dir}/document[s].parquet", schema).select(F.col("doc_id").cast("string").alias("file"), "text")


_STREAM_SQL = oracle.findings_sql(PERSONAL, oracle.docs_sql(False))


@register("stream_findings", f"SELECT {', '.join(COLUMNS)} FROM ({_STREAM_SQL})")
def stream_findings(spark, sf_dir):
    return _streamed(triage.stream_findings(_document_stream(spark, sf_dir), options=options(*PERSONAL)).select(*COLUMNS), spark)


@register("stream_first_seen", f"SELECT DISTINCT file, entity_type, text FROM ({_STREAM_SQL})")
def stream_first_seen(spark, sf_dir):
    found = triage.stream_findings(_document_stream(spark, sf_dir), options=options(*PERSONAL))
    return _streamed(triage.first_seen(found).select("file", "entity_type", "text"), spark)


def sightings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Each event of a user is a sighting of what the user's document holds: file, entity_type, text, ts (milliseconds)."""
    events = table(spark, sf_dir, "events") if events is None else events
    found = places(scan(documents(spark, sf_dir), options=options(*PERSONAL))).select("file", "entity_type", "text")
    return events.select(F.col("user_id").cast("string").alias("file"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts")).join(found, "file").select("file", "entity_type", "text", "ts")


_SIGHTINGS_SQL = f"""SELECT f.file, f.entity_type, f.text, date_trunc('milliseconds', e.ts) AS ts FROM events e JOIN ({_STREAM_SQL}) f ON f.file = CAST(e.user_id AS VARCHAR)"""


@register(
    "finding_sessions",
    f"""SELECT file, entity_type, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY file, entity_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY file, entity_type ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ({_SIGHTINGS_SQL}))) GROUP BY file, entity_type, session""",
)
def finding_sessions(spark, sf_dir):
    out = triage.sessions(sightings(spark, sf_dir), "ts", "6 hours")
    return out.select("file", "entity_type", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@register(
    "stream_first_in_a_while",
    f"""SELECT file, entity_type, text, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY file, entity_type, text ORDER BY ts) AS before FROM (SELECT DISTINCT * FROM ({_SIGHTINGS_SQL})))
    WHERE before IS NULL OR ts - before > INTERVAL 2 DAY""",
)
def stream_first_in_a_while(spark, sf_dir):
    """A stream of events, its state in the RocksDB store, bounded by two days of event time."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, triage.ROCKSDB)
    try:
        events = triage.table_stream(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)
        seen = triage.first_in_a_while(sightings(spark, sf_dir, events), "ts", 2 * 86_400)
        return _streamed(seen, spark).select("file", "entity_type", "text", F.col("ts").cast("timestamp_ntz").alias("ts"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@register("stream_to_rule_log", f"SELECT DISTINCT entity_type, file AS path, text FROM ({_STREAM_SQL})")
def stream_to_rule_log(spark, sf_dir):
    """All findings of a stream of documents become rules of a log."""
    out = shared_folder(spark, "rule-log")
    log = triage.RuleLog(spark, f"{out}/log")
    triage.triage_to_log(_document_stream(spark, sf_dir), f"{out}/state", log, accept=True, options=options(*PERSONAL)).awaitTermination()
    return log.rules().select("entity_type", "path", "text")


_PATHS_SQL = "SELECT source || '/' || doc_id % 7 || '/' || doc_id || '.txt' AS file, doc_id, text FROM documents"


@register(
    "changed_since",
    f"""SELECT file, CASE WHEN doc_id % 101 = 3 THEN 'added' ELSE 'changed' END AS change FROM ({_PATHS_SQL}) WHERE doc_id % 101 = 3 OR (doc_id % 97 = 5 AND text IS NOT NULL)
    UNION ALL SELECT 'gone/' || doc_id, 'removed' FROM documents WHERE doc_id % 103 = 0""",
)
def changed_since(spark, sf_dir):
    """documents as files of folders, against a manifest in which some texts differ, some are missing and some are more."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", (F.col("doc_id") % 7).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(path.alias("file"), "doc_id", "text")
    old = files.filter("doc_id % 101 <> 3").select("file", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    gone = docs.filter("doc_id % 103 = 0").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("file"), "text")
    return manifest.changed_since(manifest.manifest(files), manifest.manifest(old.unionByName(gone)))


@register(
    "sketched_report",
    f"""SELECT entity_type, count(*) AS n, true AS texts_agree, true AS median_agrees FROM ({oracle.findings_sql(PERSONAL, oracle.docs_sql(False))}) GROUP BY entity_type""",
)
def sketched_report(spark, sf_dir):
    """Sketches by type and source, merged over sources; whether they agree with exact figures within their stated error."""
    found = places(scan(documents(spark, sf_dir), options=options(*PERSONAL)))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "source")
    got = report.merged_sketches(report.sketched(found.join(sources, "file"), "source"), "entity_type")
    size = F.length("text").cast("long")
    exact = found.groupBy("entity_type").agg(F.countDistinct("text").alias("texts"), F.percentile_approx(size, 0.47, 1_000_000).alias("low"), F.percentile_approx(size, 0.53, 1_000_000).alias("high"))
    close = F.abs(F.col("n_texts") - F.col("texts")) <= F.greatest(F.lit(1.0), 0.05 * F.col("texts"))
    return got.join(exact, "entity_type").select("entity_type", "n", close.alias("texts_agree"), F.col("median_length").between(F.col("low"), F.col("high")).alias("median_agrees"))


@register(
    "repeated_lines_rank",
    f"""SELECT file, line_num, entity_type, CAST(row_number() OVER (PARTITION BY file ORDER BY line_num, col_start, col_end, entity_type) AS INT) AS place,
    lag(line_num) OVER (PARTITION BY file ORDER BY line_num, col_start, col_end, entity_type) AS previous_line FROM ({PERSONAL_SQL})""",
)
def repeated_lines_rank(spark, sf_dir):
    """Each finding's place in its file, and the line of the one before."""
    w = Window.partitionBy("file").orderBy("line_num", "col_start", "col_end", "entity_type")
    found = places(scan(with_fixtures(spark, sf_dir), options=options(*PERSONAL)))
    return found.select("file", "line_num", "entity_type", F.row_number().over(w).alias("place"), F.lag("line_num").over(w).alias("previous_line"))
