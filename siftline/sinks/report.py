"""What becomes of findings: lines of text, annotations, summaries, context, new rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from siftline.functions.text import url_host
from siftline.operators.suppress import Rule

CONTEXT_LINES = 3


def quoted(c: Column) -> Column:
    """In double quotes, with backslashes before quotes, backslashes and line controls."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (('"', '"'), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\0", "0")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def plain_lines(findings: DataFrame) -> DataFrame:
    """file:line:column: TYPE (score: 0.00) "text"."""
    value = F.format_string("%s:%d:%d: %s (score: %.2f) %s", "file", "line_num", F.col("col_start") + 1, "entity_type", F.col("score").cast("double"), quoted(F.col("text")))
    return findings.select(value.alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    """Annotations as continuous integration reads them; columns from 1."""
    value = F.format_string(
        "::error file=%s,line=%d,col=%d,endColumn=%d,title=PHI/PII (%s)::Found %s with score %.2f: %s",
        "file", "line_num", F.col("col_start") + 1, F.col("col_end") + 1, "entity_type", "entity_type", F.col("score").cast("double"), quoted(F.col("text")),
    )
    return findings.select(value.alias("value"))


def status_lines(outcomes: DataFrame, only_issues: bool = False) -> DataFrame:
    """file: n findings, m ignored — or ok; skipped files have none."""
    n = F.size("findings")
    found = F.when(n > 0, F.format_string("%d %s", n, F.when(n == 1, "finding").otherwise("findings")))
    ignored = F.when(F.col("ignored_count") > 0, F.format_string("%d ignored", "ignored_count"))
    said = F.concat_ws(", ", found, ignored)
    rows = outcomes.filter("NOT skipped").select("file", F.when(said == "", F.lit("ok")).otherwise(said).alias("said"), (said == "").alias("fine"))
    return (rows.filter("NOT fine") if only_issues else rows).select(F.concat("file", F.lit(": "), "said").alias("value"))


def totals(outcomes: DataFrame) -> DataFrame:
    """Files scanned and skipped, findings and ignored matches: one row."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return outcomes.agg(
        count(~F.col("skipped")).alias("files_scanned"),
        count(F.col("skipped")).alias("files_skipped"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long").alias("findings"),
        F.coalesce(F.sum("ignored_count"), F.lit(0)).cast("long").alias("ignored"),
    )


def observed(outcomes: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation | None]:
    """outcomes, and an observation that holds `totals` once they have been through an action: no second scan for them.

    Of a stream, the same numbers come with each batch's progress (None is returned). `get` waits until an action such as
    a write or collect has run; toLocalIterator isn't one.
    """
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    metrics = [count(~F.col("skipped")).alias("files_scanned"), count(F.col("skipped")).alias("files_skipped"), F.sum(F.size("findings")).cast("long").alias("findings"), F.sum("ignored_count").cast("long").alias("ignored")]
    if outcomes.isStreaming:
        return outcomes.observe(name, *metrics), None
    seen = Observation(name)
    return outcomes.observe(seen, *metrics), seen


def diagnostics(found: DataFrame) -> DataFrame:
    """For each finding (with context_before and context_after) a picture of its place: lines around, a mark below its middle.

    Columns file, line_num, col_start and value (several lines). Lines lose their indent; the mark counts bytes, as columns do.
    """
    bare = lambda c: F.regexp_replace(c, r"^(?U:\s)+", "")
    width = F.length((F.col("line_num") + F.size("context_after")).cast("string"))
    pad = F.repeat(F.lit(" "), width + 1)
    numbered = lambda n, body: F.concat(F.lpad(n.cast("string"), width, F.lit(" ")), F.lit(" │ "), body)
    indent = F.octet_length("line_content") - F.octet_length(bare(F.col("line_content")))
    middle = F.greatest(F.lit(0), F.col("col_start") - indent) + F.floor(F.greatest(F.lit(1), F.col("col_end") - F.col("col_start")) / 2).cast("int")
    mark = F.concat(pad, F.lit("· "), F.repeat(F.lit(" "), middle))
    above = F.transform("context_before", lambda x, i: numbered(F.col("line_num") - F.size("context_before") + i, bare(x)))
    below = F.transform("context_after", lambda x, i: numbered(F.col("line_num") + 1 + i, bare(x)))
    head = F.concat(pad, F.format_string("┌─ %s:%d:%d", "file", "line_num", F.col("col_start") + 1))
    here = F.array(numbered(F.col("line_num"), bare(F.col("line_content"))), F.concat(mark, F.lit("▲")), F.concat(mark, F.format_string("└── %s (σ %.1f)", "entity_type", F.col("score").cast("double"))))
    return found.select("file", "line_num", "col_start", F.array_join(F.concat(F.array(head), above, here, below), "\n").alias("value"))


def exit_code(outcomes: DataFrame) -> int:
    """1 if there is a finding, else 0; stops at the first."""
    return 0 if outcomes.filter(F.size("findings") > 0).limit(1).isEmpty() else 1


def with_context(findings: DataFrame, docs: DataFrame, radius: int = CONTEXT_LINES, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """Adds context_before and context_after: up to `radius` lines on either side, 0 to 20."""
    radius = max(0, min(20, radius))
    lines = docs.select(F.col(id_col).cast("string").alias("file"), F.split(text_col, "\n").alias("lines"))
    at, first = F.col("line_num"), F.greatest(F.lit(1), F.col("line_num") - radius)
    return (
        findings.join(lines, "file")
        .withColumn("context_before", F.slice("lines", first, at - first))
        .withColumn("context_after", F.when(at < F.size("lines"), F.slice("lines", at + 1, F.lit(radius))).otherwise(F.array().cast("array<string>")))
        .drop("lines")
    )


def rule_rows(findings: DataFrame, kind: str = "file") -> DataFrame:
    """The rules that would suppress the findings, each once: by line, file, folder, everywhere, or (URLs) by host."""
    texts = {"entity_type": F.col("entity_type"), "path": F.lit(None).cast("string"), "line": F.lit(None).cast("string"), "text": F.col("text")}
    if kind == "line":
        texts |= {"path": F.col("file"), "line": F.col("line_num").cast("string")}
    elif kind == "file":
        texts |= {"path": F.col("file")}
    elif kind == "folder":
        parent = F.regexp_replace("file", "/[^/]*$", "")
        texts |= {"path": F.when(F.contains("file", F.lit("/")) & (parent != ""), F.concat(parent, F.lit("/**"))).otherwise(F.when(F.col("file").startswith("/"), F.lit("//**")).otherwise(F.lit("**")))}
    elif kind == "host":
        host = url_host(F.col("text"))
        findings = findings.filter((F.col("entity_type") == "URL") & host.isNotNull())
        texts |= {"text": F.concat(F.lit("*."), host)}
    elif kind != "global":
        raise ValueError(f"no such kind of rule: {kind}")
    return findings.select(*(c.alias(n) for n, c in texts.items())).distinct()


def custom_rule(entity_type: str, written: str, is_pattern: bool = False) -> Rule:
    """A rule for one type from what somebody wrote: a text (wildcards count) or a pattern; everywhere, in any case."""
    if not written:
        raise ValueError("nothing written")
    return Rule(entity_type=entity_type, match=written) if is_pattern else Rule(entity_type=entity_type, text=written)


def accepted_rules(findings: DataFrame) -> DataFrame:
    """The rules of accept_all as a table, for any number of findings."""
    rows = rule_rows(findings, "file")
    wild = F.when(F.col("text").rlike(r"[*?\[]"), False)
    return rows.select("entity_type", F.regexp_replace("path", r"([*?\[])", "[$1]").alias("path"), "text", wild.alias("textglob"))


def accept_all(findings: DataFrame) -> list[Rule]:
    """A rule for each file, type and text, for a rules file; texts count as they are, not as wildcards.

    The rules go to the driver, so this is for triage of a finite set of files, as a rules file is.
    """
    rows = rule_rows(findings, "file").orderBy("path", "entity_type", "text").collect()
    literal = lambda s: "".join(f"[{c}]" if c in "*?[" else c for c in s)
    return [Rule(entity_type=r["entity_type"], path=literal(r["path"]), text=r["text"], textglob=False if set(r["text"]) & set("*?[") else None) for r in rows]


def by_group(findings: DataFrame, docs: DataFrame, keys: list[str], id_col: str = "doc_id") -> DataFrame:
    """Findings by entity type and columns of docs, with subtotals over all sets of them."""
    named = docs.select(F.col(id_col).cast("string").alias("file"), *keys)
    return findings.select("file", "entity_type").join(named, "file").cube("entity_type", *keys).agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


def ranked(findings: DataFrame, per_type: int = 10) -> DataFrame:
    """The most frequent texts of each type, ties by text."""
    counts = findings.groupBy("entity_type", "text").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))
    w = Window.partitionBy("entity_type").orderBy(F.desc("n"), "text")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_type)


def new_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose file, type and text the baseline doesn't hold, wherever they stand."""
    return findings.join(baseline.select("file", "entity_type", "text").distinct(), ["file", "entity_type", "text"], "left_anti")


#: Of a sketch of distinct texts and of one of lengths: the relative standard error is about 1.6 % and 1 %.
HLL_BITS, KLL_SIZE = 12, 200


def sketched(findings: DataFrame, *keys: str) -> DataFrame:
    """keys, entity_type, n, and sketches of distinct texts and of their lengths: rows to be stored, and merged later."""
    return findings.groupBy(*keys, "entity_type").agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.concat_ws("\0", "entity_type", "text"), HLL_BITS).alias("texts"),
        F.kll_sketch_agg_bigint(F.length("text").cast("long"), KLL_SIZE).alias("lengths"),
    )


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, n, n_texts (about), median_length and p99_length (about) of stored sketches, over any of their keys: no finding is read."""
    got = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("n_texts"), F.kll_merge_agg_bigint("lengths").alias("lengths"))
    at = lambda q: F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))
    return got.select(*keys, "n", "n_texts", at(0.5).alias("median_length"), at(0.99).alias("p99_length"))
