"""The scan: recognizers, flags, suppression, confirmation by a tagger, dedupe.

Everything that depends on one text alone stays in its row, so a scan without a tagger has no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.operators import recognizers as rec
from siftline.operators.overlap import overlapping
from siftline.operators.suppress import Rules, is_file_skipped, is_suppressed
from siftline.schema import FINDING_COLUMNS, FINDING_FIELDS, FOUND, FOUND_COLUMNS
from siftline.shared import written


@dataclass(frozen=True)
class Options:
    """entities: only these types in the result. flags: by type, False switches it off, True allows an opt-in type, a
    number asks for that score. recognizers: what may run. max_bytes: longer texts are skipped; None (the default) scans
    texts of any length, and sources of files have a limit of their own. context: outcomes hold all lines of a text with
    findings, so that `findings(outcomes, context)` can show lines around."""

    entities: tuple[str, ...] = ()
    rules: Rules = field(default_factory=Rules)
    recognizers: tuple[rec.Recognizer, ...] = rec.DEFAULT
    max_bytes: int | None = None
    context: int | None = None

    @property
    def flags(self) -> dict[str, bool | float]:
        return self.rules.flags

    def enabled(self, tier: str) -> list[rec.Recognizer]:
        """Recognizers of a tier that run: an opt-in one has to be asked for."""
        return [r for r in self.recognizers if r.tier == tier and self.flags.get(r.entity) is not False and (tier != rec.OPT_IN or r.entity in self.flags)]


def passes_flags(f: Column, flags: dict[str, bool | float]) -> Column:
    """By the finding's type: not switched off, and with the score asked for."""
    keep = F.lit(True)
    off = [e for e, v in flags.items() if v is False]
    if off:
        keep = keep & ~f["entity_type"].isin(*off)
    for e, v in flags.items():
        if not isinstance(v, bool):
            keep = keep & ((f["entity_type"] != e) | (f["score"] >= F.lit(float(v)).cast("float")))
    return keep


_built: dict[tuple, Column] = {}


def candidates_of_text(chosen: list[rec.Recognizer]) -> Column:
    """candidates() of a column `text`; building so large an expression takes longer than scanning many texts, so it is kept."""
    key = (id(SparkContext._gateway), *chosen)
    if key not in _built:
        if len(_built) > 100:
            _built.clear()
        _built[key] = candidates(F.col("text"), chosen)
    return _built[key]


def candidates(text: Column, chosen: list[rec.Recognizer]) -> Column:
    """Findings of all chosen recognizers; those that share a screen are tried only where it is passed."""
    parts = [t.no_matches()]
    for screen in dict.fromkeys(r.screen for r in chosen):
        here = [r for r in chosen if r.screen == screen]
        table = [x for r in here for x in r.table]
        group = F.concat(*(r.matches(text) for r in here if not r.table), t.matches_of(text, table) if table else t.no_matches())
        parts.append(F.when(text.rlike(screen), group).otherwise(t.no_matches()) if screen else group)
    return t.located(text, F.concat(*parts), rec.LINE_RULES)


def dedupe(findings: Column) -> Column:
    """One finding for each place and type, that of the highest score; sorted by line, columns and type."""
    key = lambda f: F.struct(f["line_num"].alias("a"), f["col_start"].alias("b"), f["col_end"].alias("c"), f["entity_type"].alias("d"), (-f["score"]).alias("e"), f.alias("f"))
    ordered = F.transform(F.sort_array(F.transform(findings, key)), lambda x: x["f"])

    def first_of_its_kind(fs: Column) -> Column:
        same = lambda a, b: (a["line_num"] == b["line_num"]) & (a["col_start"] == b["col_start"]) & (a["col_end"] == b["col_end"]) & (a["entity_type"] == b["entity_type"])
        return F.filter(fs, lambda f, i: (i == 0) | ~same(f, F.get(fs, i - 1)))

    return t.bind(ordered, first_of_its_kind)


def readable(text: Column, max_bytes: int | None = None) -> Column:
    """Not null, not blank, not too long; None: however long."""
    fits = F.octet_length(text) >= 1 if max_bytes is None else F.octet_length(text).between(1, max_bytes)
    return F.coalesce(fits & text.rlike(r"(?U)\S"), F.lit(False))


def scan(docs: DataFrame, id_col: str = "file", text_col: str = "text", options: Options | None = None, tagger: Callable[[DataFrame], DataFrame] | None = None, confirm: bool = True) -> DataFrame:
    """Outcomes: file, findings (array), lines, ignored_count, skipped, failed_lines; a row for each row of docs.

    lines holds the lines of findings, line n as item n - 1, and nulls in between; `findings` puts both together.
    Without a tagger only strict (and asked-for opt-in) recognizers run. A tagger maps lines (file, line_num,
    line_content) to tags (file, line_num, col_start, col_end, entity_type, text, score). With confirm, it sees only
    lines with candidates, and a broad candidate stays where a tag of its type overlaps it; without, it sees all lines and
    its tags are findings. A tag with an `error` is a line that the model failed on; failed_lines counts them. Ids are taken to be unique where a tagger is given. Null, blank and too long texts are skipped,
    as are files that a rule names. Other columns of docs play no part.
    """
    o = options or Options()
    base = docs.select(F.col(id_col).cast("string").alias("file"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("skipped", ~readable(F.col("text"), o.max_bytes) | is_file_skipped(F.col("file"), o.rules))
    none = t.no_findings()
    strict = F.when(~F.col("skipped"), candidates_of_text(o.enabled(rec.STRICT) + o.enabled(rec.OPT_IN))).otherwise(none)
    found = base.withColumn("found", F.filter(strict, lambda f: passes_flags(f, o.flags)))
    found = _suppressed(found, "found", o)
    if tagger is None:
        return _finish(found.withColumn("all", F.col("kept")), o)
    broad = F.when(~F.col("skipped"), candidates_of_text(o.enabled(rec.BROAD))).otherwise(none) if confirm else none
    found = found.withColumnRenamed("kept", "strict").withColumnRenamed("ignored", "strict_ignored").withColumn("found", broad)
    found = _suppressed(found, "found", o).withColumnRenamed("kept", "broad").withColumnRenamed("ignored", "broad_ignored")
    if confirm:
        # What is found is narrow and needed twice, for lines and in the end: written, so that texts are scanned once.
        numbers = F.array_sort(F.array_distinct(F.transform(F.concat("strict", "broad"), lambda f: f["line_num"])))
        known = F.split("text", "\n") if o.context is not None else t.lines_at(F.col("text"), numbers)
        found = written(found.withColumn("lines", F.when(F.size(numbers) > 0, known)).drop("text"), "candidates")
        lines = found.select("file", F.posexplode("lines").alias("i", "line_content")).filter(F.col("line_content").isNotNull())
        if o.context is not None:
            here = found.select("file", F.explode(F.array_distinct(F.transform(F.concat("strict", "broad"), lambda f: f["line_num"] - 1))).alias("i"))
            lines = lines.join(here, ["file", "i"], "left_semi")
    else:
        lines = found.filter(~F.col("skipped")).select("file", F.posexplode(F.split("text", "\n")).alias("i", "line_content"))
    tags = tagger(lines.select("file", (F.col("i") + 1).alias("line_num"), "line_content"))
    if "error" in tags.columns:
        tags = written(tags, "tags")
        failed = tags.filter(F.col("error").isNotNull()).groupBy("file").agg(F.count("*").alias("failed_lines"))
        tags = tags.filter(F.col("error").isNull())
    else:
        failed = None
    tags = tags.select("file", F.struct(*(F.col(c) for c in FOUND_COLUMNS)).cast(FOUND).alias("tag")).filter(passes_flags(F.col("tag"), o.flags))
    tags = tags.withColumn("silenced", is_suppressed(F.col("file"), F.col("tag"), o.rules) if o.rules.matchers else F.lit(False))
    new = tags.filter(~F.col("silenced")).select("file", "tag.*")
    if confirm:
        new = overlapping(found.select("file", F.inline("broad")), new, ["file", "line_num", "entity_type"])
    by_file = new.groupBy("file").agg(F.collect_list(F.struct(*FOUND_COLUMNS)).alias("new"))
    silenced = tags.filter("silenced").groupBy("file").agg(F.count("*").alias("silenced"))
    joined = found.join(by_file, "file", "left").join(silenced, "file", "left")
    joined = joined.withColumn("failed_lines", F.lit(0)) if failed is None else joined.join(failed, "file", "left")
    ignored = F.col("strict_ignored") + F.col("broad_ignored") + F.coalesce("silenced", F.lit(0))
    return _finish(joined.select(*found.columns, "failed_lines", F.concat("strict", F.coalesce("new", none)).alias("all"), ignored.alias("ignored")), o)


def trace(docs: DataFrame, id_col: str = "file", text_col: str = "text", options: Options | None = None) -> DataFrame:
    """Every candidate of every tier with what becomes of it: kept, flagged off, suppressed, or awaiting a tag."""
    o = options or Options()
    base = docs.select(F.col(id_col).cast("string").alias("file"), F.col(text_col).cast("string").alias("text"))
    base = base.filter(readable(F.col("text"), o.max_bytes) & ~is_file_skipped(F.col("file"), o.rules))
    out = None
    for tier in (rec.STRICT, rec.OPT_IN, rec.BROAD):
        rows = base.select("file", F.inline_outer(candidates_of_text(o.enabled(tier)))).filter(F.col("entity_type").isNotNull())
        f = F.struct(*(F.col(c) for c in FOUND_COLUMNS))
        silenced = is_suppressed(F.col("file"), f, o.rules) if o.rules.matchers else F.lit(False)
        flagged = F.lit(False) if tier == rec.BROAD else ~passes_flags(f, o.flags)
        decision = F.when(flagged, "flagged off").when(silenced, "suppressed").otherwise("awaits a tag" if tier == rec.BROAD else "kept")
        rows = rows.withColumn("tier", F.lit(tier)).withColumn("decision", decision)
        out = rows if out is None else out.unionByName(rows)
    return out


def _suppressed(df: DataFrame, column: str, o: Options) -> DataFrame:
    """Splits findings into kept ones and a count of those that a rule suppresses."""
    kept = F.filter(column, lambda f: ~is_suppressed(F.col("file"), f, o.rules)) if o.rules.matchers else F.col(column)
    df = df.withColumn("kept", kept)
    return df.withColumn("ignored", (F.size(column) - F.size("kept")).cast("long")).drop(*(["found"] if column == "found" else []))


def _finish(df: DataFrame, o: Options) -> DataFrame:
    df = df.withColumn("findings", dedupe(F.col("all")))
    if o.entities:
        names = [e.upper() for e in o.entities]
        df = df.withColumn("named", F.filter("findings", lambda f: F.upper(f["entity_type"]).isin(*names)))
        df = df.withColumn("ignored", F.col("ignored") + F.size("findings") - F.size("named")).drop("findings").withColumnRenamed("named", "findings")
    if "lines" not in df.columns:
        numbers = F.array_distinct(F.transform("findings", lambda f: f["line_num"]))
        lines = F.split("text", "\n") if o.context is not None else t.lines_at(F.col("text"), numbers)
        df = df.withColumn("lines", F.when(F.size("findings") > 0, lines))
    failed = F.coalesce("failed_lines", F.lit(0)).cast("long") if "failed_lines" in df.columns else F.lit(0).cast("long")
    return df.select("file", "findings", "lines", F.col("ignored").alias("ignored_count"), "skipped", failed.alias("failed_lines"))


def findings(outcomes: DataFrame, context: int | None = None) -> DataFrame:
    """The table of findings, a row each. context: with context_before and context_after, up to so many lines (0 to 20) each.

    A row's findings go by line first, so that a line leaves its row once and meets its findings after that. Generators are
    outer, as for a plain one a filter on the array's size would be inferred, pushed below, and compute all findings again.
    """

    def by_line(fs: Column, starts: Column) -> Column:
        def group(start: Column, k: Column) -> Column:
            n = F.get(fs, start)["line_num"]
            out = [F.get(F.col("lines"), n - 1).alias("line_content")]
            if context is not None:
                most, first = max(0, min(20, context)), F.greatest(F.lit(1), n - max(0, min(20, context)))
                on = F.when(n < F.size("lines"), F.slice("lines", n + 1, F.lit(most))).otherwise(F.array().cast("array<string>"))
                out += [F.slice("lines", first, n - first).alias("context_before"), on.alias("context_after")]
            return F.struct(*out, F.slice(fs, start + 1, F.coalesce(F.get(starts, k + 1), F.size(fs)) - start).alias("here"))

        return F.transform(starts, group)

    fs = F.col("findings")
    starts = F.filter(F.transform(fs, lambda f, i: F.when((i == 0) | (f["line_num"] != F.get(fs, i - 1)["line_num"]), i)), lambda i: i.isNotNull())
    rows = outcomes.select("file", F.inline_outer(t.bind(starts, lambda s: by_line(fs, s))))
    more = ["context_before", "context_after"] if context is not None else []
    return rows.select("file", "line_content", *more, F.inline_outer("here")).filter(F.col("entity_type").isNotNull()).select(*FINDING_COLUMNS, *more)


def places(outcomes: DataFrame) -> DataFrame:
    """The table of findings without their lines."""
    return outcomes.select("file", F.inline_outer("findings")).filter(F.col("entity_type").isNotNull())


def findings_view(spark: SparkSession, name: str, source: str, id_col: str = "file", text_col: str = "text", options: Options | None = None) -> None:
    """Makes the findings of a table or view available to SQL as a temporary view; a query on it is the native scan."""
    findings(scan(spark.table(source), id_col, text_col, options)).createOrReplaceTempView(name)


#: What a column's SQL text has as calls by bare operators; SQL takes them between backquotes.
_OPERATORS = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`'])(<=>|<=|>=|<|>|=|\+|-|\*|/|%|!|and|or|in|not)\(")


def scan_function(spark: SparkSession, name: str, options: Options | None = None) -> None:
    """Makes the scan of a text a table function of SQL: SELECT .. FROM docs, LATERAL name(docs.text).

    It returns line_num, col_start, col_end, entity_type, text and score of strict (and asked-for opt-in) recognizers, with
    the flags and the rules that need no file name. The body is the native expression, so plans are those of `scan`. A null
    or blank text has no rows.
    """
    o = options or Options()
    chosen = o.enabled(rec.STRICT) + o.enabled(rec.OPT_IN)
    text, file = F.col("t"), F.lit("")
    kept = F.filter(candidates(text, chosen), lambda f: passes_flags(f, o.flags) & ~is_suppressed(file, f, o.rules))
    body = F.when(readable(text, o.max_bytes), dedupe(kept))._jc.node().sql()
    body = _OPERATORS.sub(lambda m: m[1] or f"`{m[2]}`(", body)
    columns = ", ".join(f"f.{c}" for c in FOUND_COLUMNS)
    kinds = ", ".join(f"{n} {k}" for n, k in FINDING_FIELDS[:-1])
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE({kinds}) RETURN SELECT {columns} FROM (SELECT explode({body}) AS f)")
