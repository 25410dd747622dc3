"""Rule sets as tables: equality rules by hash joins on keys, in plans whose size doesn't depend on the number of rules.

A rule that names a type or none, a text or none, a path, a folder or none, and lines or none becomes one key; lines are bits
of a number, 64 to a key, so that the hundreds of rules that a file gathers are few keys before anything is shuffled. A
finding has one key for each kind of rule that the table holds: with its type or without, its text as it is, folded or left
out, its path, each folder above it, or neither. Both meet in an equi-join. Rules with patterns and wildcards remain; they
are few, since each was thought up by somebody, and are predicates of the plan.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.operators.suppress import FILE, GLOBAL, LINE, Rule, Rules, is_file_skipped, is_suppressed
from siftline.schema import FOUND_COLUMNS, RULE_FIELDS
from siftline.shared import written

#: Lines that a range of a rule may have to become keys.
RANGE_LINES = 64
RULES = ", ".join(f"`{n}` {'boolean' if n in ('ignorecase', 'textglob') else 'string'}" for n in RULE_FIELDS)
#: 64 lines share a key, as bits of a long.
LINE_BITS = 6
_WILD, _SPEC = r"[*?\[]", r"^\s*(?:,\s*)*\+?\d+\s*(?:\.\.\s*\+?\d+\s*)?(?:,\s*(?:\+?\d+\s*(?:\.\.\s*\+?\d+\s*)?)?)*$"


def _path(c: Column) -> Column:
    return F.when(c.startswith("./") | c.startswith(".\\"), F.substring(c, F.lit(3), F.length(c))).otherwise(c)


def _shaped(rules: DataFrame) -> DataFrame:
    """Rules with what their keys hold: scope, text and path as kinds, lines; keyed tells whether keys are all there is to it.

    There are many rules, and filters are pushed below what they are computed from: only cheap ones stand here, and what
    costs time is computed where a rule needs it.
    """
    have = [c if c in rules.columns else None for c in RULE_FIELDS]
    r = rules.select(*((F.col(f"`{c}`") if c else F.lit(None)).cast("boolean" if n in ("ignorecase", "textglob") else "string").alias(n) for n, c in zip(RULE_FIELDS, have, strict=True)))
    r = r.withColumn("both", F.when(F.col("text").isNotNull() & F.col("match").isNotNull(), F.raise_error(F.lit("a rule sets both `text` and `match`"))))
    inferred = F.when(F.col("line").isNotNull(), LINE).when(F.col("path").isNotNull(), FILE).otherwise(GLOBAL)
    r = r.filter(F.col("both").isNull()).withColumn("at", F.when(F.col("scope").isin(GLOBAL, FILE, LINE), F.col("scope")).otherwise(inferred))
    r = r.filter((F.col("type").eqNullSafe("file") & F.col("path").isNotNull()) | (~F.col("type").eqNullSafe("file") & ((F.col("at") == GLOBAL) | (F.col("path").isNotNull() & ((F.col("at") == FILE) | F.col("line").isNotNull())))))
    r = r.withColumn("fold", F.coalesce("ignorecase", F.lit(True))).withColumn("p", _path(F.col("path")))
    folder = F.when(F.col("p") == "**", "").when(F.col("p").endswith("/**"), F.expr("left(p, length(p) - 2)"))
    r = r.withColumn("folder", F.when(F.col("p").endswith("**"), F.when(~folder.rlike(_WILD), folder)))
    uses_path = (F.col("at") != GLOBAL) | F.col("type").eqNullSafe("file")
    r = r.withColumn("path_kind", F.when(~uses_path, "none").when(F.col("folder").isNotNull(), "folder").when(~F.col("p").rlike(_WILD), "path").otherwise("wild"))
    text = F.col("text")
    wild = (F.coalesce("textglob", F.lit(True)) & text.rlike(_WILD)) | text.startswith("@") | text.startswith("*.") | text.endswith("@")
    r = r.withColumn("text_kind", F.when(F.col("match").isNotNull(), "wild").when(text.isNull(), "none").when(wild, "wild").when(F.col("fold"), "folded").otherwise("exact"))
    number = F.when((F.col("at") == LINE) & F.col("line").rlike("^[0-9]{1,18}$"), F.col("line").try_cast("long"))
    r = r.withColumn("number", number)
    parts = F.filter(F.transform(F.split("line", ","), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^\+?(\d+)", 1).try_cast("long").alias("lo"), F.regexp_extract(x, r"(\d+)$", 1).try_cast("long").alias("hi")))
    fine = F.col("line").rlike(_SPEC) & ~F.exists(ends, lambda x: x["lo"] > x["hi"])
    bad = F.raise_error(F.concat(F.lit("no line numbers in `"), F.col("line"), F.lit("`"))).cast(ends_type := "array<struct<lo:bigint,hi:bigint>>")
    r = r.withColumn("ranges", F.when((F.col("at") == LINE) & F.col("number").isNull(), F.when(fine, ends).otherwise(bad)).cast(ends_type))
    long = F.when(F.col("ranges").isNull(), False).otherwise(F.coalesce(F.exists("ranges", lambda x: x["hi"] - x["lo"] >= RANGE_LINES), F.lit(False)))
    return r.withColumn("keyed", (F.col("text_kind") != "wild") & (F.col("path_kind") != "wild") & ~long)


def _compact(rules: DataFrame) -> DataFrame:
    """Rules in one pass: `kind` ("file", "rest" or four words on a key), key and bits (null: of no lines), of the rest a rule.

    Equal ones, and lines that share a key, become one row before the shuffle.
    """
    nothing, rest = F.lit(""), F.col("what") == "rest"
    r = _shaped(rules)
    r = r.withColumn("what", F.when(F.col("type").eqNullSafe("file"), F.when(F.col("path_kind") == "wild", "rest").otherwise("file")).when(F.col("keyed"), "key").otherwise("rest"))
    r = r.withColumn("lined", (F.col("what") == "key") & (F.col("at") == LINE))
    numbers = F.when(F.col("lined"), F.when(F.col("number").isNotNull(), F.array("number")).otherwise(F.flatten(F.transform("ranges", lambda x: F.sequence(x["lo"], x["hi"])))))
    own = F.when(F.col("path_kind") == "folder", F.col("folder")).when(F.col("path_kind") == "path", F.col("p")).otherwise("")
    text = F.when(F.col("text_kind") == "folded", t.lower_ascii(F.col("text"))).when(F.col("text_kind") == "exact", F.col("text")).otherwise("")
    of = F.coalesce("entity_type", nothing)
    kind = F.when(F.col("what") != "key", F.col("what")).otherwise(F.concat_ws(" ", (of != "").cast("string"), "text_kind", "path_kind", F.col("lined").cast("string")))
    key = F.when(F.col("what") == "key", _key(of, F.col("text_kind"), text, F.col("path_kind"), own)).when(F.col("what") == "file", _key(nothing, "", nothing, F.col("path_kind"), own))
    r = r.select("lined", kind.alias("kind"), key.alias("key"), F.when(rest, F.struct(*RULE_FIELDS)).alias("rule"), numbers.alias("numbers"))
    # The generator is outer, and the rows that it adds go here: for a plain one a filter on its array would be pushed below.
    r = r.select("lined", "kind", "key", "rule", F.explode_outer("numbers").alias("n")).filter(~F.col("lined") | F.col("n").isNotNull())
    line = F.when(F.col("lined"), _lines(F.col("n"))).otherwise(nothing)
    return r.groupBy("kind", _at(F.col("key"), line).alias("key"), "rule").agg(F.bit_or(F.when(F.col("lined"), _bit(F.col("n")))).alias("bits"))


def _lines(n: Column) -> Column:
    """Which lines share a key with line n."""
    return F.shiftright(n, LINE_BITS).cast("string")


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(1 << LINE_BITS)).cast("int"))


def _key(type_: Column, text_kind: str | Column, text: Column, path_kind: str | Column, path: Column) -> Column:
    """A key but for its lines."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws("\0", type_, lit(text_kind), text, lit(path_kind), path)


def _at(key: Column, lines: Column) -> Column:
    return F.concat(key, F.lit("\0"), lines)


class RuleTable:
    """A table of rules (the columns of RULES, any of them may be missing) made ready; what is collected are rules with
    wildcards, patterns or long ranges, and the few kinds of keys there are.

    Rules mean what they mean in `suppress`. A row of nulls suppresses everything. Repeated rules count once. Rules that can
    match nothing (a file or line rule without a path) play no part; other columns don't either. A row with `text` and
    `match`, or with lines that are none, is an error when it is read.
    """

    def __init__(self, rules: DataFrame):
        compact = written(_compact(rules), "rules")
        rest = compact.filter("kind = 'rest'").select("rule.*").distinct()
        self.rest = Rules(tuple(Rule(**r.asDict()) for r in rest.toLocalIterator()))
        self.files = compact.filter("kind = 'file'").select("key")
        kinds = [r.kind.split(" ") for r in compact.filter("kind NOT IN ('file', 'rest')").select("kind").distinct().collect()]  # 2 x 3 x 3 x 2 at most
        self.kinds = [(typed == "true", text_kind, path_kind, lined == "true") for typed, text_kind, path_kind, lined in kinds]
        self.keys = compact.filter("kind NOT IN ('file', 'rest')").select("key", "bits")

    def suppressed(self, found: DataFrame) -> DataFrame:
        """found (file and the columns of findings) with `suppressed`; found is written, as it is needed twice."""
        by_plan = is_suppressed(F.col("file"), F.struct(*(F.col(c) for c in FOUND_COLUMNS)), self.rest) if self.rest.matchers else F.lit(False)
        if not self.kinds:
            return found.withColumn("suppressed", by_plan)
        found = written(found, "found")
        place = ["file", "line_num", "col_start", "col_end", "entity_type", "text"]
        path, nothing, number = _path(F.col("file")), F.lit(""), F.col("line_num").cast("long")
        texts = {"none": nothing, "folded": t.lower_ascii(F.col("text")), "exact": F.col("text")}
        keys = []
        for typed, text_kind, path_kind, lined in self.kinds:
            of = lambda p: _at(_key(F.col("entity_type") if typed else nothing, text_kind, texts[text_kind], path_kind, p), _lines(number) if lined else nothing)  # noqa: B023, E731
            keys.append(F.transform(folders(path), of) if path_kind == "folder" else F.array(of(path if path_kind == "path" else nothing)))
        mine = found.select(*place, F.explode(F.array_distinct(F.flatten(F.array(*keys)))).alias("key"), _bit(number).alias("bit"))
        hit = (mine["key"] == self.keys["key"]) & (self.keys["bits"].isNull() | (self.keys["bits"].bitwiseAND(mine["bit"]) != 0))
        hits = mine.join(self.keys, hit, "left_semi").select(*place).distinct().withColumn("hit", F.lit(True))
        return found.join(hits, place, "left").withColumn("suppressed", F.coalesce("hit", F.lit(False)) | by_plan).drop("hit")

    def skipped(self, files: DataFrame, file_col: str = "file") -> DataFrame:
        """The distinct names of files that whole-file rules skip, as `file`: narrow, for an anti-join with what holds texts."""
        names = files.select(F.col(file_col).cast("string").alias("file")).distinct()
        path, nothing = _path(F.col("file")), F.lit("")
        of = lambda kind, p: _at(_key(nothing, "", nothing, kind, p), nothing)
        own = F.concat(F.array(of("path", path)), F.transform(folders(path), lambda p: of("folder", p)))
        hits = names.select("file", F.explode(own).alias("key")).join(self.files, "key", "left_semi").select("file")
        return hits.unionByName(names.filter(is_file_skipped(F.col("file"), self.rest))).distinct()


def folders(path: Column) -> Column:
    """'', 'a/', 'a/b/', .. of a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))


def _ready(rules: DataFrame | RuleTable) -> RuleTable:
    return rules if isinstance(rules, RuleTable) else RuleTable(rules)


def without_suppressed(found: DataFrame, rules: DataFrame | RuleTable) -> DataFrame:
    """The findings that no rule of a table suppresses."""
    return _ready(rules).suppressed(found).filter(~F.col("suppressed")).drop("suppressed")


def ignored_by_file(found: DataFrame, rules: DataFrame | RuleTable) -> DataFrame:
    """file, kept and ignored: how many findings stay, and how many rules suppress."""
    flag = _ready(rules).suppressed(found).groupBy("file")
    return flag.agg(F.count_if(~F.col("suppressed")).alias("kept"), F.count_if("suppressed").alias("ignored"))


def without_skipped(docs: DataFrame, rules: DataFrame | RuleTable, file_col: str = "file") -> DataFrame:
    """docs but for files that whole-file rules name; null names stay."""
    names = _ready(rules).skipped(docs, file_col).withColumnRenamed("file", "__skipped")
    return docs.join(names, docs[file_col].cast("string") == names["__skipped"], "left_anti")
