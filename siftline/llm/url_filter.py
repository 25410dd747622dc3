"""URL filters by hash-prefix lookup.

Each URL becomes the expressions (host suffix + path prefix) that any rule could be written as. Expressions and rules
meet in an equi-join on a short prefix of their SHA-256; full digests confirm a hit, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the hash prefix that the join uses (32 bits).
PREFIX_HEX = 8
#: Rule tables of at most so many rows are broadcast: about 100 bytes each, so 20 MB.
BROADCAST_RULES = 200_000
#: Path lengths that rules may have before path prefixes are cut at every length instead of at those in use.
MAX_LENGTHS = 200

ALLOW, BLOCK = "allow", "block"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where the URL is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return lower_ascii(host), path


def host_suffixes(host: Column, most: int) -> Column:
    """The host's ends of up to `most` labels, the host itself among them if it is as short."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(labels))), lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def filter_urls(
    urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW, broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """One row for each row of `urls`: its columns `__row.*` as a struct `row`, host, path, rule and verdict.

    A rule fits its host and all subdomains of it if the URL's path starts with the rule's path. Of fitting rules the
    longest (host and path together, then host) wins; rules given twice with different verdicts: block wins. A URL
    without a fitting rule gets a null rule and the default verdict. Null URLs and such without `://` have an empty
    host and path, and fit no rule. Repeated rows stay repeated. An empty rule table gives the default verdict to all.
    Rules are normalised: a null host or path counts as empty, hosts are lower-cased; rules with an empty host are
    dropped, since they would fit none.
    """
    rules = (
        rules.select(
            lower_ascii(F.coalesce("rule_host", F.lit(""))).alias("rule_host"),
            F.coalesce("rule_path", F.lit("")).alias("rule_path"),
            F.coalesce("verdict", F.lit(BLOCK)).alias("rule_verdict"),
        )
        .filter("rule_host != ''")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule_digest", F.sha2(F.concat("rule_host", F.lit(" "), "rule_path"), 256))
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    )
    lengths = [r[0] for r in rules.select(F.length("rule_path").alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()]
    n_rules = rules.limit(broadcast_rules + 1).count()
    most_labels = rules.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1))).first()[0]

    host, path = host_and_path(F.col(url_col))
    rows = urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    # Equal host and path: equal answer. A hot URL is one row from here on; partial aggregation comes before the shuffle.
    distinct = rows.select("host", "path").filter("host != ''").distinct()
    if len(lengths) > MAX_LENGTHS:
        prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    else:
        cuts = F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("path"))
        prefixes = F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        distinct.withColumn("host_part", F.explode(host_suffixes(F.col("host"), most_labels)))
        .withColumn("path_part", F.explode(prefixes))
        .withColumn("digest", F.sha2(F.concat("host_part", F.lit(" "), "path_part"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    side = F.broadcast(rules) if n_rules <= broadcast_rules else rules
    best = (
        expressions.join(side, "prefix")
        .filter("digest = rule_digest")
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("n"),
                    F.length("rule_host").alias("h"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    "rule_verdict",
                )
            ).alias("best")
        )
    )
    # URLs without a host would be one large key of the join; they fit no rule.
    judged = rows.filter("host != ''").join(best, ["host", "path"], "left").select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(rows.filter("host = ''").select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


#: The rules of the registered query.
RULES = [
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_table(spark, RULES)).select("row.page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE_SQL = f"""
WITH rules(rule_verdict, h, p) AS (VALUES {_RULE_ROWS}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest),
best AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(rule_verdict, length(h || p) * 1000 + length(h)) AS v
  FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best
"""
