"""URL filter: host-suffix and path-prefix expressions against a table of rules.

Every distinct (host, path) is expanded into the expressions that a rule could
be written as: its host's suffixes at label borders, times the prefixes of its
path, at the label counts and path lengths that occur in the rules. Expressions
and rules meet in an equi-join on the first ``prefix_chars`` hex digits of
their SHA-256; equal full digests confirm a match, and the longest rule wins.
DataFrame functions only. A hot URL is judged once and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import read_table

KEY = "op10_url_filter"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(rules: DataFrame, prefix_chars: int) -> DataFrame:
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    out = rules.select(host.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"),
                       F.col("verdict").alias("rule_verdict"))
    out = out.withColumn("rule", F.concat("rule_host", "rule_path"))
    return out.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, prefix_chars))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", prefix_chars: int = 8) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, a row per row of ``pages``.

    ``rules`` has columns host, path and verdict. A rule fits its host and all
    subdomains when the path starts with the rule's; the longest wins, and of
    one rule given with both verdicts, block does. ``default`` is the verdict
    where no rule fits.

    Defined cases: a null url, or one without ``://``, has an empty host and
    path and meets only a rule with both empty. Null ids and repeated rows are
    kept as they are; a null host or path of a rule counts as empty. Very long
    urls are expanded only at lengths that rules have. Other columns are
    ignored; without rules every row gets the default, no pages give no rows.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    table = rule_table(rules, prefix_chars)
    # the lengths at which to cut: one small row, no longer than the longest rule
    cut = table.agg(F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"),
                    F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    labels = F.array(*[F.lit(x) for x in cut["labels"]]).cast("array<int>")
    lengths = F.array(*[F.lit(x) for x in cut["lengths"]]).cast("array<int>")
    names = F.split("host", r"\.")
    suffixes = F.transform(F.filter(labels, lambda k: k <= F.size(names)),
                           lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")),
                           lambda k: F.substring(F.col("path"), F.lit(1), k))
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = (parsed.select("host", "path").distinct()
                .select("host", "path", F.explode(made).alias("expression"))
                .select("host", "path", F.sha2("expression", 256).alias("full"))
                .withColumn("short", F.substring("full", 1, prefix_chars)))
    found = expanded.join(table, "short").filter(F.col("full") == F.col("digest"))
    best = found.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("size"), (F.col("rule_verdict") == "block").alias("blocks"),
        F.col("rule"), F.col("rule_verdict"))).alias("best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")
    return url_filter(read_table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule_host, rule_path, verdict) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + r"""),
m AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
             arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM (SELECT DISTINCT host, path FROM u) JOIN r
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY ALL)
SELECT page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""
