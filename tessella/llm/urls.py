"""URL filters by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEFAULT = "allow"
PREFIX_HEX = 8  # hex digits of the short hash that is joined on
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """Every page's verdict by the longest rule (host, path, verdict) that fits.

    Different (host, path) pairs are expanded: each suffix of the host at a dot, times each prefix of the path of a
    length that some rule's path has. The short hash of host and prefix is joined with the rules' and the full
    digest confirms. Of the rules that fit, the one of the longest host, then the longest path, decides. Verdicts go
    back to the pages by (host, path).

    Returns page_id, host, path, rule (host and path together, null if none fits), verdict. Null urls and those
    without "://" have an empty host and path, which no rule fits; urls and rules of any length and number of lengths
    are expanded whole; a rule given twice is one, and of two verdicts on the same host and path the one later in the
    alphabet holds; repeated rows and null ids stay; an empty table gives no rows, no rules the default for all; other
    columns, whatever their names, are left out.
    """
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))

    kept = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    # NUL can't be in a host's or path's place where it would join two expressions into one
    digest = lambda h, p: F.sha2(F.concat_ws("\0", h, p), 256)
    kept = kept.withColumn("digest", digest(F.col("rule_host"), F.col("rule_path")))
    known = kept.select(F.substring("digest", 1, PREFIX_HEX).alias("short"), F.col("digest").alias("rule_digest"), "rule_host", "rule_path", "rule_verdict")

    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)))
    pairs = rows.where("host <> ''").select("host", "path").distinct()
    own = F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    prefixed = pairs.withColumn("prefix", F.explode(F.transform(own, lambda n: F.substr(F.col("path"), F.lit(1), n))))
    expressed = prefixed.withColumn("suffix", F.explode(F.array_distinct(suffixes))).withColumn("full", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    hits = expressed.join(known, "short").where(F.col("full") == F.col("rule_digest"))
    # grouped by one key that holds both, so that the join below deals its own exchange, which Spark may split
    best = hits.groupBy(F.struct("host", "path").alias("page")).agg(F.max(F.struct(F.length("rule_host").alias("h"), F.length("rule_path").alias("p"), "rule_host", "rule_path", "rule_verdict")).alias("best"))
    verdicts = best.select(F.col("page.host").alias("host"), F.col("page.path").alias("path"), F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.rule_verdict").alias("found"))
    return rows.join(verdicts, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))


def op4_urls(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH u AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT h.*, (SELECT struct_pack(rule := rh || rp, v := v) FROM r
               WHERE (h.host = rh OR h.host LIKE '%.' || rh) AND starts_with(h.path, rp)
               ORDER BY length(rh) DESC, length(rp) DESC LIMIT 1) AS b FROM h
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM f
"""
