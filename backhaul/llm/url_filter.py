"""URL rules as intervals of canonical keys, swept in sorted order.

Only DataFrame functions. A key is the host with its labels reversed, followed by the
path (``org.example/es/7``). A rule is then a prefix, a prefix an interval
``[prefix, prefix + 0xFF)`` of bytes, and intervals of rules nest. The sweep sorts
rule boundaries and url keys together; each boundary brings the whole stack of rules
that are open from there on, and a url takes the stack of the last boundary before it.

A rule also fits subdomains, so a url is looked up once for each of its last 1..n host
labels, n being the most labels a rule has; each lookup is one more sort of the same
partition, without a shuffle. Urls are dealt out evenly (never by host, so a hot host
does no harm), and the boundaries, two per rule, go to every partition.

Defined cases: host and path of a null url or one without ``://`` are empty; such a url
fits no rule. Without a rule the verdict is ``block`` for an empty host, else ``allow``.
Of rules for the same host and path, ``block`` wins; among rules that fit, the longest
wins, then the one with more host labels. Repeated rows stay repeated. A null page_id
is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

# Verdict, host and path of the base rules
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(labels)), path).cast("binary")


def boundaries(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(key, stack): from this key on, these rules are open, outermost first."""
    named = spark.createDataFrame(rules, "verdict string, host string, path string")
    named = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat(F.concat_ws(".", F.reverse(F.split("host", r"\."))), F.col("path"))
    named = named.select(
        text.alias("prefix"),
        F.struct(
            F.length(F.concat("host", "path")).alias("long"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("rule"),
    )
    lengths = F.explode(F.sequence(F.lit(1), F.length("prefix")))
    inside = named.select("prefix", lengths.alias("n")).select("prefix", F.expr("left(prefix, n)").alias("outer"))
    outer = named.select(F.col("prefix").alias("outer"), "rule")
    pair = F.struct(F.length("outer").alias("n"), "rule")
    nested = inside.join(outer, "outer").groupBy("prefix").agg(F.sort_array(F.collect_list(pair)).alias("open"))
    stack = F.transform("open", lambda x: x["rule"])
    starts = nested.select(F.col("prefix").cast("binary").alias("key"), stack.alias("stack"))
    ends = nested.select(
        F.concat(F.col("prefix").cast("binary"), F.lit(b"\xff")).alias("key"),
        F.slice(stack, F.lit(1), F.size("open") - 1).alias("stack"),
    )
    return starts.union(ends)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    depth = max((len(host.split(".")) for _, host, _ in rules), default=1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select("page_id", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    labels = F.split("host", r"\.")
    keys = [
        F.when(F.size(labels) >= n, key_of(F.slice(labels, -n, n), F.col("path"))).alias(f"key{n}")
        for n in range(1, depth + 1)
    ]
    urls = urls.select(
        "page_id", "host", "path", F.lit(True).alias("is_url"), *keys,
        F.lit(None).cast("array<struct<long:int,labels:int,rule:string,verdict:string>>").alias("stack"),
        F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("deal"),
    )
    edges = boundaries(spark, rules).select(
        F.lit(None).cast("long").alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"),
        F.lit(False).alias("is_url"), *[F.col("key").alias(f"key{n}") for n in range(1, depth + 1)], "stack",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("deal"),
    )
    swept = urls.union(edges)
    for n in range(1, depth + 1):
        sweep = Window.partitionBy("deal").orderBy(f"key{n}", "is_url").rowsBetween(Window.unboundedPreceding, 0)
        swept = swept.withColumn(f"open{n}", F.last("stack", ignorenulls=True).over(sweep))
    tops = [F.when(F.size(f"open{n}") > 0, F.element_at(f"open{n}", -1)) for n in range(1, depth + 1)]
    best = F.array_max(F.array(*tops))
    otherwise = F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit("allow"))
    judged = swept.where("is_url").withColumn("best", best)
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", otherwise).alias("verdict"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
  FROM v JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT v.page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN fits ON v.page_id = fits.page_id
"""
