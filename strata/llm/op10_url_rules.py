"""URL filters: sort-merge range join of urls and nested host/path rules.

A host is turned round label by label, so a rule's host and all its subdomains
are one interval of keys; below one host a rule's path is an interval of paths.
Both kinds nest.  A url is written once for each of its host's suffixes that
has rules (at most as many as it has labels), keyed ``reversed host \\x00 path``.
Urls and rule starts are then sorted together and swept: each rule row carries
the stack of the rules that are open where it starts, a url takes the stack of
the last rule before it, and the longest entry that is a prefix of the url's
path is the rule it meets.  Of the rules met under all suffixes the longest
(host and path together, then host) wins.

Skew: the sweep of a host is split into as many lanes as its urls ask for
(``LANE_ROWS`` each); each lane gets a copy of that host's rules.

Cases: a null url, or one without ``://``, has empty host and path, meets no
rule and gets ``default``.  Repeated rows come back as often as they came in;
null ids stay null.  Rules with null fields are skipped; of equal (host, path)
rules with different verdicts ``block`` wins.  An empty table gives no rows, an
empty rule table gives ``default`` throughout.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANE_ROWS = 250_000
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_host(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.expr("substring(url, locate('://', url) + 3)")
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.expr("substring(url, locate('://', url) + 3)")
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule: ``suffix`` (reversed host), ``path`` and ``stack``, the
    rules of that host open at its start, shortest first, itself last."""
    one = (rules.where("host is not null and path is not null and verdict is not null")
           .groupBy(_reversed(F.col("host")).alias("suffix"), "host", "path")
           .agg(F.max("verdict").alias("verdict")))
    # the rules open at a start are those on prefixes of its path: an equi join on (host, prefix)
    outer = one.select(F.col("suffix").alias("s2"), F.col("path").alias("prefix"),
                       F.struct(F.length("path").alias("n"), "host", "path", "verdict").alias("rule"))
    inner = one.select("suffix", "path", F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("prefix"))
    met = inner.join(outer, (F.col("suffix") == F.col("s2")) & (inner["prefix"] == outer["prefix"]))
    return met.groupBy("suffix", "path").agg(F.sort_array(F.collect_list("rule")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", lane_rows: int = LANE_ROWS) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``."""
    url = F.col("url")
    seen = (pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
            .groupBy("id", "url").agg(F.count(F.lit(1)).alias("times"))
            .withColumns({"host": F.coalesce(url_host(url), F.lit("")), "path": F.coalesce(url_path(url), F.lit(""))}))
    stacks = rule_stacks(rules)
    suffixes = F.expr("transform(sequence(1, size(labels)), n -> array_join(slice(labels, 1, n), '.'))")
    points = (seen.withColumn("labels", F.reverse(F.split("host", r"\.", -1)))
              .select("id", "url", "times", "host", "path", F.explode(suffixes).alias("suffix")))
    hosts = stacks.select("suffix").distinct()
    # how many urls fall under each ruled host: a partial count, then one row per ruled host
    load = (points.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).join(hosts, "suffix")
            .select("suffix", F.ceil(F.col("n") / lane_rows).cast("int").alias("lanes")))
    lanes = load.withColumnRenamed("suffix", "ruled")
    under = points.join(lanes, F.col("suffix") == F.col("ruled"))
    lane = F.pmod(F.xxhash64("id", "url"), F.col("lanes")).cast("int")
    none = F.lit(None)
    marks = (stacks.join(lanes, F.col("suffix") == F.col("ruled"))
             .select("suffix", F.explode(F.expr("sequence(0, lanes - 1)")).alias("lane"), "path", "stack",
                     F.lit(0).alias("kind"), none.cast(seen.schema["id"].dataType).alias("id"), none.cast("string").alias("url"),
                     none.cast("string").alias("host"), F.lit(0).cast("long").alias("times")))
    swept = under.select("suffix", lane.alias("lane"), "path", none.cast(stacks.schema["stack"].dataType).alias("stack"),
                         F.lit(1).alias("kind"), "id", "url", "host", "times").unionByName(marks)
    order = Window.partitionBy("suffix", "lane").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = (swept.withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
           .withColumn("rule", F.expr("try_element_at(filter(open, r -> startswith(path, r.path)), -1)"))
           .where("rule is not null")
           .select("id", "url", F.struct(
               (F.length("rule.host") + F.length("rule.path")).alias("n"), F.length("rule.host").alias("nh"),
               F.concat("rule.host", "rule.path").alias("rule"), F.col("rule.verdict").alias("verdict")).alias("best")))
    rows = (seen.select("id", "url", "times", "host", "path", F.lit(None).cast(met.schema["best"].dataType).alias("best"))
            .unionByName(met, allowMissingColumns=True)
            .groupBy("id", "url").agg(F.max("times").alias("times"), F.max("host").alias("host"),
                                      F.max("path").alias("path"), F.max("best").alias("best")))
    return (rows.withColumn("_", F.explode(F.expr("sequence(1L, times)")))
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(verdict, host, path)")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.page_id, p.host, p.path, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := r.verdict)) AS best
  FROM p LEFT JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY ALL)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""
