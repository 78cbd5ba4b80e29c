"""URL filters as a sort-merge range join on reversed-host keys.

A rule (host, path, verdict) fits the host and all of its subdomains where the url's path starts with the
rule's. Hosts are written as reversed labels, each ended by ``/`` (``com/example/``), so a host and its
subdomains are one interval of keys. A url is looked up at each of its ancestor hosts that has rules; there its
key is the path, and a rule is the interval of paths that start with its own. Rules of one host nest like
brackets, so a sorted sweep needs only the top of its stack: where a rule's interval begins the rule is on top,
where it ends its enclosing rule is. The enclosing rule is found beforehand from the rules alone, with an
equi-join on the prefixes of each rule's path. The sweep itself is one window over rule events and distinct
url paths in key order. The longest rule (host and path together) of all ancestor hosts wins; of rules equally
long the one with the longer host, then ``block``.

A host that many urls share is dealt out in salts, each with the host's events; equal urls are swept once.

Defined cases: null or unparsable urls have empty host and path; a host with an empty label (``a..com``) is
taken literally; urls that no rule fits get ``default`` and a null rule; repeated rules count once (of
contradicting ones ``block`` stays); rules with null host or path are ignored; empty tables give empty results
or the default; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomroute.plans.workspace import checked_broadcast, save, shuffle_width

from .text import ascii_lower

#: Fewest distinct url keys of one host that are worth a salt of their own.
SALT_ROWS = 1000
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


def _ancestors(host: Column) -> Column:
    """Reversed keys of the host and all hosts above it."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "/"), F.lit("/")))


def _events(rules: DataFrame) -> DataFrame:
    """(at, key, side, top): from key on, ``top`` is the innermost rule at host ``at``. Keys are binary; 0xFF ends an interval."""
    own = rules.select("at", "path", F.struct("host", "path", "verdict").alias("own"))
    cut = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring("path", F.lit(1), n))
    prefixes = own.where(F.length("path") > 0).select("at", "path", F.explode(cut).alias("prefix"))
    above = own.select("at", F.col("path").alias("prefix"), F.col("own").alias("above"))
    outer = prefixes.join(above, ["at", "prefix"]).groupBy("at", "path").agg(F.max_by("above", F.length("prefix")).alias("outer"))
    nested = own.join(outer, ["at", "path"], "left")
    key = F.col("path").cast("binary")
    begins = nested.select("at", key.alias("key"), F.lit(0).alias("side"), F.struct(F.col("own").alias("rule")).alias("top"))
    ends = nested.select("at", F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("side"), F.struct(F.col("outer").alias("rule")).alias("top"))
    return begins.unionByName(ends)


def judge(urls: DataFrame, rules: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(host, path, rule_host, rule_path, verdict) of the distinct (host, path) in ``urls``; no row for urls that no rule fits."""
    clean = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    clean = save(clean.withColumn("at", reversed_host(F.col("host"))), "rules")
    hosts = clean.select("at").distinct()
    n_hosts = hosts.count()
    asked = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).select("host", "path", F.explode(_ancestors(F.col("host"))).alias("at"))
    asked = save(asked.join(checked_broadcast(hosts, n_hosts), "at"), "asked")
    # A quarter of an even share for each salt, so that the hosts' salts spread over all tasks.
    size = max(salt_rows, asked.count() // (4 * shuffle_width(asked.sparkSession)))
    salts = asked.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("salts"))
    events = _events(clean).join(salts, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "side", "top", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    dealt = asked.join(checked_broadcast(salts, n_hosts), "at").select(
        "at", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), F.col("path").cast("binary").alias("key"), F.lit(1).alias("side"), F.lit(None).cast(events.schema["top"].dataType).alias("top"), "host", "path"
    )
    sweep = Window.partitionBy("at", "salt").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.unionByName(dealt).withColumn("on_top", F.last("top", ignorenulls=True).over(sweep)).where(F.col("side") == 1)
    rule = F.col("on_top.rule")
    best = F.struct((F.length(rule["host"]) + F.length(rule["path"])).alias("length"), F.length(rule["host"]).alias("host_length"), rule["verdict"].alias("verdict"), rule["host"].alias("rule_host"), rule["path"].alias("rule_path"))
    return swept.where(rule.isNotNull()).groupBy("host", "path").agg(F.max(best).alias("b")).select("host", "path", "b.rule_host", "b.rule_path", "b.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    parsed = save(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    judged = judge(parsed, rules, salt_rows)
    out = parsed.join(judged, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.concat("rule_host", "rule_path").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the query, fixed by its contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, verdict DESC) AS k
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN fit ON u.page_id = fit.page_id AND k = 1
"""
