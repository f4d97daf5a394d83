"""URL filters (operator 4): a sort-merge range join on reversed-host keys.

``www.example.com`` becomes ``com.example.www.``; a rule's host becomes a prefix of the keys of its
host and all subdomains, hence an interval of the sorted keys. Rules and pages are sorted together;
a sweep in key order keeps, for each number of labels, the rule host that began last, which is the
stack of nested intervals: those that still are prefixes of a page's key are active. Of the active
hosts' rules, the longest whose path begins the page's path decides.

Rows are dealt out by top label and a salt in proportion to how many pages a label has, with
the rules of that label beside each share, so neither a hot host nor a hot label is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.common import cut, table

#: Rules of the registered query: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Shares of pages for each shuffle partition.
SHARES = 4
#: Rows of shares by label up to which they are broadcast (about 4 MB).
FOLDED_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(map(str, RULES)) + " as rules(host, path, verdict)")


def host_of(url: str = "url"):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str = "url"):
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) as (page_id, host, path, rule, verdict), a row for each row.

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains if the url's path
    starts with its path. The longest rule wins, by host and path together, then by host; of rules
    with the same host and path the least verdict. A null url, or one without ``://``, has empty host
    and path and fits no rule; a rule with null or empty host is left out, a null path is empty.
    Other columns are not read, repeated rows are kept, empty tables are fine.
    """
    spark = pages.sparkSession
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
    own = own.where("host <> ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    nodes = own.groupBy("host").agg(
        F.map_from_entries(F.collect_list(F.struct("path", F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("n_host"))))).alias("paths"),
        F.array_sort(F.collect_set(F.length("path"))).alias("sizes"),
    )
    nodes = nodes.select(host_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("depth"), "paths", "sizes")
    depths = [r.depth for r in nodes.select("depth").distinct().orderBy("depth").collect()]

    rows = pages.select("page_id", host_of().alias("host"), path_of().alias("path")).withColumn("key", host_key(F.col("host")))
    top = F.substring_index("key", ".", 1)
    shares = SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # shares of each top label that rules have; pages of other labels fit no rule
    labels = nodes.select(top.alias("top")).distinct()
    with_top = rows.withColumn("top", top)
    counts = with_top.groupBy("top").agg(F.count("*").alias("c")).join(labels, "top")
    n_all = F.sum("c").over(Window.partitionBy())
    counts = cut(counts.select("top", F.ceil(F.col("c") * shares / n_all).cast("int").alias("n_salts")))
    # not every page needs the label's count: one share in `shares` is drawn first, then folded
    page_salt = F.pmod(F.xxhash64("page_id", "path", "key"), F.lit(shares)).cast("int")
    probes = with_top.withColumn("draw", page_salt)
    folded = counts.select("top", "n_salts", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("draw")).select("top", "draw", (F.col("draw") % F.col("n_salts")).alias("salt"))
    starts = nodes.withColumn("top", top).join(counts, "top").select("top", F.explode(F.expr("sequence(0, n_salts - 1)")).alias("salt"), "key", "depth", "paths", "sizes")
    probes = probes.join(F.broadcast(folded) if len(depths) and _small(counts, FOLDED_ROWS // shares) else folded, ["top", "draw"], "left")
    probes = probes.select("top", F.coalesce("salt", "draw").alias("salt"), "key", "page_id", "host", "path")
    both = starts.select("top", "salt", "key", F.struct("key", "paths", "sizes").alias("node"), "depth", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"))
    both = both.unionByName(probes.withColumns({"node": F.lit(None).cast(both.schema["node"].dataType), "depth": F.lit(None).cast("int")}))
    # by key, a host's rules before its pages
    sweep = Window.partitionBy("top", "salt").orderBy("key", F.col("depth").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    stack = F.array(*(F.last(F.when(F.col("depth") == d, F.col("node")), ignorenulls=True).over(sweep) for d in depths)) if depths else F.array().cast(f"array<{both.schema['node'].dataType.simpleString()}>")
    swept = both.withColumn("stack", stack).where("depth is null")
    active = F.filter("stack", lambda n: n.isNotNull() & F.col("key").startswith(n["key"]))
    fitting = F.flatten(F.transform(active, lambda n: F.filter(F.transform(n["sizes"], lambda k: F.element_at(n["paths"], F.substring(F.col("path"), F.lit(1), k))), lambda r: r.isNotNull())))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["n_host"].alias("n_host"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    out = swept.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _small(counts: DataFrame, most: int) -> bool:
    return counts.limit(most + 1).count() <= most


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_table(spark))


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT parts.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS rn
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE rn = 1
"""
