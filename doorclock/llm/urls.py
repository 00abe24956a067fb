"""Allow and block rules on URLs, looked up by hashed host-suffix and path-prefix expressions.

A rule names a host and the start of a path. A URL is expanded into the expressions under which a
rule could be stored (its host and the parents of it, each with prefixes of its path), every
expression is hashed, and the short hash prefix is the key of an equi-join with the rules. The full
digest confirms a match, and the longest matching rule decides. Only pairs of label count and path
length that some rule has are expanded, so a very long URL has no more expressions than that.

Defined results: a null URL, or one without `://`, has an empty host and path and no rule; without a
rule the default verdict holds; a rule with a null host or path never fits; of equal rules with
different verdicts the block wins; an empty table gives an empty table; a column of the input that
has the name of a result column is replaced by it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorclock.llm.columns import packed, unpacked
from doorclock.plans.staging import staged

# Rules of the query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end; A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests of the host suffixes and path prefixes of the given (labels, path length).

    The shapes are one constant array, so the plan stays as small with thousands of them.
    """
    known = F.from_json(F.lit(json.dumps([{"labels": n, "size": size} for n, size in shapes])), "array<struct<labels:int,size:int>>")
    labels, length = F.size(F.split(host, r"\.")), F.length(path)
    fitting = F.filter(known, lambda s: (s["labels"] <= labels) & (s["size"] <= length))
    suffix = lambda s: F.call_function("substring_index", host, F.lit("."), -s["labels"])
    return F.transform(fitting, lambda s: digest(suffix(s), F.substring(path, F.lit(1), s["size"])))


def filtered(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row with `host`, `path`, the deciding `rule` (or null) and the `verdict`."""
    keyed = rules.where("host is not null and path is not null and verdict is not null").select(
        "verdict",
        F.col("host").alias("_rule_host"),
        F.concat("host", "path").alias("rule"),
        F.size(F.split("host", r"\.")).alias("_labels"),
        F.length("path").alias("_size"),
        digest(F.col("host"), F.col("path")).alias("_digest"),
    )
    keyed = staged(keyed.withColumn("_key", F.substring("_digest", 1, PREFIX_HEX)), "url_rules")
    # At most as many shapes as label counts times path lengths of rules, however many rules there are.
    shapes = sorted((r[0], r[1]) for r in keyed.select("_labels", "_size").distinct().collect())

    rows = packed(urls)
    value = F.col("row").getField(url)
    rows = rows.withColumns({"_host": url_host(value), "_path": url_path(value)})
    # A verdict depends on host and path alone, so copies of a URL are looked up once.
    asked = rows.select("_host", "_path").distinct()
    hashed = asked.select("_host", "_path", F.explode(expressions(F.col("_host"), F.col("_path"), shapes)).alias("_full"))
    matches = hashed.withColumn("_key", F.substring("_full", 1, PREFIX_HEX)).join(keyed, "_key").where(
        F.col("_full") == F.col("_digest")
    )
    best = matches.groupBy("_host", "_path").agg(
        F.max(F.struct(F.length("rule").alias("size"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("_best")
    )
    decided = rows.join(best, ["_host", "_path"], "left")
    return unpacked(decided, urls.columns, {
        "host": F.col("_host"),
        "path": F.col("_path"),
        "rule": F.col("_best.rule"),
        "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default)),
    })


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filtered(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
with rules(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
after as (select row_number() over () as r, page_id,
  case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
part as (select r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from after),
best as (select part.r, max_by(struct_pack(rule := rules.host || rules.path, verdict := rules.verdict),
    length(rules.host || rules.path)) as b
  from part join rules on (part.host = rules.host or ends_with(part.host, '.' || rules.host))
    and starts_with(part.path, rules.path) group by part.r)
select page_id, host, path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict from part left join best using (r)
"""
