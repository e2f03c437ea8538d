"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

import json
import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm.common import checkpointed, column, literal_rows, table

#: Hex digits of a digest that the join uses.
PREFIX_DIGITS = 8
#: Up to so many rules are broadcast; more are joined by shuffle, with skewed prefixes left to adaptive execution.
MAX_BROADCAST_RULES = 50_000
#: The rules of the query.
QUERY_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, rest = rule.partition("/")
    return host, slash + rest


def judge_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id_col, host, path, rule, verdict.

    rules: a table with the columns verdict and rule, or a short list of such pairs; a rule is "host/path-prefix". It
    fits its host and every subdomain when the URL's path starts with the rule's path; of the rules that fit, the longest
    string wins, then the longer host, then block before allow. Without a fitting rule: rule null, verdict `default`.
    Null rules fit nothing; repeated rules are one.

    Each URL is expanded only into the (number of host labels, path length) shapes that some rule has, which are data, not
    branches: their number is bounded by the lengths of URLs and not by the number of rules. A table of rules is written
    to the shared folder, never collected; its hashes are broadcast up to MAX_BROADCAST_RULES. Rows are grouped again by
    their own id, host and path inside their scan partition, so a hot host never gathers in one task; rows repeated
    exactly are counted and restored. Null or malformed URLs: empty host and path, no rule. Other columns of pages are
    not carried (join on id_col). No rules: every row gets the default.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        own = checkpointed(rules.select(column("verdict").cast("string").alias("verdict"), column("rule").cast("string").alias("rule")).filter(F.col("rule").isNotNull()).distinct())
        host = F.substring_index("rule", "/", 1)
        found = own.select(F.size(F.split(host, r"\.")).alias("n"), (F.length("rule") - F.length(host)).alias("k")).distinct().collect()  # label counts x path lengths at most
        shapes, n_rules = {(r["n"], r["k"]) for r in found}, own.count()
    else:
        listed = sorted({(verdict, rule) for verdict, rule in rules if rule is not None})
        own = literal_rows(spark, json.dumps([{"verdict": v, "rule": r} for v, r in listed]), "verdict:string,rule:string")
        shapes, n_rules = {(len((hp := _split_rule(rule))[0].split(".")), len(hp[1])) for _, rule in listed}, len(listed)
    by_labels = [{"n": n, "lengths": sorted(k for m, k in shapes if m == n)} for n in sorted({n for n, _ in shapes})]

    url = F.col("url")
    rows = (
        pages.select(column(id_col).alias("id"), column(url_col).cast("string").alias("url"))
        .select("id", F.spark_partition_id().alias("part"), url_host(url).alias("host"), url_path(url).alias("path"))
    )
    labels, shape = F.size(F.split("host", r"\.")), F.from_json(F.lit(json.dumps(by_labels)), "array<struct<n:int,lengths:array<int>>>")

    def expressions(x: Column) -> Column:
        suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -x["n"])
        fitting = F.filter(x["lengths"], lambda k: k <= F.length("path"))
        return F.transform(fitting, lambda k: F.concat(suffix, F.substring(F.col("path"), F.lit(1), k)))

    expanded = rows.withColumn("exprs", F.flatten(F.transform(F.filter(shape, lambda x: x["n"] <= labels), expressions)))
    expanded = expanded.withColumn("n_exprs", F.greatest(F.size("exprs"), F.lit(1)))
    expanded = expanded.withColumn("expr", F.explode_outer("exprs")).drop("exprs").withColumn("digest", F.sha2(F.col("expr"), 256))
    expanded = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))

    by_prefix = (
        own.select(
            F.sha2(F.col("rule"), 256).alias("digest"),
            F.struct(F.length("rule").alias("size"), F.length(F.substring_index("rule", "/", 1)).alias("host"), (F.col("verdict") == "block").cast("int").alias("block"), "rule", "verdict").alias("is"),
        )
        .groupBy(F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"))
        .agg(F.collect_list(F.struct("digest", "is")).alias("rules"))
    )
    # cut off, a long list is dealt anew by the join, which can then split what meets a prefix that many URLs have
    by_prefix = F.broadcast(by_prefix) if n_rules <= MAX_BROADCAST_RULES else checkpointed(by_prefix)
    joined = expanded.join(by_prefix, "prefix", "left")
    confirmed = F.array_max(F.transform(F.filter("rules", lambda r: r["digest"] == F.col("digest")), lambda r: r["is"]))
    best = joined.groupBy("id", "host", "path", "part").agg((F.count(F.lit(1)) / F.max("n_exprs")).cast("bigint").alias("copies"), F.max(confirmed).alias("best"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), QUERY_RULES)


def _fits(rule: str) -> str:
    host, path = _split_rule(rule)
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_ORDERED = sorted(QUERY_RULES, key=lambda r: -len(r[1]))
OP1_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _ORDERED)} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE rule {' '.join(f"WHEN '{r}' THEN '{v}'" for v, r in _ORDERED)} ELSE 'allow' END AS verdict FROM ruled
"""
