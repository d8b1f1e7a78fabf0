"""URL filters with built-in functions only: expressions of each URL meet rules on short hash prefixes.

A URL's expressions are suffixes of its host (at dots) with prefixes of its path (at slashes), as many as the deepest rule has labels
and slashes: longer ones can meet no rule. A rule is filed under its
host and its path up to the last slash, so each rule that fits has its file among the expressions. Expressions and rules meet
by an equi-join on the first hex digits of SHA-256, the full digests confirm it, and the rule's whole path is then compared.
The longest rule (host and path together) wins, then the longer host, then block.

Rows of one key and URL travel as one with their count, and are combined before the shuffle, so a URL of a third of all rows
is no hot key. Rules are broadcast up to BROADCAST_RULES rows; more are joined by a shuffle, in which AQE splits the suffix that most
URLs have.

Nulls: a null URL, or one without '://', has an empty host and path, no rule and the default verdict; null keys are values.
Empty texts: as without '://'. Very long URLs: whole; their expressions are bounded by the rules. Ties: see above; rules given twice count
once. Repeated rows come back as often. Empty tables give no rows; empty rules give the default. Other columns aren't carried, and keys
travel in one struct, so no name can clash but a key's with a column of the result (ValueError).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 10_000
#: Hex digits of the digest that the join compares.
PREFIX = 8
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _filed(path: Column) -> Column:
    """A path up to its last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(df: DataFrame, rules: DataFrame, *, url_col: str = "url", key_cols: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """One row per row of df: key_cols, host, path, rule (host and path of the rule that wins, else null), verdict."""
    if clash := {c.lower() for c in key_cols} & {"host", "path", "rule", "verdict"}:
        raise ValueError(f"key columns with names of the result: {sorted(clash)}")
    url = F.col(url_col)
    urls = df.select(F.struct(*[F.col(c) for c in key_cols]).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = rules.select(F.translate("host", UPPER, LOWER).alias("rhost"), F.coalesce("path", F.lit("")).alias("rpath"), F.col("verdict").alias("rverdict")).distinct()
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    deep = own.agg(F.max(F.size(F.split("rhost", r"\.", -1))).alias("labels"), F.max(slashes(F.col("rpath"))).alias("slashes"), F.count("*").alias("n")).first()
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(deep["labels"] or 1)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i)))
    upto = F.least(slashes(F.col("path")), F.lit(deep["slashes"] or 0))
    prefixes = F.transform(F.sequence(F.lit(0), upto), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), i), F.lit("/"))))
    spread = urls.select("key", "host", "path", F.explode(suffixes).alias("suffix")).select("key", "host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    spread = spread.select("key", "host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
    own = own.withColumn("rdigest", _digest(F.col("rhost"), _filed(F.col("rpath")))).withColumn("rshort", F.substring("rdigest", 1, PREFIX))
    if deep["n"] <= BROADCAST_RULES:
        own = F.broadcast(own)
    met = spread.join(own, F.substring("digest", 1, PREFIX) == F.col("rshort"))
    won = F.struct((F.length("rhost") + F.length("rpath")).alias("n"), F.length("rhost").alias("h"), (F.col("rverdict") == "block").alias("b"), F.concat("rhost", "rpath").alias("rule"), F.col("rverdict").alias("verdict"))
    hits = met.where((F.col("digest") == F.col("rdigest")) & F.startswith("path", "rpath")).select("key", "host", "path", F.lit(0).alias("one"), won.alias("won"))
    every = urls.select("key", "host", "path", F.lit(1).alias("one"), F.lit(None).cast(hits.schema["won"].dataType).alias("won"))
    judged = every.unionByName(hits).groupBy("key", "host", "path").agg(F.sum("one").alias("rows"), F.max("won").alias("won"))
    again = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return again.select(*[F.col("key")[c].alias(c) for c in key_cols], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
