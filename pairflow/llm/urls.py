"""URL filters: rules of a host (with its subdomains) and a path prefix.

Each distinct URL is expanded into its host suffixes and those path prefixes
whose length some rule's path has. Expressions meet the rules in an equi-join on
a short hash prefix; the full digests then confirm. The longest rule wins; of
equally long ones that with the longer host, then ``block``. Without a rule the
verdict is ``DEFAULT``.

A null URL, or one without ``://``, has an empty host and path and gets the
default. Repeated rows are judged each; an empty table gives no rows. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "allow"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Hexadecimal digits of the digest that the join uses.
PREFIX_DIGITS = 8
#: Rules are broadcast up to this many; with more, the join shuffles.
BROADCAST_RULES = 50_000
A_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) as columns; a host without a path blocks or allows all of it."""
    return spark.createDataFrame([(h.translate(str.maketrans(A_Z, LOWER)), p, v) for h, p, v in rules], "host string, path string, verdict string")


def host_of(url):
    after = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), A_Z, LOWER), F.lit(""))


def path_of(url):
    after = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per distinct url and expression: a host suffix and a path prefix of one of the lengths."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    return (
        urls.where("host <> ''")
        .withColumn("suffix", F.explode(suffixes))
        .where("suffix <> ''")
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
    )


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    rules = rules.select(F.translate("host", A_Z, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_verdict is not null")
    # Distinct lengths of rules' paths: as many as a path has characters at most.
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).groupBy("r_digest", "r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block beats allow
    rules = rules.withColumn("short", F.substring("r_digest", 1, PREFIX_DIGITS))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    parts = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    distinct = parts.select("host", "path").distinct()
    found = (
        expressions(distinct, lengths or [0])
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
        .join(rules, "short")
        .where("digest = r_digest and suffix = r_host and prefix = r_path")
    )
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule"))
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.v").alias("ruled"))
    # Rows without a host have no rule to meet, however many there are: what they are joined on spreads them.
    place = F.when(F.col("host") == "", F.col("page_id").cast("string")).otherwise(F.col("path"))
    met = parts.withColumn("place", place).join(best.withColumnRenamed("path", "place"), ["host", "place"], "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
