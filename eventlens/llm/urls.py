"""URL filters by rule look-up: host suffixes and path prefixes, short hash prefixes, full digests.

Every url is expanded into the pairs of a suffix of its host (on label boundaries) and a prefix of its
path that rules can have; each expression is hashed, and only the short prefix of its digest is
the equi-join key, as in a client that holds prefixes alone. A hit counts when the full digests agree.
Of the hits the longest rule (host and path together, then host) wins; a url without one gets the default verdict.

Path prefixes are only made for the lengths that rules have (a list as short as the rule table's
distinct path lengths), so a long path isn't expanded character by character. Hosts of very many
labels give that many suffixes. Null urls and urls without `://` have empty host and path and fit
no rule. Repeated rules count once; the same host and path with both verdicts is an error. Repeated
pages stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest in the join key.
PREFIX = 8
#: Rules are broadcast up to this many; beyond it the join shuffles on the hash prefix.
BROADCAST_RULES = 100_000


def parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host and path: after the first `://` up to `/`, `?`, `#` or the end; then up to `?`, `#` or the end."""
    at = F.instr(url_col, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumns({"host": F.coalesce(F.translate(host, upper, lower), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (host then path, null if none fits), verdict. rules: host, path (starts with / or empty), verdict."""
    clean = rules.select("host", "path", "verdict").distinct()
    stats = clean.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host", "path").alias("keys"), F.collect_set(F.length("path")).alias("lengths")).first()
    if stats.n != stats.keys:
        raise ValueError("a rule has two verdicts")
    lengths = sorted(stats.lengths)
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    book = clean.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    book = book.withColumn("rule_digest", digest).withColumn("short", F.left("rule_digest", F.lit(PREFIX)))
    if stats.n <= BROADCAST_RULES:
        book = F.broadcast(book)

    asked = parts(pages.select(F.monotonically_increasing_id().alias("row"), id_col, url_col), url_col).drop(url_col)
    distinct = asked.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    wide = distinct.select("host", "path", F.explode(suffixes).alias("suffix"))
    prefixes = F.filter(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    wide = wide.select("host", "path", "suffix", F.explode(F.transform(prefixes, lambda n: F.left("path", n))).alias("prefix"))
    wide = wide.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).withColumn("short", F.left("digest", F.lit(PREFIX)))
    hits = wide.join(book, "short").where("digest = rule_digest")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("best"))
    return asked.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
