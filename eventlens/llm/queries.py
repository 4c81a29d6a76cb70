"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from eventlens.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(coded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import substring

    out = substring.remove_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


#: The rules of the registered query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


ORACLES["op3_url_filter"] = r"""
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
parts AS (SELECT row_number() OVER () AS n, page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM cut),
best AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts, rules
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import simhash

    groups = simhash.near_groups(table(spark, sf_dir, "documents"), n=3, words=1, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import quality

    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import merkle

    out = merkle.fingerprints(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import secrets

    found = secrets.find(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [count(k) for k in ("assign", "access", "hex")]
    digest = F.sha2(F.encode(secrets.listed(F.col("base")), "UTF-8"), 256).alias("base_sha256")
    live = F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live")
    copied = secrets.listed(F.filter("all", lambda s: ~s["live"])).alias("copied_spans")
    return found.select("doc_id", *kinds, digest, secrets.listed(F.col("all")).alias("spans"), live, copied)


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import language
    from eventlens.llm.common import crc_mod

    docs = table(spark, sf_dir, "documents")
    books = language.dictionaries(docs, crc_mod(F.col("doc_id"), 4) != 2)
    out = language.predict(docs, books)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import toxicity
    from eventlens.llm.common import crc_mod

    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("id"), 3) != 1)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import codes

    out, books = codes.compress(table(spark, sf_dir, "embeddings"))
    text = F.array_join(F.transform("codes", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")
    return out.select("vec_id", text.alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def op11_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm import neighbours
    from eventlens.llm.common import crc_mod

    docs = table(spark, sf_dir, "documents")
    model = neighbours.learn(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("id"), 3) != 1)
    out = neighbours.score(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
