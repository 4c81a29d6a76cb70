"""Stages of the pipeline decide by row: rows whose doc_id is null or repeated go only if the method rejects them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, text(1), "en", "s", 1), (None, text(2), "en", "s", 1), (None, "short", "en", "s", 1), (7, text(3), "en", "s", 1), (7, text(4), "en", "s", 1), (7, "bad", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(df):
    return sorted(r.text for r in df.collect())


def test_quality_and_near_dedup(spark, docs):
    whole = sorted(text(k) for k in (1, 2, 3, 4))
    clean = corpus_pipeline.quality_rules(spark, docs, "")
    assert texts(clean) == whole
    assert texts(corpus_pipeline.near_dedup(spark, clean, "")) == whole
    twice = clean.unionByName(clean).unionByName(clean.withColumn("doc_id", F.lit(3).cast("long")))
    left = corpus_pipeline.near_dedup(spark, twice, "").collect()
    assert sorted(r.text for r in left) == whole and {r.doc_id for r in left} == {3}


def test_secrets_of_repeated_ids(spark):
    rows = [(7, "password=hunter22 end", "en", "s", 1), (7, "so the token: abcdefgh9", "en", "s", 1), (None, "passwd=hunter33", "en", "s", 1), (None, "clean", "en", "s", 1)]
    got = corpus_pipeline.secret_scan(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert texts(got) == sorted(["[secret] end", "so the [secret]", "[secret]", "clean"])


def test_mixing_takes_unnamed_rows(spark, docs):
    rows = corpus_pipeline.keyed(docs)
    want = rows.join(mixing.mix(rows, corpus_pipeline.KEY).select(corpus_pipeline.KEY, "copies"), corpus_pipeline.KEY).collect()
    assert texts(corpus_pipeline.mix_sources(spark, docs, "")) == sorted(r.text for r in want for _ in range(r.copies)) and any(r.copies and r.doc_id is None for r in want)
