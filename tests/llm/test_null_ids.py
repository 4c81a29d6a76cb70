"""Rows without an id go through every operator and stage; each gives them a row, near-dedup and mixing of the pipeline leave them out."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlens.llm import bpe, language, merkle, mixing, quality, secrets, simhash, substring, toxicity

TEXT = " ".join(f"word{k}" for k in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, TEXT, "en", "s", 1), (None, None, None, None, None), (1, TEXT, "en", "s", 1), (2, TEXT + " password=hunter22", "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


OPERATORS = {
    "encode": lambda d: bpe.decode(bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "substring": substring.remove_duplicates,
    "simhash": simhash.near_groups,
    "quality": quality.judge,
    "secrets": secrets.find,
    "mixing": mixing.mix,
    "merkle": merkle.fingerprints,
    "language": lambda d: language.predict(d, language.dictionaries(d, F.lit(True))),
    "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, d.select("doc_id", F.lit(1).alias("toxic")), F.lit(True))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, name):
    assert OPERATORS[name](docs).count() == 4


def test_stages(spark, docs):
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "").cache()
        at.count()
    assert {r.doc_id for r in at.collect()} == {1}
