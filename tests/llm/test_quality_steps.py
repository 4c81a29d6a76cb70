"""What the quality rules write on their way."""

from pyspark.sql import functions as F

from eventlens.llm import quality


def test_a_step_is_checkpointed_once(spark, monkeypatch):
    """One for the spread, three for the starts and one a step."""
    z = list(quality.FLOORS)
    rows = spark.range(400).select(*((F.rand(k) + F.col("id") % 2).alias(x) for k, x in enumerate(z)), F.lit("all").alias("grp")).cache()
    seen = []

    def counted(df, cut=quality.cut):
        seen.append(df)
        return cut(df)

    monkeypatch.setattr(quality, "cut", counted)
    monkeypatch.setattr(quality, "STEPS", 1)
    assert quality.determinants(rows, z).count() == 1
    assert len(seen) == 5
    rows.unpersist()
