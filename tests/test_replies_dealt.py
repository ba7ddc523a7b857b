"""Prompts are made and told apart once, however many waves they are asked in."""

from pyspark.sql import functions as F

from briefmill.sources.stores import Store, replies


def test_waves_read_their_own_part(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def prompt(i):
        made.add(1)
        return f"p{i % 50}"

    rows = spark.range(100).select("id", prompt("id").alias("prompt"))
    got = replies(Store(spark, str(tmp_path)), rows, "m", lambda some: some.withColumn("raw", F.upper("prompt")), wave=5)
    assert made.value <= 400  # a count and one table, each makes a prompt twice; before, ten waves made them too
    assert {(r["id"], r["raw"]) for r in got.collect()} == {(i, f"P{i % 50}") for i in range(100)}
