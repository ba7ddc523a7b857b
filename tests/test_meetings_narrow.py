"""What moves for pairs is far less than the pairs, and the lines are read once for both kinds of conflicts."""

import time

import pytest
from pyspark.sql import functions as F

from briefmill.operators import conflicts
from briefmill.plans import catalogue
from briefmill.sources.stores import Store


@pytest.mark.parametrize("name", ["contradictions_all", "contradiction_table_rows", "value_conflicts", "value_conflicts_normalized", "absence_conflicts"])
def test_lines_are_read_once(spark, name):
    rows = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in rows.inputFiles() if "lineitem" in f]  # before, each kind of conflict made the clauses of the lines


def test_documents_move_once_for_many_pairs(spark):
    rows = spark.range(4000).selectExpr("id AS document_id", "'Governing Law' AS clause_type", "true AS found", "concat('law ', id % 2) AS normalized_value")
    classes = conflicts.classes(conflicts.both_kinds(rows))
    moved = conflicts.meetings(classes).agg(F.sum(F.size("documents_x") + F.size("documents_y")).alias("n")).first()["n"]
    assert conflicts.pairs(classes).count() == 4_000_000 and moved <= 8_000  # before, 32,000 and more


def test_sentences_are_made_after_the_meetings_are_dealt(spark):
    rows = spark.range(40).selectExpr("id AS document_id", "'Governing Law' AS clause_type", "true AS found", "concat('law ', id % 2) AS normalized_value")
    plan = conflicts.contradictions(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Conflicting" not in plan[plan.index("RepartitionByExpression") :]  # before, each meeting made them in its join too


def test_shuffle_files_of_a_kept_table_are_removed(spark, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = manager.getAllBlocks()
        return {x for x in (found.apply(i).toString() for i in range(found.size())) if x.startswith("shuffle_")}

    before = shuffled()
    Store(spark, str(tmp_path)).append(spark.range(100).groupBy(F.col("id") % 7).count(), "t")
    for _ in range(50):  # they go a little later
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left  # before, they stayed until the driver collected its garbage
    assert spark.read.parquet(f"{tmp_path}/t").count() == 7
