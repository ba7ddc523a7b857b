"""Texts are split into lines and pages into tokens once, and what is empty has no row."""

from briefmill.operators import chunks


def test_texts_are_split_once(spark):
    texts = [(1, "a b\n  \nc\r\n\r\nd"), (2, ""), (3, None), (4, " \t\n\x0b"), (5, " x ")]
    rows = chunks.parents(chunks.pages(spark.createDataFrame(texts, "doc_id long, text string"), 2))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # before, filters made it four
    found = [tuple(r) for r in rows.select("doc_id", "page_number", "page_parent_index", "tokens").orderBy("doc_id", "page_number").collect()]
    assert found == [(1, 1, 0, ["a", "b", "c"]), (1, 2, 0, ["d"]), (5, 1, 0, ["x"])]
