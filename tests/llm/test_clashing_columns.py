"""Operators that keep a table's columns keep those that are named like their own."""


def test_deduplicate_keeps_all_columns(spark):
    from briefmill.llm.exact_dedup import deduplicate

    columns = "doc_id long, text string, _text string, _copies long, _ID long, _sha string, _text_ string"
    rows = [(1, "Same", "a", 7, 8, "s", "x"), (2, "same", "b", 9, 10, "t", "y"), (2, "same", "b", 9, 10, "t", "y"), (3, None, None, None, None, None, None)]
    got = deduplicate(spark.createDataFrame(rows, columns))
    assert got.columns == ["doc_id", "text", "_text", "_copies", "_ID", "_sha", "_text_"] and sorted(map(tuple, got.collect())) == rows[2:]
    once = deduplicate(spark.createDataFrame(rows[:1], columns))
    assert list(map(tuple, once.collect())) == rows[:1]


def test_removed_lines_leave_all_columns(spark):
    from briefmill.llm.line_dedup import remove

    line = "a line of some words that stands twice in this table"
    rows = [(1, f"{line}\nother words are here", "kept", 1), (2, f"{line}\nwhat only this one says", None, 2)]
    got = remove(spark.createDataFrame(rows, "doc_id long, text string, _gone string, line_no long"))
    assert got.columns == ["doc_id", "text", "_gone", "line_no"]
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "what only this one says", None, 2)]


def test_scratch_tables_go(spark):
    import os

    from briefmill.llm.common import materialize, scratch

    there = lambda t: os.path.exists(t.stored_at.removeprefix("file:"))
    with scratch() as keep:
        with scratch() as inner:
            a, b = materialize(spark.range(3), "a"), inner(materialize(spark.range(4), "b"))
        assert not there(a) and there(b) and b.count() == 4
        c = keep(materialize(spark.range(5), "c"))
    assert not there(b) and there(c) and c.count() == 5
    assert there(materialize(spark.range(1), "d"))
