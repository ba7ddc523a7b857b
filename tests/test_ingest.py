"""The document source, tables in buckets and files that arrive and change."""

import io
import os
import random
import time
import zipfile

import pytest

from briefmill.operators.chunks import children, parents
from briefmill.sources.page_source import listing, register, splits
from briefmill.sources.stores import Buckets, Store
from briefmill.streaming.ingest import Ingest


def docx(paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    runs = lambda p: "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in p.split("|"))
    body = "".join(f"<w:p>{runs(p)}</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_pages_of_a_folder(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/_hidden").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(f"line {i}" for i in range(120)))
    (tmp_path / "in/deep/b.docx").write_bytes(docx(["First |paragraph", "", "Second"]))
    (tmp_path / "in/blank.txt").write_text(" \n\n")
    (tmp_path / "in/broken.docx").write_bytes(b"no zip")
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "in/d.odd").write_text("?")
    (tmp_path / "in/_hidden/e.txt").write_text("not read")
    register(spark)
    rows = spark.read.format("briefmill_pages").load(str(tmp_path / "in")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["file_path"][len(str(tmp_path / "in")) + 1 :], []).append(r)
    assert set(by) == {"a.txt", "deep/b.docx", "blank.txt", "broken.docx", "c.pdf", "d.odd"}
    assert [(r["page_number"], r["total_pages"], r["text"].split("\n")[0]) for r in by["a.txt"]] == [(1, 3, "line 0"), (2, 3, "line 50"), (3, 3, "line 100")]
    assert [(r["page_number"], r["text"]) for r in by["deep/b.docx"]] == [(1, "First paragraph\nSecond")]
    assert [(r["page_number"], r["total_pages"], r["error"]) for r in by["blank.txt"]] == [(None, 0, None)]
    assert all(by[f][0]["error"] and by[f][0]["text"] is None for f in ("broken.docx", "c.pdf", "d.odd")) and "unsupported" in by["d.odd"][0]["error"]
    assert by["d.odd"][0]["bytes"] == 1 and by["d.odd"][0]["content_md5"]
    assert spark.read.format("briefmill_pages").load(str(tmp_path / "nothing")).count() == 0
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("briefmill_pages").load().count()


def test_splits_by_bytes(tmp_path):
    files = [(f"f{i}", 0, s) for i, s in enumerate([10_000] * 5 + [100_000] + [0] * 3)]
    got = [[f[2] for f in s.files] for s in splits(files, 25_000)]
    assert got == [[10_000, 10_000], [10_000, 10_000], [10_000], [100_000], [0, 0, 0]] and splits([], 5) == []
    assert listing(str(tmp_path / "none")) == []


def test_buckets(spark, tmp_path):
    """Many changes of keys leave what a dictionary holds."""
    rng = random.Random(3)
    table, held = Buckets(Store(spark, str(tmp_path)), "t", "k", "k string, v long", 4), {}
    for _ in range(4):
        new = {f"k{rng.randint(0, 9)}/ö": [rng.randint(0, 9) for _ in range(rng.randint(1, 3))] for _ in range(4)}
        gone = [f"k{rng.randint(0, 9)}/ö"]
        rows = spark.createDataFrame([(k, v) for k, vs in new.items() for v in vs], "k string, v long")
        for _ in range(2):  # done again it changes nothing
            table.upsert(rows, spark.createDataFrame([(k,) for k in gone], "k string"))
        held = {k: v for k, v in held.items() if k not in gone} | new
        assert sorted(map(tuple, table.read().collect())) == sorted((k, v) for k, vs in held.items() for v in vs)
    table.delete(spark.createDataFrame([(k,) for k in held], "k string"))
    assert table.read().count() == 0


def test_files_that_arrive_twice_and_change(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    texts, clock = {}, [time.time() - 1000]

    def put(name, text):
        (folder / name).write_text(text)
        clock[0] += 10
        os.utime(folder / name, (clock[0], clock[0]))
        texts[str(folder / name)] = text

    def run():
        query = Ingest(store, buckets=4).start(spark, str(folder), str(tmp_path / "check"))
        query.awaitTermination()
        assert query.exception() is None

    def check():
        from briefmill.sources.files import load_pages

        want = children(parents(load_pages(spark, str(folder / "*.txt")).filter("error IS NULL"))).collect()
        strip = lambda d: d.removeprefix("file:")
        got = Ingest(store, buckets=4).chunks.read().collect()
        key = lambda r: (strip(r["doc_id"]), r["page_number"], r["chunk_index"], tuple(r["tokens"]))
        assert sorted(map(key, got)) == sorted(map(key, want))
        return {strip(r["doc_id"]): r for r in Ingest(store, buckets=4).versions.read().collect()}

    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    put("a.txt", words(700, "a"))
    put("b.txt", words(20, "b"))
    run()
    assert set(check()) == set(texts)
    put("a.txt", words(40, "new"))  # shorter than before
    put("c.txt", words(300, "c"))
    before = check_versions = Ingest(store, buckets=4).versions.read().filter("doc_id LIKE '%b.txt'").first()
    put("b.txt", texts[str(folder / "b.txt")])  # the same again
    run()
    versions = check()
    assert set(versions) == set(texts) and versions[str(folder / "b.txt")]["modified"] == before["modified"] == check_versions["modified"]
    run()  # a restart from the checkpoint with nothing new
    put("old.txt", "arrives late")
    os.utime(folder / "old.txt", (1000, 1000))  # with a time before all others
    run()
    assert str(folder / "old.txt") in check()
    ingest = Ingest(store, buckets=4)
    rows = spark.read.format("briefmill_pages").load(str(folder))
    ingest.batch(rows, 99)
    assert set(check()) == set(texts)
    (folder / "c.txt").rename(folder / "gone")
    os.remove(folder / "gone")
    ingest.forget(spark.createDataFrame([(str(folder / "c.txt"),)], "doc_id string"))
    check()
