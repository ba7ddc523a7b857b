"""WARC archives of pages, and a globally ordered index of their captures by external merging.

Archives are written by Spark's text sink: a row is a record and the line separator is the blank line that ends it, so
the files are WARC 1.1 as they stand and the sink's commit protocol covers lost tasks. Reading back goes by
Content-Length over whole files, which are gzipped; offsets are those of the plain bytes. Each archive is a run of captures sorted by URL key and time; range partitioning
deals every run's segments out, and each partition merges its k segments with a loser tree, so that the partitions in
order hold the capture history of each URL. A URL with any part of the rows is split by time and page.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BYTES = 100
GAP = b"\r\n\r\n"
FILE_RECORDS = 10_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURES = (
    "urlkey string, captured string, page_id long, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, archive string, offset long, length long"
)


def urlkey(url: str) -> str:
    """Host labels from the top domain down, then path and sorted query, all lower-case; fragments and ports go."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")[::-1] if host else []
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return (",".join(labels) + ")" + (parts.path or "/") + ("?" + query if query else "")).lower()


def _captured(page_id: Column) -> Column:
    """The pages carry no time of capture; a page's number stands for seconds since 2020."""
    second = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000)) + F.lit(1_577_836_800)
    return F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, captured: Callable[[Column], Column] = _captured) -> None:
    """Write a record for each row of pages (page_id, url, html). Of equal payloads of at least LEAST_BYTES bytes the
    smallest page_id is a response and the others are revisits of it. A null html is an empty payload, a null url has no
    target; a null page_id has no record id and is a revisit only where another page has the payload. Rows that repeat
    the response's page_id are responses too."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("_html"))
    rows = rows.withColumn("_digest", F.sha2(F.col("_html").cast("binary"), 256)).withColumn("_n", F.octet_length("_html"))
    first = rows.filter(F.col("_n") >= LEAST_BYTES).groupBy("_digest")
    first = first.agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies")).filter("_copies > 1").drop("_copies")
    rows = rows.join(first, "_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("_html")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "+")
    line = lambda name, c: F.concat(F.lit(name + ": "), c.cast("string"), F.lit("\r\n"))
    page = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    whose = F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.coalesce(line("WARC-Record-ID", page), F.lit("")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", captured(F.col("page_id"))),
        F.when(again, line("WARC-Refers-To", whose)).otherwise(F.lit("")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        line("X-Payload-Length", F.col("_n")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    # the join's partitions are the files
    out = rows.select(record.alias("value")).write.option("lineSep", GAP.decode()).option("compression", "gzip")
    out.option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, headers and block of each record of an archive."""
    at, view = 0, memoryview(content)
    while at < len(content):
        head = content.find(GAP, at)
        if not content.startswith(b"WARC/", at) or head < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:head].decode().split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        begin = head + len(GAP)
        end = begin + int(headers["content-length"])
        yield at, end + len(GAP) - at, headers, view[begin:end]
        at = end + len(GAP)


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content.startswith(b"\x1f\x8b") else content


def _page(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("_place", pa.int64()),
    ])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for at, length, headers, block in records(_plain(content.as_py())):
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                n = int(headers["x-payload-length"])
                if headers["warc-type"] == "response":
                    payload = block[bytes(block[:400]).index(GAP) + len(GAP) :]
                    if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: the record at byte {at} is damaged")
                key = urlkey(headers.get("warc-target-uri", ""))
                page, whose = _page(headers.get("warc-record-id")), _page(headers.get("warc-refers-to"))
                rows.append((key, headers["warc-date"], page, headers["warc-type"], whose, digest, n, path, at, length))
            rows.sort(key=_order)
            rows = [(*r, i) for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)],
                schema=schema,
            )


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def loser_tree_merge(runs: list[list[tuple]], key: Callable[[tuple], tuple] = _order) -> Iterator[tuple[int, int]]:
    """Run and place in it of each row of k sorted runs in merged order; ties go to the earlier run.

    Inner nodes hold the losers of their matches, so that replacing the winner replays one path of log2(k) matches.
    """
    k = len(runs)
    at = [0] * k
    heads = [(key(r[0]), i) if r else None for i, r in enumerate(runs)]
    beats = lambda a, b: heads[b] is None or heads[a] is not None and heads[a] < heads[b]
    tree = [-1] * max(1, k)
    for i in range(k):
        player, node = i, (i + k) // 2
        while node > 0:
            if tree[node] < 0:
                tree[node], player = player, -1
                break
            if beats(tree[node], player):
                tree[node], player = player, tree[node]
            node //= 2
        if player >= 0:
            tree[0] = player
    while k and heads[best := tree[0]] is not None:
        yield best, at[best]
        at[best] += 1
        heads[best] = (key(runs[best][at[best]]), best) if at[best] < len(runs[best]) else None
        player, node = best, (best + k) // 2
        while node > 0:
            if beats(tree[node], player):
                tree[node], player = player, tree[node]
            node //= 2
        tree[0] = player


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range, which come run by run: merged, in batches."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    keys = list(zip(*(table.column(c).to_pylist() for c in ("urlkey", "captured", "page_id")), strict=True))
    archive = table.column("archive").to_pylist()
    begins = [i for i in range(len(keys)) if not i or archive[i] != archive[i - 1]] + [len(keys)]
    runs = [keys[a:b] for a, b in zip(begins, begins[1:], strict=False)]
    order = [begins[run] + place for run, place in loser_tree_merge(runs)]
    yield from table.take(pa.array(order, pa.int64())).drop_columns(["_place"]).to_batches(max_chunksize=10_000)


def capture_index(spark, path: str, partitions: int | None = None) -> DataFrame:
    """A row for each record of the archives under path, globally ordered by URL key, time and page."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = files.mapInArrow(_runs, CAPTURES + ", _place long")
    keys = ["urlkey", "captured", "page_id"]
    ranges = runs.repartitionByRange(partitions, *keys) if partitions else runs.repartitionByRange(*keys)
    return ranges.sortWithinPartitions("archive", "_place").mapInArrow(_merge, CAPTURES)
