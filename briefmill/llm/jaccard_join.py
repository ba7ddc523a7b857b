"""Size-aware Jaccard join of shingle sets: subsets for small sets, inverted lists for large ones.

A small set enumerates its subsets of the size that a link needs; sets that meet in such a subset are linked. Large
sets scan inverted lists. The boundary is the size at which the estimated cost of both parts is least.

The lists are built from blocks of documents: a block sends each bucket of hashes its distinct shingles, sorted and
packed, and learns which occur elsewhere and how often. A shingle of one document alone can't be in an overlap, so
only documents with fewer of these than a link allows go on, with their rarest other shingles as entries of the lists. A
block sends a shingle once however many of its documents have it, so a frequent one is no larger than others.

Links within a list are found without pairing all with all: first neighbours in order of size are compared and linked
documents contracted; then entries are compared with those of other components than their own. No pair that may be
linked and isn't yet connected is left out; parities of the sets rule out most others before they become rows. Equal sets are one set from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import give_back, materialize, mix64, pack_sorted, unpack_sorted
from briefmill.llm.components import components
from briefmill.llm.shingles import digest, shingle_sets

#: Sets up to this size may count as small; the boundary is chosen at or below it.
MOST_SMALL = 20
BLOCK_BYTES, BLOCK_DOCS, BUCKET_BYTES = 16_000_000, 60_000, 8_000_000
#: Bytes of texts that are read as sets at once.
READ_BYTES = 2_000_000
MANY = 0xFFFF
#: Places of a list within which entries are compared at first, and 64-bit words of an outline for the lists.
NEAREST, FOLDS = 6, 8
#: Estimated cost of a list's entry, with the comparisons that it leads to, in enumerated subsets.
ENTRY_COST = 12.0


def needed(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of n and m elements with Jaccard similarity of at least percent/100."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes that a set linked with one of n elements can have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def boundary(histogram: dict[int, int], percent: int, most: int = MOST_SMALL) -> int:
    """The size up to which enumeration is cheapest, given how many sets have each size up to `most`."""
    small = {n: sum(comb(n, needed(n, m, percent)) for m in partners(n, percent)) for n in histogram if n}
    large = {n: ENTRY_COST * (n - -(-percent * n // 100) + 1) for n in histogram if n}
    cost = lambda x: sum(k * (small if n <= x else large)[n] for n, k in histogram.items() if n)
    return min(range(most + 1), key=lambda x: (cost(x), x))


def _blocks(buckets: int, words: int):
    """Rows of a block: kind 0, its distinct shingles for one bucket; kind 1, its documents, for the block itself."""

    def flush(block: int, ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        # arrays as long as the block's words are let go as soon as they have served: a task holds few of them at once
        sizes = np.array([len(s) for s in sets], np.int64)
        docs = [
            {"doc_id": i, "n": int(n), "digest": digest(s), "small": s.astype("<u8").tobytes() if n <= MOST_SMALL else None}
            for i, n, s in zip(ids.to_pylist(), sizes, sets, strict=True)
        ]
        flat = np.concatenate(sets)
        sets.clear()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order]
        del order
        begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
        count = np.diff(np.append(begin, len(flat))).astype(np.uint32)
        keys, who = flat[begin], np.where(count > 1, MANY, owner[begin]).astype(np.uint16)
        del begin
        shared = np.repeat(count > 1, count)
        own_keys, own_who = np.ascontiguousarray(flat[shared]).tobytes(), owner[shared].tobytes()
        del flat, owner, shared
        # the least key of each bucket
        bounds = [-(-(b << 32) // buckets) << 32 for b in range(buckets)]
        cut = np.append(np.searchsorted(keys, np.array(bounds, np.uint64)), len(keys))
        rows: dict[str, list] = {c: [] for c in ("bucket", "kind", "block", "keys", "who", "counts", "docs")}

        def add(**row):
            for c, values in rows.items():
                values.append(row.get(c))

        for b in range(buckets):
            part = slice(cut[b], cut[b + 1])
            if part.start < part.stop:
                counts = count[part][who[part] == MANY].astype("<u4")
                add(bucket=b, kind=0, block=block, keys=pack_sorted(keys[part]), who=who[part].tobytes(), counts=counts.tobytes())
        add(bucket=block % buckets, kind=1, block=block, keys=own_keys, who=own_who, counts=b"", docs=docs)
        return pa.RecordBatch.from_pydict(rows, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids, texts, sets, size, read, made = [], [], [], 0, 0, 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i.as_py())
                texts.append(t)
                size += len(t or b"")
                read += len(t or b"")
                full = size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS
                if full or read >= READ_BYTES:  # texts go as they are read
                    sets += shingle_sets(texts, words)
                    texts, read = [], 0
                if full:
                    yield flush(task << 24 | made, pa.array(ids, pa.int64()), sets)
                    ids, sets, size, made = [], [], 0, made + 1
        if ids:
            sets += shingle_sets(texts, words)
            texts = []
            yield flush(task << 24 | made, pa.array(ids, pa.int64()), sets)
        give_back()

    return run


_DOC = "array<struct<doc_id: long, n: long, digest: binary, small: binary>>"
_SQL = f"bucket int, kind int, block long, keys binary, who binary, counts binary, docs {_DOC}"
_ARROW = pa.schema([
    ("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("who", pa.binary()),
    ("counts", pa.binary()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("small", pa.binary())]))),
])


def _lists(table: pa.Table) -> pa.Table:
    """A bucket: which shingles occur in two documents or more, for each block; the blocks' own rows pass through."""
    rows = table.to_pylist()
    sent = [r for r in rows if r["kind"] == 0]
    keys = [unpack_sorted(r["keys"]) for r in sent]
    who = [np.frombuffer(r["who"], np.uint16) for r in sent]
    out = [r for r in rows if r["kind"] == 1]
    if sent:
        counts = []
        for w, r in zip(who, sent, strict=True):
            c = np.ones(len(w), np.int64)
            c[w == MANY] = np.frombuffer(r["counts"], "<u4")
            counts.append(c)
        flat, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        total = np.empty(len(flat), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], begin), np.diff(np.concatenate([begin, [len(flat)]])))
        at = 0
        for r, k, w in zip(sent, keys, who, strict=True):
            t = total[at : at + len(k)]
            at += len(k)
            more = t > 1
            rarity = np.minimum(np.round(8 * np.log2(t[more])), 255).astype(np.uint8)
            out.append({**r, "keys": pack_sorted(k[more]), "who": w[more].tobytes(), "counts": rarity.tobytes()})
    return pa.Table.from_pylist(out, schema=_ARROW)


_FOUND = "row long, doc_id long, n long, digest binary, small binary, keys binary, prefix array<long>, outline binary, fold array<long>"
_FOUND_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("small", pa.binary()),
    ("keys", pa.binary()), ("prefix", pa.list_(pa.int64())), ("outline", pa.binary()), ("fold", pa.list_(pa.int64())),
])


def parity(keys: np.ndarray, bits: int) -> bytes:
    """The parity of how many keys fall on each bit."""
    at = (keys & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def outline(keys: np.ndarray) -> bytes:
    """The parities on about as many bits as there are keys."""
    return parity(keys, 1 << max(6, int(len(keys) - 1).bit_length()))


def most_overlap(n: int, m: int, a: bytes, b: bytes) -> int:
    """An upper bound of the overlap of two sets of n and m keys with these outlines."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    # bit i of a larger outline counts keys whose low bits are i: its parts add up to the smaller outline
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def _documents(percent: int):
    """A block: its documents, and of those that may be linked the shingles found elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 1)
        shared, owner = np.frombuffer(own["keys"], np.uint64), np.frombuffer(own["who"], np.uint16)
        keys, who, rarity = [], [], []
        for r in rows:
            if r["kind"] == 0:
                k, w, t = unpack_sorted(r["keys"]), np.frombuffer(r["who"], np.uint16), np.frombuffer(r["counts"], np.uint8)
                one = w != MANY
                begin, end = np.searchsorted(shared, k[~one], "left"), np.searchsorted(shared, k[~one], "right")
                many = end - begin
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
                keys += [k[one], np.repeat(k[~one], many)]
                who += [w[one], owner[at]]
                rarity += [t[one], np.repeat(t[~one], many)]
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        who = np.concatenate(who) if who else np.empty(0, np.uint16)
        rarity = np.concatenate(rarity) if rarity else np.empty(0, np.uint8)
        order = np.lexsort((keys, rarity, who))
        keys, who = keys[order], who[order]
        cut = np.searchsorted(who, np.arange(len(own["docs"]) + 1))
        out: dict[str, list] = {f.name: [] for f in _FOUND_ARROW}
        for i, d in enumerate(own["docs"]):
            mine, n = keys[cut[i] : cut[i + 1]], d["n"]
            useful = len(mine) - -(-percent * n // 100) + 1 if n else 0  # the prefix less the shingles found nowhere else
            out["row"].append(own["block"] << 16 | i)
            for c in ("doc_id", "n", "digest", "small"):
                out[c].append(d[c])
            live = useful > 0 and len(mine) > 0
            out["keys"].append(np.sort(mine).tobytes() if live else None)
            out["prefix"].append(mine[:useful].view(np.int64) if live else None)
            out["outline"].append(outline(mine) if live else None)
            out["fold"].append(np.frombuffer(parity(mine, 64 * FOLDS), np.int64) if live else None)
        return pa.Table.from_pydict(out, schema=_FOUND_ARROW)

    return run


def _subsets(percent: int, most: int):
    """key, row, least: the subsets in which a small set meets sets that it is linked with; least: it is the smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, least = [], [], []
            for row, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(blob, np.uint64)
                n = len(values)
                for m in partners(n, percent):
                    if m > most or m < 1:
                        continue
                    size = needed(n, m, percent)
                    chosen = np.array(list(combinations(range(n), size)), np.int64).reshape(-1, size)
                    label = np.uint64((min(n, m) * 64 + max(n, m)) * BASE_LABEL % 2**64)
                    h = mix64(mix64(values)[chosen].sum(axis=1, dtype=np.uint64) + label)
                    keys.append(h.view(np.int64))
                    rows.append(np.full(len(h), row))
                    least.append(np.full(len(h), n <= m))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (keys, rows, least)], ["key", "row", "least"]
                )

    return run


BASE_LABEL = 0xD1B54A32D192ED03


def _neighbours(percent: int):
    """Pairs of entries that are within NEAREST places of each other in a list; a is the smaller row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            entry = [batch.column(c).to_numpy() for c in ("key", "n", "row")]
            if tail is not None:
                entry = [np.concatenate(x) for x in zip(tail, entry, strict=True)]
            key, n, row = entry
            found = [np.empty((0, 2), np.int64)]
            for k in range(1, NEAREST + 1):
                meet = (key[k:] == key[:-k]) & (100 * n[:-k] >= percent * n[k:]) & (row[k:] != row[:-k])
                a, b = row[:-k][meet], row[k:][meet]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            tail = [x[-NEAREST:] for x in entry]
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _outline_test(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = [
                most_overlap(ka, kb, oa, ob) >= needed(na, nb, percent)
                for na, nb, ka, kb, oa, ob in zip(*(x[c] for c in ("na", "nb", "ka", "kb", "oa", "ob")), strict=True)
            ]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlap_test(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                na, nb, xa, xb = (batch.column(c)[i].as_py() for c in ("na", "nb", "xa", "xb"))
                both = np.intersect1d(np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64), assume_unique=True)
                keep.append(100 * len(both) >= percent * (na + nb - len(both)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows of sets whose similarity is enough."""
    slim = sets.select("row", "n", F.expr("length(keys) div 8").alias("k"), "outline")
    side = lambda c: slim.select(*[F.col(x).alias(y) for x, y in (("row", c), ("n", "n" + c), ("k", "k" + c), ("outline", "o" + c))])
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.filter(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
    near = materialize(near.mapInArrow(_outline_test(percent), "a long, b long, na long, nb long"), "near")
    near = near.join(sets.select(F.col("row").alias("a"), F.col("keys").alias("xa")), "a")
    near = near.join(sets.select(F.col("row").alias("b"), F.col("keys").alias("xb")), "b")
    return materialize(near.mapInArrow(_overlap_test(percent), "a long, b long"), "links")


def join(docs: DataFrame, percent: int = 80, words: int = 5, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text): documents are linked when their shingle sets
    have a Jaccard similarity of at least percent/100, and component_id is the smallest doc_id reachable by links.

    A null text, or one without words, has an empty set and is linked with nothing. Equal texts are linked. Rows that
    repeat a doc_id are distinct documents; a null doc_id takes part but names no component unless all in it are null.
    An empty table gives an empty result. Columns besides doc_id and text are not read. Shingles are told apart by
    64-bit hashes.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(buckets, words), _SQL)
    listed = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lists, _SQL)
    found = materialize(listed.groupBy("block").applyInArrow(_documents(percent), _FOUND), "sets")
    classes = found.filter("n > 0").groupBy("n", "digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"))
    classes = materialize(classes, "classes")
    one = found.join(classes.select("row"), "row", "left_semi")

    histogram = {r[0]: r[1] for r in one.filter(f"n <= {MOST_SMALL}").groupBy("n").count().collect()}  # MOST_SMALL rows
    most = boundary(histogram, percent)
    met = one.filter(f"n > 1 AND n <= {most}").select("row", "small")
    met = materialize(met.mapInArrow(_subsets(percent, most), "key long, row long, least boolean"), "subsets")
    centre = met.groupBy("key").agg(F.min(F.when(F.col("least"), F.col("row"))).alias("b"), F.count("*").alias("n"))
    links = met.join(centre.filter("b IS NOT NULL AND n > 1"), "key").select(F.col("row").alias("a"), "b").filter("a <> b")

    large = materialize(one.filter(f"prefix IS NOT NULL AND n >= {-(-percent * (most + 1) // 100)}"), "large")
    entries = large.select("row", "n", F.explode("prefix").alias("key"))
    ranges = entries.repartitionByRange("key", "n", "row").sortWithinPartitions("key", "n", "row")
    pairs = materialize(ranges.mapInArrow(_neighbours(percent), "a long, b long").distinct(), "pairs")
    links = links.unionByName(_linked(pairs, large, percent))
    links = materialize(links, "links")
    joined = components(links)

    # lists that still hold more than one component
    k = F.expr("int(length(keys) div 8)").alias("k")
    folds = large.select(F.col("row").alias("id"), k, *[F.get("fold", i).alias(f"f{i}") for i in range(FOLDS)])
    named = entries.join(joined, entries["row"] == joined["node"], "left")
    named = named.select("key", "row", "n", F.coalesce("root", "row").alias("part"))
    sizes = named.groupBy("key", "part").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts"))
    mixed = materialize(named.join(mixed.filter("parts > 1"), "key").drop("parts"), "mixed")
    full = mixed.join(folds, mixed["row"] == folds["id"]).drop("id")
    left = full.filter("part <> main").drop("main").withColumnsRenamed({c: "x" + c for c in full.columns if c != "key"})
    right = full.drop("main").withColumnsRenamed({c: "y" + c for c in full.columns if c != "key"})
    # pairs of other components whose sizes and parities allow enough overlap
    apart = " + ".join(f"bit_count(xf{i} ^ yf{i})" for i in range(FOLDS))
    least = f"((xn + yn) * {percent} + {99 + percent}) div {100 + percent}"
    close = F.expr(
        f"xpart <> ypart AND 100 * least(xn, yn) >= {percent} * greatest(xn, yn) AND (xk + yk - ({apart})) div 2 >= {least}"
    )
    rest = left.join(right, (left["key"] == right["key"]) & close)
    rest = rest.select(F.least("xrow", "yrow").alias("a"), F.greatest("xrow", "yrow").alias("b")).distinct()
    more = _linked(rest, large, percent)
    joined = components(links.unionByName(more))

    rooted = classes.join(joined, classes["row"] == joined["node"], "left").select(
        "n", "digest", "least_id", F.coalesce("root", "row").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(names, "root").select("n", "digest", "component_id")
    out = found.select("doc_id", "n", "digest").join(named, ["n", "digest"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
