"""The best chunks of each scope for each query, exactly, in blocks.

Chunks lie in blocks of bounded size, many small scopes in one and a large scope in several; queries lie in bundles. A
task takes some blocks and a bundle, and hands on only the best few of each scope, so no row stands for a pair. Dense scores
are a matrix product, and so are sparse ones whose weights are whole numbers, which add up exactly in any order. Other
sparse scores come from the block's inverted index: a scope's chunks are cut into runs of like chunks, a token's postings
are parted by run, each part with its greatest weight. The sum of a query's greatest weights bounds a run's scores; the
runs with the best bounds are read first, then those whose bound reaches the score that is in the k-th place by then. The
others aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunks of a block, queries of a bundle, chunks of a run.
BLOCK, BUNDLE, RUN = 4096, 1024, 8
#: A scope with more than a block's chunks divided by this has blocks of its own.
SHARE = 8
#: Scores that a task holds at once, tokens whose weights it holds as a matrix, and tasks for each core.
SCORES, SLAB, TASKS = 1 << 20, 1024, 8
#: A bundle of dense queries grows to so many times BUNDLE where there are many, and so many rows of large scopes are held by a task.
WIDEST, HELD = 16, 1 << 22


def _dealt(rows: DataFrame, block: int, sized: DataFrame | None = None) -> DataFrame:
    """rows (scope, ordinal) with _block. Large scopes share a row of blocks in order, each by hashes of its ordinals, so that a
    block has chunks of one or two of them and hands on few rows for a query; small ones lie whole in the others. How many
    blocks there are is worked out first, from `sized` (scope of each row) where rows are costly, and stands beside them."""
    each = (rows if sized is None else sized).groupBy("scope").agg(F.count("*").alias("_n"))
    large = each.filter(F.col("_n") > block // SHARE)  # at most SHARE rows for each block
    before = W.orderBy("scope").rowsBetween(W.unboundedPreceding, -1)
    large = large.select(F.col("scope").alias("_scope"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    total = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"), F.coalesce(F.sum(F.when(F.col("_n") > block // SHARE, F.col("_n"))), F.lit(0)).alias("_large"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_all") / F.lit(block))).cast("int").alias("blocks")
    total = total.select("_large", "_all", blocks)
    own = F.when(F.col("_large") == F.col("_all"), F.col("blocks")).otherwise(F.least(F.col("blocks") - 1, F.round(F.col("blocks") * F.col("_large") / F.col("_all")).cast("int")))
    total = total.select("blocks", "_large", own.alias("_own"))  # one row
    part = F.pmod(F.xxhash64("ordinal"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    place = F.least(F.floor((F.col("_from") + part * F.col("_n")) * F.col("_own") / F.col("_large")), F.col("_own") - 1)
    near = F.floor(F.col("ordinal") / F.lit(block))
    rest = F.col("_own") + F.pmod(F.xxhash64("scope", near), F.greatest(F.lit(1), F.col("blocks") - F.col("_own")))
    found = rows.crossJoin(F.broadcast(total)).join(F.broadcast(large), F.col("scope").eqNullSafe(F.col("_scope")) & F.col("_n").isNotNull(), "left")
    where = F.when(F.col("_n").isNotNull() & (F.col("_own") > 0), place).otherwise(F.least(rest, F.col("blocks") - 1)).cast("int")
    return found.withColumn("_block", where).select(*rows.columns, "blocks", "_block")


def dense_blocks(chunks: DataFrame, block: int = BLOCK, sized: DataFrame | None = None) -> DataFrame:
    """block, blocks (how many), rows: the chunks (scope, ordinal, dense) with a length, in blocks. This is an index to keep."""
    some = chunks.select("scope", "ordinal", "dense").filter(F.exists("dense", lambda x: x != 0))
    dealt = _dealt(some, block, sized)
    return dealt.groupBy(F.col("_block").alias("block"), "blocks").agg(F.collect_list(F.struct("scope", "ordinal", "dense")).alias("rows"))


def sparse_blocks(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, blocks (how many), rows: the chunks of weights (scope, ordinal, token, weight) with their tokens, in blocks. Weights must be above 0;
    others take no part. This is an index to keep."""
    each = weights.filter("weight > 0").groupBy("scope", "ordinal").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("_t"))
    return bag_blocks(each.select("scope", "ordinal", F.col("_t.token").alias("tokens"), F.col("_t.weight").alias("weights")), block)


def bag_blocks(bags: DataFrame, block: int = BLOCK, sized: DataFrame | None = None) -> DataFrame:
    """sparse_blocks() of chunks whose distinct tokens and weights, above 0, stand in arrays (scope, ordinal, tokens, weights)."""
    dealt = _dealt(bags.select("scope", "ordinal", "tokens", "weights"), block, sized)
    return dealt.groupBy(F.col("_block").alias("block"), "blocks").agg(F.collect_list(F.struct("scope", "ordinal", "tokens", "weights")).alias("rows"))


def of_scope(blocks: DataFrame, scope) -> DataFrame:
    """The blocks with one scope's chunks alone."""
    return blocks.withColumn("rows", F.filter("rows", lambda r: r["scope"] == scope)).filter(F.size("rows") > 0)


def _meetings(queries: DataFrame, blocks: DataFrame, bundle: int, widest: int = 1) -> DataFrame:
    """Each bundle of queries with each block: blocks, the larger side, are read once for each bundle that there is. A bundle goes
    to as many tasks as there are for it, and meets neighbouring blocks, a share of all, in each; their number is set, since a
    task's work grows with its meetings and not with their bytes. Blocks move for every bundle and bundles for every share, so
    bundles beyond the root of the tasks grow, up to `widest` times."""
    tasks = TASKS * blocks.sparkSession.sparkContext.defaultParallelism
    few = F.least(F.ceil(F.count("*") / F.lit(bundle)), F.lit(math.isqrt(tasks)))
    many = queries.agg(F.greatest(F.lit(1), few, F.ceil(F.count("*") / F.lit(bundle * widest))).cast("int").alias("_bundles"))  # one row
    many = many.withColumn("_shares", F.ceil(F.lit(tasks) / F.col("_bundles")).cast("int"))
    dealt = queries.crossJoin(F.broadcast(many)).withColumn("_bundle", F.pmod(F.xxhash64("query_id", F.lit(9)), F.col("_bundles")).cast("int"))
    asked = dealt.groupBy("_bundle", "_shares").agg(F.collect_list(F.struct(*queries.columns)).alias("asked"))
    asked = asked.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    met = blocks.crossJoin(F.broadcast(many)).withColumn("_bundle", F.explode(F.sequence(F.lit(0), F.col("_bundles") - 1)))
    share = F.floor(F.col("block") * F.col("_shares") / F.col("blocks")).cast("int")
    met = met.withColumn("_share", F.least(share, F.col("_shares") - 1)).select("block", "rows", "_bundle", "_share")
    asked = asked.repartition(tasks, "_bundle", "_share").hint("shuffle_hash")
    return met.repartition(tasks, "_bundle", "_share").join(asked, ["_bundle", "_share"]).select("block", "rows", "asked", "_bundle", "_share")


def _codes(column: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each distinct value, from 0 on; null is a value."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def _places(group: np.ndarray, score: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by group, falling score and ordinal, and each one's place in its group, from 0."""
    order = np.lexsort((ordinal, -score, group))
    of = group[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    return order, np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


#: Which query, which chunk of the block, and the score, of the best.
Best = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Columns:
    """A block's chunks as columns of a matrix, in order of scope and ordinal."""

    def __init__(self, rows: pa.StructArray):
        scope, ordinal = _codes(rows.field("scope"))[0], rows.field("ordinal").to_numpy(zero_copy_only=False)
        self.order = np.lexsort((ordinal, scope))
        self.scope = scope[self.order]
        self.begin = np.append(np.flatnonzero(np.concatenate([[True], self.scope[1:] != self.scope[:-1]])), len(scope))
        self.step = max(1, SCORES // max(1, len(scope)))  # queries at a time

    def best(self, score: np.ndarray, some: np.ndarray, most: int) -> Best:
        """Of scores (a query's in each row) where `some` says so, the best of each scope, ties to the earlier chunk."""
        keep = some.copy()
        for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True):
            if b - a > most:
                part = score[:, a:b]
                keep[:, a:b] &= part >= np.partition(part, b - a - most, axis=1)[:, b - a - most, None]
        who, at = np.nonzero(keep)
        value = score[who, at]
        order, place = _places(who * len(self.scope) + self.scope[at], value, at)
        first = order[place < most]
        return who[first], self.order[at[first]], value[first].astype(np.float64)


class _Dense:
    """A block's vectors."""

    def __init__(self, rows: pa.StructArray):
        self.columns = _Columns(rows)
        x = _matrix(rows.field("dense"))[self.columns.order]
        self.x, self.length = x, np.sqrt((x * x).sum(axis=1))

    def best(self, asked: pa.StructArray, most: int, digits: int | None) -> Iterator[Best]:
        q = _matrix(asked.field("dense"))
        length = np.sqrt((q * q).sum(axis=1))
        some = np.flatnonzero(length > 0)
        for i in range(0, len(some), self.columns.step):
            at = some[i : i + self.columns.step]
            score = (q[at] @ self.x.T) / (length[at, None] * self.length)
            if digits is not None:
                score = np.round(score, digits)
            who, place, value = self.columns.best(score, np.ones(score.shape, bool), most)
            yield at[who], place, value


class _Sparse:
    """A block's inverted index."""

    def __init__(self, rows: pa.StructArray, run: int):
        self.rows, self.run = rows, run
        lists = rows.field("tokens")
        self.size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        self.words = words.dictionary
        self.token = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = rows.field("weights").flatten().to_numpy(zero_copy_only=False)
        self.whole = bool((self.weight == np.floor(self.weight)).all())
        self.parted = False

    def best(self, asked: pa.StructArray, most: int, digits: int | None) -> Iterator[Best]:
        given = asked.field("weights").flatten().to_numpy(zero_copy_only=False)
        if self.whole and (given == np.floor(given)).all():
            size = pc.list_value_length(asked.field("weights")).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.bincount(np.repeat(np.arange(len(size)), size), given, len(size))
            largest = float(total.max(initial=0)) * float(self.weight.max(initial=0))
            if largest < 1 << 53:
                yield from self._products(asked, most, digits, np.float32 if largest < 1 << 24 else np.float64)
                return
        for i, place, value, _ in self.bounded(asked, most, digits):
            yield np.full(len(place), i), place, value

    def _products(self, asked: pa.StructArray, most: int, digits: int | None, kind: type) -> Iterator[Best]:
        """By matrix products over slabs of the queries' tokens, in numbers that hold every sum."""
        columns = _Columns(self.rows)
        at = np.empty(len(columns.order), np.int64)
        at[columns.order] = np.arange(len(at))
        column = at[np.repeat(np.arange(len(self.size)), self.size)]  # of each posting
        for i in range(0, len(asked), columns.step):
            some = asked.slice(i, columns.step)
            lists = some.field("tokens")
            who = np.repeat(np.arange(len(some)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            known = pc.index_in(lists.flatten(), value_set=self.words)
            hit = known.is_valid().to_numpy(zero_copy_only=False)
            used, code = np.unique(known.drop_null().to_numpy(), return_inverse=True)
            who, factor = who[hit], some.field("weights").flatten().to_numpy(zero_copy_only=False)[hit]
            place = np.full(len(self.words), -1)
            place[used] = np.arange(len(used))
            row = place[self.token]
            score = np.zeros((len(some), len(at)), kind)
            for slab in range(0, len(used), SLAB):
                wide = min(SLAB, len(used) - slab)
                q, c = np.zeros((len(some), wide), kind), np.zeros((wide, len(at)), kind)
                a, b = (code >= slab) & (code < slab + wide), (row >= slab) & (row < slab + wide)
                q[who[a], code[a] - slab] = factor[a]
                c[row[b] - slab, column[b]] = self.weight[b]
                score += q @ c
            seen = score > 0
            if digits is not None:
                score = np.round(score.astype(np.float64), digits)
            found, place, value = columns.best(score, seen, most)
            yield found + i, place, value

    def part(self) -> None:
        """Part the postings by runs of like chunks."""
        if self.parted:
            return
        self.parted, rows, run, size, token, weight = True, self.rows, self.run, self.size, self.token, self.weight
        scope, self.scopes = _codes(rows.field("scope"))
        row = np.repeat(np.arange(len(scope)), size)
        # like chunks stand together: those of one scope whose heaviest tokens are the same
        heavy = np.lexsort((token, -weight, row))
        begin = np.cumsum(size) - size
        top = [token[heavy[np.minimum(begin + k, np.maximum(begin + size - 1, begin))]] if len(token) else np.zeros(len(scope), np.int64) for k in range(3)]
        ordinal = rows.field("ordinal").to_numpy(zero_copy_only=False)
        self.order = np.lexsort((ordinal, top[2], top[1], top[0], scope))
        self.scope, self.ordinal = scope[self.order], ordinal[self.order]
        first = np.flatnonzero(np.concatenate([[True], self.scope[1:] != self.scope[:-1]]))
        inside = np.arange(len(scope)) - np.repeat(first, np.diff(np.append(first, len(scope))))
        run_of = np.cumsum(inside % run == 0) - 1  # a run begins anew with each scope
        self.run_scope = self.scope[inside % run == 0]
        self.run_size = np.bincount(run_of)
        at = np.empty(len(scope), np.int64)
        at[self.order] = np.arange(len(scope))
        row = at[row]
        by = np.lexsort((row, token))
        self.row, self.by_token, token = row[by], weight[by], token[by]
        part = np.concatenate([[True], (token[1:] != token[:-1]) | (run_of[self.row[1:]] != run_of[self.row[:-1]])]) if len(token) else np.zeros(0, bool)
        self.part_begin = np.append(np.flatnonzero(part), len(token))  # postings of one token in one run
        self.part_run = run_of[self.row[self.part_begin[:-1]]]
        self.part_most = np.maximum.reduceat(self.by_token, self.part_begin[:-1]) if len(token) else np.empty(0)
        self.token_begin = np.searchsorted(token[self.part_begin[:-1]], np.arange(len(self.words) + 1))  # parts of one token

    def _read(self, parts: np.ndarray, factor: np.ndarray, score: np.ndarray, seen: np.ndarray) -> int:
        """Add the postings of parts to the scores; how many there were."""
        size = self.part_begin[parts + 1] - self.part_begin[parts]
        ends = np.cumsum(size)
        many = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.part_begin[parts] - (ends - size), size) + np.arange(many)
        np.add.at(score, self.row[at], np.repeat(factor, size) * self.by_token[at])
        seen[self.row[at]] = True
        return many

    def _kth(self, score: np.ndarray, seen: np.ndarray, most: int) -> np.ndarray:
        """The score in the k-th place of each scope; below all where it has fewer."""
        some = np.flatnonzero(seen)
        order, place = _places(self.scope[some], score[some], self.ordinal[some])
        kth = np.full(self.scopes, -np.inf)
        at = some[order[place == most - 1]]
        kth[self.scope[at]] = score[at]
        return kth

    def bounded(self, asked: pa.StructArray, most: int, digits: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Number, best chunks, their scores and how many postings were read, of each query."""
        self.part()
        for i, one in enumerate(asked):
            known = pc.index_in(one["tokens"].values, value_set=self.words)
            hit = known.is_valid().to_numpy(zero_copy_only=False)
            token = known.drop_null().to_numpy().astype(np.int64)
            factor = one["weights"].values.to_numpy(zero_copy_only=False)[hit]
            size = self.token_begin[token + 1] - self.token_begin[token]
            ends = np.cumsum(size)
            parts = np.repeat(self.token_begin[token] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            factor = np.repeat(factor, size)
            run = self.part_run[parts]
            bound = np.bincount(run, factor * self.part_most[parts], len(self.run_size))
            # of each scope the runs with the best bounds that together have `most` chunks
            order, place = _places(self.run_scope, bound, np.arange(len(bound)))
            held = np.cumsum(self.run_size[order]) - self.run_size[order]
            held = held - np.repeat(held[place == 0], np.diff(np.append(np.flatnonzero(place == 0), len(order))))
            early = np.zeros(len(bound), bool)
            early[order[held < most]] = True
            score, seen = np.zeros(len(self.scope)), np.zeros(len(self.scope), bool)
            first = early[run]
            read = self._read(parts[first], factor[first], score, seen)
            # a bound is a sum in another order, so it may fall short of the score by its rounding
            late = ~early & (bound * (1 + 1e-9) >= self._kth(score, seen, most)[self.run_scope])
            late = late[run]
            read += self._read(parts[late], factor[late], score, seen)
            some = np.flatnonzero(seen)
            value = score[some] if digits is None else np.round(score[some], digits)
            order, place = _places(self.scope[some], value, self.ordinal[some])
            keep = order[place < most]
            yield i, self.order[some[keep]], value[keep], read


class _Running:
    """The best of a bundle's queries in the large scopes of the blocks that a task has met so far."""

    def __init__(self, query_id: pa.Array, most: int):
        self.query_id, self.most, self.codes = query_id, most, {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.pruned = 0

    def add(self, who: np.ndarray, scope: pa.Array, ordinal: np.ndarray, score: np.ndarray) -> None:
        coded = scope.dictionary_encode(null_encoding="encode")
        code = np.array([self.codes.setdefault(v, len(self.codes)) for v in coded.dictionary.to_pylist()], np.int64)
        self.parts.append((who, code[coded.indices.to_numpy(zero_copy_only=False)], ordinal, score))
        self.rows += len(who)
        if self.rows > max(1 << 20, 2 * self.pruned):
            self.prune()

    def prune(self) -> None:
        who, scope, ordinal, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order, place = _places(who * max(1, len(self.codes)) + scope, score, ordinal)
        first = order[place < self.most]
        self.parts, self.rows, self.pruned = [(who[first], scope[first], ordinal[first], score[first])], len(first), len(first)

    def columns(self, scope: pa.DataType, ordinal: pa.DataType) -> list[pa.Array]:
        self.prune()
        who, code, place, score = self.parts[0]
        return [self.query_id.take(pa.array(who)), pa.array(list(self.codes), scope).take(pa.array(code)), pa.array(place, ordinal), pa.array(score)]


def _search(meetings: DataFrame, kind: str, most: int, digits: int | None, run: int, counted: bool) -> DataFrame:
    rows, asked = meetings.schema["rows"].dataType.elementType, meetings.schema["asked"].dataType.elementType
    schema = [T.StructField("query_id", asked["query_id"].dataType), T.StructField("scope", rows["scope"].dataType), T.StructField("ordinal", rows["ordinal"].dataType), T.StructField("score", T.DoubleType())]
    if counted:
        schema = [schema[0], T.StructField("read", T.LongType()), T.StructField("all", T.LongType())]

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, few = None, None, False
        names, running = ["query_id", "scope", "ordinal", "score"], {}  # a task has few bundles and shares
        for batch in batches:
            for k in range(batch.num_rows):
                if (block := batch.column("block")[k].as_py()) != last:
                    held = batch.column("rows").slice(k, 1).flatten()
                    last, index = block, _Dense(held) if kind == "dense" else _Sparse(held, run)
                    few = pc.count_distinct(held.field("scope"), mode="all").as_py() <= 2 * SHARE
                ask = batch.column("asked").slice(k, 1).flatten()
                held = batch.column("rows").slice(k, 1).flatten()
                if counted:
                    found = [(i, read) for i, _, _, read in index.bounded(ask, most, digits)]
                    one = pa.array([i for i, _ in found], pa.int64())
                    every = pa.array([_all_postings(index, ask[i]) for i, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([ask.field("query_id").take(one), pa.array([read for _, read in found], pa.int64()), every], ["query_id", "read", "all"])
                    continue
                cell = (batch.column("_bundle")[k].as_py(), batch.column("_share")[k].as_py())
                for who, place, score in index.best(ask, most, digits):
                    at = pa.array(place)
                    scope, ordinal = held.field("scope").take(at), held.field("ordinal").take(at)
                    if not few:  # small scopes lie in one block or two
                        yield pa.RecordBatch.from_arrays([ask.field("query_id").take(pa.array(who)), scope, ordinal, pa.array(score)], names)
                        continue
                    if cell not in running:
                        running[cell] = _Running(ask.field("query_id"), most)
                    running[cell].add(who, scope, ordinal.to_numpy(zero_copy_only=False), score)
                kinds = held.field("scope").type, held.field("ordinal").type
                if sum(r.rows for r in running.values()) > HELD:
                    for r in running.values():
                        yield pa.RecordBatch.from_arrays(r.columns(*kinds), names)
                    running = {}
        for r in running.values():
            yield pa.RecordBatch.from_arrays(r.columns(*kinds), names)

    return meetings.mapInArrow(run_all, T.StructType(schema))


def _all_postings(index: _Sparse, one) -> int:
    """The postings that the query's tokens have in the block."""
    known = pc.index_in(one["tokens"].values, value_set=index.words).drop_null().to_numpy().astype(np.int64)
    return int((index.part_begin[index.token_begin[known + 1]] - index.part_begin[index.token_begin[known]]).sum())


def _top(found: DataFrame, score: str, rank: str, most: int) -> DataFrame:
    """Of the best of each share or block, the best: `most` rows of each for each query and scope come here."""
    order = W.partitionBy("query_id", "scope").orderBy(F.desc("score"), "ordinal")
    ranked = found.withColumn(rank, F.row_number().over(order) - 1).filter(F.col(rank) < most)
    return ranked.select("query_id", "scope", "ordinal", F.col("score").alias(score), rank)


def dense_nearest(queries: DataFrame, blocks: DataFrame, most: int, digits: int | None = None, bundle: int = BUNDLE) -> DataFrame:
    """query_id, scope, ordinal, dense_score, dense_rank (from 0): of each scope the chunks with the greatest cosine to each query
    (query_id, dense), ties by ordinal; with digits, scores are rounded first. A query or chunk without a vector, or of length 0,
    takes no part."""
    some = queries.select("query_id", "dense").filter("dense IS NOT NULL")
    return _top(_search(_meetings(some, blocks, bundle, WIDEST), "dense", most, digits, RUN, False), "dense_score", "dense_rank", most)


def _asked(queries: DataFrame) -> DataFrame:
    each = queries.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("_t"))
    return each.select("query_id", F.col("_t.token").alias("tokens"), F.col("_t.weight").cast("array<double>").alias("weights"))


def sparse_nearest(queries: DataFrame, blocks: DataFrame, most: int, run: int = RUN, bundle: int = BUNDLE) -> DataFrame:
    """query_id, scope, ordinal, sparse_score, sparse_rank (from 0): of each scope the chunks with the greatest sum of weights over
    the tokens that they share with each query (query_id, token, weight above 0), ties by ordinal."""
    some = _asked(queries.filter("weight > 0"))
    return _top(_search(_meetings(some, blocks, bundle), "sparse", most, None, run, False), "sparse_score", "sparse_rank", most)


def postings_read(queries: DataFrame, blocks: DataFrame, most: int, run: int = RUN, bundle: int = BUNDLE) -> DataFrame:
    """query_id, read, all: how many of the postings of a query's tokens sparse_nearest() reads where weights aren't whole numbers."""
    found = _search(_meetings(_asked(queries.filter("weight > 0")), blocks, bundle), "sparse", most, None, run, True)
    return found.groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("all").alias("all"))


def postings_of(queries: DataFrame, bags: DataFrame) -> DataFrame:
    """query_id, all: how many chunks of bags (tokens, each once) have each query's tokens (query_id, token), counted by token and
    without a search. A query whose tokens are nowhere has no row."""
    each = bags.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return queries.join(each, "token").groupBy("query_id").agg(F.sum("n").alias("all"))
