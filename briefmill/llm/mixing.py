"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the mix (its target in words) and a schedule of weights over training time 0..1. The
integral of the schedule, scaled to the target, is the source's cumulative demand; a document that starts at word c of
its source's stream is trained at the time at which demand reaches c, found by inverting the integral. Documents are
then range-sorted by that position.

Everything is DataFrame expressions. A source's stream is ordered by a hash of the document; the running sums are taken
within (source, hash bucket) and offset by the sums of earlier buckets, so that a source with any part of the rows is
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from briefmill.llm.common import materialize, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEAT = 1.5, 2.0
#: Times of the schedule's knots, and for each class of source its weights there; between knots weights are linear.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.0, 1.0, 0.5), (0.5, 1.0, 1.0), (0.25, 0.75, 1.5))


def _integrals(knots: Sequence[float], weights: Sequence[float]) -> list[float]:
    out = [0.0]
    for i in range(1, len(knots)):
        out.append(out[-1] + (knots[i] - knots[i - 1]) * (weights[i] + weights[i - 1]) / 2)
    return out


def invert_demand(share: Column, kind: Column, knots=KNOTS, schedules=SCHEDULES) -> Column:
    """The time at which a source of this kind has used the given share (0..1) of its target."""
    by_kind = None
    for k, weights in enumerate(schedules):
        sums = _integrals(knots, weights)
        area = share * F.lit(sums[-1])
        at = None
        for i in reversed(range(len(knots) - 1)):
            slope = (weights[i + 1] - weights[i]) / (knots[i + 1] - knots[i])
            over = F.greatest(area - F.lit(sums[i]), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(weights[i] ** 2) + F.lit(2 * slope) * over, F.lit(0.0)))
            time = F.lit(knots[i]) + F.when(over == 0, F.lit(0.0)).otherwise(2 * over / (F.lit(weights[i]) + root))
            at = time if at is None else F.when(area < F.lit(sums[i + 1]), time).otherwise(at)
        by_kind = at if by_kind is None else F.when(kind == k, at).otherwise(by_kind)
    return F.least(by_kind, F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """_key, source_size, kind and target of each source; sizes has _key, _size. The excess of sources that stop at
    `repeat` times their size goes to the others by weight, again and again until none is above."""
    per = sizes.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    # one row for each source from here on
    kind = (F.row_number().over(W.orderBy("_key")) - 1) % len(weights)
    per = materialize(per.withColumn("kind", kind), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * repeat)
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, n_capped = 0.0, -1
    while True:
        capped = F.col("_cap") <= F.col("_w") * level
        n, used, rest = per.agg(
            F.count_if(capped), F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("_w")))
        ).first()
        if n == n_capped or not rest:
            break
        level, n_capped = (total - (used or 0.0)) / rest, n
    target = F.least(F.col("_cap"), F.col("_w") * level)
    return per.select("_key", "source_size", "kind", target.alias("target"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: float = REPEAT, knots=KNOTS, schedules=SCHEDULES,
    whole: bool = False, buckets: int = 256, seed: int = 17,
) -> DataFrame:
    """docs (doc_id, text, source, any more) with size, source_size, target, taken, and copies: an array of
    (epoch, words, position) for each time that the document is trained on, in order of first position.

    Sources are told apart by code point; null is a source of its own and comes last. A null or empty text has size 0
    and is never taken. In a source's last epoch one document is cut where the target is reached; with whole=True it is
    taken whole if at least half of it would be, else not at all. Equal rows are distinct documents. An empty table
    gives an empty result. Columns of docs that have the names above, or kind, are dropped.
    """
    own = ["size", "source_size", "target", "taken", "copies", "_key", "_size", "_hash", "_bucket", "_before", "kind"]
    own += ["epoch", "words", "position", "_copy"]  # of in_training_order()
    docs = docs.drop(*own)
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    sized = docs.select("*", key.alias("_key"), word_count(F.col("text")).alias("_size"), order.alias("_hash"))
    sized = sized.withColumn("_bucket", F.pmod(F.shiftright("_hash", 40), F.lit(buckets)).cast("int"))
    parts = materialize(sized.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_size")), "parts")
    before = F.sum("_size").over(W.partitionBy("_key").orderBy("_bucket")) - F.col("_size")
    offsets = parts.select("_key", "_bucket", before.alias("_before"))
    targets = source_targets(parts, weights, share, repeat)
    offsets = offsets.join(targets, "_key")
    inside = W.partitionBy("_key", "_bucket").orderBy("_hash", "doc_id", "_size")
    start = F.sum("_size").over(inside) - F.col("_size") + F.col("_before")
    placed = sized.join(offsets, ["_key", "_bucket"]).withColumn("_before", start)
    goal = F.round("target").cast("long")
    epochs = F.sequence(F.lit(0), F.greatest(F.ceil(F.lit(repeat)).cast("int") - 1, F.lit(0)))

    def one(epoch: Column) -> Column:
        begin = F.col("_before") + epoch * F.col("source_size")
        words = F.greatest(F.least(goal - begin, F.col("_size")), F.lit(0).cast("long"))
        if whole:
            words = F.when(words * 2 >= F.col("_size"), F.col("_size")).otherwise(F.lit(0).cast("long"))
        share_used = F.least(begin / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
        return F.struct(
            epoch.alias("epoch"), words.alias("words"), invert_demand(share_used, F.col("kind"), knots, schedules).alias("position")
        )

    copies = F.filter(F.transform(epochs, one), lambda c: c["words"] > 0)
    out = placed.withColumn("copies", copies).withColumn("size", F.col("_size"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    out = out.select(*docs.columns, "size", "source_size", "target", taken.alias("taken"), "copies")
    return out


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy that mix() takes, range-sorted by training position: columns epoch, words and position."""
    rows = mixed.withColumn("_copy", F.explode("copies"))
    rows = rows.select(*[c for c in mixed.columns if c != "copies"], "_copy.*")
    return rows.repartitionByRange("position", "doc_id", "epoch").sortWithinPartitions("position", "doc_id", "epoch")
