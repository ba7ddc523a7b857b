"""Line dedup by an exact set-similarity join, in DataFrame operations alone.

Every line is read as a set of tokens once. Lines of equal sets are one line, kept where it comes first. Each line's
tokens are ordered by rarity (their counts in a fixed number of hash buckets; ties by hash), and its prefix is as long
as a match needs. Lines that meet in a prefix token are candidates if their lengths, the token's positions and a parity
outline of their sets allow enough overlap (a wider one where a line is long), and a still wider outline before their sets move. First each line is held against its nearest neighbours in its lists; only
lines that no earlier one of these matches are then paired with all earlier candidates. So a large group of near copies
costs a few pairs a line, and no candidate of a line that stays is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from briefmill.llm.common import ascii_lower, discard, free_names, materialize

#: Rarity is counted in ROWS x PLACES buckets, a number each.
ROWS, PLACES = 512, 2048
#: Neighbours of a list that a line is held against first, lines that one neighbourhood's sort may hold, and parts in
#: which the full pairing goes through the tokens, so that a part's shuffle is a fraction of the lists.
NEAREST, SORTED_LINES, TOKEN_PARTS = 3, 250_000, 3
#: Words of 64 bits of the outlines that pairs are held against before their sets; a power of two.
OUTLINE_WORDS = 8
#: Words of the outlines that stand in the lists of the full pairing for lines of more than SHORT tokens, too many for 64 bits.
LIST_WORDS, SHORT = 4, 64

#: Words repeat, so that a file's distinct ones as a dictionary and places in it take less than half of the numbers.
WIDE = {"parquet.dictionary.page.size": str(32 << 20)}


def _words(line: Column) -> Column:
    """Words of a line, A-Z lower-cased; one or more may be empty strings. Lines whose only white space is blanks take
    the faster way."""
    low = ascii_lower(line)
    other = F.contains(line, F.lit("\t"))
    for c in "\n\v\f\r":
        other = other | F.contains(line, F.lit(c))
    return F.when(other, F.split(low, r"[\x20\x09-\x0D]+")).otherwise(F.split(low, " "))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line of each line of each text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


#: Bits of a token that hold its hash; above them stands its class of rarity.
HASH_BITS = 56


def _tokens(line: Column) -> Column:
    """Sorted hashes of the distinct words of a line, A-Z lower-cased."""
    number = lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - HASH_BITS)
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(_words(line), number)), number(F.lit(""))))


def _rarity(read: DataFrame) -> DataFrame:
    """One row with arrays of classes: a token's class grows with the count of its bucket. Its size is fixed."""
    bucket = F.col("t").bitwiseAND(F.lit(ROWS * PLACES - 1)).alias("id")
    counts = read.select(F.explode("tokens").alias("t")).groupBy(bucket).count()
    counts = counts.unionByName(read.sparkSession.range(ROWS * PLACES).select("id", F.lit(0).cast("long").alias("count")))
    rank = F.shiftleft(F.least(F.round(3 * F.log2(F.sum("count") + 1)), F.lit(127)).cast("long"), HASH_BITS)
    ranks = counts.groupBy("id").agg(rank.alias("c")).select(F.expr(f"id div {PLACES}").alias("row"), F.struct("id", "c").alias("s"))
    rows = ranks.groupBy("row").agg(F.sort_array(F.collect_list("s")).getField("c").alias("classes"))  # PLACES numbers
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("row", "classes"))).getField("classes").alias("classes"))
    return materialize(rows.select(F.flatten("classes").alias("classes")), "rarity")  # ROWS * PLACES numbers


def _ranked(tokens: Column, classes: Column) -> Column:
    """Tokens in order of rarity: the class stands above the hash."""
    bucket = lambda t: t.bitwiseAND(F.lit(ROWS * PLACES - 1)).cast("int")
    return F.sort_array(F.transform(tokens, lambda t: F.coalesce(F.get(classes, bucket(t)), F.lit(0)).bitwiseOR(t)))


def _needed(percent: int) -> str:
    """The least overlap of sets of n and m tokens."""
    return f"((n + m) * {percent} + {99 + percent}) div {100 + percent}"


def _candidates(percent: int) -> str:
    """Conditions on entries (n, at, outline) and (m, mat, moutline) that a match of their lines can't fail."""
    return (
        f"100 * least(n, m) >= {percent} * greatest(n, m)"
        f" AND least(at, mat) + 1 + least(n - at - 1, m - mat - 1) >= {_needed(percent)}"
        f" AND (n + m - bit_count(outline ^ moutline)) div 2 >= {_needed(percent)}"
    )


def _close(percent: int) -> str:
    """A further condition on long lines of a list: their wide outlines (w0 and so on, m before the other's) allow a match."""
    differ = " + ".join(f"bit_count(w{w} ^ mw{w})" for w in range(LIST_WORDS))
    return f"(n <= {SHORT} OR m <= {SHORT} OR (n + m - ({differ})) div 2 >= {_needed(percent)})"


def _entries(prefixes: DataFrame, *more: str) -> DataFrame:
    return prefixes.select("id", "n", "outline", *more, F.posexplode("prefix").alias("at", "t"))


def _by_tokens(prefixes: DataFrame, met: Callable[[DataFrame], DataFrame], *more: str) -> DataFrame:
    """Distinct pairs (a, b) that met() finds in the lists, which go through it in TOKEN_PARTS parts."""
    pairs = None
    for part in range(TOKEN_PARTS):
        listed = _entries(prefixes, *more).filter(F.pmod(F.col("t"), F.lit(TOKEN_PARTS)) == part)
        got = materialize(met(listed).distinct(), "pairs")
        pairs = got if pairs is None else pairs.unionByName(got)
    return materialize(pairs.distinct(), "met")


def _bit(t: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))


def _wide_outline(tokens: Column, words: int = OUTLINE_WORDS, name: str = "o") -> list[Column]:
    """A parity outline of 64 * words bits, as columns o0, o1 and so on."""
    word = lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(words - 1))
    of = lambda w: F.aggregate(F.filter(tokens, lambda t: word(t) == w), F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(_bit(t)))
    return [of(w).alias(f"{name}{w}") for w in range(words)]


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _both(pairs: DataFrame, rows: DataFrame, kept: Column, name: str) -> DataFrame:
    """The pairs (a, b) whose rows (id and more, the names led by a or b) are as kept says; a part's rows move at a time."""
    side = lambda c: rows.select(*[F.col(x).alias(c + x) for x in rows.columns])
    found = None
    for part in range(TOKEN_PARTS):
        both = pairs.filter(F.pmod("a", F.lit(TOKEN_PARTS)) == part).join(side("a"), F.col("a") == F.col("aid"))
        got = materialize(both.join(side("b"), F.col("b") == F.col("bid")).filter(kept).select("a", "b"), name)
        found = got if found is None else found.unionByName(got)
    return found


def _verified(pairs: DataFrame, read: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The later line's id of each pair (a, b) of ids that match, b before a; lines of one place aren't before each other.
    Wide outlines, a fraction of the sets' size, leave few pairs whose sets must move."""
    wanted = firsts.join(_ids(pairs), "id", "left_semi").select("id", "line", "d", "l")
    sets = read.select("line", "tokens").join(wanted, "line").drop("line")
    sets = materialize(sets.select("*", F.size("tokens").alias("n"), *_wide_outline(F.col("tokens"))), "token_sets")
    differ = " + ".join(f"bit_count(ao{w} ^ bo{w})" for w in range(OUTLINE_WORDS))  # at most the tokens that one of two has
    needed = f"((an + bn) * {percent} + {99 + percent}) div {100 + percent}"
    outlines = sets.select("id", "n", *[f"o{w}" for w in range(OUTLINE_WORDS)])
    close = _both(pairs, outlines, F.expr(f"(an + bn - ({differ})) div 2 >= {needed}"), "close")
    both = F.size(F.array_intersect("atokens", "btokens"))
    match = (100 * both >= percent * (F.size("atokens") + F.size("btokens") - both)) & F.expr("ad <> bd OR al <> bl")
    moved = sets.select("id", "tokens", "d", "l").join(_ids(close), "id", "left_semi")
    found = materialize(_both(close, moved, match, "found").select(F.col("a").alias("id")).distinct(), "later")
    discard(sets)
    return found


def find(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, line_no of the lines that match an earlier one: sets of words (A-Z lower-cased) with a Jaccard similarity
    of at least percent/100. Earlier is by doc_id, then line number; whether the earlier line is itself removed makes no
    difference. Words are told apart by 56-bit hashes.

    Lines without words match nothing; a null or empty text has no such lines. Rows that repeat a doc_id are one
    document, whose lines of the same number are not earlier than each other; rows with a null doc_id are left as they
    are. An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    every = lines(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"))
    # the id, which is not deterministic, keeps the filter from being pushed below, where it would tokenize again
    read = every.select(F.monotonically_increasing_id().alias("line"), "doc_id", "line_no", _tokens(F.col("line")).alias("tokens"))
    read = read.filter(F.size("tokens") > 0)
    read = materialize(read.withColumns({"k1": F.xxhash64("tokens"), "k2": F.xxhash64(F.lit("k2"), F.col("tokens"))}), "lines", **WIDE)
    # of equal sets the first; ids are in the order of places
    firsts = read.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no", "line")).alias("first"))
    firsts = firsts.select("k1", "k2", F.col("first.doc_id").alias("d"), F.col("first.line_no").alias("l"), F.col("first.line").alias("line"))
    firsts = firsts.repartitionByRange("d", "l").sortWithinPartitions("d", "l", "k1", "k2")
    firsts = materialize(firsts.withColumn("id", F.monotonically_increasing_id()), "firsts")

    rarity = _rarity(read)
    # a parity outline: the exclusive or of a bit for each token
    outline = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(_bit(t)))
    n = F.size("tokens")
    # the classes are read in one place, so that the optimizer puts the subquery there and no row carries them
    ranked = _ranked(F.col("tokens"), F.col("_classes"))
    prefix = F.slice(ranked, F.lit(1), n - F.expr(f"(size(tokens) * {percent} + 99) div 100").cast("int") + 1)
    # a long line's 64 bits say nothing; zeros of short ones take no room
    wide = [f"w{w}" for w in range(LIST_WORDS)]
    long = F.when(n > SHORT, F.col("tokens")).otherwise(F.array().cast("array<long>"))
    prefixes = read.withColumn("_classes", rarity.scalar()).select(
        "line", n.alias("n"), outline.alias("outline"), prefix.alias("prefix"), *_wide_outline(long, LIST_WORDS, "w")
    )
    prefixes = materialize(prefixes.join(firsts.select("line", "id"), "line").drop("line"), "prefixes")
    discard(rarity)

    # a list's lines by length, in neighbourhoods of bounded size
    parts = max(1, -(-prefixes.count() // SORTED_LINES))
    order = W.partitionBy("t", "_part").orderBy("n", "id")
    other = F.struct(F.col("id").alias("mid"), F.col("n").alias("m"), F.col("at").alias("mat"), F.col("outline").alias("moutline"))
    back = F.array(*[F.lag(other, i).over(order) for i in range(1, NEAREST + 1)])

    def neighbours(listed: DataFrame) -> DataFrame:
        listed = listed.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        met = listed.withColumn("_b", back).withColumn("_b", F.explode("_b")).select("id", "n", "at", "outline", "_b.*")
        met = met.filter(F.expr("mid IS NOT NULL AND " + _candidates(percent)))
        return met.select(F.greatest("id", "mid").alias("a"), F.least("id", "mid").alias("b"))

    near = _by_tokens(prefixes, neighbours)
    found = _verified(near, read, firsts, percent)

    marked = prefixes.join(found.withColumn("rest", F.lit(False)), "id", "left")
    marked = materialize(marked.withColumn("rest", F.coalesce("rest", F.lit(True))), "marked")
    discard(prefixes)

    def earlier(listed: DataFrame) -> DataFrame:
        left, others = listed.filter("rest").drop("rest"), {"n": "m"}
        right = listed.drop("rest").select("t", *[F.col(c).alias(others.get(c, f"m{c}")) for c in ("id", "n", "at", "outline", *wide)])
        met = left.join(right, "t").filter(F.expr(f"mid < id AND {_candidates(percent)} AND {_close(percent)}"))
        return met.select(F.col("id").alias("a"), F.col("mid").alias("b"))

    pairs = _by_tokens(marked, earlier, "rest", *wide)
    discard(marked)
    rest = materialize(pairs.join(near, ["a", "b"], "left_anti"), "rest")
    found = materialize(found.unionByName(_verified(rest, read, firsts, percent)).withColumn("near", F.lit(True)), "matches")

    places = firsts.join(found, "id", "left").select("k1", "k2", "d", "l", "near")
    again = read.select("doc_id", "line_no", "k1", "k2").join(places, ["k1", "k2"])
    later = (F.col("doc_id") != F.col("d")) | (F.col("line_no") != F.col("l"))
    gone = materialize(again.filter(later | F.coalesce("near", F.lit(False))).select("doc_id", "line_no").distinct(), "gone")
    discard(read, firsts)
    return gone


def summary(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (their numbers, ascending) of each row of docs."""
    gone = find(docs, percent).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_lines"))
    rows = rows.join(gone, "doc_id", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def remove(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the lines that find() gives taken out of text; other columns stay, whatever their names."""
    (name,) = free_names(docs, "_gone")
    gone = find(docs.select("doc_id", "text"), percent).groupBy("doc_id").agg(F.collect_set("line_no").alias(name))
    rows = docs.join(gone, "doc_id", "left")
    kept = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: ~F.coalesce(F.array_contains(name, s["i"]), F.lit(False)),
    )
    text = F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    return rows.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(text)).select(*docs.columns)
