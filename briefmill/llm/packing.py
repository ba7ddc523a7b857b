"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenized where they are read; only a row of lengths for each piece moves. Full pieces fill a sequence
alone. The others are dealt at random into shards of bounded size; each is packed best-fit decreasing, then documents
are moved, exchanged one for one or two for one between all of its underfull bins, each step raising the sum of squared
fills, until no step is left.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import materialize

CAPACITY, END = 2048, 0
#: Pieces of a shard on average.
SHARD_PIECES = 20_000

_cache: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a tokenizer must do before its merges so that texts can be encoded word by word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


#: Lower-case letters that composition and lower-casing leave as they are: Latin, Greek and Cyrillic.
LETTERS = "a-zß-öø-ÿα-ωа-џ"
#: What is looked up: the letters of a word of them and, apart, ASCII signs and digits up to its end; other words as wholes.
LOOKED_UP = re.compile(rf"[{LETTERS}]++(?=[!-@\[-`{{-~]*+(?:[\x20\x09-\x0D]|\Z))|[^\x20\x09-\x0D]+")


class _Ids(dict):
    """Ids of words as little-endian 32-bit bytes, learned when first asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class WordTokenizer:
    """Encodes texts word by word with a cache where the tokenizer is known never to join across ASCII white space, else
    as wholes.

    Such a tokenizer also cuts between letters and signs, so a word of letters with signs after it is looked up in two
    parts, and letters go to its merges directly.
    """

    #: Bytes of words and ids after which the cache begins anew; it holds as many from before, and a batch's words.
    LIMIT = 40_000_000
    #: What a word takes besides its letters and ids.
    OVERHEAD = 230

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        normalizer, pre = form.get("normalizer") or {}, form.get("pre_tokenizer") or {}
        cuts = pre.get("pretokenizers") or [{}, {}]
        split = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
        level = cuts[-1].get("type") == "ByteLevel" and not cuts[-1].get("add_prefix_space") and not cuts[-1].get("use_regex")
        added = [t["content"] for t in form.get("added_tokens") or ()]
        plain = form["model"].get("type") == "BPE" and not any(t.isalpha() for t in added)
        self.by_word = normalizer.get("normalizers") == NORMALIZERS and len(cuts) == 2 and cuts[0] == split and level
        self.merges = self.tokenizer.model.tokenize if self.by_word and plain else None
        # where lower-casing of A-Z first could change the result: capitals that compose otherwise with a mark of
        # U+0300 to U+037F than their small letters, and what would read as an added token
        self.kept_case = [b"\xcc", b"\xcd", *(t.lower().encode() for t in added)]
        self.letters = _byte_letters()
        self.ids, self.before, self.held = _Ids(self._learn), {}, 0

    def _plain(self, word: str) -> bool:
        """Whether a word is letters that composition and lower-casing leave as they are."""
        if word.isascii():
            return word.isalpha() and word.islower()
        return word.isalpha() and word == word.lower() and is_normalized("NFC", word)

    def _learn(self, word: str) -> bytes:
        ids = self.before.get(word) or self._find(word)
        self.held += 2 * len(word) + len(ids) + self.OVERHEAD
        return ids

    def _find(self, word: str) -> bytes:
        if self.merges and len(word) < 100 and self._plain(word):
            text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            return array("I", [t.id for t in self.merges(text)]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _words(self, text: bytes) -> list[str]:
        low = text.lower()  # A-Z only
        return LOOKED_UP.findall((text if any(x in low for x in self.kept_case) else low).decode("utf-8", "replace"))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        if self.held > self.LIMIT:
            self.before, self.held = dict(self.ids), 0
            self.ids.clear()
        get = self.ids.__getitem__
        return [b"".join(map(get, self._words(t))) for t in texts]


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _cache:
        _cache.clear()
        _cache[path] = WordTokenizer(path)
    return _cache[path]


def some_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose texts have about `most` bytes; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, np.cumsum(size)
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, ending with `end`, cut at `capacity`."""
    path = tokenizer or default_tokenizer()
    kind = dict(docs.dtypes)["doc_id"]
    tail = np.asarray([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for whole in batches:
            for batch in some_bytes(whole, 1, 2_000_000):
                raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(tok.encode(raw)):
                    ids += tail
                    for k, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[begin : begin + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                number = np.asarray(piece, np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(number),
                    pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class _Bins:
    """Bins of item sizes, found by free room."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []

    def best_fit(self, sizes: np.ndarray) -> None:
        rooms: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_rooms: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            s = int(sizes[i])
            k = bisect.bisect_left(open_rooms, s)
            if k < len(open_rooms):
                room = open_rooms[k]
                b = rooms[room].pop()
                if not rooms[room]:
                    open_rooms.pop(k)
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([])
                self.free.append(self.capacity)
            self.items[b].append(int(i))
            self.free[b] = room = room - s
            if room:
                if not rooms[room]:
                    bisect.insort(open_rooms, room)
                rooms[room].append(b)


class _Sources:
    """Bins by the sizes of their items and by the sums of two of them."""

    def __init__(self, items: list[list[int]], sizes: list[int]):
        self.items, self.sizes = items, sizes
        self.bins: tuple[dict, dict] = ({}, {})  # of one item, of two: size -> bins
        self.have = [0, 0]  # bit s is set where size s occurs
        self.kept: dict[int, tuple] = {}

    def add(self, b: int) -> None:
        count = Counter(self.sizes[i] for i in self.items[b])
        one = sorted(count)
        two = {s + t for k, s in enumerate(one) for t in one[:k]} | {2 * s for s, n in count.items() if n > 1}
        self.kept[b] = one, two
        for kind, found in enumerate((one, two)):
            for s in found:
                if s not in self.bins[kind]:
                    self.bins[kind][s] = set()
                    self.have[kind] |= 1 << s
                self.bins[kind][s].add(b)

    def remove(self, b: int) -> None:
        for kind, found in enumerate(self.kept.pop(b)):
            for s in found:
                left = self.bins[kind][s]
                left.remove(b)
                if not left:
                    del self.bins[kind][s]
                    self.have[kind] ^= 1 << s

    def greatest(self, kind: int, most: int) -> int:
        """The greatest size of at most `most`; -1 for none."""
        return (self.have[kind] & ((2 << most) - 1)).bit_length() - 1

    def taken(self, b: int, kind: int, size: int) -> list[int]:
        """The item of bin b, or its two, of that size."""
        by_size: dict[int, int] = {}
        for i in self.items[b]:
            s = self.sizes[i]
            if not kind and s == size:
                return [i]
            if size - s in by_size:
                return [by_size[size - s], i]
            by_size.setdefault(s, i)
        raise KeyError(size)


def local_search(items: list[list[int]], free: list[int], sizes: np.ndarray) -> None:
    """Improve bins in place until no step is left: moves and exchanges of one or two items for one at most, from any
    emptier bin to a fuller one.

    Each step raises the sum of squared fills. Bins are filled from the fullest on, each taking what brings it nearest
    to full, from the emptiest bin that has it. A bin that has been emptied stays as an empty list.
    """
    size, changed = [int(s) for s in sizes], True
    while changed:
        changed = False
        left = [(free[b], b) for b in range(len(items)) if items[b] and free[b] > 0]
        heapq.heapify(left)
        sources = _Sources(items, size)
        for _, b in left:
            sources.add(b)
        while left:
            room, target = heapq.heappop(left)
            if target not in sources.kept:
                continue
            if room != free[target]:  # it has given since
                heapq.heappush(left, (free[target], target))
                continue
            sources.remove(target)
            while free[target] and _improve(sources, free, target):
                changed = True


def _improve(sources: _Sources, free: list[int], target: int) -> bool:
    """One step that takes bin `target` nearest to full, from a bin that is no fuller."""
    room, items, sizes = free[target], sources.items, sources.sizes
    best, what, seen = 0, None, set()
    for j in [None, *items[target]]:
        out = 0 if j is None else sizes[j]
        if out in seen:
            continue
        seen.add(out)
        for kind in (0, 1):
            s = sources.greatest(kind, out + room)
            if s - out > best:
                best, what = s - out, (kind, s, j)
        if best == room:
            break
    if what is None:
        return False
    kind, s, back = what
    source = max(sources.bins[kind][s], key=lambda b: (free[b], b))
    sources.remove(source)
    give = sources.taken(source, kind, s)
    items[source] = [i for i in items[source] if i not in give] + ([] if back is None else [back])
    items[target] = [j for j in items[target] if j != back] + give
    free[target] -= best
    free[source] += best
    if items[source]:
        sources.add(source)
    return True


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset in it of each item."""
    bins = _Bins(capacity)
    bins.best_fit(sizes)
    local_search(bins.items, bins.free, sizes)
    number, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for n, got in enumerate(x for x in bins.items if x):
        at = 0
        for i in got:
            number[i], offset[i] = n, at
            at += int(sizes[i])
    return number, offset


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of every document.

    Documents are dealt to shards by hash, so an order of the rows (a curriculum's, say) isn't kept between sequences. A
    null or empty text is the end id alone. Equal rows, and rows of one doc_id, are distinct documents. An empty table
    gives an empty result. Columns besides doc_id and text are not read.
    """
    cut = materialize(pieces(docs, tokenizer, capacity, end), "pieces")
    full, part = cut.filter(F.col("length") == capacity), cut.filter(F.col("length") < capacity)
    shards = max(1, round(part.count() / shard_pieces))
    dealt = part.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    # the shard's number is above, so that sequences of different shards differ
    step = 1 << 32

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        number, offset = pack_sizes(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = number + int(rows["_shard"].iloc[0]) * step
        rows["offset"] = offset
        return rows.drop(columns="_shard")

    kind = dict(docs.dtypes)["doc_id"]
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("_shard").applyInPandas(place, out)
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)
