"""Byte-pair encoding and decoding by a vocabulary file, in Arrow batches.

A piece of text is a doubly linked list of symbols; a priority queue holds the merge ranks of neighbours, and entries
whose neighbours have changed since are skipped. So a piece of n letters takes n log n steps, however long. Pieces
that occur again are looked up. Decoding concatenates the vocabulary's strings.

The file's normal form and cuts are those of its library; for the form that cuts at white space and signs they are done
here for ASCII words, one by one.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The normal form and cuts for which words can be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for printable ASCII in lower case.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = re.compile(r"[!-~]+")
#: Small letters that composition and lower-casing leave as they are (Latin, Greek, Cyrillic), with the signs behind them.
SIMPLE = re.compile(r"([a-zß-öø-ÿα-ωа-џ]+)([!-@\[-`{-~]*)")
#: Bytes of texts that are encoded between looks at the size of what was learned.
SLICE = 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def letter_bytes() -> dict[str, int]:
    """The byte for each letter of byte-level vocabularies: letters that print stand for themselves, else 256 and on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Merge ranks over symbols by number."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix, self.end = vocab, suffix, max(vocab.values(), default=-1) + 1
        self.letters = {x: n for x, n in vocab.items() if len(x) == 1}
        none: dict[int, int] = {}
        #: For each symbol the ranks of what it merges with, above 32 bits for a place; `end` merges with nothing.
        self.ranks = [none] * (self.end + 1)
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if self.ranks[vocab[a]] is none:
                self.ranks[vocab[a]] = {}
            self.ranks[vocab[a]][vocab[b]] = rank << 32
            self.made.append(vocab[a + b])

    def symbols(self, piece: str) -> list[int]:
        """The piece's letters, the last with the suffix; letters that the vocabulary lacks are left out."""
        ids = [*map(self.letters.get, piece)]
        ids[-1] = self.vocab.get(piece[-1] + self.suffix)
        return [n for n in ids if n is not None] if None in ids else ids

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols after all merges: always the pair of the least rank, of several the first.

        The list is linked by places. A symbol that was merged away, and what lies beyond both ends, reads as `end`; a queue's
        entry whose pair no longer has its rank is skipped."""
        ranks, made, end, n = self.ranks, self.made, self.end, len(ids)
        queue = [r + i for i, (a, b) in enumerate(pairwise(ids)) if (r := ranks[a].get(b)) is not None]
        if not queue:
            return ids
        heapify(queue)
        ids = [*ids, end]  # also the place before the first
        after, before = [*range(1, n + 1)], [*range(-1, n)]
        while queue:
            top = heappop(queue)
            at = top & 0xFFFFFFFF
            right = after[at]
            if ranks[ids[at]].get(ids[right]) != top - at:
                continue
            ids[at] = new = made[top >> 32]
            ids[right] = end
            after[at] = right = after[right]
            before[right] = at
            if (r := ranks[new].get(ids[right])) is not None:
                heappush(queue, r + at)
            left = before[at]
            if (r := ranks[ids[left]].get(new)) is not None:
                heappush(queue, r + left)
        return [x for x in ids if x != end]


class _Learned(dict):
    """Packed ids of words and pieces, found when first asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, text: str | bytes) -> bytes:
        ids = self[text] = self.find(text)
        return ids


class BytePairs:
    """Encodes and decodes by a tokenizers file with a byte-pair model."""

    #: Bytes of texts and ids after which what was learned is set aside; what is asked for again is taken from there.
    LIMIT = 60_000_000
    #: What an entry takes besides its letters and ids.
    OVERHEAD = 230

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        model = form["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"{path}: a plain byte-pair model is needed, without {', '.join(odd) or model.get('type')}")
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = Merges(self.vocab, model["merges"], model.get("end_of_word_suffix") or "")
        library = Tokenizer.from_file(path)  # for its normal form and cuts
        self.normalizer, self.cuts = library.normalizer, library.pre_tokenizer
        added = form.get("added_tokens") or []
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens must stand for themselves")
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None
        pre = form.get("pre_tokenizer") or {}
        cuts = pre.get("pretokenizers") or [{}, {}]
        cut = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
        level = cuts[-1].get("type") == "ByteLevel" and not cuts[-1].get("add_prefix_space") and not cuts[-1].get("use_regex")
        self.by_word = (form.get("normalizer") or {}).get("normalizers") == NORMALIZERS and len(cuts) == 2 and cuts[0] == cut and level
        # an added token that SIMPLE words could hold, or white space cut
        self.by_word &= not any(re.search(r"\s", t) or not re.search(r"[a-z]", t) or t.isalpha() for t in self.added)
        # where lower-casing of A-Z first could change the result: capitals that compose otherwise with a mark of
        # U+0300 to U+037F than their small letters, and what would read as an added token
        self.kept_case = [b"\xcc", b"\xcd", *(t.lower().encode() for t in self.added)]
        self.letters = {b: x for x, b in letter_bytes().items()}
        self.words, self.pieces = _Learned(self._word), _Learned(self._piece)
        self.before: tuple[dict, dict] = ({}, {})
        self.held = 0
        self._set_strings(form.get("decoder"))

    def _set_strings(self, decoder: dict | None) -> None:
        """The vocabulary as one Arrow array of what each id adds to a text."""
        if decoder is not None and decoder.get("type") != "ByteLevel":
            raise ValueError(f"decoder {decoder.get('type')} isn't known")
        self.between = b"" if decoder else b" "
        strings = [b""] * (max([*self.vocab.values(), *self.added.values()], default=-1) + 1)
        as_byte = letter_bytes()
        for text, i in self.vocab.items():
            strings[i] = bytes(map(as_byte.get, text)) if decoder and all(x in as_byte for x in text) else text.encode()
        for text, i in self.added.items():
            strings[i] = text.encode()
        self.strings = pa.array([s + self.between if s else s for s in strings], pa.large_binary())

    def _merged(self, piece: str) -> bytes:
        return array("I", self.merges.merge(self.merges.symbols(piece))).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece in the vocabulary's letters."""
        if (ids := self.before[1].get(piece)) is None:
            ids = self._merged(piece)
        self.held += 2 * len(piece) + len(ids) + self.OVERHEAD
        return ids

    def _word(self, word: bytes) -> bytes:
        """A word between white space, A-Z lower-cased unless that could matter."""
        if (ids := self.before[0].get(word)) is None:
            text = word.decode("utf-8", "replace")
            if not (simple := SIMPLE.fullmatch(text)):
                ids = self._text(text)
            elif signs := simple[2]:
                ids = self.words[word[: -len(signs)]] + b"".join(map(self.pieces.__getitem__, ASCII_PIECES.findall(signs)))
            else:
                ids = self._merged(text if text.isascii() else "".join(map(self.letters.__getitem__, word)))
        self.held += len(word) + len(ids) + self.OVERHEAD
        return ids

    def _text(self, text: str) -> bytes:
        parts = self.find_added.split(text) if self.find_added else [text]  # added tokens are every other part
        return b"".join(array("I", [self.added[p]]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        if self.by_word and PRINTABLE.fullmatch(text):
            found = ASCII_PIECES.findall(text.lower())
        else:
            if self.normalizer is not None:
                text = self.normalizer.normalize_str(text)
            found = [p for p, _ in self.cuts.pre_tokenize_str(text)] if self.cuts is not None else [text] if text else []
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if self.held > self.LIMIT:
            self.before, self.held = (dict(self.words), dict(self.pieces)), 0
            self.words.clear()
            self.pieces.clear()
        if not self.by_word:
            return [self._text(t.decode("utf-8", "replace")) for t in texts]
        get, out = self.words.__getitem__, []
        for text in texts:
            low = text.lower()  # A-Z only
            words = (text if any(x in low for x in self.kept_case) else low).split()  # at the six white-space bytes of ASCII
            out.append(b"".join(map(get, words)))
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of the ids between each two bounds. Ids that the vocabulary lacks add nothing."""
        known = np.where(ids < len(self.strings), ids, 0).astype(np.int64)
        if (gone := ids >= len(self.strings)).any():
            keep = ~gone
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            known = known[keep]
        said = self.strings.take(pa.array(known))
        at = np.frombuffer(said.buffers()[1], np.int64, len(said) + 1, 8 * said.offset)[bounds]
        data = memoryview(said.buffers()[2]) if len(known) else memoryview(b"")
        last = len(self.between)
        texts = [bytes(data[a : b - last]) if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if last:
            return pa.array(texts, pa.binary()).cast(pa.string())
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())


_held: dict[str, BytePairs] = {}


def byte_pairs(path: str) -> BytePairs:
    """The file's encoder; a worker keeps one."""
    if path not in _held:
        _held.clear()
        _held[path] = BytePairs(path)
    return _held[path]


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of runs of rows that hold about `most`; a larger row is alone."""
    total, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", ids: str = "ids", packed: bool = False) -> DataFrame:
    """docs with the ids of each whole text: an array of numbers or, packed, little-endian unsigned 32-bit ones.

    No special token is added; those that the text spells out are encoded as themselves. A null or empty text has no ids;
    texts may be of any length; equal rows are encoded alike; an empty table stays empty. Other columns stay as they are; one
    named as the result is refused.
    """
    if ids in docs.columns:
        raise ValueError(f"there is a column {ids} already; name another")
    path, at = tokenizer or default_tokenizer(), docs.columns.index(text)
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for begin, end in slices(batch, sizes):
                part = batch.slice(begin, end - begin)
                found = pairs.encode([t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()])
                if packed:
                    out = pa.array(found, pa.binary())
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                    out = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, kind)]))


def decode(rows: DataFrame, tokenizer: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids (an array of numbers, or packed), special tokens included. Null ids have a null text,
    no ids an empty one; an id that the vocabulary lacks, a null one too, adds nothing. A column named as the result is
    refused; an empty table stays empty."""
    if text in rows.columns:
        raise ValueError(f"there is a column {text} already; name another")
    path, at = tokenizer or default_tokenizer(), rows.columns.index(ids)
    packed = isinstance(rows.schema[ids].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path)
        for batch in batches:
            column = batch.column(at)
            sizes = (pc.divide(pc.binary_length(column), 4) if packed else pc.list_value_length(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for begin, end in slices(batch, sizes, SLICE // 4):
                part, many = batch.slice(begin, end - begin), sizes[begin:end]
                if packed:
                    numbers = np.frombuffer(b"".join(x or b"" for x in part.column(at).to_pylist()), "<u4")
                else:
                    numbers = part.column(at).flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype("<u4")
                said = pairs.decode(numbers, np.concatenate([[0], np.cumsum(many)]).astype(np.int64))
                said = pc.if_else(part.column(at).is_valid(), said, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, said], [*part.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))
