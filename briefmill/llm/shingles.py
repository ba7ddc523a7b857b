"""Names of words, word shingles and byte windows: 64-bit hashes, many texts at a time.

Words are named by a cryptographic hash, and what is made of several names goes through a mixer that is not linear, so
that no regularity of texts makes different ones equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from briefmill.llm.common import mix64

#: Bytes of texts that are split at once.
GROUP_BYTES = 8_000_000
#: Fixed odd multipliers of the mixer.
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB))


#: White space of texts, and a place for every byte's value.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def named(words: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), "<u8")


def split_words(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of joined texts of so many bytes (A-Z lower-cased, split at ASCII white space and between texts): names of
    the distinct ones, each word's place among these, and how many words each text has."""
    buf = np.frombuffer(raw.lower(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(len(sizes), np.int64)
    letter = ~SPACE[buf]
    apart = np.ones(len(buf) + 1, bool)  # no word goes on from the byte before
    apart[1:-1] = ~letter[:-1]
    apart[bounds] = True
    begin = np.flatnonzero(letter & apart[:-1])
    apart[:-1] |= ~letter
    end = np.flatnonzero(letter & apart[1:]) + 1
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(buf[letter])])
    coded = words.dictionary_encode()
    many = np.diff(np.searchsorted(begin, bounds))
    return named(coded.dictionary.to_pylist()), coded.indices.to_numpy(), many


def shingle_sets(texts: list[bytes | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: A-Z lower-cased, words split at ASCII white space; with fewer words the
    whole sequence is one shingle; without words there is none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        group: list[bytes] = []
        size = 0
        while at < len(texts) and (not group or size < GROUP_BYTES):
            group.append(texts[at] or b"")
            size += len(group[-1])
            at += 1
        names, place, n = split_words(b"".join(group), np.array([len(g) for g in group], np.int64))
        flat = names[place]
        begin = np.cumsum(n) - n
        many = np.where(n >= words, n - words + 1, 0)  # whole shingles
        hashes = np.full(max(0, len(flat) - words + 1), words, np.uint64)
        for k in range(words):
            hashes = mix64(hashes * FACTORS[0] + flat[k : k + len(hashes)])
        for b, k, m in zip(begin.tolist(), n.tolist(), many.tolist(), strict=True):
            if m:
                out.append(np.unique(hashes[b : b + m]))
            elif k:
                h = np.full(1, k, np.uint64)
                for i in range(b, b + k):
                    h = mix64(h * FACTORS[0] + flat[i : i + 1])
                out.append(h)
            else:
                out.append(np.empty(0, np.uint64))
    return out


def window_names(buf: np.ndarray, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of the `length` (16 at least) bytes from each place of buf: of 8 bytes, then of twice as many again and again.
    Other salts give other hashes."""
    if not len(at):
        return np.empty(0, np.uint64)
    a, b = FACTORS[salt], FACTORS[salt + 1]
    n = len(buf) - 7
    h = np.empty(n, np.uint64)
    for k in range(8):
        part = h[k::8]
        part[:] = buf[k : k + 8 * len(part)].view("<u8")
    h ^= h >> np.uint64(29)
    h *= a
    size = 8
    while 2 * size < length:
        h ^= h >> np.uint64(32)
        h = h[:-size] * a + h[size:]
        h *= b
        size *= 2
    h ^= h >> np.uint64(31)
    return mix64(h[at] * a + h[at + (length - size)])


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
