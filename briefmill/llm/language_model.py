"""Scoring of texts by a gated recurrent language model.

Words are counted over all training documents. The most frequent ones and the end of a text are the model's own words,
in classes of like frequency; all others are one more class, within which their smoothed counts decide. The network (a
gated recurrent unit with class-factored softmax outputs, in numpy) is trained by truncated backpropagation on every token
of every training document: documents lie end to end in lanes that are read side by side, window after window, with the
state carried along until a document ends. Groups of documents train copies of the network, whose average starts the next
round, in which every document is read again. To score, each text is read in the same way, from its first word to its end.

Texts are split once and stay in blocks of tokens. For the counts a block sends each bucket its distinct words, and learns
how often each occurs in training.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.blocks import open_block, text_blocks
from briefmill.llm.common import discard, materialize, pack_sorted, unpack_sorted
from briefmill.llm.shingles import split_words

WORDS, CLASSES, HIDDEN = 1024, 24, 16
WINDOW, LANES = 24, 256
ROUNDS, TRAINER_TOKENS, LEAST_STEPS, RATE = 2, 4_000_000, 60, 0.02
BLOCK_BYTES, BUCKET_BYTES = 24_000_000, 24_000_000
FOLDS, HELD_OUT = 5, 1
END = np.uint64(0)  # no word has this name
LOG10 = float(np.log(10))

_TOKENS = ["block", "ids", "nulls", "many", "words", "places"]
_COUNTED = "bucket int, block long, words binary, counts binary"
_ROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])


def held_out(ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return np.array([not z and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i, z in zip(ids.tolist(), nulls, strict=True)], bool)


def tokens(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted names of the distinct tokens of all texts, A-Z lower-cased, for each token its place among them, and how
    many each text has; every text ends with END."""
    names, place, many = split_words(raw, sizes)
    every, at = np.unique(np.concatenate([np.maximum(names, np.uint64(1)), [END]]).astype(np.uint64), return_inverse=True)
    flat = np.insert(place, np.cumsum(many), len(names))
    return every, at.astype(np.int32)[flat], many + 1


def _token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as tokens: names of the distinct ones, most frequent first, and places in byte planes."""
    for row in _rows(batches):
        _, _, words, place, many = open_tokens(row)
        order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        planes = np.ascontiguousarray(rank[place].view(np.uint8).reshape(-1, 4).T)
        zipped = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        values = [row["block"], row["ids"], row["nulls"], many.astype("<i8").tobytes(), words[order].tobytes(), zipped]
        yield pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in values[1:]]], _TOKENS)


def open_tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, which of them are null, and what tokens() gives for a block of tokens or of texts."""
    if "text" in row:
        ids, nulls, sizes, raw = open_block(row["ids"], row["nulls"], row["sizes"], row["text"])
        return ids, nulls, *tokens(raw, sizes)
    many, words = np.frombuffer(row["many"], "<i8"), np.frombuffer(row["words"], np.uint64)
    n = int(many.sum())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["places"], max_output_size=max(1, 4 * n)), np.uint8)
    order = np.argsort(words)
    at = np.empty(len(order), np.int32)
    at[order] = np.arange(len(order))
    place = at[np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()]
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), words[order], place, many


def _cuts(words: np.ndarray, buckets: int) -> np.ndarray:
    bounds = np.array([-(-(b << 64) // buckets) for b in range(buckets)], np.uint64)
    return np.concatenate([np.searchsorted(words, bounds), [len(words)]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, nulls, words, place, many = open_tokens(row)
            train = np.repeat(~held_out(ids, nulls), many)
            count = np.bincount(place[train], minlength=len(words)).astype("<u4")
            cut = _cuts(words, buckets)
            out: list[list] = [[], [], [], []]
            for b in range(buckets):
                part = slice(cut[b], cut[b + 1])
                if part.start < part.stop:
                    for c, x in zip(out, (b, row["block"], pack_sorted(words[part]), count[part].tobytes()), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ROW, strict=True)], schema=_ROW)

    return run


def _total(most: int):
    """A bucket: the training count of each word, for each block that has it (as it stands there), and in a row of no block
    the bucket's sum, distinct words and most frequent ones."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [unpack_sorted(r["words"]) for r in rows]
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]), minlength=len(every))
        total = total.astype("<u8")
        top = np.lexsort((every, -total.astype(np.int64)))[:most]
        top = np.sort(top[total[top] > 0])
        head = np.array([total.sum(), (total > 0).sum()], "<u8")
        out = [{"bucket": rows[0]["bucket"], "block": None, "words": every[top].tobytes(), "counts": head.tobytes() + total[top].tobytes()}]
        at = 0
        for r, w in zip(rows, words, strict=True):
            part = total[place[at : at + len(w)]]
            at += len(w)
            out.append({"bucket": r["bucket"], "block": r["block"], "words": None, "counts": zlib.compress(part.tobytes(), 1)})
        return pa.Table.from_pylist(out, schema=_ROW)

    return run


class Vocabulary:
    """The model's own words with their ids and classes; id len(words) stands for all others, in the last class."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int, most: int = WORDS, classes: int = CLASSES):
        """words, counts: the candidates, END among them if it has been seen."""
        is_end = words == END
        order = np.lexsort((words, -counts.astype(np.int64)))
        order = order[~is_end[order]][: most - 1]
        self.n, self.v = n, v
        self.words = np.concatenate([[END], words[order]]).astype(np.uint64)
        self.counts = np.concatenate([[counts[is_end].sum()], counts[order]]).astype(np.float64)
        self.rest_n, self.rest_v = n - self.counts.sum(), max(0, v - int((self.counts > 0).sum()))
        # classes of like frequency, so that each has a like part of the square roots of the counts
        rank = np.argsort(-self.counts, kind="stable")
        part = np.sqrt(self.counts[rank] + 0.5)
        made = np.minimum((np.cumsum(part) - part / 2) / part.sum() * classes, classes - 1).astype(np.int64)
        made = np.unique(made, return_inverse=True)[1]
        self.class_of = np.empty(len(self.words) + 1, np.int64)
        self.class_of[rank] = made
        self.n_classes = int(made.max()) + 2
        self.class_of[-1] = self.n_classes - 1
        self.members = [np.flatnonzero(self.class_of[:-1] == c) for c in range(self.n_classes - 1)]
        self.inside = np.zeros(len(self.words) + 1, np.int64)
        for m in self.members:
            self.inside[m] = np.arange(len(m))
        # words stand by frequency, the end aside, so that nearly every class is a run of them
        self.runs = [slice(int(m[0]), int(m[-1]) + 1) if len(m) and m[-1] - m[0] + 1 == len(m) else m for m in self.members]
        self.by_name = np.argsort(self.words, kind="stable")

    def ids(self, names: np.ndarray) -> np.ndarray:
        ranked = self.words[self.by_name]
        at = np.minimum(np.searchsorted(ranked, names), len(ranked) - 1)
        return np.where(ranked[at] == names, self.by_name[at], len(self.words))


def start(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """A network that gives every text its words' smoothed frequencies, whatever the state."""
    rng, h, n = np.random.default_rng(seed), HIDDEN, len(vocabulary.words)
    mass = np.array([vocabulary.counts[m].sum() for m in vocabulary.members] + [max(vocabulary.rest_n, 0)]) + 0.5
    return {
        "inputs": (0.1 * rng.standard_normal((n + 1, 3 * h))).astype(np.float32),
        "state": (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32),
        "class": np.zeros((h, vocabulary.n_classes), np.float32), "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "word": np.zeros((h, n), np.float32), "word_bias": np.log(vocabulary.counts + 0.5).astype(np.float32),
    }


def gates(net: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights of inputs (3, tokens, HIDDEN) and state (3, HIDDEN, HIDDEN), a gate after the other, so that each step's
    arrays are whole."""
    apart = lambda w: np.ascontiguousarray(w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2))
    return apart(net["inputs"]), apart(net["state"])


def step(net: dict | tuple, h: np.ndarray, x: np.ndarray, tape: tuple | None = None) -> tuple:
    """The state after token x, and what the way back needs (gates and new part, written to tape). net may be its gates()."""
    weights = gates(net) if isinstance(net, dict) else net
    a, (g, n) = weights[0].take(x, axis=1), tape or (np.empty((3, *h.shape), h.dtype), np.empty_like(h))
    np.matmul(h, weights[1], out=g)
    zr = g[:2]
    zr += a[:2]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    np.multiply(zr[1], g[2], out=n)
    n += a[2]
    np.tanh(n, out=n)
    new = h - n
    new *= zr[0]
    new += n
    return new, (g, n)


def outputs(net: dict, vocabulary: Vocabulary, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
    """The log probability of token y after state h (of an other word: of their class); with grads also the loss's
    gradient by h, adding up those of the weights."""
    # tokens in order of classes; one column for each: sums over classes or words then run along rows
    c = vocabulary.class_of[y]
    order = np.argsort(c.astype(np.int16), kind="stable")
    c, inside, h = c[order], vocabulary.inside[y[order]], h.take(order, axis=0)
    cut, rows = np.searchsorted(c, np.arange(vocabulary.n_classes)), np.arange(len(y))
    ht = np.ascontiguousarray(h.T)
    z = net["class"].T @ ht
    z += net["class_bias"][:, None]
    z -= z.max(axis=0)
    got = z[c, rows]
    p = np.exp(z, out=z)
    s = p.sum(axis=0)
    got -= np.log(s)
    if grads is not None:
        p /= s
        p[c, rows] -= 1
        grads["class"] += ht @ p.T
        grads["class_bias"] += p.sum(axis=1)
        back = p.T @ net["class"].T
    for k, members in enumerate(vocabulary.runs):
        own = slice(cut[k], cut[k + 1])
        if own.start == own.stop or len(vocabulary.members[k]) == 1:
            continue
        weights, some = net["word"][:, members], ht[:, own]
        z = weights.T @ some
        z += net["word_bias"][members][:, None]
        z -= z.max(axis=0)
        at, one = inside[own], rows[: own.stop - own.start]
        mine = z[at, one]
        p = np.exp(z, out=z)
        s = p.sum(axis=0)
        got[own] += mine - np.log(s)
        if grads is not None:
            p /= s
            p[at, one] -= 1
            grads["word"][:, members] += some @ p.T
            grads["word_bias"][members] += p.sum(axis=1)
            back[own] += p.T @ weights.T
    out = np.empty_like(got)
    out[order] = got
    if grads is None:
        return out
    by_token = np.empty_like(back)
    by_token[order] = back
    return out, by_token


def backpropagate(
    net: dict, vocabulary: Vocabulary, h: np.ndarray, x: np.ndarray, fresh: np.ndarray | None = None
) -> tuple[np.ndarray, dict, float]:
    """The state after a window x (texts, tokens; -1 after a text's end), the gradients within it, and the loss. Where
    fresh holds, a text begins and the state before is dropped."""
    k, grads = HIDDEN, {name: np.zeros_like(w) for name, w in net.items()}
    steps, xt = x.shape[1], np.ascontiguousarray(x.T)
    there, known = (xt >= 0).ravel(), np.maximum(xt, 0)
    begins = fresh.any(axis=0) if fresh is not None else np.zeros(steps, bool)
    weights, before = gates(net), np.empty((steps, len(x), k), h.dtype)
    zrg, n = np.empty((3, *before.shape), h.dtype), np.empty_like(before)
    for t in range(steps):
        if begins[t]:
            h = np.where(fresh[:, t, None], 0, h)
        before[t] = h
        h = step(weights, h, known[t], (zrg[:, t], n[t]))[0]
    z, r, g = zrg
    full, flat, y = bool(there.all()), before.reshape(-1, k), xt.ravel()
    if not full:
        flat, y = flat[there], y[there]
    logs, d_states = outputs(net, vocabulary, flat, y, grads)
    if not full:
        back, d_states = d_states, np.zeros((steps * len(x), k), h.dtype)
        d_states[there] = back
    d_states = d_states.reshape(steps, len(x), k)
    dh, d_inputs = np.zeros_like(h), np.empty_like(zrg)
    of_n, of_z, of_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), g * r * (1 - r)
    back_state, d_n = np.ascontiguousarray(weights[1].transpose(0, 2, 1)), np.empty_like(n)
    for t in reversed(range(steps)):
        dz, dr, dn = d_inputs[0, t], d_inputs[1, t], d_inputs[2, t]
        np.multiply(dh, of_n[t], out=dn)
        np.multiply(dh, of_z[t], out=dz)
        np.multiply(dn, of_r[t], out=dr)
        np.multiply(dn, r[t], out=d_n[t])
        dh = dh * z[t]
        for d, w in zip((dz, dr, d_n[t]), back_state, strict=True):
            dh += d @ w
        dh += d_states[t]
        if begins[t]:
            dh = np.where(fresh[:, t, None], 0, dh)
    flat = before.reshape(-1, k).T
    for i, d in enumerate((d_inputs[0], d_inputs[1], d_n)):
        grads["state"][:, i * k : (i + 1) * k] += flat @ d.reshape(-1, k)
    order = np.argsort(y.astype(np.int16), kind="stable")
    if len(y):
        first = np.flatnonzero(np.diff(y[order], prepend=-1))
        places = order if full else np.flatnonzero(there)[order]
        words = y[order[first]]
        for i, d in enumerate(d_inputs):
            grads["inputs"][words, i * k : (i + 1) * k] += np.add.reduceat(d.reshape(-1, k).take(places, axis=0), first)
    return h, {name: g / max(1, len(y)) for name, g in grads.items()}, -float(logs.sum())


def lanes(many: np.ndarray, rng: np.random.Generator) -> list[list[int]]:
    """Texts of so many tokens dealt to at most LANES lanes of like length, longest lane first, in random order within each."""
    dealt: list[list[int]] = [[] for _ in range(min(LANES, len(many)))]
    ends = [(0, k) for k in range(len(dealt))]
    for i in np.argsort(-many, kind="stable").tolist():
        length, k = ends[0]
        heapq.heapreplace(ends, (length + int(many[i]), k))
        dealt[k].append(i)
    for lane in dealt:
        rng.shuffle(lane)
    return [dealt[k] for _, k in sorted(ends, key=lambda e: (-e[0], e[1]))]


def windows(ids: np.ndarray, many: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All tokens of all texts, window after window of every lane that has any left: tokens (lanes, WINDOW; -1 after a
    lane's end) and where texts begin. A lane keeps its row."""
    begin, dealt = np.cumsum(many) - many, lanes(many, rng)
    flat = np.concatenate([ids[begin[i] : begin[i] + many[i]] for lane in dealt for i in lane])
    order = np.array([i for lane in dealt for i in lane])
    fresh = np.zeros(len(flat), bool)
    fresh[np.cumsum(many[order]) - many[order]] = True
    length = np.array([many[lane].sum() for lane in dealt])
    start_of, at = (np.cumsum(length) - length)[:, None], np.arange(WINDOW)
    for w in range(0, int(length[0]), WINDOW):
        live = int(np.searchsorted(-length, -w, "left"))  # lanes longer than w
        there = w + at < length[:live, None]
        place = np.where(there, start_of[:live] + w + at, 0)
        yield np.where(there, flat[place], -1).astype(np.int64), fresh[place] & there


def train_on(net: dict, vocabulary: Vocabulary, ids: np.ndarray, many: np.ndarray, seed: int) -> dict:
    """The network after training on every token of the texts (their tokens' ids, `many` >= 1 of them), once or, where
    that makes fewer than LEAST_STEPS steps, up to 12 times."""
    rng = np.random.default_rng(seed)
    net = {name: w.copy() for name, w in net.items()}
    first, second = ({name: np.zeros_like(w) for name, w in net.items()} for _ in range(2))
    rows = min(LANES, len(many))
    per_turn = max(-(-int(many.max()) // WINDOW), -(-int(many.sum()) // (rows * WINDOW)))  # about so many
    turns, done = min(12, max(1, -(-LEAST_STEPS // per_turn))), 0
    for _ in range(turns):
        h = np.zeros((rows, HIDDEN), np.float32)
        for x, fresh in windows(ids, many, rng):
            h, grads, _ = backpropagate(net, vocabulary, h[: len(x)], x, fresh)
            done += 1
            rate = RATE * max(0.1, 1 - 0.9 * done / (turns * per_turn)) * (1 - 0.99**done) ** 0.5 / (1 - 0.9**done)
            # when most lanes have ended, a window says little and moves the weights less
            rate *= min(1.0, 4 * float((x >= 0).mean()) * len(x) / rows)
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                net[name] -= rate * first[name] / (np.sqrt(second[name]) + 1e-7)
    return net


def _flat(net: dict) -> np.ndarray:
    return np.concatenate([net[name].ravel() for name in sorted(net)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for name in sorted(like):
        out[name] = flat[at : at + like[name].size].reshape(like[name].shape).astype(np.float32)
        at += like[name].size
    return out


def log_likelihoods(net: dict, vocabulary: Vocabulary, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The log probability of each text (its tokens' ids, `many` of them): all texts side by side, window after window."""
    out = np.zeros(len(many))
    order = np.argsort(-many, kind="stable")
    length, begin = many[order], (np.cumsum(many) - many)[order]
    h, weights = np.zeros((len(many), HIDDEN), np.float32), gates(net)
    for w in range(0, int(length[0]) if len(length) else 0, WINDOW):
        states, ys, rows = [], [], []
        for t in range(w, w + WINDOW):
            live = int(np.searchsorted(-length, -t, "left"))  # texts longer than t
            if not live:
                break
            y = ids[begin[:live] + t]
            states.append(h[:live])
            ys.append(y)
            rows.append(order[:live])
            h = step(weights, h[:live], y)[0]
        logs = outputs(net, vocabulary, np.concatenate(states), np.concatenate(ys))
        out += np.bincount(np.concatenate(rows), weights=logs, minlength=len(many))
    return out


def _learnt(vocabulary: Vocabulary):
    """The tokens of every training document, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, nulls, words, place, many = open_tokens(row)
            known = vocabulary.ids(words).astype(np.int16)[place]
            begin, train = np.cumsum(many) - many, ~held_out(ids, nulls)
            salt = np.array([zlib.crc32(b"%d" % i) for i in ids.tolist()], np.int64)
            out = [known[a:e].tobytes() for a, e, t in zip(begin, begin + many, train, strict=True) if t]
            yield pa.RecordBatch.from_arrays([pa.array(salt[train]), pa.array(many[train], pa.int64()), pa.array(out, pa.binary())], ["salt", "many", "words"])

    return run


def _trained(net: dict, vocabulary: Vocabulary, seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("salt", "ascending"), ("words", "ascending")])
        many = table.column("many").to_numpy()
        ids = np.frombuffer(b"".join(table.column("words").to_pylist()), np.int16)
        flat = _flat(train_on(net, vocabulary, ids, many, seed)).astype(np.float64) * len(ids)
        group = table.column("trainer")[0].as_py() // 64
        return pa.table({"group": pa.array([group], pa.int64()), "n": pa.array([float(len(ids))]), "net": pa.array([flat.tobytes()], pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Networks of a group added up."""
    flat = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("net"))
    return pa.table({
        "group": pa.array([table.column("group")[0].as_py() // 64], pa.int64()),
        "n": pa.array([float(sum(table.column("n").to_pylist()))]), "net": pa.array([flat.tobytes()], pa.binary()),
    })


def fit(blocks: DataFrame, vocabulary: Vocabulary) -> dict:
    """Train on all of every training document in each of the rounds of averaging; networks count by their tokens."""
    learnt = materialize(blocks.mapInArrow(_learnt(vocabulary), "salt long, many long, words binary"), "learnt")
    net, schema = start(vocabulary), "group long, n double, net binary"
    tokens_in_all = learnt.agg(F.sum("many")).first()[0]
    for r in range(ROUNDS if tokens_in_all else 0):
        trainers = -(-tokens_in_all // TRAINER_TOKENS)
        dealt = learnt.withColumn("trainer", F.pmod(F.xxhash64(F.lit(r), "salt", "words"), F.lit(trainers)).cast("int"))
        nets = dealt.repartition(trainers, "trainer").groupBy("trainer").applyInArrow(_trained(net, vocabulary, r), schema)
        while trainers > 1:
            nets, trainers = nets.groupBy("group").applyInArrow(_summed, schema), -(-trainers // 64)
        n, flat = nets.agg(F.sum("n"), F.max("net")).first() if trainers == 1 else (0, None)  # one network
        net = _shaped(np.frombuffer(bytes(flat), np.float64) / n, net)
    return net


def _scored(net: dict, vocabulary: Vocabulary, buckets: int):
    names_out = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, nulls, words, place, many = open_tokens(row)
            cut, total = _cuts(words, buckets), np.zeros(len(words), np.int64)
            for a in row["answers"] or ():
                total[cut[a["bucket"]] : cut[a["bucket"] + 1]] = np.frombuffer(zlib.decompress(a["counts"]), "<u8")
            n, v = vocabulary.n, vocabulary.v
            base = np.log10((total + 0.5) / (n + 0.5 * (v + 1)))
            own = vocabulary.ids(words)
            rest = np.log10((total + 0.5) / (vocabulary.rest_n + 0.5 * (vocabulary.rest_v + 1)))
            rest[own < len(vocabulary.words)] = 0.0
            text = np.repeat(np.arange(len(many)), many)
            add = lambda x: np.bincount(text, weights=x, minlength=len(many))
            score = log_likelihoods(net, vocabulary, own[place], many) / LOG10 + add(rest[place])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=nulls), pa.array(held_out(ids, nulls)), pa.array(many, pa.int64()),
                pa.array(add((total > 0)[place]).astype(np.int64)), pa.array(np.full(len(many), n, np.int64)),
                pa.array(add(base[place])), pa.array(score),
            ], names_out)

    return run


def score_texts(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    Tokens are words (A-Z lower-cased) and one end of each text; documents whose crc32(doc_id as text) modulo FOLDS is
    HELD_OUT are not learnt from. base_score sums the smoothed log10 frequencies of the tokens, score is the network's
    log10 probability of the whole text. A null or empty text is its end alone; a null doc_id is learnt from. Equal rows
    are distinct documents. Without training documents every count is 0. An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    texts = text_blocks(docs, BLOCK_BYTES)
    blocks = texts.mapInArrow(_token_blocks, "block long, ids binary, nulls binary, many binary, words binary, places binary")
    blocks = materialize(blocks, "token_blocks")
    discard(texts)
    counted = blocks.mapInArrow(_count(buckets), _COUNTED).repartition(buckets, "bucket")
    totals = materialize(counted.groupBy("bucket").applyInArrow(_total(WORDS), _COUNTED), "totals")
    # of all buckets' most frequent words the most frequent: WORDS of them and the end
    sums = totals.filter("block IS NULL").select("words", "counts")

    def spread(batches):
        for row in _rows(batches):
            head = np.frombuffer(row["counts"], "<u8")
            words = np.frombuffer(row["words"], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(2, np.uint64), words]).view(np.int64)), pa.array(head.astype(np.int64)),
                 pa.array([1, 2] + [0] * len(words), pa.int32())], ["word", "n", "kind"],
            )

    flat = sums.mapInArrow(spread, "word long, n long, kind int")
    whole = {r[0]: r[1] for r in flat.filter("kind > 0").groupBy("kind").agg(F.sum("n")).collect()}
    top = flat.filter("kind = 0").orderBy(F.col("word") != 0, F.desc("n"), "word").limit(WORDS + 1).collect()
    words, counts = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    vocabulary = Vocabulary(words, counts, int(whole.get(1, 0)), int(whole.get(2, 0)))
    net = fit(blocks, vocabulary)
    by = totals.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    return blocks.join(by, "block", "left").mapInArrow(
        _scored(net, vocabulary, buckets),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
