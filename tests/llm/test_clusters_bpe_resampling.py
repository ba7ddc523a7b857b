"""Centroid clustering, byte-pair encoding and importance resampling, each against a plain version and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, seed=5, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(64)], 0) for i in range(n)]
    rows += [(n + i, rows[3][1], 0) for i in range(90)]  # one vector has much of the table
    return rows + [(5000, None, 0), (5001, [1.0] * 63, 0), (5002, [None] + [1.0] * 63, 0), (5003, [math.nan] * 64, 0), (5004, [math.inf] + [0.0] * 63, 0), (5005, [], 0)]


def lloyd(rows, clusters=16, rounds=3, seed=1):
    """Vector by vector in Python's numbers."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centers = [v for _, v in order[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda: [min((far(v, c), k) for k, c in enumerate(centers)) for _, v in kept]
    for _ in range(rounds):
        to = place()
        for k in range(len(centers)):
            inside = [v for (_, v), (_, at) in zip(kept, to, strict=True) if at == k]
            if inside:
                centers[k] = [sum(x) // len(inside) for x in zip(*inside, strict=True)]
    return {i: (k, d) for (i, _), (d, k) in zip(kept, place(), strict=True)}, centers


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_clusters(spark, scale):
    """Values of the larger scale are beyond the sizes that are compared in 64 bits, and some distances beyond a long."""
    from briefmill.llm.clusters import report

    rows = vectors(scale=scale, n=300 if scale == 1 else 40)
    want, centers = lloyd(rows)
    got = report(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    fits = lambda x: x if x < 2**63 else None
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in got} == {i: (k, fits(d)) for i, (k, d) in want.items()}
    assert {(r["cluster"], r["centroid_sha256"]) for r in got} == {(k, hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for k, _ in want.values()}
    if scale == 1:
        sums = Counter()
        for k, d in want.values():
            sums[k] += d
        assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) for r in got)


def test_clusters_ties_go_to_the_first_and_empty_ones_stay(spark):
    from briefmill.llm.clusters import cluster

    rows = [(i, [1.0] * 64, 0) for i in range(20)]
    placed, centers = cluster(spark.createDataFrame(rows, VECTORS))
    assert {(r["cluster"], r["distance"]) for r in placed.collect()} == {(0, 0)} and centers == [[64] * 64] * 16


def test_clusters_odd(spark):
    from briefmill.llm.clusters import cluster, report

    assert report(spark.createDataFrame([], VECTORS)).collect() == [] and cluster(spark.createDataFrame([], VECTORS))[1] == []
    rows = [(None, [1.0] * 64, 1, 2), (None, [1.0] * 64, 1, 2), (7, [-0.3] * 64, 1, 2), (7, [2.0] * 64, None, None), (8, [1e30] * 64, 1, 1)]
    got = report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, distance long")).collect()
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in got) == [(0, 0), (0, 0), (7, 0), (7, 0)] and len(got[0]) == 6


ALPHABET = [*"abcDEf'st.,!<|>09 \n\t\x1c\x85\xa0é́̈ΣσİßДжÅK가각中🙂‍ͅǅﬁ", "<|endoftext|>", "<|STARTOFTEXT|>", "'re", "'LL", "  ", "<|startoftext|>"]


@pytest.fixture(scope="module")
def texts(docs_texts):
    rng = random.Random(8)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    made += ["a" + chr(c) + "b " + chr(c) * 2 + "! A" + chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    return made + docs_texts


@pytest.fixture(scope="module")
def docs_texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice(["an", "ti", "on", "re", "sh", "ä", "ed", "É"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", ",\n", "'s", "***", "12"]) for _ in range(k))
    return [say(rng.randint(1, 150)) for _ in range(150)] + [say(9000), "xyz" * 20_000, "", "   ", "!" * 5000]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_as_the_library(texts, name):
    import public_tokenizers

    from briefmill.llm.bpe import BytePairs

    own, other = BytePairs(public_tokenizers.path(name)), library(public_tokenizers.path(name))
    some = texts if own.by_word else texts[::7]
    got = [np.frombuffer(x, "<u4") for x in own.encode([t.encode() for t in some])]
    said = own.decode(np.concatenate(got), np.cumsum([0, *map(len, got)])).to_pylist()
    for t, ids, back in zip(some, got, said, strict=True):
        want = other.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and back == other.decode(want, skip_special_tokens=False), t[:80]


def plain_merges(ids, ranks, made):
    """Always the first of the pairs of least rank, found by looking at all."""
    ids = list(ids)
    while len(ids) > 1:
        best = min(((ranks[a].get(b, math.inf), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))))
        if best[0] == math.inf:
            return ids
        ids[best[1] : best[1] + 2] = [made[best[0] >> 32]]
    return ids


def test_merges_take_the_least_rank_first():
    from briefmill.llm.bpe import Merges

    rng = random.Random(1)
    for _ in range(60):
        vocab = {x: i for i, x in enumerate(["a", "b", "c", "a>", "b>", "c>"])}
        merges = []
        while len(merges) < 25:
            a, b = rng.choice([*vocab]), rng.choice([*vocab])
            if ">" not in a and len(a + b) < 9 and (a, b) not in merges:
                vocab.setdefault(a + b, len(vocab))
                merges.append((a, b))
        m = Merges(vocab, merges, ">")
        for _ in range(50):
            ids = m.symbols("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))))
            assert m.merge(list(ids)) == plain_merges(ids, m.ranks, m.made)


def test_bpe_forgets_without_changing_results(docs_texts, monkeypatch):
    from briefmill.llm.bpe import BytePairs, default_tokenizer

    raw = [t.encode() for t in docs_texts[:60]]
    want = BytePairs(default_tokenizer()).encode(raw)
    monkeypatch.setattr(BytePairs, "LIMIT", 1)
    one = BytePairs(default_tokenizer())
    assert [one.encode([t])[0] for t in raw] == want and len(one.words) < 200


@pytest.mark.parametrize("packed", [True, False])
def test_bpe_tables(spark, docs_texts, packed):
    from briefmill.llm import bpe

    other = library(bpe.default_tokenizer())
    rows = [(i, t) for i, t in enumerate(docs_texts)] + [(None, "<|endoftext|> Twice"), (None, "<|endoftext|> Twice"), (900, None)]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), packed=packed, ids="n").drop("text"), ids="n").collect()
    assert len(got) == len(rows)
    held = {r["doc_id"]: r for r in got}
    for i, t in rows:
        want = other.encode(t or "", add_special_tokens=False).ids
        ids = np.frombuffer(held[i]["n"], "<u4").tolist() if packed else held[i]["n"]
        assert ids == want and held[i]["text"] == other.decode(want, skip_special_tokens=False)


def test_bpe_odd(spark):
    from briefmill.llm import bpe

    empty = bpe.encode(spark.createDataFrame([], "doc_id long, text string"))
    assert bpe.decode(empty.drop("text")).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([], "ids long, text string"))
    with pytest.raises(ValueError):
        bpe.decode(empty)
    rows = spark.createDataFrame([(1, [3306, 99_999, None, 1002]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: r["text"] for r in bpe.decode(rows).collect()} == {1: "hello</w> world</w>", 2: None, 3: ""}


def plain_resample(docs, target, run, buckets=10_000, percent=10, least=20, seed=2024):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(split(x))), Counter(bucket(f) for x in target for f in runs(split(x)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, x in docs:
        words = split(x)
        found = [gain(bucket(f)) for f in runs(words)]
        weight = math.floor(sum(found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, (r[:5] for r in rows)))


@pytest.mark.parametrize(("run", "nodes"), [(1, 500_000), (1, 40), (3, 500_000), (2, 100)])
def test_resampling(spark, docs_texts, monkeypatch, run, nodes):
    """With few nodes a task's trie begins anew again and again, to the same results."""
    from briefmill.llm import resampling

    monkeypatch.setattr(resampling, "MOST_NODES", nodes)
    docs = [(i, t) for i, t in enumerate(docs_texts)] + [(1000 + i, docs_texts[5] + " Éé x9") for i in range(60)] + [(2000, None)]
    target = [*docs_texts[20:30], None, "an ti on"]
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(*tables, run=run, percent=30)
    assert sorted(str([*r]) for r in got.collect()) == plain_resample(docs, target, run, percent=30)


def test_resampling_odd(spark):
    from briefmill.llm.resampling import resample, sample

    some, none = "doc_id long, text string, rank string, weight int", spark.createDataFrame([], "text string")
    assert resample(spark.createDataFrame([], some), none).collect() == []
    rows = [(None, "a " * 30, "x", 1)] * 2 + [(4, "b " * 30, None, None)] * 8 + [(5, "c", None, 2), (6, None, None, 2)]
    got = resample(spark.createDataFrame(rows, some), none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len(got) == 12
    want = plain_resample([r[:2] for r in rows], [], 1, percent=50)
    assert sorted(str([*r]) for r in got) == want
    kept = sample(spark.createDataFrame(rows, some), none, percent=50)
    assert kept.columns == ["doc_id", "text", "rank", "weight"] and set(kept.toPandas()["text"]) <= {"a " * 30, "b " * 30} and kept.count() >= 5
