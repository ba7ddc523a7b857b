"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and
columns with clashing names."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
import pytest

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=3, n=120):
    """Texts with exact and near copies, shared passages, nulls, empty ones and one that is long."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["an", "ti", "on", "re", "sh", "ä", "ed"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", "\n", "\t"]) for _ in range(k))
    passage = say(70)
    texts = [say(rng.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 6):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        texts.append(texts[i].upper() if i % 12 else texts[i])
        texts.append(say(10) + " " + passage + " " + say(8))
    texts += [None, "", "   ", "a b c", "A b C", "a b c d", say(9000), say(9000)[:50]]
    rng.shuffle(texts)
    return [(i, t, "en", rng.choice(["x", "x", "x", "y", "Z", "é", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids, and columns named like the operators' own."""
    rows = [(1, "same words in this text here", "s", "k", 5), (1, "same words in this text here", "s", "k", 5), (None, "same words in this text here", None, "k", 5),
            (2, None, "s", None, None), (3, "", "s", "k", 1), (None, "other words", "s", "k", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, kept long")


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Small tables need no million buckets of rarity; results don't depend on their number."""
    from briefmill.llm import line_dedup

    monkeypatch.setattr(line_dedup, "ROWS", 2)
    monkeypatch.setattr(line_dedup, "PLACES", 512)
    monkeypatch.setattr(line_dedup, "TOKEN_PARTS", 2)


def test_mixing_targets_and_taken(spark, docs):
    from briefmill.llm.mixing import in_training_order, mix

    got = mix(docs).collect()
    sizes = defaultdict(int)
    for r in got:
        assert r["size"] == len(words(r["text"]))
        sizes[r["source"]] += r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, total = set(names), {}, 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    order = [r["position"] for r in in_training_order(mix(docs)).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1


def test_mixing_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    from briefmill.llm.mixing import KNOTS, SCHEDULES, invert_demand

    rows = spark.range(0, 101).select((F.col("id") / 100).alias("y"), (F.col("id") % 3).cast("int").alias("k"))
    for r in rows.select("y", "k", invert_demand(F.col("y"), F.col("k")).alias("t")).collect():
        at = np.linspace(0, 1, 20001)
        w = np.interp(at, KNOTS, SCHEDULES[r["k"]])
        sums = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert abs(np.interp(r["t"], at, sums / sums[-1]) - r["y"]) < 1e-3


def test_mixing_odd(spark, empty, odd):
    from briefmill.llm.mixing import in_training_order, mix

    assert mix(empty).count() == 0
    clash = empty.selectExpr("*", "1 AS epoch", "2 AS position", "3 AS words", "4 AS copies", "5 AS kind", "6 AS taken")
    assert in_training_order(mix(clash)).count() == 0
    got = mix(odd).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got if r["text"]) > 0


def test_suffix_dedup(spark, docs):
    from briefmill.llm.suffix_dedup import remove_repeats

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    seen = Counter(t[k : k + 200] for t in texts.values() for k in range(len(t) - 199))
    for r in remove_repeats(docs, bucket_bytes=20_000).collect():
        t = texts[r["doc_id"]]
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        assert (r["n_bytes"], r["n_removed"], bytes(r["kept"])) == (len(t), gone.sum(), kept)
        assert [tuple(s) for s in r["spans"]] == [tuple(x) for x in turn.reshape(-1, 2)]
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_odd(spark, empty, odd):
    from briefmill.llm.suffix_dedup import COVER, PERIOD, remove_repeats

    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert remove_repeats(empty).count() == 0
    assert remove_repeats(odd).count() == 6
    twice = spark.createDataFrame([(1, "ab" * 150), (1, "ab" * 150)], "doc_id long, text string")
    assert [r["n_removed"] for r in remove_repeats(twice).collect()] == [300, 300]
    one = spark.createDataFrame([(1, "xy" * 101)], "doc_id long, text string")
    assert remove_repeats(one).first()["n_removed"] == 202


def test_toxicity(spark, empty, odd):
    from briefmill.llm.toxicity import score, train

    rng = random.Random(1)
    plain = ["tree", "stone", "river", "cloud", "field", "light", "house", "paper"]
    rows, marks = [], []
    for i in range(900):
        bad = rng.random() < 0.15
        w = [rng.choice(plain) for _ in range(40)] + ([rng.choice(["vilea", "vileb", "grimx"])] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, int(rng.random() < 0.8), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks[:600], "doc_id long, quality int, toxic int")
    chain = train(docs, labels)
    got = by_id(score(docs, chain).collect())
    assert sum(got[i]["rejected"] == bool(t) for i, _, t in marks[600:]) >= 295  # held out
    assert score(empty, chain).count() == 0 and score(odd, chain).count() == 6
    nothing = train(docs, labels.limit(0))
    assert not score(docs, nothing).filter("rejected").count()


def test_toxicity_chain_feeds_earlier_categories():
    from briefmill.llm.toxicity import fit_chain, gather

    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 50, 12)).astype(np.uint32) for _ in range(500)]
    y0 = np.array([float(3 in r) for r in x])
    rows = gather(np.concatenate(x), np.concatenate([[0], np.cumsum([len(r) for r in x])]))
    chain = fit_chain(["a", "b"], rows, np.column_stack([y0, y0]), np.arange(500) % 3)
    assert chain.models[1].extra[0] > 0.1
    assert ((chain.predict(rows)[:, 1] >= chain.threshold) == y0).mean() > 0.98


def test_neighbours_recall_and_scores(spark):
    from briefmill.llm import neighbours

    rng = np.random.default_rng(0)
    x = (rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    got = neighbours.search(vectors.filter("id % 20 = 0"), vectors, 20).collect()
    x = x.astype(np.float64)
    found, exact = defaultdict(list), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["id"])
        assert math.isclose(r["score"], float(x[r["query_id"]] @ x[r["id"]]), rel_tol=1e-12, abs_tol=1e-12)
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        exact = np.lexsort((np.arange(3000), -s))[:20]
        hits += len(set(exact.tolist()) & set(found[q]))
        assert len(found[q]) == 20 and q not in found[q]
    assert hits / (150 * 20) >= 0.9


def test_neighbours_odd(spark):
    from briefmill.llm import neighbours

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in neighbours.search(vectors, vectors, 2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (1, 1, 0, 1.0), (1, 2, 2, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0), (8, 1, 0, -1.0), (8, 2, 1, -1.0)]
    assert neighbours.search(vectors.limit(0), vectors.limit(0), 2).count() == 0


def test_language_model(spark, docs):
    from briefmill.llm.language_model import score_texts

    rows = docs.collect()
    tokens = {r["doc_id"]: [w.translate(LOW) for w in words(r["text"])] + [None] for r in rows}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in tokens.items() if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = by_id(score_texts(docs, bucket_bytes=20_000).collect())
    for i, t in tokens.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_language_model_gradients():
    from briefmill.llm import language_model as lm

    rng = np.random.default_rng(0)
    voc = lm.Vocabulary(np.arange(12, dtype=np.uint64), np.arange(12, 0, -1), 90, 15, most=12, classes=3)
    net = {k: (w + 0.3 * rng.standard_normal(w.shape)).astype(np.float64) for k, w in lm.start(voc).items()}
    x = rng.integers(0, 13, (3, 5))
    x[1, 3:] = -1
    h = 0.1 * rng.standard_normal((3, lm.HIDDEN))
    _, grads, loss = lm.backpropagate(net, voc, h, x)
    count = (x >= 0).sum()
    for name, w in net.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            old, eps = w[at], 1e-5
            w[at] = old + eps
            up = lm.backpropagate(net, voc, h, x)[2]
            w[at] = old - eps
            down = lm.backpropagate(net, voc, h, x)[2]
            w[at] = old
            assert abs((up - down) / (2 * eps) / count - grads[name][at]) < 1e-4, name


def test_language_model_probabilities_and_carried_state():
    from briefmill.llm import language_model as lm

    voc = lm.Vocabulary(np.arange(12, dtype=np.uint64), np.arange(12, 0, -1), 90, 15, most=12, classes=3)
    rng = np.random.default_rng(1)
    net = {k: (w + 0.3 * rng.standard_normal(w.shape)).astype(np.float32) for k, w in lm.start(voc).items()}
    h = rng.standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = lm.outputs(net, voc, np.repeat(h, 13, axis=0), np.arange(13))
    assert abs(np.exp(every).sum() - 1) < 1e-5
    ids = rng.integers(0, 13, 100)
    state, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
    for t in range(70):  # longer than two windows
        total += lm.outputs(net, voc, state, ids[t : t + 1])[0]
        state = lm.step(net, state, ids[t : t + 1])[0]
    got = lm.log_likelihoods(net, voc, ids, np.array([70, 30]))
    assert abs(got[0] - total) < 1e-2


def test_language_model_learns(spark):
    """Held-out texts of alternating words are likelier than by counts alone."""
    from briefmill.llm.language_model import score_texts

    rng = random.Random(0)
    rows = []
    for i in range(300):
        a, b = rng.choice([("up", "down"), ("left", "right"), ("in", "out")])
        rows.append((i, " ".join([a, b] * rng.randint(5, 40))))
    got = [r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


def test_language_model_trains_on_every_token(spark, docs, monkeypatch):
    """Whole training documents leave the blocks and reach the network, the state carried until a document ends."""
    from briefmill.llm import language_model as lm
    from briefmill.llm.blocks import text_blocks

    voc = lm.Vocabulary(np.arange(12, dtype=np.uint64), np.arange(12, 0, -1), 90, 15, most=12, classes=3)
    rows = text_blocks(docs, lm.BLOCK_BYTES).mapInArrow(lm._learnt(voc), "salt long, many long, words binary").collect()
    want = [len(words(r["text"])) + 1 for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    assert sorted(r["many"] for r in rows) == sorted(want) and all(len(r["words"]) == 2 * r["many"] for r in rows)
    rng = np.random.default_rng(2)
    many = np.concatenate([rng.integers(1, 90, 600), [3000]])
    ids = rng.integers(1, 12, many.sum()).astype(np.int16)
    ids[np.cumsum(many) - 1] = 0  # ends
    seen, plain, last = Counter(), lm.backpropagate, {}

    def spy(net, v, h, x, fresh):
        starts = fresh.sum()
        seen.update({"tokens": (x >= 0).sum(), "texts": starts, "sum": x[x >= 0].sum()})
        if last:  # the state that the window before left
            assert np.array_equal(h, last["h"][: len(x)])
        out = plain(net, v, h, x, fresh)
        last["h"] = out[0]
        return out

    monkeypatch.setattr(lm, "backpropagate", spy)
    monkeypatch.setattr(lm, "LEAST_STEPS", 1)
    lm.train_on(lm.start(voc), voc, ids, many, 0)
    assert seen == {"tokens": many.sum(), "texts": len(many), "sum": ids.sum()}


def test_language_model_texts_in_a_lane_are_apart():
    """Two texts end to end give the loss and gradients of the two alone."""
    from briefmill.llm import language_model as lm

    rng = np.random.default_rng(0)
    voc = lm.Vocabulary(np.arange(12, dtype=np.uint64), np.arange(12, 0, -1), 90, 15, most=12, classes=3)
    net = {k: (w + 0.3 * rng.standard_normal(w.shape)).astype(np.float64) for k, w in lm.start(voc).items()}
    x, zero = rng.integers(0, 13, (1, 9)), np.zeros((1, lm.HIDDEN))
    fresh = np.array([[True] + [False] * 4 + [True] + [False] * 3])
    _, one, a = lm.backpropagate(net, voc, zero, x[:, :5])
    _, two, b = lm.backpropagate(net, voc, zero, x[:, 5:])
    _, both, loss = lm.backpropagate(net, voc, zero, x, fresh)
    assert abs(a + b - loss) < 1e-9
    for name in net:
        assert np.allclose(5 * one[name] + 4 * two[name], 9 * both[name], atol=1e-6)


def test_language_model_odd(spark, empty, odd):
    from briefmill.llm.language_model import score_texts

    assert score_texts(empty).count() == 0
    assert score_texts(odd).count() == 6
    held = spark.createDataFrame([(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r["train_tokens"], r["n_known"]) for r in score_texts(held).collect()} == {(0, 0)}


def test_warc_round_trip(spark, tmp_path):
    from briefmill.llm.warc import capture_index, urlkey, write_archives

    big = "<p>" + "ä" * 80 + "\r\n\r\nWARC/1.1\r\n</p>"
    pages = [(i, f"http://www.Example.com/{i % 3}?b=1&a=2#x", [big, "<p>short</p>", None, "", "z" * 100][i % 5]) for i in range(23)]
    pages += [(None, None, big), (99, "not a url\n", "y" * 99), (98, "http://[bad", "y" * 99)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    write_archives(df, str(tmp_path / "w"))
    got = capture_index(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, h in pages:
        h = h or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    text = {i: h or "" for i, _, h in pages}
    for r in got:
        h = text[r["page_id"]]
        whose = first.get(h) if len(h.encode()) >= 100 and first.get(h) != r["page_id"] else None
        want = (len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if whose is not None else "response", whose)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    keys = [(r["urlkey"], r["captured"]) for r in got]
    assert keys == sorted(keys)
    assert urlkey("http://www.Example.com:80/A?b=1&a=2#x") == "com,example)/a?a=2&b=1"
    write_archives(df.limit(0), str(tmp_path / "e"))
    assert capture_index(spark, str(tmp_path / "e")).count() == 0


def test_loser_tree():
    from briefmill.llm.warc import loser_tree_merge

    rng = random.Random(4)
    for k in range(9):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 6))) for _ in range(k)]
        got = [(runs[r][i], r) for r, i in loser_tree_merge(runs, key=lambda x: x)]
        assert got == sorted((x, r) for r, run in enumerate(runs) for x in run)


def test_exact_dedup(spark, docs):
    from briefmill.llm.exact_dedup import classify, deduplicate

    groups = defaultdict(list)
    rows = docs.collect()
    for r in rows:
        groups[(r["text"] or "").translate(LOW)].append(r["doc_id"])
    got = by_id(classify(docs).collect())
    for text, ids in groups.items():
        for i in ids:
            want = (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == want
    assert sorted(r["doc_id"] for r in deduplicate(docs).collect()) == sorted(max(x) for x in groups.values())


def test_exact_dedup_odd(spark, empty, odd):
    from briefmill.llm.exact_dedup import PerfectHash, classify, deduplicate

    assert classify(empty).count() == 0 and deduplicate(empty).count() == 0
    clash = odd.selectExpr("*", "'a' AS text_sha256", "1 AS keep_id", "2 AS group_size", "'d' AS digest")
    assert sorted(deduplicate(clash).columns) == sorted(clash.columns) and deduplicate(clash).count() == 3
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in deduplicate(odd).collect()) == [(False, 1), (False, 3), (True, 0)]
    keys = np.random.default_rng(0).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    table = PerfectHash(keys)
    assert sorted(table.slot) == list(range(5000)) and (table.lookup(keys) == table.slot).all()


def sets_of(text):
    w = words((text or "").translate(LOW))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def roots(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_jaccard_join(spark, docs):
    from briefmill.llm.jaccard_join import join

    sets = {r["doc_id"]: sets_of(r["text"]) for r in docs.collect()}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(ids, linked)
    assert len(linked) > 20
    for r in join(docs, bucket_bytes=20_000).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_jaccard_join_small_sets_and_chains(spark):
    """Sets around every size up to the boundary, and chains whose ends aren't linked."""
    from briefmill.llm.jaccard_join import join

    rng = random.Random(5)
    rows = []
    for k in range(60):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(4, 26))]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:-1])), (len(rows) + 2, " ".join(["q", *w])), (len(rows) + 3, " ".join(["p", "q", *w, "z"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: sets_of(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, linked)
    assert all(r["component_id"] == want[r["doc_id"]] for r in join(docs).collect())


def test_jaccard_join_odd(spark, empty, odd):
    from briefmill.llm.jaccard_join import boundary, join, most_overlap, outline

    assert join(empty).count() == 0
    assert sorted(str((r["doc_id"], r["component_id"])) for r in join(odd).collect()) == sorted(
        ["(1, 1)", "(1, 1)", "(None, 1)", "(2, 2)", "(3, 3)", "(None, None)"]
    )
    assert 0 <= boundary({5: 10, 9: 10, 20: 1}, 80) <= 20 and boundary({}, 80) == 0
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**62, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 2**62, 40).astype(np.uint64)]))
        assert len(np.intersect1d(a, b)) <= most_overlap(len(a), len(b), outline(a), outline(b))


def test_components_rounds(spark):
    from briefmill.llm.components import components

    rng = random.Random(2)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    want = {k: v for k, v in roots({x for e in edges for x in e}, edges).items() if k != v}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for most in (10**6, 5):  # in one task, and by rounds of stars
        assert {r["node"]: r["root"] for r in components(df, most).collect()} == want


def test_line_dedup(spark, docs):
    from briefmill.llm.line_dedup import find, remove, summary

    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    lines = [(i, k, frozenset(words(x.translate(LOW)))) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    want = set()
    for n, (i, k, s) in enumerate(lines):
        if s and any(p and 100 * len(s & p) >= 80 * len(s | p) for _, _, p in lines[:n]):
            want.add((i, k))
    assert {(r["doc_id"], r["line_no"]) for r in find(docs).collect()} == want and want
    told = by_id(summary(docs).collect())
    left = by_id(remove(docs).collect())
    for i, t in rows:
        parts = [] if t is None else t.split("\n")
        assert told[i]["n_lines"] == len(parts) and told[i]["removed"] == sorted(k for j, k in want if j == i)
        assert left[i]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(parts) if (i, k) not in want))


def test_line_dedup_odd(spark, empty, odd):
    from briefmill.llm.line_dedup import find, summary

    assert find(empty).count() == 0 and summary(empty).count() == 0
    assert find(odd).count() == 0 and summary(odd).count() == 6


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    from briefmill.llm.packing import default_tokenizer, pack

    tok = Tokenizer.from_file(default_tokenizer())
    rows = pack(docs, capacity=256).collect()
    whole = defaultdict(dict)
    bins = defaultdict(list)
    for r in rows:
        whole[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs.collect():
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = whole[d["doc_id"]]
        assert sorted(pieces) == list(range(-(-len(ids) // 256)))
        for k, r in pieces.items():
            part = ids[256 * k : 256 * k + 256]
            assert (r["start"], r["length"], r["ids_crc32"]) == (256 * k, len(part), zlib.crc32(part.tobytes()))
    for got in bins.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 256) * 1.03 + 1


def test_packing_tokenizer_matches_whole_texts():
    from tokenizers import Tokenizer

    from briefmill.llm.packing import WordTokenizer, default_tokenizer

    own, tok = WordTokenizer(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    texts = ["It's DON'T.., o'clock 'll x's. 3.14,", "Äpfel, ÉTÉ. ß. İstanbul. ΣΑΣ. é. ́x", "a b c \x1c d\x1fe", "<|endoftext|> <|startoftext|>. x<|endoftext|>y", "..., ,,. .", "日本語。テスト, 한국어. \U0001f600!", "", "  \n\t "]
    for t in texts:
        assert np.frombuffer(own.encode([t.encode()])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_words_are_cut_where_the_tokenizer_cuts():
    """Letters, signs, digits, marks that compose, white space of all kinds and added tokens in any order."""
    import random

    from tokenizers import Tokenizer

    from briefmill.llm.packing import WordTokenizer, default_tokenizer

    own, tok = WordTokenizer(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    own.LIMIT = 100_000  # begins anew many times
    letters = [*"aAjJtThHwWyYiIsSdDmM", *"ßéÉöÿŸİıſKΣσςαйЙѠǅ漢あ한"] * 2
    signs = [*"'’.,!#_-=<>«×÷½²Ⅷ٣09", *" \t\n\v\f\r\x00\x1c\x1f\x7f\x85\xa0\u200b\u3000", "😀"]
    marks = [chr(x) for x in (0x301, 0x307, 0x308, 0x30A, 0x30C, 0x331, 0x338, 0x344, 0x1DC0)]
    more = ["<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "'s", "'LL", "don't"]
    rng = random.Random(5)
    for _ in range(5000):
        t = "".join(rng.choice(letters + signs + marks + more) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(own.encode([t.encode()])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)
    assert own.before and own.held <= own.LIMIT + 20_000


@pytest.mark.parametrize(("least", "most", "bins"), [(300, 700, 5000), (400, 900, 6650), (500, 1100, 8300)])
def test_local_search_takes_up_every_underfull_bin(least, most, bins):
    """A whole shard: no step is left between any two bins, and fewer bins than a search of 400 of them leaves."""
    from briefmill.llm.packing import _Bins, local_search, pack_sizes

    sizes = np.random.default_rng(1).integers(least, most + 1, 20_000)
    number, offset = pack_sizes(sizes, 2048)
    fill = np.bincount(number, weights=sizes)
    assert number.max() + 1 <= bins and fill.max() <= 2048
    assert all(offset[i] >= 0 and offset[i] + sizes[i] <= 2048 for i in range(len(sizes)))
    some = _Bins(2048)
    some.best_fit(sizes[:400])
    local_search(some.items, some.free, sizes)
    under = [(sorted(int(sizes[i]) for i in x), f) for x, f in zip(some.items, some.free, strict=True) if x and f]
    for a, room_a in under:
        groups = a + [x + y for k, x in enumerate(a) for y in a[:k]]
        for b, room in under:
            if room < room_a:
                assert not any(0 < g - back <= room for g in groups for back in [0, *b])


def test_local_search_pairs_from_bins_of_many_items():
    """Only the last two of 40 items, for one, fill the other bin."""
    from briefmill.llm.packing import local_search

    sizes = np.array([30] * 38 + [60, 53, 100, 1900])
    items, free = [list(range(40)), [40, 41]], [2013 - 1253, 13]
    local_search(items, free, sizes)
    assert free[1] == 0 and sorted(i for x in items for i in x) == list(range(42))


def test_local_search_empties_bins():
    from briefmill.llm.packing import local_search, pack_sizes

    sizes = np.array([60, 40, 50, 50, 30, 30, 40])
    items, free = [[0], [1], [2, 4], [3, 5], [6]], [40, 60, 20, 20, 60]
    before = sum((100 - f) ** 2 for f in free)
    local_search(items, free, sizes)
    assert sum((100 - f) ** 2 for f in free) > before and sum(bool(x) for x in items) == 3
    assert sorted(i for x in items for i in x) == list(range(7)) and all(sum(sizes[i] for i in x) <= 100 for x in items)
    rng = np.random.default_rng(0)
    many = rng.integers(1, 2048, 3000)
    number, _ = pack_sizes(many, 2048)

    def least(size):  # Martello and Toth's bound L2: no packing has fewer bins
        best = 0
        for k in range(2048 // 2 + 1):
            large, middle, small = size[size > 2048 - k], size[(size > 1024) & (size <= 2048 - k)], size[(size >= k) & (size <= 1024)]
            best = max(best, len(large) + len(middle) + max(0, -(-(small.sum() - (len(middle) * 2048 - middle.sum())) // 2048)))
        return best

    assert number.max() + 1 <= least(many) * 1.005 + 1


def test_names_of_regular_texts_differ(spark):
    """Two texts that hashes by polynomials modulo a power of two can't tell apart."""
    from briefmill.llm.jaccard_join import join
    from briefmill.llm.language_model import score_texts
    from briefmill.llm.shingles import window_names

    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other), (0, one), (4, one), (5, other), (7, "x")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in join(docs).collect()}
    assert [found[i]["component_id"] for i in (0, 1, 4, 2, 5)] == [0, 0, 0, 2, 2]
    learnt = {r["doc_id"]: r for r in score_texts(docs.filter("doc_id <> 5")).collect()}
    assert learnt[1]["n_known"] == 2 and learnt[1]["base_score"] != learnt[2]["base_score"]
    buf = np.frombuffer((one + other).encode(), np.uint8)
    assert len(np.unique(window_names(buf, np.array([0, 1024]), 1024))) == 2


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    from briefmill.llm.packing import WordTokenizer, default_tokenizer

    with open(default_tokenizer(), encoding="utf-8") as f:
        form = json.load(f)
    form["normalizer"] = {"type": "NFC"}
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(form))
    cased, texts = WordTokenizer(str(path)), ["One two, Three", "", "ONE  two"]
    assert not cased.by_word
    want = [np.asarray(e.ids, "<u4").tobytes() for e in cased.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert cased.encode([t.encode() for t in texts]) == want
    known = WordTokenizer(default_tokenizer())
    texts = ["One two, Three.. x.y it's", "É été STRASSE ß Σίσυφος ΣΑΣ 12,5 日本", "a\u0301b ﬁne", ""]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert known.by_word and known.encode([t.encode() for t in texts]) == want
    known.held = known.LIMIT + 1  # begins anew, with the same ids
    assert known.encode([t.encode() for t in texts]) == want and known.held < known.LIMIT


def test_packing_odd(spark, empty, odd):
    from briefmill.llm.packing import pack

    assert pack(empty).count() == 0
    assert sorted(r["length"] for r in pack(odd).collect()) == [1, 1, 3, 7, 7, 7]


def test_split_words_as_plain_split():
    from briefmill.llm.language_model import _token_blocks, open_tokens, tokens
    from briefmill.llm.shingles import named, split_words

    rng = np.random.default_rng(3)
    pieces = ["a", "B", "é", "Ä", "\x1c", "\x85", "\xa0", " ", "\t", "\n", "\v", "\f", "\r"]
    for _ in range(200):
        texts = ["".join(rng.choice(pieces, rng.integers(0, 12))).encode() for _ in range(rng.integers(0, 6))]
        sizes = np.array([len(t) for t in texts], np.int64)
        names, place, many = split_words(b"".join(texts), sizes)
        plain = [t.lower().split() for t in texts]
        assert many.tolist() == [len(p) for p in plain] and len(set(names.tolist())) == len(names)
        assert names[place].tolist() == named([w for p in plain for w in p]).tolist()
    # a block of tokens gives what the texts gave
    raw = zstandard.ZstdCompressor().compress(b"".join(texts))
    row = {"block": 1, "ids": np.arange(len(texts)).tobytes(), "nulls": np.zeros(len(texts), bool).tobytes(), "sizes": sizes.tobytes(), "text": raw}
    block = next(_token_blocks(iter([pa.RecordBatch.from_pylist([row])])))
    for got, want in zip(open_tokens(block.to_pylist()[0])[2:], tokens(b"".join(texts), sizes), strict=True):
        assert got.tolist() == want.tolist()
