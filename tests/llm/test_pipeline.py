"""The corpus pipeline and each of its stages against plain versions."""

import random
from collections import Counter, defaultdict

from test_operators import LOW, corpus, roots, sets_of, words


def test_stages_and_run(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(2)
    rows = [(i, t, "en", s or "x", n) for i, t, _, s, n in corpus(n=60)]
    toxic, labels = set(), []
    plain = ["tree", "stone", "river", "cloud", "field", "light", "house", "paper"]
    for i in range(1000, 1500):
        w = [rng.choice(plain) + str(rng.randint(0, 30)) for _ in range(40)]
        if rng.random() < 0.2:
            toxic.add(i)
            w += ["vilea", "grimx"]
        text = " ".join(w)
        rows.append((i, text, "en", "y", len(text)))
        labels.append((i, 1, int(i in toxic)))
    at = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    texts = {r[0]: r[1] for r in rows}
    stages, docs = dict(cp.STAGES), spark.read.parquet(f"{at}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]

    def after(name):
        nonlocal docs
        docs = cp.materialize(stages[name](spark, docs, at), name)
        got = docs.collect()
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS) and all(r["text"] == texts[r["doc_id"]] for r in got)
        return got

    left = [r["doc_id"] for r in after("toxicity")]
    assert len(set(left)) == len(left) and len(toxic & set(left)) <= 2 and len(set(texts) - toxic - set(left)) <= 5

    groups = defaultdict(list)
    for i in left:
        groups[(texts[i] or "").translate(LOW)].append(i)
    left = sorted(r["doc_id"] for r in after("exact_dedup"))
    assert left == sorted(max(x) for x in groups.values())

    sets = {i: sets_of(texts[i]) for i in left}
    linked = [(a, b) for a in left for b in left if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    left = sorted(r["doc_id"] for r in after("jaccard_join"))
    assert linked and left == sorted(set(roots(list(sets), linked).values()))

    source, size = {r[0]: r[3] for r in rows}, {i: len(words(texts[i])) for i in left}
    mixed = after("mixing")
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    total = sum(n * size[i] for i, n in copies.items())
    assert abs(total - 1.5 * sum(size.values())) <= len(set(source.values())) * max(size.values())

    packed = after("packing")
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048

    plain_row = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(plain_row, cp.run(spark, at).collect())) == sorted(map(plain_row, packed))
