"""Sets of words move to be compared only for pairs that a wide outline leaves."""

import random


def test_sets_of_unlike_pairs_do_not_move(spark, monkeypatch):
    from briefmill.llm import line_dedup

    draw, seen = random.Random(3), {}
    lines = [" ".join(f"w{k}" for k in draw.sample(range(300), 200)) for _ in range(60)]
    lines += [x.replace(x.split()[0], "other") for x in lines[:10]]
    real = line_dedup.materialize

    def materialize(df, name, **options):
        out = real(df, name, **options)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", materialize)
    monkeypatch.setattr(line_dedup, "ROWS", 2)
    monkeypatch.setattr(line_dedup, "PLACES", 512)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = [set(x.split()) for x in lines]
    want = [i for i, s in enumerate(sets) if any(100 * len(s & p) >= 80 * len(s | p) for p in sets[:i])]
    assert sorted(r["doc_id"] for r in line_dedup.find(docs).collect()) == want == list(range(60, 70))
    assert seen["met"] > 200 and seen["close"] < 40  # before, both sets of every pair moved
