"""Long lines that are unlike aren't paired in the full pairing of the lists."""

import random


def test_unlike_long_lines_are_not_paired(spark, monkeypatch):
    from briefmill.llm import line_dedup

    draw, seen = random.Random(5), []
    lines = [" ".join(f"w{k}" for k in draw.sample(range(300), n)) for n in (200, 190, 64, 65, 66) for _ in range(24)]
    lines += [x.replace(x.split()[0], "other") for x in lines[::6]]
    lines += [" ".join(x.split()[: 60 if len(x.split()) < 70 else 170]) for x in lines[::8]]  # some cross from long to short
    real = line_dedup.materialize

    def materialize(df, name, **options):
        out = real(df, name, **options)
        if name == "met":
            seen.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", materialize)
    monkeypatch.setattr(line_dedup, "ROWS", 2)
    monkeypatch.setattr(line_dedup, "PLACES", 512)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = [set(x.split()) for x in lines]
    want = [i for i, s in enumerate(sets) if any(100 * len(s & p) >= 80 * len(s | p) for p in sets[:i])]
    assert sorted(r["doc_id"] for r in line_dedup.find(docs).collect()) == want and len(want) > 20
    near, full = seen
    assert near > 200 and full < 100  # before, 64 bits let all long lines of a list through
