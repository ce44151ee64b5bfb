"""The pipeline's near-dedup against brute force over five-word shingles."""

import random

import corpus_pipeline
from filingmill.llm import near_copies, simhash


def _similar(a, b):
    def cut(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) >= 0.8


def _expected(rows):
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and _similar(rows[i][1], rows[j][1]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}


def _edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_joins_similar_texts(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    rows = []
    for _ in range(25):
        base = make(rng.randrange(60, 200))
        rows += [(len(rows), base)] + [(len(rows) + 1 + k, _edited(rng, base, e)) for k, e in enumerate((1, 2, 4))]
    hub = make(120)
    rows += [(1000 + k, _edited(rng, hub, 1)) for k in range(40)] + [(2000, ""), (2001, " ,"), (2002, "One  two"), (2003, "one two")]
    far = sum((simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[i + 1][1])).bit_count() > 3 for i in range(0, 100, 4) if _similar(rows[i][1], rows[i + 1][1]))
    assert far > 5  # similar, but beyond the anchors' 3 bits
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _expected(rows)
    got = [r.doc_id for r in corpus_pipeline.near_copy_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)
    # Blocks of a few texts give the same components.
    monkeypatch.setattr(near_copies.near_links, "__defaults__", (7,))
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == sorted(want)


def test_stage_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "x y"), (None, "x y"), (6, None), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in near_copies.one_of_each(docs).collect())
    assert got == [(0, "a b c d e f"), (5, "x y"), (6, None)]
    assert near_copies.one_of_each(docs.limit(0)).count() == 0
