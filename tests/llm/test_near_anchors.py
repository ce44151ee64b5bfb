"""The near-copy stage takes candidates from SimHash anchors."""

import random

from filingmill.llm import near_copies, simhash


def test_anchors_give_candidates(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{rng.randrange(500)}" for _ in range(400)]
    near = [base[:k] + [f"x{k}"] + base[k + 1 :] for k in range(0, 400, 40)]
    prints = [simhash.fingerprint(" ".join(x), near_copies.SHINGLE_WORDS) for x in (base, *near)]
    twin = next(x for x, p in zip(near, prints[1:], strict=True) if 0 < (p ^ prints[0]).bit_count() <= 3)
    other = [f"v{rng.randrange(500)}" for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((base, twin, other))], "doc_id long, text string")
    # Without bands only the anchors are left.
    monkeypatch.setattr(near_copies, "bands", lambda hashes: [])
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [0, 2]
