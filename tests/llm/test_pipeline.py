"""The stages against brute force on a small part of the given documents' kind."""

import random
import re

import corpus_pipeline


def _tables(spark, folder):
    rng = random.Random(9)
    words = "the report and of growth shares board annual meeting that with from company value price".split()
    make = lambda n: " ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.2 else "") for _ in range(n))
    item = make(30)
    docs = [(i, make(rng.randrange(30, 120)), "en", "src0") for i in range(80)]
    # One word in seventy changed: similar, whatever the fingerprints say.
    docs += [(90 + i, " ".join("changed" if k == 35 else w for k, w in enumerate(make(70).split())), "en", "src0") for i in range(2)]
    docs += [(i + 5, docs[i - 10][1].replace("changed", "other"), "de", "src1") for i in (90, 91)]
    docs += [(100, docs[3][1], "en", "src1"), (101, docs[4][1], None, "src1"), (102, make(10) + " " + item + " " + make(10), "en", "src2")]
    docs += [(103, "12345 !!", "en", "src2"), (104, None, "en", "src2"), (105, "", "en", None), (106, make(40) + ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' + make(5), "en", "src3")]
    table = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t, _, _ in docs}, item


def _similar(a, b):
    """Whether the sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    cut = lambda t: {tuple(w[i : i + 5]) for w in (t.lower().split(),) for i in range(max(1, len(w) - 4))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b)) >= 0.8


def test_stages(spark, tmp_path):
    texts, item = _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    alive = {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        if k == 1:
            alive = {i for i in alive if not any(j < i and _similar(texts[i], texts[j]) for j in alive)}
        if k == 2:
            alive = {i for i in alive if item not in texts[i]}
        assert got == alive, name
        if k == 3:
            after = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            for i in alive:
                want = re.sub("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "[SECRET]", texts[i])
                assert after[i] == (want, len(want))
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in docs.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == alive


def test_entry_lists_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
