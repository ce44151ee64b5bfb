import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filingmill.llm import decontaminate, neighbours, simhash, substrings
from filingmill.llm._shared import staged
from filingmill.llm._components import components


def _roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = _roots({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _documents(n=120, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = make(60)
    docs = []
    for i in range(n):
        kind = i % 8
        text = make(rng.randrange(3, 200))
        if kind == 1 and docs:
            text = rng.choice(docs)[1]
        elif kind == 2 and docs and docs[-2][1]:
            words = docs[-2][1].split()
            text = " ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 + 1 :])
        elif kind == 3:
            text = make(20) + " " + passage + "\n" + make(rng.randrange(10))
        elif kind == 4:
            text = "the same line again and again " * rng.randrange(1, 30)
        docs.append((i, text))
    return docs + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one two"), (None, passage), (5, docs[5][1]), (905, make(5000))]


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) * 2 > len(grams) for b in range(64)]
    return sum(1 << b for b, x in enumerate(bits) if x)


def test_simhash_against_brute_force(spark):
    docs = _documents()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(docs)
    prints = {t: _fingerprint(t) for _, t in docs}
    links = [(a, b) for a in set(prints.values()) for b in set(prints.values()) if (a ^ b).bit_count() <= 3]
    groups = _roots(set(prints.values()), links)
    least = {}
    for i, t in docs:
        if i is not None:
            g = groups[prints[t]]
            least[g] = min(least.get(g, i), i)
    expected = sorted(((i if i is not None else -1), prints[t], least.get(groups[prints[t]], -1)) for i, t in docs)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.fp % 2**64, -1 if r.component_id is None else r.component_id) for r in got) == expected


def test_anchor_links_in_blocks(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 4))) for b in base for _ in range(5)]
    values = sorted({x - 2**64 if x >= 2**63 else x for x in base + near})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = _roots(values, [(a, b) for a in values for b in values if ((a ^ b) % 2**64).bit_count() <= 3])
    for block in (4, simhash.BLOCK):
        got = {r.node: r.root for r in components(simhash.near_links(fps, block)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_anchors_cover_everything():
    words, starts = simhash._errors()
    assert len(words) == 242825
    assert np.bitwise_count(words[starts[:-1]].astype(np.uint64)).max() == simhash.COVER_RADIUS


def test_one_of_each_keeps_the_smallest(spark):
    docs = spark.createDataFrame([(3, "a b c d", 1), (1, "a b c d", 2), (7, "x y z w", 3), (7, "x y z w", 3), (9, "p q r", 4)], "doc_id long, text string, n_chars int")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 7, 9]


def _without_repeats(docs, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    count = {}
    for ws in lists:
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for (doc, _), ws in zip(docs, lists, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if count[tuple(ws[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((doc if doc is not None else -1, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 20])
def test_repeats_against_brute_force(spark, window):
    docs = _documents(seed=window)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string")
    got = substrings.remove_repeats(df, window).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_removed, r.kept_sha256) for r in got) == _without_repeats(docs, window)
    for r in got:
        if r.kept is not None:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert substrings.remove_repeats(df.limit(0), window).count() == 0


def test_decontamination_edges(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, "x " + item.upper() + " y"), (2, None), (3, ""), (4, "short item"), (5, " ".join(item.split()[:10])), (6, "one, SHORT-item; two"), (6, "one, SHORT-item; two"), (7, "é " * 3000 + item)]
    items = [(10, item), (11, "short item"), (11, "short item"), (12, None), (13, "!!"), (None, "x alpha")]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n_words int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(df, it).collect())
    assert got == [
        (1, 13, 12, ("10",)), (2, 0, 0, ()), (3, 0, 0, ()), (4, 2, 2, ("11",)), (5, 10, 10, ("10",)),
        (6, 4, 2, ("11",)), (6, 4, 2, ("11",)), (7, 3011, 11, ("10",)),
    ]
    assert [r.n_hit for r in decontaminate.decontaminate(df, it.limit(0)).collect()] == [0] * len(docs)
    kept = decontaminate.without_contaminated(df, it)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def _places(docs, items, window, slop, probes=3):
    """(doc, start, words) of exact and of proximity matches, by brute force."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(d, cut(t)) for d, t in docs]
    count = {}
    for _, ws in texts:
        for w in ws:
            count[w] = count.get(w, 0) + 1
    phrases = {tuple(ws[i : i + window]) for ws in (cut(t) for _, t in items) if ws for i in range(max(1, len(ws) - window + 1))}
    exact, near = set(), set()
    for phrase in phrases:
        if any(w not in count for w in phrase):
            continue
        anchor = min(range(len(phrase)), key=lambda o: (count[phrase[o]], o))
        for doc, ws in texts:
            for x, w in enumerate(ws):
                if w != phrase[anchor]:
                    continue
                start = x - anchor
                if start >= 0 and tuple(ws[start : start + len(phrase)]) == phrase:
                    exact.add((doc, start, len(phrase), phrase))
                elif all(q in ws[max(0, start + j - slop) : max(0, start + j + slop + 1)] for j, q in enumerate(phrase)):
                    near.add((doc, start, len(phrase), phrase))
    return sorted(p[:3] for p in exact), sorted(p[:3] for p in near)


@pytest.mark.parametrize("window,slop,vocabulary", [(10, 2, 4), (70, 2, 3), (3, 0, 5)])
def test_matches_against_brute_force(spark, window, slop, vocabulary):
    rng = random.Random(window * 100 + vocabulary)
    make = lambda n: [f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n)]
    items = [(i, " ".join(make(rng.randrange(1, window + 6)))) for i in range(8)] + [(50, " ".join(["w0"] * window))]
    docs = []
    for i in range(30):
        words = make(rng.randrange(0, 60))
        held = rng.choice(items)[1].split()
        if i % 3 == 1:  # with a word put in, and two that change places
            held.insert(len(held) // 2, "odd")
            held[0], held[-1] = held[-1], held[0]
        docs.append((i, " ".join(words + (held if i % 3 else [])) + " " + " ".join(make(5))))
    docs += [(100, " ".join(["w0"] * 200)), (101, "W1 far " * 40)]
    found = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window, slop
    ).collect()
    exact, near = _places(docs, items, window, slop)
    assert sorted((r.doc_id, m.start, m.n) for r in found for m in r.exact) == exact and exact
    assert sorted((r.doc_id, m.start, m.n) for r in found for m in r.near) == near
    assert bool(near) == (slop > 0)
    for r in found:
        assert r.n_hit == len({w for d, s, n in exact if d == r.doc_id for w in range(s, s + n)})


def test_an_index_serves_a_second_benchmark(spark):
    docs = spark.createDataFrame([(1, "alpha one beta two gamma"), (2, "alpha " + "far " * 30 + "beta gamma"), (3, "x alpha beta gamma")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    for text, exact, near in (("alpha beta gamma", {3}, {1}), ("one beta", {1}, set()), ("missing word", set(), set())):
        phrases, _ = decontaminate.windows_of(spark.createDataFrame([(1, text)], "item_id long, text string"))
        found = decontaminate.matches(index, phrases).join(index.texts, ["seg", "ord"]).collect()
        assert {r.doc_id for r in found if r.exact} == exact and {r.doc_id for r in found if r.near} == near


def test_few_terms_are_looked_up_and_many_are_read(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id", F.lit(" common x"), F.col("id") % 7).alias("text"))
    index = decontaminate.build_index(docs)
    terms = staged(spark.createDataFrame([("w5",), ("common",), ("absent",)], "w string").select(F.xxhash64("w").alias("term")), "terms")
    for most in (200, 2):
        monkeypatch.setattr(decontaminate, "SOUGHT", most)
        found = decontaminate.term_counts(index.postings, terms)
        assert ("In(term, [" in found._jdf.queryExecution().executedPlan().toString()) == (most == 200)
        assert sorted(r.cf for r in found.collect()) == [1, 300]
    monkeypatch.setattr(decontaminate, "SOUGHT", 200)
    many = staged(spark.range(200).select(F.xxhash64(F.concat(F.lit("w"), "id")).alias("term")), "terms")
    assert decontaminate.term_counts(index.postings, many).count() == 200


@pytest.mark.parametrize("trees,leaf", [(6, 64), (2, 8)])  # with leaves of 8, the descent finds what the trees do not
def test_neighbours_against_brute_force(spark, trees, leaf):
    rng = np.random.default_rng(4)
    rows, vec_id = [], 0
    for label in (0, 1):
        for size in (1, 2, 90, 3):
            centre = rng.normal(size=16)
            for _ in range(size):
                spread = 0.01 if size != 90 else rng.choice([0.02, 0.35])
                rows.append((vec_id, [float(x) for x in centre / np.linalg.norm(centre) + spread * rng.normal(size=16) / 4], label))
                vec_id += 1
        rows += [(vec_id + i, [float(x) for x in rng.normal(size=16)], label) for i in range(60)]
        vec_id += 60
    rows += [(vec_id, rows[0][1], 0), (vec_id + 1, rows[0][1], 0), (vec_id + 2, None, 0), (vec_id + 3, [0.0] * 16, 0), (vec_id + 4, [float("nan")] * 16, 1)]
    rows += [(vec_id + 5, rows[0][1], None), (vec_id + 6, [1.0, None] * 8, 1), (vec_id + 7, [], 1), (vec_id + 8, [1.0, 2.0], 1), (vec_id + 9, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    stored = {r.vec_id: r for r in df.collect()}
    live = []
    for i, r in stored.items():
        if r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding):
            x = np.array(r.embedding, dtype=float)
            live.append((i, r.label, x / np.linalg.norm(x)))
    links = [(a, b) for a, la, x in live for b, lb, y in live if a != b and la == lb and len(x) == len(y) and x @ y >= 0.93]
    groups = _roots(stored, links)
    count = {i: 0 for i in stored}
    for a, _ in links:
        count[a] += 1
    assert max(count.values()) > neighbours.DENSE
    got = neighbours.near_duplicates(df, trees, leaf).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], groups[i], groups[i] == i) for i in stored}
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_descent_finds_what_the_first_graph_lacks(spark):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(900, 32)))
    near = unit(base[:200] + unit(rng.normal(size=(200, 32))) * 0.35)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.concatenate([base, near]))]
    _, nodes = neighbours._nodes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    x = np.stack([np.array(r[1]) for r in rows])
    linked = int(np.triu(x @ x.T >= neighbours.THRESHOLD, 1).sum())
    lists = neighbours.staged(neighbours._top(neighbours.first_graph(nodes, 2, 0, 32), neighbours.LIST), "lists")
    found = lambda lists: neighbours.threshold_edges(lists, nodes).count() / 2 / linked
    first, last = found(lists), found(neighbours.refined(lists, nodes, neighbours.LIST))
    assert linked > 100 and first < 0.9 and last > 0.97, (linked, first, last)


def test_a_poor_graph_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUILDS", 1)
    monkeypatch.setattr(neighbours, "audit_recall", lambda *a: 0.5)
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="0.5"):
        neighbours.near_duplicates(df)
