"""Personal data: base spans against plain patterns, messages against enumeration, added spans on held-out made texts."""

import re
import time
from itertools import product

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from filingmill.llm import personal as P

WORDS = "the report of that year was made for them and it has no numbers at all in any of its lines".split()


def plain(text):
    """The rule, word for word."""
    out = [(1, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((3, m.start(), m.end()))
    return out + [(4, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "_d@", "@", ".", "..", "-", " ", "  ", "1", "25", "256", "0.0", "4111111111111111", "4242 4242", "+1", "+", "(", ")", "é", "\n", "%", "x", "1.2.3.4", "555-3922", "٣"]), max_size=14).map("".join))
@example("a@b.c_d@e.f a@b@c.d @x.y 1.2.3.4.5.6.7.8 1.2.3.4@h.i +1 (2) 3.4-5 67890.")
def test_base_spans_equal_the_patterns(text):
    assert P.base_spans(text) == plain(text)


def random_graph(rng, n, links, held=()):
    starts = np.arange(n + 1) * 3
    a, b, types = np.array(links).T
    fixed = np.full(n, -1)
    fixed[list(held)] = rng.integers(1, 5, len(held))
    return P.Graph(rng.integers(0, P.WIDTH, 3 * n), starts, a, b, types, fixed)


def random_model(rng):
    return P.Model(rng.normal(size=(P.WIDTH, P.SIZE)), rng.normal(size=(P.SIZE, P.SIZE)), rng.normal(size=(2, 5)))


def enumerated(model, graph):
    """(log of the sum over all labellings, marginals)"""
    phi, pots = graph.scores(model.weights), model.potentials()
    n = len(phi)
    scores = []
    for y in product(range(P.SIZE), repeat=n):
        s = sum(phi[i, y[i]] for i in range(n))
        s += sum(pots[0 if t == 0 else t + 1][y[i], y[j]] for i, j, t in zip(graph.a, graph.b, graph.types, strict=True))
        scores.append(s)
    log = np.logaddexp.reduce(scores)
    shares = np.exp(np.array(scores) - log).reshape((P.SIZE,) * n)
    return log, np.stack([shares.sum(axis=tuple(j for j in range(n) if j != i)) for i in range(n)])


@pytest.mark.parametrize("held", [(), (2,)])
def test_messages_are_exact_without_loops(held):
    rng = np.random.default_rng(4)
    graph, model = random_graph(rng, 5, [(0, 1, 0), (1, 2, 0), (4, 2, 1), (3, 2, 2)], held), random_model(rng)
    node, _, _ = P.messages(graph.scores(model.weights), graph, model.potentials())
    assert np.allclose(np.exp(node), enumerated(model, graph)[1], atol=1e-6)


def test_messages_are_near_on_loops():
    rng = np.random.default_rng(5)
    graph, model = random_graph(rng, 4, [(0, 1, 0), (2, 3, 0), (2, 0, 1), (3, 1, 2)]), random_model(rng)
    node, _, _ = P.messages(graph.scores(model.weights), graph, model.potentials())
    assert np.abs(np.exp(node) - enumerated(model, graph)[1]).max() < 0.1


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    graph, model = random_graph(rng, 4, [(0, 1, 0), (1, 2, 0), (3, 0, 1)], (1,)), random_model(rng)
    labels = np.array([3, graph.held[1], 0, 3])
    pots = model.potentials

    def likelihood():
        phi = graph.scores(model.weights)
        s = sum(phi[i, y] for i, y in enumerate(labels))
        s += sum(pots()[0 if t == 0 else t + 1][labels[i], labels[j]] for i, j, t in zip(graph.a, graph.b, graph.types, strict=True))
        return s - enumerated(model, graph)[0]

    found = P.gradient(model, graph, labels)
    places = [(0, (graph.rows[0], 3)), (0, (graph.rows[7], 0)), (1, (0, 1)), (1, (3, 3)), (2, (0, 3)), (2, (0, 0))]
    for which, at in places:
        x = (model.weights, model.transitions, model.skips)[which]
        before = x[at]
        x[at] = before + 1e-4
        up = likelihood()
        x[at] = before - 1e-4
        down = likelihood()
        x[at] = before
        assert abs((up - down) / 2e-4 - found[which][at]) < 1e-4


@pytest.fixture(scope="module")
def model():
    return P.fit([" ".join(WORDS[i:] + WORDS[:i]) for i in range(len(WORDS))] * 20)


MENTIONS = [
    (1, "ann.lee7@mail3.example.com", "ann.lee7@mail3"), (2, "26.58.236.81", "26-58-236-81"), (3, "4111111111111111", "4111.1111.1111.1111"), (3, "4111 1111 1111 1111", "4111111111111111 12/27"),
    (4, "+1 (918) 555-3922", "(918) 555-3922"), (4, "+1 (918) 555-3922", "9185553922"), (4, "+1 918 555 3922", "918-555-3922"), (4, "+1 (918) 555-3922", "(918)\n555-3922"),
]


@pytest.mark.parametrize(("kind", "first", "later"), MENTIONS)
@pytest.mark.parametrize("turned", [False, True])
def test_distant_forms_agree(model, kind, first, later, turned):
    far = " ".join(WORDS * 40)
    parts = [f"{far} {first} {far}", f"in 1999 {far} {later} {far}"]
    text = " ".join(reversed(parts) if turned else parts)
    [(base, added)] = P.find(model, [text])
    assert [k for k, _, _ in base] == [kind]
    assert [(k, text[s:e]) for k, s, e, _ in added] == [(kind, later.removesuffix(" 12/27"))]


@pytest.mark.parametrize("parts", [[(4, "+1 (269) 555-3296"), (3, "4524132264652876")], [(3, "7536784127813050"), (3, "4845168114407329")], [(4, "+1 (578) 555-6437"), (3, "4918 1871 2863 5271")], [(3, "4918187128635271"), (4, "+1 (578) 555-6437")], [(4, "+1 (608) 555-2280"), (2, "37.92.178.161")]])
def test_values_side_by_side(model, parts):
    """What stands side by side is one long number for the patterns; each value is found by itself."""
    far = " ".join(WORDS * 5)
    text = f"{far} {' '.join(v for _, v in parts)} {far}"
    [(base, added)] = P.find(model, [text])
    assert sorted((k, text[s:e]) for k, s, e, *_ in [*base, *added]) == sorted(parts)


def test_the_same_forms_alone_are_left_alone(model):
    far = " ".join(WORDS * 5)
    texts = [f"{far} {x} {far}" for x in ("ann.lee7@mail3", "26-58-236-81", "4111.1111.1111.1112", "9185553922", "555-3922", "1,234.56", "2024-05-17", "1.2.3", "@name", "12 34 56", "978-3-16-148410-0", "4111111111111112")]
    assert [a for _, a in P.find(model, texts)] == [[] for _ in texts]


def test_made_texts_that_were_not_trained_on(model):
    rng = np.random.default_rng(77)
    found = missed = wrong = 0
    made = [P.made_text(rng, " ".join(WORDS * 3)) for _ in range(500)]
    for (text, spans), (base, added) in zip(made, P.find(model, [t for t, _ in made]), strict=True):
        over = lambda s, e, others: any(s < y and x < e for _, x, y, *_ in others)
        for kind, s, e in spans:
            if not over(s, e, base):
                hit = any(k == kind for k, x, y, _ in added if s < y and x < e)
                found, missed = found + hit, missed + (not hit)
        wrong += sum(not over(s, e, spans) for _, s, e, _ in added)
        assert not any(over(s, e, base) for _, s, e, _ in added)
    assert found / (found + missed) > 0.9 and wrong / found < 0.05


def test_long_texts_take_linear_time(model):
    began = time.time()
    long = ["a" * 2_000_000 + "1", "1" * 1_000_000, "1." * 400_000, "a@" * 300_000, "+1 " * 100_000, "x@y.z " * 20_000 + "9185553922 " * 3, "(" * 500_000 + "1"]
    found = P.find(model, long)
    assert [len(b) for b, _ in found][5] == 20_000 and time.time() - began < 90


ROWS = [(1, "mail a.b@c.de now"), (2, None), (3, ""), (3, "no numbers"), (4, "é 1.2.3.4 ü +1 (918) 555-3922, a@b.c; 4111-1111-1111-1111"), (4, "é 1.2.3.4"), (None, "call +1 (918) 555-3922 " + "word " * 50_000 + "(918) 555-3922")]


def test_rows(spark, model):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in ROWS], "doc_id long, text string, base int, added string, kind string")
    got = P.identify(df, model).collect()
    assert len(got) == len(ROWS)
    key = lambda i, b: (i is None, i or 0, b)
    found = sorted(key(r.doc_id, [(P.KINDS.index(x.kind) + 1, x.start, x.end) for x in r.base]) for r in got)
    assert found == sorted(key(i, plain(t or "")) for i, t in ROWS)
    [last] = [r for r in got if r.doc_id is None]
    assert [(x.kind, ROWS[-1][1][x.start : x.end]) for x in last.added] == [("phone", "(918) 555-3922")]
    masked = {r.text for r in P.redact(df, model).collect()}
    assert {None, "", "no numbers", "mail [EMAIL] now", "é [IP] ü [PHONE], [EMAIL]; [CARD]"} <= masked
    assert P.identify(df.limit(0), model).count() == 0 and P.redact(df.limit(0), model).columns == df.columns


def test_training_takes_any_table(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, piece int, kind string")
    pieces = P.training_pieces(df)
    assert len(pieces) == 3 and all(len(p) <= P.PIECE_CHARS for p in pieces)
    assert P.training_pieces(df.limit(0)) == []
