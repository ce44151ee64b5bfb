"""The audit of filter interactions: diagrams against plain counting, rows against brute force."""

import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filingmill.llm import audit

NAMES = "ABCDE"


@pytest.mark.parametrize("k", range(1, 7))
def test_swaps_reach_every_order(k):
    order, seen = list(range(k)), set()
    seen.add(tuple(order))
    for i in audit.adjacent_swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == factorial(k)


def plain(counts, order):
    """(kept, removed) of each step, by counting masks."""
    left = dict(counts)
    for f in order:
        gone = {m: w for m, w in left.items() if m >> f & 1}
        left = {m: w for m, w in left.items() if not m >> f & 1}
        yield tuple(sum(w[i] for w in left.values()) for i in range(3)), tuple(sum(w[i] for w in gone.values()) for i in range(3))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(*[st.integers(0, 9)] * 3)))
def test_every_order_counts_as_masks_do(counts):
    found = list(audit.orders(counts, NAMES))
    assert len({tuple(f for f, _, _ in steps) for steps in found}) == 120
    for steps in found:
        assert [(k, r) for _, k, r in steps] == list(plain(counts, [f for f, _, _ in steps]))


def test_equal_parts_are_one_node():
    diagram = audit.Diagram({0: (5, 0, 0)}, 5)
    assert len(diagram.children) == 5 + 4  # the path itself, and one node a level for what is empty
    for i in audit.adjacent_swaps(5):
        diagram.swap(i)
    assert len(diagram.children) == 5 + 4


PROSE = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
ROWS = [
    (1, PROSE, "s"), (2, PROSE, "s"), (2, PROSE, "s"), (3, PROSE, None), (None, PROSE, "s"), (None, PROSE, ""), (4, None, "s"), (5, "", "t"), (5, "", "t"), (6, "SHOUT & more", "t"),
    (7, "é " * 400, "t"), (8, "A" * 6 + "x" * 94, "t"), (9, "A" * 5 + "x" * 95, "t"), (10, "　".join(PROSE.split()), "u"), (11, "a\tb\x0bc " * 50_000, "u"),
    (12, PROSE + " wxx | #", "hot"), *[(20 + i, PROSE + " copied", "hot") for i in range(40)], (61, None, None),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (6, 0, 1), (25, 1, None), (20, 1, 0), (None, 1, 1)]


def brute(rows, labels):
    out = {}
    masks = []
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in rows)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        good = doc_id is not None and any(i == doc_id and q == 1 for i, q, _ in labels)
        toxic = doc_id is not None and any(i == doc_id and x == 1 for i, _, x in labels)
        masks.append((source or "", fails, good, toxic))
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = Counter()
        steps = {}
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                shapley[f] += len(gone)
                steps["".join(NAMES[i] for i in order), step] = (
                    f, len(left), len(gone), sum(m[1][f] for m in own) - len(gone), sum(m[1][f] and sum(m[1]) == 1 for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)
                )
        out |= {(part, *k): (*v[1:], shapley[v[0]]) for k, v in steps.items()}
    return out


def test_rows_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2, True) for r in ROWS], "doc_id long, text string, source string, n int, part string, mask int, good boolean")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(got) == len(found) and found == brute(ROWS, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS[:3], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in audit.audit(docs, labels).collect()} == {0}
