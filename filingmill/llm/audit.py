"""Which document filters matter, in which order: an audit of filter interactions by decision diagrams.

Every document gets a mask of the filters it fails, and per part the masks are counted. A part's counts become a decision
diagram with one level a filter: a node has a pass child and a fail child, and weighs what lies below it (documents, good
ones, toxic ones); equal parts of the diagram are one node. Another order of the filters is another order of the levels, and two
orders that differ in two neighbours differ in two levels only: swapping these rebuilds the nodes there and no others, so all
k! orders are walked through by k! - 1 adjacent swaps. In each order the path of documents that pass everything yields the
steps: what a filter removes is the weight of the fail child beside the path, what it keeps that of the pass child.

Documents are read once; what is shuffled after that are counts. A diagram holds at most 2^k masks of a part, never rows.

Defined results: a null text is empty, a null part the empty string; a null doc_id carries no label, is no copy and makes no
other row one; repeated rows count each, and share the first place among copies of their text; a document is good or toxic if any of its label rows
says so, and neither without one; texts are equal by 128 bits of hash; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged, text_key

#: The filters of `failing`, the last one that on copies.
FILTERS = "ABCDE"
Weight = tuple[int, int, int]


def failing(text: Column) -> list[Column]:
    """For the filters A to D, whether a text fails: under 50 words; under 65 % of the words distinct; over 5 % of the code
    points A-Z; any of #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """docs: doc_id, text and the column `part`; labels: doc_id, quality, toxic. Returns part, mask, n, good, toxic: documents by the set of filters
    they fail (bit i for the i-th of FILTERS). A copy of a text with a smaller doc_id anywhere in docs fails the last."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("t"))
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing(F.col("t")))]
    key = text_key(F.col("t"))
    read = read.select("doc_id", "part", key["a"].alias("a"), key["b"].alias("b"), sum(bits[1:], bits[0]).alias("mask"))
    rows = read.groupBy("doc_id", "part", "a", "b", "mask").agg(F.count("*").alias("n"))
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # Rows without an id are kept out of the join, where they would all have one key.
    known = rows.filter("doc_id IS NOT NULL").join(said, "doc_id", "left")
    rows = known.unionByName(rows.filter("doc_id IS NULL"), allowMissingColumns=True)
    same = ["a", "b", "part", "mask", "good", "toxic"]
    rows = rows.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    groups = rows.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    groups = staged(groups, "groups")
    least = groups.groupBy("a", "b").agg(F.min("first.doc_id").alias("least"))
    own = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("nameless")
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), own.alias("n")), F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - own).alias("n"))))
    parted = groups.join(least, ["a", "b"]).select("part", "good", "toxic", split.alias("x")).filter("x.n > 0")
    held = [F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return parted.groupBy("part", F.col("x.m").alias("mask")).agg(F.sum("x.n").alias("n"), *held)


def adjacent_swaps(k: int) -> Iterator[int]:
    """The k! - 1 places at which neighbours are swapped so that every order of k things comes up once: the largest thing
    walks through the others from end to end, and between two walks these make one swap of their own."""
    if k < 2:
        return
    inner = adjacent_swaps(k - 1)
    down = True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


class Diagram:
    """A count-weighted decision diagram. A node is its number; `children` has (pass, fail) of all that are not leaves, `weights` what lies
    below; `levels` has the nodes of each level by their children, so that equal ones are one."""

    def __init__(self, counts: dict[int, Weight], k: int):
        self.order = list(range(k))
        self.children: dict[int, tuple[int, int]] = {}
        self.weights: dict[int, Weight] = {}
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(k)]
        leaves: dict[Weight, int] = {}
        row = []
        for place in range(1 << k):  # the filter of the first level is the highest bit of a place
            weight = counts.get(sum((place >> (k - 1 - i) & 1) << i for i in range(k)), (0, 0, 0))
            if weight not in leaves:
                leaves[weight] = len(self.weights)
                self.weights[leaves[weight]] = weight
            row.append(leaves[weight])
        self.made = len(self.weights)
        for level in range(k - 1, -1, -1):
            row = [self._node(level, row[i], row[i + 1]) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _node(self, level: int, passed: int, failed: int) -> int:
        at = self.levels[level].get((passed, failed))
        if at is None:
            at = self.made
            self.made += 1
            self.levels[level][passed, failed] = at
            self.children[at] = (passed, failed)
            a, b = self.weights[passed], self.weights[failed]
            self.weights[at] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])
        return at

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next. Nodes of this level stand for what they stood for, so nothing above
        changes; the next level is made anew."""
        self.order[level : level + 2] = self.order[level + 1], self.order[level]
        upper, lower = self.levels[level], self.levels[level + 1]
        self.levels[level], self.levels[level + 1] = {}, {}
        for (passed, failed), at in upper.items():
            (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
            pair = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.children[at] = pair
            self.levels[level][pair] = at
        for at in lower.values():
            del self.children[at], self.weights[at]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """(filter, weight that it keeps, weight that it removes) down the path that passes everything."""
        at = self.root
        for f in self.order:
            passed, failed = self.children[at]
            yield f, self.weights[passed], self.weights[failed]
            at = passed


def orders(counts: dict[int, Weight], names: Sequence[str]) -> Iterator[list[tuple]]:
    """A list of (filter, kept, removed) for every order of the filters, by their numbers."""
    diagram = Diagram(counts, len(names))
    yield list(diagram.steps())
    for level in adjacent_swaps(len(names)):
        diagram.swap(level)
        yield list(diagram.steps())


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(names: Sequence[str]):
    def run(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in masks[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        fails = [sum(w[0] for m, w in counts.items() if m >> i & 1) for i in range(len(names))]
        alone = [counts.get(1 << i, (0, 0, 0))[0] for i in range(len(names))]
        found = list(orders(counts, names))
        shares = [0] * len(names)
        for steps in found:
            for f, _, removed in steps:
                shares[f] += removed[0]
        out = []
        for steps in found:
            order = "".join(names[f] for f, _, _ in steps)
            for step, (f, kept, removed) in enumerate(steps, 1):
                out.append((key[0], order, step, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shares[f]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def interactions(counts: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """counts: part, mask, n, good, toxic. Returns, per part, order of the filters and step (from 1): kept, removed, redundant (failing the step's filter but removed
    earlier), unique_fails (failing it alone), good_lost and toxic_lost (removed here), shapley (what it removes, summed over
    all orders). A group given to a task has one row for each set of filters failed, 2^k at most."""
    return counts.groupBy("part").applyInPandas(_audited(names), SCHEMA)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """docs: doc_id, text and the column `part`; labels: doc_id, quality, toxic. The interactions of FILTERS."""
    return interactions(mask_counts(docs, labels, part))
