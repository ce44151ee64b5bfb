"""Embedding near-duplicates by NN-descent.

Vectors of one label are linked at a cosine of THRESHOLD or more. Equal vectors are one node from the start (128 bits of hash,
then a number of its own). The neighbour graph is built on sketches, SKETCH signs of random projections per node, so that 32
bytes travel instead of a vector:
1. A rough first graph: in each of TREES random-hyperplane trees, nodes of a label with the same signs share a leaf of about
   LEAF nodes and name their nearest partners there. Leaves carry node numbers and sketches alone.
2. NN-descent: around every node, its neighbours and those that name it as theirs are compared with each other, and lists keep
   the best, however far; that is how a node's list moves towards its true partners. Rounds go on until one finds no new link.
3. Lists full of likely links (sketches that differ in at most CUT signs) may lack some: they are enlarged and refined again.
4. Threshold edges: likely links are compared by their vectors, in double precision. A pair at the threshold differs in 31 +- 5
   signs of 256, so CUT leaves out less than one true link in 10^6.

Nodes whose lists of DENSE entries are still full lie in dense groups of near copies, where listing every link would grow with
the square of the group. For these the links are counted, not listed: members of a group within half the threshold's angle of
its mean are all linked with each other (the angles add up), and only the others are compared, block by block. Groups that may
touch are found by the leaves their means share. A group whose members are mostly far from its mean (a long chain) costs the
square of its size, in blocks.

Recall is audited after each build: AUDIT nodes, taken in turn from all labels, half of them with links, are compared with all
vectors of their label. If the links found fall short of AUDIT_RECALL of the true ones, further trees are added and the graph is
refined again; after BUILDS builds the operator fails rather than return a poor result.

Leaves, lists and blocks are bounded; oversized leaves (a dense group) are dealt into blocks by hash; all state
between rounds is written to the shared folder.

Defined results: a null label, a vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of
different lengths do not link; a null vec_id is a row of its own that is never named as smallest unless all are null;
repeated rows are vectors of their own and link as equal ones; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType

from ._components import components
from ._shared import small, small_batches, staged

THRESHOLD = 0.93
SKETCH, CUT = 256, 60
LIST, DENSE = 16, 32
#: A node names so many partners in a leaf.
NAMED = 8
TREES, LEAF, BLOCK = 6, 64, 1024
AUDIT, AUDIT_RECALL, BUILDS = 2000, 0.999, 8
SEED = 5
_WORDS = SKETCH // 64
_SKETCH = [f"s{i}" for i in range(_WORDS)]


@F.pandas_udf(ArrayType(DoubleType()))
def _unit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each vector in double precision over its norm, or null if it is unusable."""
    for batch in batches:
        out = []
        for values in batch:
            x = np.asarray(values, dtype=np.float64) if values is not None else np.zeros(0)
            most = np.abs(x).max(initial=0.0)
            usable = most > 0 and np.isfinite(most)  # a null component has come as NaN
            x = x / most if usable else x  # so that squares neither overflow nor vanish
            out.append(x / np.sqrt(x @ x) if usable else None)
        yield pd.Series(out, dtype=object)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the signs of random projections, by each vector's length."""
    for batch in batches:
        out = np.zeros((len(batch), _WORDS), dtype=np.int64)
        for dim in batch["dim"].unique():
            at = np.flatnonzero(batch["dim"].to_numpy() == dim)
            lines = np.random.default_rng([SEED, SKETCH, int(dim)]).normal(size=(int(dim), SKETCH))
            signs = np.stack(batch["vec"].to_numpy()[at]) @ lines > 0
            out[at] = np.packbits(signs, axis=1).view(np.int64)
        yield batch.assign(**{c: out[:, i] for i, c in enumerate(_SKETCH)})


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, x, y; nodes: node, x, y, label, dim, weight, vec, sketch), stored. x and y name the node; null for what
    links with nothing."""
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), _unit("embedding").alias("vec"))
    live = F.col("label").isNotNull() & F.col("vec").isNotNull()
    named = {"x": F.when(live, F.xxhash64("label", "vec")), "y": F.when(live, F.xxhash64(F.lit("key"), "label", "vec"))}
    rows = staged(rows.withColumns(named), "vectors")
    nodes = rows.filter("x IS NOT NULL").groupBy("x", "y").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("weight")
    )
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "x", "y", "label", F.size("vec").alias("dim"), "weight", "vec")
    schema = "node long, x long, y long, label string, dim int, weight long, vec array<double>, " + ", ".join(f"{c} long" for c in _SKETCH)
    return rows.select("vec_id", "x", "y"), staged(nodes.mapInPandas(_sketch, schema), "nodes")


def _leaves(trees: int, first: int):
    """The leaf of each row (dim, bits, vec, and other columns that stay) in each tree: bits signs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim, bits), part in batch.groupby(["dim", "bits"]):
                x, bits = np.stack(part["vec"].to_numpy()), int(bits)
                for tree in range(first, first + trees):
                    planes = np.random.default_rng([SEED, tree, int(dim)]).normal(size=(int(dim), bits))
                    leaf = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    yield part.drop(columns=["vec", "bits"]).assign(tree=tree, leaf=leaf)

    return run


def _with_bits(nodes: DataFrame, leaf: int) -> DataFrame:
    """Adds bits, so that the leaves of a label hold about so many nodes."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("_n"))
    bits = F.greatest(F.ceil(F.log2(F.col("_n") / leaf)), F.lit(0)).cast("int")
    return nodes.join(small(staged(sizes, "sizes")), ["label", "dim"]).withColumn("bits", bits).drop("_n")


EDGES = "u long, v long, dist int"
FAR = SKETCH + 1


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signs in which sketches differ: of shape [..., n, words] and [..., m, words], each with each."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # of a negative number numpy counts the bits of its absolute value
    out = np.zeros((*a.shape[:-1], b.shape[-2]), dtype=np.int32)
    for w in range(_WORDS):
        out += np.bitwise_count(a[..., :, None, w] ^ b[..., None, :, w]).astype(np.int32)
    return out


def _compare_leaf(group: pd.DataFrame) -> pd.DataFrame:
    """Each node's NAMED nearest partners in a leaf."""
    nodes, sketches = group["node"].to_numpy(dtype=np.int64), group[_SKETCH].to_numpy(dtype=np.int64)
    k = min(NAMED, len(nodes) - 1)
    if k < 1:
        return pd.DataFrame({"u": nodes[:0], "v": nodes[:0], "dist": np.zeros(0, np.int32)})
    dist = _differ(sketches, sketches)
    np.fill_diagonal(dist, FAR)
    top = np.argpartition(dist, k - 1, axis=1)[:, :k]
    return pd.DataFrame({"u": np.repeat(nodes, k), "v": nodes[top].ravel(), "dist": np.take_along_axis(dist, top, axis=1).ravel()})


def _compare_around(most: int):
    """Rows of arrays v, worst and sketches (the neighbours of one node): pairs among them that enter a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("around")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            field = lambda c, flat=flat: flat.field(c).to_numpy(zero_copy_only=False)
            v, worst, sketch = field("v"), field("worst"), np.stack([field(c) for c in _SKETCH], axis=1)
            first = np.concatenate([[0], np.cumsum(sizes)])
            for i in range(0, len(sizes), 256):  # so many nodes at a time bound the memory
                n = sizes[i : i + 256]
                width = int(n.max(initial=0))
                if width < 2:
                    continue
                at = np.minimum(first[i : i + 256][: len(n), None] + np.arange(width), len(v) - 1)
                there = np.arange(width) < n[:, None]
                dist = _differ(sketch[at], sketch[at])
                dist[~(there[:, :, None] & there[:, None, :])] = FAR
                dist[:, np.arange(width), np.arange(width)] = FAR
                k = min(most, width - 1)
                top = np.argpartition(dist, k - 1, axis=2)[:, :, :k]
                best = np.take_along_axis(dist, top, axis=2)
                g, a, b = np.nonzero((best < worst[at][:, :, None]) & (best < FAR))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[at[g, a]]), pa.array(v[at[g, top[g, a, b]]]), pa.array(best[g, a, b].astype(np.int32))], ["u", "v", "dist"]
                )

    return run


def _top(edges: DataFrame, most: int) -> DataFrame:
    """Each node's list: its `most` nearest distinct partners. Equal rows have equal ranks, so that they are dropped after the one
    shuffle, before which every task keeps no more than is needed of a node."""
    rank = F.dense_rank().over(W.partitionBy("u").orderBy("dist", "v"))
    return edges.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r").distinct()


def first_graph(nodes: DataFrame, trees: int = TREES, first: int = 0, leaf: int = LEAF) -> DataFrame:
    """Edges u, v, dist between nodes that share a leaf."""
    dealt = _with_bits(nodes, leaf).select("node", "label", "dim", "bits", *_SKETCH, "vec").mapInPandas(
        _leaves(trees, first), "node long, label string, dim int, " + "".join(f"{c} long, " for c in _SKETCH) + "tree int, leaf long"
    )
    dealt = staged(dealt, "leaves")
    key = ["label", "dim", "tree", "leaf"]
    large = dealt.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    large = small(staged(large.select(*key, F.ceil(F.col("n") / BLOCK * 2).cast("int").alias("blocks")), "large"))
    dealt = dealt.join(large, key, "left").withColumn("block", F.pmod(F.xxhash64("node", "tree"), F.coalesce("blocks", F.lit(1))))
    return dealt.groupBy(*key, "block").applyInPandas(_compare_leaf, EDGES)


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "dist"))


def _likely(lists: DataFrame) -> DataFrame:
    return lists.filter(F.col("dist") <= CUT)


def one_round(lists: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The lists after one join of neighbours with neighbours, stored."""
    worst = lists.groupBy("u").agg(F.when(F.count("*") >= most, F.max("dist")).otherwise(FAR).alias("worst"))
    known = nodes.select(F.col("node").alias("v"), *_SKETCH).join(worst.withColumnRenamed("u", "v"), "v", "left")
    # While sketches may be broadcast, neighbours stay with the node whose list they are on.
    known = small(staged(known.withColumn("worst", F.coalesce("worst", F.lit(FAR))), "known"))
    around = _top(_both(lists), 2 * most).select("u", "v").join(known, "v")
    around = around.groupBy("u").agg(F.collect_list(F.struct("v", "worst", *_SKETCH)).alias("around")).select("around")
    return staged(_top(lists.union(around.mapInArrow(_compare_around(most), EDGES)), most), "lists")


def refined(lists: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins until no list gains a likely link. Lists never lose any but for nearer ones."""
    before = _likely(lists).count()
    while True:
        lists = one_round(lists, nodes, most)
        after = _likely(lists).count()
        if after <= before:
            return lists
        before = after


def _full(lists: DataFrame, most: int) -> DataFrame:
    """u whose list of `most` holds nothing but likely links."""
    return _likely(lists).groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("u")


def enlarged(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lists, those full of likely links and of their neighbours enlarged and refined up to DENSE entries; all others stay."""
    size = LIST
    while size < DENSE:
        full = staged(_full(lists, size), "full")
        if not full.limit(1).count():
            break
        size = min(2 * size, DENSE)
        near = full.union(_likely(lists).join(small(full), "u", "left_semi").select(F.col("v").alias("u"))).distinct()
        part = _both(lists).join(small(staged(near, "near")), "u", "left_semi")
        lists = staged(lists.union(refined(staged(_top(part, size), "lists"), nodes, size)).distinct(), "lists")
    return lists


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            cosine = np.einsum("ij,ij->i", np.stack(batch["p"].to_numpy()), np.stack(batch["q"].to_numpy()))
            yield batch.loc[cosine >= THRESHOLD, ["u", "v"]]


def threshold_edges(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v (both ways) of likely links whose vectors are near enough, stored."""
    pair = _likely(lists).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    one, two = (nodes.select(F.col("node").alias(n), F.col("vec").alias(c)) for n, c in (("u", "p"), ("v", "q")))
    found = staged(pair.join(one, "u").join(two, "v").select("u", "v", "p", "q").mapInPandas(_check, "u long, v long"), "edges")
    return found.union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _block_links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """What two blocks of dense nodes add: weight of links of each left node, and of right nodes that are asked for; one link
    each."""
    if not len(left) or not len(right):
        return pd.DataFrame({"node": [], "more": [], "other": []}).astype({"node": "int64", "more": "int64", "other": "int64"})
    a, b = left["node"].to_numpy(dtype=np.int64), right["node"].to_numpy(dtype=np.int64)
    linked = (np.stack(left["vec"].to_numpy()) @ np.stack(right["vec"].to_numpy()).T >= THRESHOLD) & (a[:, None] != b[None, :])
    own = pd.DataFrame({"node": a, "more": linked @ right["weight"].to_numpy(dtype=np.int64), "other": b[linked.argmax(axis=1)]})
    asked = right["asked"].to_numpy(dtype=bool)
    back = pd.DataFrame({"node": b, "more": left["weight"].to_numpy(dtype=np.int64) @ linked, "other": a[linked.argmax(axis=0)]})[asked]
    out = pd.concat([own, back])
    return out[out["more"] > 0]


def _near_groups(group: DataFrame, trees: int) -> DataFrame:
    """group: cell, label, dim, r, p, blocks. Pairs of cells (c1, c2, n1, n2) that may hold a link, each cell with itself too: cells
    whose means share a leaf in one of the trees, and lie near enough."""
    dealt = _with_bits(group, LEAF).withColumn("vec", F.col("p")).mapInPandas(
        _leaves(trees, 0), "cell long, label string, dim int, r double, p array<double>, blocks int, tree int, leaf long"
    )
    dealt = staged(dealt, "means")
    one, two = dealt.alias("one"), dealt.alias("two")
    shared = [F.col(f"one.{c}") == F.col(f"two.{c}") for c in ("label", "dim", "tree", "leaf")]
    near = _angle(_dot("one.p", "two.p")) <= F.col("one.r") + F.col("two.r") + (math.acos(THRESHOLD) + 1e-7)
    pair = one.join(two, shared).filter(near & (F.col("one.cell") != F.col("two.cell")))
    pair = pair.select(F.col("one.cell").alias("c1"), F.col("two.cell").alias("c2"), F.col("one.blocks").alias("n1"), F.col("two.blocks").alias("n2"))
    return staged(pair.distinct().union(group.select("cell", "cell", "blocks", "blocks")), "pairs")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _angle(cosine):
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def _dense_links(dense: DataFrame, links: DataFrame, nodes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """For nodes in dense groups (node): (node, more: weight of linked dense nodes), and links u, v that join the groups."""
    inner = links.join(dense.withColumnRenamed("node", "u"), "u", "left_semi").join(dense.withColumnRenamed("node", "v"), "v", "left_semi")
    cells = dense.join(components(inner).withColumnRenamed("root", "cell"), "node", "left").select("node", F.coalesce("cell", "node").alias("cell"))
    member = staged(cells.join(nodes, "node"), "dense")
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("vec"))))
    pivots = member.groupBy("cell").agg(mean.alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, v: s + v * v))
    pivots = pivots.select("cell", F.transform("mean", lambda v: v / length).alias("pivot"))
    reach = math.acos(THRESHOLD)
    member = member.join(pivots, "cell").withColumn("angle", F.coalesce(_angle(_dot("vec", "pivot")), F.lit(math.pi)))
    member = staged(member.withColumn("core", F.col("angle") <= reach / 2 - 1e-7), "members")
    core = member.filter("core").groupBy("cell").agg(F.sum("weight").alias("all"), F.min("node").alias("least"))
    in_core = member.filter("core").select("cell", "node", "weight").join(core, "cell")

    group = member.groupBy("cell", "label", "dim").agg(F.max("angle").alias("r"), F.first("pivot").alias("p"), F.count("*").alias("n"))
    group = staged(group.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "groups")
    pair = _near_groups(group.select("cell", "label", "dim", "r", "p", "blocks"), trees)
    same = F.col("c1") == F.col("c2")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = member.withColumnRenamed("cell", "c1").join(pair, "c1").filter(~same | ~F.col("core"))
    left = left.select("c1", "c2", deal(F.col("n1")).alias("b1"), spread(F.col("n2")).alias("b2"), "node", "vec", "weight")
    # Of a cell without any node outside its core nothing is compared with itself.
    rest = left.select("c1", "c2", "b1", "b2").distinct()
    right = member.withColumnRenamed("cell", "c2").join(pair, "c2").select(
        "c1", "c2", spread(F.col("n1")).alias("b1"), deal(F.col("n2")).alias("b2"), "node", "vec", "weight", (same & F.col("core")).alias("asked")
    ).join(rest, ["c1", "c2", "b1", "b2"], "left_semi")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # else cogroup takes both sides' columns for the same
    blocks = ["c1", "c2", "b1", "b2"]
    found = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(_block_links, "node long, more long, other long")
    found = staged(found, "found")
    more = found.select("node", "more").union(in_core.select("node", F.col("all") - F.col("weight")))
    links = found.select(F.col("node").alias("u"), F.col("other").alias("v")).union(in_core.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return more.groupBy("node").agg(F.sum("more").alias("more")), links


def link_table(lists: DataFrame, nodes: DataFrame, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(node, n: weight of all nodes linked), (u, v: links from which all components follow)."""
    dense = staged(_full(lists, DENSE).withColumnRenamed("u", "node"), "full")
    links = threshold_edges(lists, nodes)
    more, joining = _dense_links(dense, links, nodes, trees)
    marked = links.join(dense.select(F.col("node").alias("u"), F.lit(True).alias("du")), "u", "left")
    marked = marked.join(dense.select(F.col("node").alias("v"), F.lit(True).alias("dv")), "v", "left")
    listed = marked.filter("du IS NULL OR dv IS NULL").join(nodes.select(F.col("node").alias("v"), "weight"), "v")
    counts = listed.select(F.col("u").alias("node"), F.col("weight").alias("n")).union(more.select("node", "more"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    return staged(counts, "counts"), staged(links.union(joining), "links")


def audit_recall(nodes: DataFrame, counts: DataFrame, most: int = AUDIT) -> float:
    """Links found over true links, of at most `most` nodes, each compared with all vectors of its label. Nodes are taken in turn
    from all labels by hash, half of them from those with links."""
    known = nodes.select("node", "label", "dim").join(counts, "node", "left").withColumn("has", F.col("n").isNotNull())
    turn = F.row_number().over(W.partitionBy("has", "label", "dim").orderBy(F.xxhash64("node"), "node"))
    known = staged(known.withColumn("_turn", turn).filter(F.col("_turn") <= most // 2), "audit")
    part = lambda has: known.filter("has" if has else "NOT has").orderBy("_turn", F.xxhash64("node"), "node").limit(most // 2)
    asked = part(True).union(part(False)).select("node", F.coalesce("n", F.lit(0)).alias("n"))
    asked = F.broadcast(asked).join(nodes, "node").select("node", "label", "dim", "vec", "n").toPandas()  # bounded by `most`
    if not len(asked):
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast({k: (g["node"].to_numpy(), np.stack(g["vec"].to_numpy())) for k, g in asked.groupby(["label", "dim"])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby(["label", "dim"]):
                if k in shared.value:
                    ids, x = shared.value[k]
                    y, own = np.stack(part["vec"].to_numpy()), part["node"].to_numpy()
                    linked = (x @ y.T >= THRESHOLD) & (ids[:, None] != own[None, :])
                    yield pd.DataFrame({"true": [int((linked @ part["weight"].to_numpy(dtype=np.int64)).sum())]})

    true = nodes.select("node", "label", "dim", "vec", "weight").mapInPandas(run, "true long").agg(F.sum("true")).first()[0] or 0
    return 1.0 if not true else min(1.0, float(asked["n"].sum()) / true)


def near_duplicates(vectors: DataFrame, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vectors: vec_id, embedding, label. Returns vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    rows, nodes = _nodes(vectors)
    lists = None
    for build in range(BUILDS):
        graph = first_graph(nodes, trees, build * trees, leaf)
        lists = staged(_top(graph if lists is None else lists.union(graph), LIST), "lists")
        lists = enlarged(refined(lists, nodes, LIST), nodes)
        counts, links = link_table(lists, nodes, (build + 1) * trees)
        recall = audit_recall(nodes, counts)
        if recall >= AUDIT_RECALL:
            break
    else:
        raise RuntimeError(f"the neighbour graph finds {recall:.4f} of the audited links after {BUILDS} builds")
    roots = components(links)
    ids = rows.filter("x IS NOT NULL").groupBy("x", "y").agg(F.min("vec_id").alias("least"))
    named = nodes.select("node", "x", "y", "weight").join(ids, ["x", "y"]).join(roots, "node", "left")
    named = staged(named.select("node", "x", "y", "weight", "least", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").join(counts, "node", "left")
    named = named.select("x", "y", "component_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.join(staged(named, "nodes"), ["x", "y"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("x").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
