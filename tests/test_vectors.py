"""Nearest neighbours: exact ones against numpy, a stored index's recall and the share that it compares."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingmill.operators import vector_index, vectors


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in row] if row is not None else None, i % 3) for i, row in enumerate(x)], "id long, vec array<double>, label int")


def exact(x, q, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    far = np.round(1 - unit(q) @ unit(x).T, 9)
    return [sorted(range(len(x)), key=lambda j, row=row: (row[j], j))[:k] for row in far]


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = r.id
    return {q: [ids[i] for i in sorted(ids)] for q, ids in out.items()}


def test_exact_search_with_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    x[300:] = x[7]  # two thirds are equal
    odd = [None, [], [0.0] * 8, [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.0] * 7]
    v = table(spark, x).union(table(spark, odd, 5000)).repartition(6)
    q = table(spark, x[:20]).union(table(spark, odd, 5000)).select(F.col("id").alias("query_id"), "vec")
    want = dict(enumerate(exact(x, x[:20], 10))) | {5003: [5003]}
    found = vectors.nearest(q, v)
    assert rows_of(found) == want
    # A batch hands on k rows a query, however many are as near: twenty-one queries over six partitions of one batch each.
    asked = {8: (np.arange(20), x[:20] / np.linalg.norm(x[:20], axis=1, keepdims=True))}
    names = np.arange(900)
    assert sum(map(len, vectors.compare(asked, names, v.filter("id < 5000").orderBy("id").toPandas()["vec"], 10))) == 200
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 6)
    monkeypatch.setattr(vectors, "COMPARED_AT_ONCE", 1000)
    assert rows_of(vectors.nearest(q, v)) == want
    assert vectors.nearest(q.limit(0), v).count() == 0 and vectors.nearest(q, v.limit(0)).count() == 0


def test_search_within_keys_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTORS_A_BLOCK", 50)
    x = np.random.default_rng(2).normal(size=(600, 5))
    v = table(spark, x).withColumn("label", F.when(F.col("id") < 400, 0).otherwise(F.col("label")))
    q = v.filter("id % 7 = 0").select(F.col("id").alias("query_id"), "vec", "label")
    labels = [0 if i < 400 else i % 3 for i in range(600)]
    want = {}
    for i in range(0, 600, 7):
        own = [j for j in range(600) if labels[j] == labels[i]]
        want[i] = [own[j] for j in exact(x[own], x[[i]], 4)[0]]
    assert rows_of(vectors.nearest_within(q, v, ["label"], 4)) == want


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    return np.repeat(rng.normal(size=(2000, 32)), 50, axis=0) + 0.4 * rng.normal(size=(100_000, 32))


def test_index_of_many_vectors_compares_few(spark, clustered, tmp_path):
    """100,000 vectors in groups: at most 5 % of them are compared, and nine in ten neighbours found."""
    np.save(tmp_path / "x.npy", clustered)
    at = str(tmp_path / "x.npy")
    v = spark.range(0, 100_000, 1, 8).mapInPandas(
        lambda bs: (b.assign(vec=list(np.load(at)[b["id"].to_numpy()]), label=(b["id"] % 3).astype("int32")) for b in bs), "id long, vec array<double>, label int"
    )
    index = vector_index.build(v, str(tmp_path / "index"))
    q = v.filter("id % 500 = 0").select(F.col("id").alias("query_id"), "vec")
    own = clustered[::500]
    x = own / np.linalg.norm(own, axis=1, keepdims=True)
    assert index.share_compared(x) <= 0.05
    want, got = exact(clustered, own, 10), rows_of(vector_index.search(q, index))
    assert all(len(r) == 10 for r in got.values()) and len(got) == 200
    assert np.mean([len(set(w) & set(got[500 * i])) / 10 for i, w in enumerate(want)]) >= 0.9
    # Few queries open few partitions, and the plan says so.
    one = vector_index.search(q.limit(1), vector_index.load(spark, index.path))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN? ?\(|PartitionFilters: \[[^\]]*cell#\d+ (=|IN|INSET)", plan), plan[:2000]
    # A filter is honoured, and every query still gets k rows.
    filtered = vector_index.search(q, index, condition=F.col("label") == 1)
    assert all(i % 3 == 1 for ids in rows_of(filtered).values() for i in ids) and filtered.count() == 2000


def test_registered_index_recall(spark):
    from filingmill.plans import derived, queries

    folder = "/root/testdata/sf0.1"
    v = derived.read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    want = {(r.query_id, r.id) for r in vectors.nearest(q, v).collect()}
    rows = queries.QUERIES["approximate_vectors"](spark, folder).collect()
    assert len(rows) == len(want) == 10 * q.count()
    assert len(want & {(r.query_id, r.id) for r in rows}) >= 0.9 * len(want)


def test_small_index(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(12, 4))
    v = table(spark, [*x, None, [0.0] * 4, [1.0]])
    index = vector_index.build(v, str(tmp_path / "i"), cells=4, wanted=0.1)
    assert index.sizes.sum() == 12
    q = v.select(F.col("id").alias("query_id"), "vec")
    got = rows_of(vector_index.search(q, index, k=9))
    assert set(got) == set(range(12)) and all(len(ids) == 9 for ids in got.values())
    assert vector_index.search(q.limit(0), index).count() == 0
    with pytest.raises(ValueError):
        vector_index.build(v.limit(0), str(tmp_path / "j"))
