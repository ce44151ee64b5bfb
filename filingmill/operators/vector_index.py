"""Approximate nearest neighbours from a stored index: vectors lie in partitions by their nearest centroid, and a search opens only the partitions
whose centroids are near its queries.

Centroids are fitted (k-means on directions) on a sample of at most SAMPLE vectors by hash order; every vector is then indexed. How many
cells a query has to probe is measured when the index is built: for CALIBRATION vectors of the table their true k nearest are found exactly,
and the smallest number of cells that holds the wanted share of them is kept with the index. Where vectors gather in groups that is a
few cells; where they lie evenly in all directions no index can do with few, and the number says so. A query whose cells would hold fewer
than k vectors (after the filter, if there is one) probes on until they hold k, so that every query gets its k rows where there are k."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import HIT, MOST_RESULTS, blocks_of_queries, by_length, compare, live, nearest, ranked

SAMPLE, CALIBRATION, MOST_CELLS, ROUNDS = 20_000, 200, 4096, 8
#: The share of true neighbours that the probed cells are to hold.
WANTED = 0.95


@dataclass
class Index:
    path: str
    centres: np.ndarray  # unit vectors, a row a cell
    sizes: np.ndarray  # vectors a cell
    probes: int
    recall: float  # as measured at so many probes

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")

    def cells_of(self, x: np.ndarray, k: int, sizes: np.ndarray | None = None) -> list[np.ndarray]:
        """The cells that each of these queries (unit vectors) probes, the nearest first: `probes` of them, and on until they hold k vectors."""
        order = np.argsort(-(x @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum((self.sizes if sizes is None else sizes)[order], axis=1)
        enough = np.minimum((held < k).sum(axis=1) + 1, len(self.centres))
        return [row[: max(self.probes, n)] for row, n in zip(order, enough, strict=True)]

    def share_compared(self, x: np.ndarray, k: int = MOST_RESULTS) -> float:
        """The share of all vectors that these queries are compared with."""
        return float(np.mean([self.sizes[c].sum() for c in self.cells_of(x, k)]) / max(1, self.sizes.sum()))


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vec"].to_numpy()).astype(np.float64)
                cells = np.concatenate([np.argmax(x[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(x), 1024)])
                yield batch.assign(cell=cells.astype(np.int32))

    return run


def _centres(held: DataFrame, cells: int) -> np.ndarray:
    """Unit centroids of a bounded sample."""
    sample = held.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    model = KMeans(k=cells, distanceMeasure="cosine", initMode="random", maxIter=ROUNDS, seed=3).fit(sample.cache())
    sample.unpersist()
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def build(vectors: DataFrame, path: str, cells: int | None = None, wanted: float = WANTED, k: int = MOST_RESULTS) -> Index:
    """vectors: id (long), vec, and any columns to filter by. Stores an index at path. Vectors without a direction, and those of another length than the
    most frequent one, are no one's neighbours and are left out. cells: about the root of their number, if not given."""
    spark = vectors.sparkSession
    held = vectors.filter(live(F.col("vec")))
    usual = held.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        raise ValueError("there is no vector to index")
    held = held.filter(F.size("vec") == usual.d)
    cells = max(1, min(cells or round(usual.n**0.5), MOST_CELLS, usual.n))
    centres = _centres(held, cells)
    shared = spark.sparkContext.broadcast(centres)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in held.schema)}, cell int"
    found = held.mapInPandas(lambda batches: _assigned(shared.value)(batches), schema)
    # A large cell is split over files, small ones share a task.
    found.hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/vectors")
    index = Index(path, centres, np.zeros(len(centres), dtype=np.int64), len(centres), 1.0)
    stored = index.vectors(spark)
    for r in stored.groupBy("cell").count().collect():
        index.sizes[r.cell] = r["count"]
    sample = stored.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).select(F.col("id").alias("query_id"), "vec")
    truth = nearest(sample, stored, k).select("query_id", "id").join(stored.select("id", "cell"), "id").collect()  # k a query
    asked = sample.toPandas()
    [(ids, x)] = by_length(asked["query_id"], asked["vec"]).values()
    place = np.argsort(np.argsort(-(x @ centres.T), axis=1, kind="stable"), axis=1)
    row = {q: i for i, q in enumerate(ids.tolist())}
    reached = np.bincount([place[row[r.query_id], r.cell] for r in truth], minlength=len(centres)).cumsum() / max(1, len(truth))
    index.probes = int(np.searchsorted(reached, wanted - 1e-12)) + 1
    index.recall = float(reached[index.probes - 1])
    about = json.dumps({"probes": index.probes, "recall": index.recall, "sizes": index.sizes.tolist(), "centres": centres.tolist()})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")
    return index


def load(spark: SparkSession, path: str) -> Index:
    """The index that was stored at path."""
    about = json.loads(spark.read.option("wholetext", True).text(f"{path}/about").first()[0])
    return Index(path, np.array(about["centres"]), np.array(about["sizes"], dtype=np.int64), about["probes"], about["recall"])


def search(queries: DataFrame, index: Index, k: int = MOST_RESULTS, condition: Column | None = None) -> DataFrame:
    """queries: query_id, vec. As `nearest`, of the vectors in the probed cells: query_id, id, distance, rank. condition: a filter over the
    columns stored with the vectors, which reaches the scan. Only files of probed cells are opened, and a vector is compared with the queries that
    probe its cell; queries beyond a block follow in further blocks."""
    spark = queries.sparkSession
    stored = index.vectors(spark)
    sizes = None
    if condition is not None:
        stored = stored.filter(condition)
        sizes = np.zeros(len(index.centres), dtype=np.int64)
        for r in stored.groupBy("cell").count().collect():  # one a cell
            sizes[r.cell] = r["count"]

    def run(shared):
        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, x, by_cell = shared.value
            for batch in batches:
                for cell, rows in batch.groupby("cell"):
                    own = by_cell.get(cell)
                    if own is not None:
                        yield from compare({x.shape[1]: (ids[own], x[own])}, rows["id"].to_numpy(), rows["vec"], k)

        return over

    found = []
    for block in blocks_of_queries(queries):
        asked = by_length(block["query_id"], block["vec"]).get(index.centres.shape[1])
        if asked is None:
            continue
        ids, x = asked
        by_cell: dict[int, list[int]] = {}
        for i, cells in enumerate(index.cells_of(x, k, sizes)):
            for c in cells.tolist():
                by_cell.setdefault(c, []).append(i)
        shared = spark.sparkContext.broadcast((ids, x, {c: np.array(i) for c, i in by_cell.items()}))
        read = stored if len(by_cell) == len(index.centres) else stored.filter(F.col("cell").isin(sorted(by_cell)))
        found.append(read.select("id", "vec", "cell").mapInPandas(run(shared), HIT))
    return ranked(found, stored, k)
