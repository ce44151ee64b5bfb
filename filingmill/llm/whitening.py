"""Whitened principal components of embeddings, by MLlib's BlockMatrix.

Vectors become integers (a fixed-point form in which counts and sums are exact), are numbered, centred and laid into the blocks of a
BlockMatrix A, a fixed number of rows each. A^T A, multiplied block by block, is the scatter; divided by the number of rows it is the
covariance, whose eigenvectors are found on the driver (d x d numbers for d dimensions). A W, with the eigenvectors over the square roots of their eigenvalues as
W, is the whitened form, and a last sum over all rows says how far its covariance is from the identity.

MLlib's multiplication keeps the places of all blocks on the driver and in each task, so at most PANEL_BLOCKS blocks are
multiplied at a time; panels of so many blocks are added up. The middle dimension is split, so that a task holds a few blocks and
not all of them. Blocks come from a stored table: a block that is lost with its executor is made again from there.

Defined results: a vector that is null, empty or holds null or non-finite entries is left out, and so is one of another length than the most frequent
(the longer on a tie); repeated rows count each and are returned each; a null vec_id stays null; a component without variance
(all vectors equal, fewer vectors than dimensions) is returned with whitened null, and all components of such vectors with explained null if nothing varies at all;
equal eigenvalues leave their vectors free up to a rotation, the same for all rows; an entry beyond +-2^52 / 1024 ends the query with an error, as its integer
form would not be exact; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import dropped, scratch_path, small_batches, staged

#: Bytes of a block's numbers, columns of a block, and blocks multiplied at a time.
BLOCK_BYTES, BLOCK_COLUMNS, PANEL_BLOCKS = 2 * 1024 * 1024, 512, 1024
#: Blocks of each side that one task multiplies.
BLOCKS_A_TASK = 4
STEPS, SHIFT, MOST = 1024, 100_000, float(1 << 52)
_EXACT = T.DecimalType(38, 0)


@dataclass
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float

    def weights(self, k: int) -> np.ndarray:
        """Columns that project centred rows to unit variance; zero for components without variance."""
        live = self.varies()[:k]
        return np.where(live, self.vectors[:, :k] / np.sqrt(np.where(live, self.values[:k], 1.0)), 0.0)

    def varies(self) -> np.ndarray:
        """Whether a component's eigenvalue is more than rounding of the largest."""
        return self.values > max(self.values.max(initial=0.0), 0.0) * len(self.values) * np.finfo(float).eps


def fixed_point(vector: Column) -> Column:
    """The integer form of a vector's entries; null if an entry is null or not finite, or there is none."""
    entry = lambda c: c.cast("double") * STEPS
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    one = lambda c: F.when(F.abs(entry(c)) <= MOST, F.floor(entry(c)) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large to be made an exact integer")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, one))


def numbered(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vectors: vec_id, embedding. (a stored table of vec_id, x, row; n; dimensions): row numbers begin at 0 and are those of the
    stored table's parts laid end to end."""
    at = F.monotonically_increasing_id()
    rows = vectors.select("vec_id", fixed_point(F.col("embedding")).alias("x")).filter("x IS NOT NULL")
    rows = staged(rows.select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("pos")), "vectors")
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return rows, 0, 0
    ends = sorted(rows.groupBy("part").agg(F.max("pos").alias("last")).collect())  # as many as tasks read the input
    begins = np.cumsum([0, *(r["last"] + 1 for r in ends)]).tolist()
    starts = rows.sparkSession.createDataFrame([(r.part, b) for r, b in zip(ends, begins, strict=False)], "part int, start long")
    found = rows.filter(F.size("x") == usual.d).join(F.broadcast(starts), "part").select("vec_id", "x", (F.col("start") + F.col("pos")).alias("row"))
    found._staged_at = rows._staged_at
    return found, usual.n, usual.d


def _centred(n: int, sums: list[int], block_rows: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """One block: ids, exact squared distances from the mean times n^2, and the centred rows, column by column, zeros below."""
        flat = rows["x"].combine_chunks().flatten().to_numpy()
        x = flat.reshape(len(rows), len(sums))
        most = n * int(np.abs(x).max()) + max(map(abs, sums))
        exact = object if most >= 1 << 62 else np.int64
        off = x.astype(exact) * n - np.array(sums, dtype=exact)
        if exact is object or int(np.abs(off).max()) ** 2 * len(sums) >= 1 << 62:
            off = off.astype(object)
        squares = (off * off).sum(axis=1)
        squares = pa.array(map(Decimal, squares), pa.decimal128(38, 0)) if off.dtype == object else pa.array(squares).cast(pa.decimal128(38, 0))
        block = np.zeros((block_rows, len(sums)), order="F")
        block[: len(rows)] = (off / n).astype(float)
        whole = pa.array([0, len(rows)], pa.int32())
        ids = rows["vec_id"].combine_chunks()
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, squares), pa.array([block.tobytes("F")], pa.binary())]
        return pa.Table.from_arrays(columns, ["block", "ids", "deviations", "centred"])

    return run


def blocks_of(rows: DataFrame, n: int, sums: list[int], block_rows: int) -> DataFrame:
    """rows: vec_id, x, row. A stored table of the blocks, a row each: block, ids, deviations, centred; its files lie apart by panel."""
    id_type = rows.schema["vec_id"].dataType
    schema = T.StructType().add("block", "integer").add("ids", T.ArrayType(id_type)).add("deviations", T.ArrayType(_EXACT)).add("centred", "binary")
    dealt = rows.withColumn("block", (F.col("row") / block_rows).cast("int"))
    made = dealt.groupBy("block").applyInArrow(_centred(n, sums, block_rows), schema)
    at = scratch_path(rows.sparkSession, "blocks")
    made.withColumn("panel", (F.col("block") / PANEL_BLOCKS).cast("int")).write.partitionBy("panel").parquet(at)
    out = rows.sparkSession.read.schema(schema.add("panel", "integer")).parquet(at)
    out._staged_at = at
    return out


def _matrices(block_rows: int, d: int):
    def run(row) -> Iterator[tuple]:
        block = np.frombuffer(row.centred).reshape(block_rows, d, order="F")
        for j, at in enumerate(range(0, d, BLOCK_COLUMNS)):
            part = block[:, at : at + BLOCK_COLUMNS]
            yield (row.block % PANEL_BLOCKS, j), DenseMatrix(block_rows, part.shape[1], part.ravel("F"))

    return run


def panel_matrix(blocks: DataFrame, panel: int, count: int, block_rows: int, d: int) -> BlockMatrix:
    """The BlockMatrix of one panel of `count` blocks. Kept on executors and made again from the stored table where one is lost."""
    own = blocks.filter(F.col("panel") == panel).select("block", "centred").rdd.flatMap(_matrices(block_rows, d))
    return BlockMatrix(own, block_rows, min(BLOCK_COLUMNS, d), count * block_rows, d).persist(StorageLevel.MEMORY_AND_DISK)


def multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left times right, the middle dimension split: PySpark's own `multiply` leaves that argument of MLlib out."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _projected(base: int, k: int):
    def run(block) -> tuple[int, bytearray]:
        (i, _), z = block
        return base + i, bytearray(z.toArray()[:, :k].tobytes("F"))

    return run


def _covariances(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: number of rows, and for each pair of components both means and the centred products' sum."""
        i, j = (x.ravel() for x in np.indices((k, k)))
        for batch in batches:
            for m, z in zip(batch.column("held").to_pylist(), batch.column("z").to_pylist(), strict=True):
                z = np.frombuffer(z).reshape(-1, k, order="F")[:m]
                mean = z.mean(axis=0)
                products = (z - mean).T @ (z - mean)
                columns = [i, j, np.full(k * k, float(m)), mean[i], mean[j], products.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "m", "a", "b", "p"])

    return run


def identity_error(blocks: DataFrame, live: np.ndarray) -> float:
    """blocks: held (rows in it), z. The largest absolute entry of the covariance less the identity, over the live components."""
    k = len(live)
    parts = blocks.mapInArrow(_covariances(k), "i long, j long, m double, a double, b double, p double")
    total = parts.groupBy("i", "j").agg(*(F.sum(F.expr(x)).alias(c) for c, x in (("n", "m"), ("a", "m * a"), ("b", "m * b"), ("ab", "m * a * b"), ("p", "p"))))
    rows = [r for r in total.collect() if live[r.i] and live[r.j]]  # k^2 of them
    return max((abs((r.p + r.ab - r.a * r.b / r.n) / r.n - (r.i == r.j)) for r in rows), default=0.0)


def _spread(k: int, live: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                ids, deviations = batch.column("ids")[x].values, batch.column("deviations")[x].values
                m = len(ids)
                z = np.frombuffer(batch.column("z")[x].as_py()).reshape(-1, k, order="F")[:m]
                each = pa.array(np.repeat(np.arange(m), k))
                dead = np.tile(~live, m)
                columns = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), deviations.take(each), pa.array(z.ravel("C"), mask=dead)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, components: int = 8, block_rows: int | None = None) -> DataFrame:
    """vectors: vec_id, embedding. Per vector and component, up to `components`: vec_id, component (from 1, by falling eigenvalue), n, deviation (exact: the
    sum over dimensions of (n x - S)^2), whitened, explained (the component's share of all variance), identity_error (one value)."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = T.StructType([vectors.schema["vec_id"]]).add("component", "integer").add("deviation", _EXACT).add("whitened", "double")
    tail = lambda df, n, shares, error: df.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    rows, n, d = numbered(vectors)
    if not n:
        return tail(spark.createDataFrame([], schema), 0, F.lit(None).cast("double"), 0.0)
    totals = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    sums = [r.s for r in sorted(totals.collect())]  # one number a dimension
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * d))
    blocks = blocks_of(rows, n, sums, block_rows)
    dropped(rows)
    sizes = {r.panel: r.last % PANEL_BLOCKS + 1 for r in blocks.groupBy("panel").agg(F.max("block").alias("last")).collect()}

    scatter = np.zeros((d, d))
    matrices = {}
    for panel, count in sizes.items():
        a = panel_matrix(blocks, panel, count, block_rows, d)
        scatter += multiply(a.transpose(), a, -(-count // BLOCKS_A_TASK)).toLocalMatrix().toArray()
        matrices[panel] = a
        if len(sizes) > 1:  # made again for the projection: executors need not hold all panels
            a._java_matrix_wrapper.call("blocks").unpersist(False)
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    fit = Fit(n, sums, values[::-1], axes[:, ::-1], float(np.trace(scatter)) / n)

    k = min(components, d)
    w = fit.weights(k)
    pieces = [((j, 0), DenseMatrix(len(p), k, p.ravel("F"))) for j, p in enumerate(w[i : i + BLOCK_COLUMNS] for i in range(0, d, BLOCK_COLUMNS))]
    weights = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), min(BLOCK_COLUMNS, d), k, d, k)
    at = scratch_path(spark, "projected")
    for panel, a in matrices.items():
        z = multiply(a, weights, 1).blocks.map(_projected(panel * PANEL_BLOCKS, k))
        spark.createDataFrame(z, "block int, z binary").write.mode("append").parquet(at)
        a._java_matrix_wrapper.call("blocks").unpersist(False)
    projected = spark.read.schema("block int, z binary").parquet(at)
    live = fit.varies()[:k]
    held = blocks.select("block", "ids", "deviations", F.size("ids").alias("held")).join(projected, "block")
    error = identity_error(held.select("held", "z"), live)
    shares = [F.lit(max(float(v), 0.0) / fit.trace if fit.trace > 0 else None).cast("double") for v in fit.values[:k]]
    out = held.select("ids", "deviations", "z").mapInArrow(_spread(k, live), schema)
    return tail(out, n, F.element_at(F.array(*shares), F.col("component")), error)
