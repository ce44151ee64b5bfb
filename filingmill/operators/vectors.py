"""Vector tables: metadata filters, exact and approximate nearest neighbours, child search with parent expansion."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, FloatType, MapType, StructType, VariantType

MOST_RESULTS = 10
MOST_DISTANCE = 0.75
DIMENSIONS = 384
#: So many query vectors are broadcast at a time; so many distances are worked out at once.
BROADCAST_QUERIES, COMPARED_AT_ONCE = 10_000, 1 << 21
#: So many queries and vectors of one key meet in a task.
QUERIES_A_BLOCK, VECTORS_A_BLOCK = 2048, 20_000
_COMPARE = {"$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__", "$eq": "__eq__"}


def where(tree: dict, allowed: set[str], depth: int = 0) -> Column:
    """A filter tree ($eq $ne $gt $gte $lt $lte $in $nin $and $or) as a Column, so that Catalyst can push it to the scan.
    Depth 3 and lists of 50 at most; keys outside `allowed` and unknown operators are errors."""
    if depth > 3:
        raise ValueError("the filter is nested more than 3 deep")
    if not isinstance(tree, dict) or not tree:
        raise ValueError("a filter is a non-empty mapping")
    found = []
    for key, value in tree.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or not 1 <= len(value) <= 50:
                raise ValueError(f"{key} takes 1 to 50 filters")
            parts = [where(x, allowed, depth + 1) for x in value]
            joined = parts[0]
            for x in parts[1:]:
                joined = joined & x if key == "$and" else joined | x
            found.append(joined)
        elif key not in allowed:
            raise ValueError(f"{key} can't be filtered by")
        else:
            for op, x in (value if isinstance(value, dict) else {"$eq": value}).items():
                if op in ("$in", "$nin"):
                    if not isinstance(x, list) or not 1 <= len(x) <= 50:
                        raise ValueError(f"{op} takes 1 to 50 values")
                    found.append(F.col(key).isin(x) if op == "$in" else ~F.col(key).isin(x))
                elif op in _COMPARE:
                    found.append(getattr(F.col(key), _COMPARE[op])(x))
                else:
                    raise ValueError(f"unknown operator {op}")
    out = found[0]
    for x in found[1:]:
        out = out & x
    return out


def _inline_parts(query: Column) -> tuple[Column, Column]:
    """(array of struct<k, v>, the text after the first bar) of `key:value,key:value | text`; without a bar all is text."""
    barred = query.contains("|")
    head = F.when(barred, F.split(query, r"\|", 2)[0])
    pairs = F.filter(F.transform(F.split(head, ","), F.trim), lambda p: p.contains(":"))
    names = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("v")))
    text = F.trim(F.when(barred, F.split(query, r"\|", 2)[1]).otherwise(query))
    return F.when(barred, names).otherwise(F.array().cast("array<struct<k:string,v:string>>")), text


def inline_filters(query: Column) -> Column:
    """struct<filters map, text> of `intent:x,year:2025 | text`; without a bar all is text. Of equal keys the last counts."""
    names, text = _inline_parts(query)
    last = F.transform(F.array_distinct(F.transform(names, lambda x: x["k"])), lambda k: F.element_at(F.filter(names, lambda x: x["k"] == k), -1))
    return F.struct(F.map_from_entries(last).alias("filters"), text.alias("text"))


def request_filters(query: Column) -> Column:
    """struct<intent, year, page, has_table, section, doc_type, text>, typed, of the same form. Of equal keys the last valid one counts;
    a year or page that is no integer, and unknown keys, filter nothing; has_table is whether its value is true; null: no filter."""
    names, text = _inline_parts(query)
    of = lambda key, value: F.try_element_at(F.filter(F.transform(F.filter(names, lambda x: x["k"] == key), lambda x: value(x["v"])), lambda v: v.isNotNull()), F.lit(-1))
    same = lambda v: v
    return F.struct(
        of("intent", same).alias("intent"), of("year", lambda v: v.try_cast("int")).alias("year"), of("page", lambda v: v.try_cast("int")).alias("page"),
        of("has_table", lambda v: F.lower(v) == "true").alias("has_table"), of("section", same).alias("section"), of("doc_type", same).alias("doc_type"), text.alias("text"),
    )


def usable(vector: Column, dimensions: int) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def live(vector: Column) -> Column:
    """Whether a vector has a direction: it is not null, not zero, and all its entries are finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.exists(vector, lambda v: v != 0) & ~bad, F.lit(False))


def top(far: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a row of distances a query: (query, place) of the k first by distance and name."""
    n = far.shape[1]
    if n > k:
        kth = np.partition(far, k - 1, axis=1)[:, k - 1]
        q, at = np.nonzero(far <= kth[:, None])
    else:
        q, at = np.divmod(np.arange(far.size), max(n, 1))
    order = np.lexsort((names[at], far[q, at], q))
    q, at = q[order], at[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], at[keep]


def by_length(ids: Sequence, vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length to (ids, unit vectors): vectors of unequal lengths are never compared."""
    lengths = vectors.map(len).to_numpy()
    return {int(d): (np.asarray(ids)[lengths == d], _unit(vectors[lengths == d])) for d in np.unique(lengths)}


def compare(asked: dict, names: np.ndarray, vectors: pd.Series, k: int) -> Iterator[pd.DataFrame]:
    """The k nearest of these vectors to each query of their length. Distances are kept to nine digits, so that equal vectors are equally far
    wherever they stand in a product."""
    for d, (own, y) in by_length(names, vectors).items():
        ids, x = asked.get(d, ((), ()))
        strip = max(1, COMPARED_AT_ONCE // len(own))
        for i in range(0, len(ids), strip):
            far = np.round(1 - x[i : i + strip] @ y.T, 9) + 0.0  # no minus zero
            q, at = top(far, own, k)
            yield pd.DataFrame({"query_id": ids[i + q], "id": own[at], "distance": far[q, at]})


def blocks_of_queries(queries: DataFrame, columns: Sequence[str] = ("query_id", "vec")) -> Iterator[pd.DataFrame]:
    """queries: query_id, vec. All of them that have a direction, in blocks of about BROADCAST_QUERIES at a time."""
    queries = queries.filter(live(F.col("vec"))).select(*columns)
    count = -(-queries.count() // BROADCAST_QUERIES)
    for i in range(count):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(count)) == i).toPandas()
        if len(block):
            yield block


def ranked(found: Sequence[DataFrame], vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, rank of what tasks have found, k a query; ties by id."""
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return functools.reduce(DataFrame.unionByName, found).withColumn("rank", rank).filter(F.col("rank") <= k)


HIT = "query_id long, id long, distance double"


def nearest(queries: DataFrame, vectors: DataFrame, k: int = MOST_RESULTS) -> DataFrame:
    """queries: query_id, vec. vectors: id (long), vec; filter them first. The k nearest of each query by cosine distance, as
    query_id, id, distance, rank; ties by id. Vectors without a direction, or of another length than the query's, are no neighbours. Every vector is
    compared with the queries in matrix products where it lies: the queries are broadcast, many of them in one block after another, and only k
    rows per query and batch are shuffled."""
    held = vectors.filter(live(F.col("vec"))).select("id", "vec")

    def run(shared):
        return lambda batches: (hit for b in batches if len(b) for hit in compare(shared.value, b["id"].to_numpy(), b["vec"], k))

    found = [held.mapInPandas(run(vectors.sparkSession.sparkContext.broadcast(by_length(q["query_id"], q["vec"]))), HIT) for q in blocks_of_queries(queries)]
    return ranked(found, vectors, k)


def nearest_within(queries: DataFrame, vectors: DataFrame, keys: Sequence[str], k: int = MOST_RESULTS) -> DataFrame:
    """As nearest, of vectors that share the query's keys (columns of both). A key's queries and vectors meet in blocks, at most
    QUERIES_A_BLOCK and VECTORS_A_BLOCK of them in a task, so that a hot key is spread; blocks are multiplied, and k rows per query and
    block go on."""
    asked = queries.filter(live(F.col("vec"))).select("query_id", "vec", *keys)
    held = vectors.filter(live(F.col("vec"))).select("id", "vec", *keys)
    blocks = lambda df, most, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = blocks(asked, QUERIES_A_BLOCK, "_rows").join(blocks(held, VECTORS_A_BLOCK, "_columns"), list(keys))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = asked.join(sizes, list(keys)).select("query_id", "vec", *keys, dealt("query_id", "_rows").alias("_r"), every("_columns").alias("_c"))
    # Names of its own, as both sides may be of one table.
    two = held.join(sizes, list(keys)).select("id", F.col("vec").alias("_vec"), *(F.col(c).alias(f"_{c}") for c in keys), every("_rows").alias("_r"), dealt("id", "_columns").alias("_c"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(compare(by_length(left["query_id"], left["vec"]), right["id"].to_numpy(), right["_vec"], k)) if len(left) and len(right) else []
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in HIT.split(", ")})

    groups = one.groupBy(*keys, "_r", "_c").cogroup(two.groupBy(*(f"_{c}" for c in keys), "_r", "_c"))
    return ranked([groups.applyInPandas(meet, HIT)], vectors, k)


def within(hits: DataFrame, most: float = MOST_DISTANCE) -> DataFrame:
    """Hits near enough; ranks stay what they were."""
    return hits.filter(F.col("distance") <= most)


def best_child(hits: DataFrame) -> DataFrame:
    """hits: query_id, id, parent_id, distance. One per parent, the nearest; parents ranked by it."""
    first = F.row_number().over(W.partitionBy("query_id", "parent_id").orderBy("distance", "id"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return hits.withColumn("_n", first).filter("_n = 1").drop("_n").withColumn("parent_rank", order)


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits whose parent is stored, with its columns; others are dropped."""
    return children.join(parents, "parent_id")


def placed(hits: DataFrame) -> DataFrame:
    """hits: query_id, parent_rank. Adds place: its number among the query's hits that are left, from 1."""
    return hits.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("parent_rank")))


def by_ids(requests: DataFrame, table: DataFrame) -> DataFrame:
    """requests: request_id, ids. table: id, ... The rows asked for, pos giving the asked order; unknown ids are dropped."""
    return requests.select("request_id", F.posexplode("ids").alias("pos", "id")).join(table, "id")


def embedded(records: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Adds embedding to records with text: by a given function over lists of texts, else hashed words over their norm."""
    if encode is None:
        spread = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=DIMENSIONS)
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)
        named = records.withColumn("_words", F.split(F.lower(F.coalesce("text", F.lit(""))), r"\W+"))
        out = unit.transform(spread.transform(named))
        return out.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")

    @F.pandas_udf(ArrayType(FloatType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(encode(batch.fillna("").tolist()), dtype=np.float32)))

    return records.withColumn("embedding", of("text"))


def collection_sizes(records: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """collection, n, status (as text). collections: names to be listed even if they hold nothing."""
    sizes = records.groupBy("collection").agg(F.count("*").alias("n"))
    if collections is not None:
        sizes = collections.select("collection").distinct().join(sizes, "collection", "full").select("collection", F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.withColumn("status", F.concat("collection", F.lit(": "), "n", F.lit(" chunks")))


def scalar_metadata(records: DataFrame, column: str = "metadata", joined: Sequence[str] = ("page_intent",)) -> DataFrame:
    """Keeps the atomic fields of a struct column; arrays of strings named in `joined` become one string, all other fields go."""
    kept = []
    for field in records.schema[column].dataType.fields:
        at = F.col(f"{column}.`{field.name}`")
        if isinstance(field.dataType, (StructType, MapType, VariantType)):
            continue
        if isinstance(field.dataType, ArrayType):
            if field.name in joined:
                kept.append(F.array_join(at, ",").alias(field.name))
            continue
        kept.append(at.alias(field.name))
    return records.withColumn(column, F.struct(*kept))


def context_hits(requests: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """requests: request_id, company, year, vec. chunks: id, company, year, vec. The k nearest chunks of the company's report of
    that year, as request_id, id, distance, rank."""
    found = nearest_within(requests.withColumnRenamed("request_id", "query_id"), chunks, ["company", "year"], k)
    return found.withColumnRenamed("query_id", "request_id")


def result_text(hits: DataFrame) -> DataFrame:
    """hits: query_id, rank, distance, text. One text per query, results numbered by their rank before any cut."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] (distance "), F.format_string("%.4f", F.greatest("distance", F.lit(0.0))), F.lit(")\n"), F.col("text"))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text")
    )
