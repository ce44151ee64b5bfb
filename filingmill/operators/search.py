"""Searches whose requests carry filters of their own: filters are data, a table of requests goes through one scan of the chunks, and requests that
find nothing under their filter are searched again without it."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stored
from . import vectors

#: Request column to the chunks' column that has to equal it; `intent` has to be contained in page_intent.
EQUAL = {"year": "year", "page": "page_number", "has_table": "has_table", "section": "section", "doc_type": "doc_type"}
CONTAINED = {"intent": "page_intent"}
#: A filter is pushed to the scan as a list of at most so many values.
MOST_PUSHED = 1000
# What is said where nothing is found, and what stands between results.
NOTHING_FOUND = "INSUFFICIENT_EVIDENCE: no relevant parent chunks were retrieved."
NOTHING_NEAR = "INSUFFICIENT_EVIDENCE: retrieved chunks did not clear the relevance threshold."
BETWEEN = "\n\n---\n\n"


def with_filters(requests: DataFrame, query: str = "query") -> DataFrame:
    """requests: a column of inline queries, and any others. Adds intent, year, page, has_table, section, doc_type (null: any) and text."""
    return requests.select("*", vectors.request_filters(F.col(query)).alias("_f")).select(*requests.columns, "_f.*")


def _filters() -> list[str]:
    return [*EQUAL, *CONTAINED]


def _plain(value):
    """A Python value, or None for any kind of null; whole numbers come as floats where a column has nulls."""
    if value is None or pd.isna(value):
        return None
    value = value.item() if isinstance(value, np.generic) else value
    return int(value) if isinstance(value, float) else value


def _pushed(given: list[tuple]) -> Column | None:
    """What every request of a block asks for in a column, so that the scan can leave the rest out."""
    parts = []
    for i, column in enumerate(EQUAL.values()):
        values = {filters[i] for filters in given}
        if None not in values and len(values) <= MOST_PUSHED:
            parts.append(F.col(column).isin(sorted(values)))
    return functools.reduce(lambda a, b: a & b, parts) if parts else None


def _matching(filters: tuple, chunks: pd.DataFrame) -> np.ndarray:
    """Which chunks a filter lets through; null in a filtered column matches nothing."""
    fits = np.ones(len(chunks), dtype=bool)
    for (name, column), value in zip({**EQUAL, **CONTAINED}.items(), filters, strict=True):
        if value is None:
            continue
        held = chunks[column]
        fits &= held.fillna("").str.contains(value, regex=False).to_numpy() & held.notna().to_numpy() if name in CONTAINED else (held == value).fillna(False).to_numpy(dtype=bool)
    return fits


def filtered_nearest(requests: DataFrame, chunks: DataFrame, k: int = vectors.MOST_RESULTS) -> DataFrame:
    """requests: query_id, vec, and the filters intent, year, page, has_table, section, doc_type (null: any). chunks: id, vec, page_intent, year, page_number,
    has_table, section, doc_type. As vectors.nearest, of the chunks that pass a request's own filter. Requests are grouped by their filter: a batch of chunks is filtered once for
    each distinct filter and only then multiplied; what all requests of a block have in common is pushed to the scan."""
    spark = chunks.sparkSession
    held = chunks.filter(vectors.live(F.col("vec"))).select("id", "vec", *EQUAL.values(), *CONTAINED.values())

    def run(shared):
        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for filters, asked in shared.value:
                    own = batch[_matching(filters, batch)]
                    if len(own):
                        yield from vectors.compare(asked, own["id"].to_numpy(), own["vec"], k)

        return over

    found = []
    for block in vectors.blocks_of_queries(requests, ("query_id", "vec", *_filters())):
        given = [tuple(_plain(v) for v in row) for row in block[_filters()].itertuples(index=False)]
        groups = {}
        for i, filters in enumerate(given):
            groups.setdefault(filters, []).append(i)
        groups = [(filters, vectors.by_length(block["query_id"].to_numpy()[rows], block["vec"].iloc[rows])) for filters, rows in groups.items()]
        condition = _pushed(given)
        scan = held if condition is None else held.filter(condition)
        found.append(scan.mapInPandas(run(spark.sparkContext.broadcast(groups)), vectors.HIT))
    return vectors.ranked(found, chunks, k)


def _sections(requests: DataFrame, chunks: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """The best child of each parent among the k nearest chunks, with its parent: query_id, place (from 1, before any cut by distance), distance, id, child_index, parent columns."""
    hits = filtered_nearest(requests, chunks, k)
    named = hits.join(chunks.select("id", "parent_id", "child_index"), "id").filter("parent_id IS NOT NULL")
    best = vectors.with_parents(vectors.best_child(named), parents)
    return vectors.placed(best)


def search_sections(requests: DataFrame, chunks: DataFrame, parents: DataFrame, k: int = 8, most: float = vectors.MOST_DISTANCE) -> DataFrame:
    """requests: query_id, vec, and filters (see with_filters). chunks: as for filtered_nearest, with parent_id and child_index. parents: parent_id, parent_page, parent_section,
    parent_text. Returns query_id, rerun, place, distance, near (whether within `most`), parent_id, id, child_index, parent_page, parent_section, parent_text.

    A request with a filter under which no section is near is searched again without it (rerun), and only that search counts. The first search is
    stored before it decides which requests these are, so it is run once."""
    asked = requests.select("query_id", "vec", *_filters())
    searched = lambda r, again: _sections(r, chunks, parents, k).withColumns({"rerun": F.lit(again), "near": F.col("distance") <= most})
    first = stored.kept(searched(asked, False), "sections")
    some = functools.reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in _filters()])
    empty = asked.filter(some).join(first.filter("near").select("query_id").distinct(), "query_id", "left_anti")
    empty = stored.kept(empty.select("query_id", "vec", *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in _filters())), "rerun")
    return first.join(empty.select("query_id"), "query_id", "left_anti").unionByName(searched(empty, True))


def section_texts(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """requests: query_id. sections: as from search_sections. query_id, text: the near sections of a request, each with its source, or that none was found or near."""
    unknown = lambda c, word: F.coalesce(F.col(c).cast("string"), F.lit(word))
    line = F.concat(
        F.lit("[Source "), F.col("place"), F.lit(" | page="), unknown("parent_page", "?"), F.lit(" | section="), unknown("parent_section", "unknown"), F.lit(" | parent_id="), F.col("parent_id").cast("string"),
        F.lit(" | child_id="), F.col("id").cast("string"), F.lit(" | child_index="), unknown("child_index", "?"), F.lit(" | relevance="), F.format_string("%.2f", F.bround(1 - F.col("distance"), 2)), F.lit("]\n"), F.coalesce("parent_text", F.lit("")),
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("near"), F.struct("place", line.alias("t")))))
    text = sections.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), BETWEEN).alias("text"))
    found = requests.select("query_id").join(text, "query_id", "left")
    return found.withColumn("text", F.when(F.col("text").isNull(), NOTHING_FOUND).when(F.col("text") == "", NOTHING_NEAR).otherwise(F.col("text")))
