"""Stored tables changed in place, global numbers, and searches with filters of their own."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from filingmill.operators import search, statements, vectors
from filingmill.plans import answers, queries
from filingmill.sources import stored


def files_of(path):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def test_upserts_replace_only_what_they_touch(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.range(2000).select("id", F.concat(F.lit("v"), "id").alias("value"), F.lit(0).alias("seq"))
    stored.create(stored.commented(rows, {"value": "what it says"}), at, ["id"], buckets=16)
    before = files_of(at)
    changes = spark.createDataFrame([(5, "five", 1), (5, "late", 2), (9999, "new", 1), (7, "old", -1)], "id long, value string, seq int")
    touched = statements.upsert_stored(at, changes, "seq")
    after = files_of(at)
    assert 1 <= len(touched) <= 3
    of = lambda files, inside: {f: h for f, h in files.items() if any(f"_bucket={b}/" in f for b in touched) == inside}
    assert of(before, False) == of(after, False) and len(of(before, False)) >= 13 and not set(of(before, True)) & set(of(after, True))
    got = {r.id: r.value for r in stored.read(spark, at).collect()}
    assert len(got) == 2001 and (got[5], got[9999], got[7], got[8]) == ("late", "new", "v7", "v8")
    statements.upsert_stored(at, changes.withColumn("seq", F.lit(3)).filter("id = 9999"), "seq")
    assert stored.read(spark, at).count() == 2001
    assert stored.read(spark, at).schema["value"].metadata["comment"] == "what it says"
    assert statements.upsert_stored(at, changes.limit(0), "seq") == []


def test_a_failed_job_leaves_the_old_rows(spark, tmp_path):
    at = str(tmp_path / "t")
    stored.create(spark.range(100).withColumn("v", F.lit(1)), at, ["id"], buckets=4)
    before = files_of(at)
    changes = spark.createDataFrame([(1, 2), (2, 2)], "id long, v int")
    broken = lambda old, new: old.unionByName(new.withColumn("v", F.raise_error(F.lit("stop")).cast("int")))
    with pytest.raises(Exception, match="stop"):
        stored.upsert_into(at, changes, broken)
    with pytest.raises(Exception, match="another bucket"):
        stored.upsert_into(at, changes.filter("id = 1"), lambda old, new: old.unionByName(spark.range(500, 600).withColumn("v", F.lit(1))))
    assert files_of(at) == before and stored.read(spark, at).count() == 100


def test_deletes(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int")
    stored.create(rows, at, ["k"], buckets=64)
    stored.delete_from(at, spark.createDataFrame([(None,), ("b",), ("nowhere",)], "k string"))
    assert [(r.k, r.n) for r in stored.read(spark, at).collect()] == [("a", 1)]


def test_companies_keep_their_ids_when_stored(spark, tmp_path):
    at = str(tmp_path / "c")
    table = spark.createDataFrame([(7, "B", "x"), (3, "A", "y")], "company_id long, screener_symbol string, company_name string")
    stored.create(table, at, statements.COMPANY_KEY, buckets=8)
    for _ in range(2):  # the second time nothing is new
        statements.upsert_stored_companies(at, spark.createDataFrame([("B", None), ("Z", "z"), ("C", "c")], "screener_symbol string, company_name string"))
        assert sorted((r.company_id, r.screener_symbol, r.company_name) for r in stored.read(spark, at).collect()) == [(3, "A", "y"), (7, "B", "x"), (8, "C", "c"), (9, "Z", "z")]


def test_numbers_of_many_names_with_one_prefix(spark):
    names = spark.range(0, 300_000, 1, 8).select(F.concat(F.lit("COMPANY-"), F.lpad(F.reverse(F.col("id").cast("string")), 9, "0")).alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = stored.numbered(names, "s", 100, "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert len(held) == 4 and max(held) < 1.5 * 300_000 / 4  # each range in a task of its own
    number = F.row_number().over(__import__("pyspark").sql.Window.orderBy("s")) + 100
    assert got.withColumn("m", number).filter("n <> m").count() == 0 and got.count() == 300_000
    assert stored.numbered(names.limit(0), "s", 0, "n").count() == 0


def test_answers_are_stored(spark, tmp_path):
    at = str(tmp_path / "cache")
    kind = "cache_key string, answer_text string, created_at timestamp_ntz, last_accessed_at timestamp_ntz, expires_at timestamp_ntz, hit_count long"
    stored.create(spark.createDataFrame([("k", "old", None, None, None, 1), ("other", "stays", None, None, None, 0)], kind), at, ["cache_key"], buckets=32)
    found = spark.createDataFrame([("k", "old", True, False), ("k", "old", True, False), ("n", "fresh", False, False), (None, "stop", False, True)], "cache_key string, answer string, from_cache boolean, stopped boolean")
    answers.store_answers(at, found, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    assert {r.cache_key: (r.answer_text, r.hit_count) for r in stored.read(spark, at).collect()} == {"k": ("old", 3), "other": ("stays", 0), "n": ("fresh", 0)}


def test_inline_filters_of_every_form(spark):
    cases = {
        "year:2024,year:2025 | sales": (None, 2025, None, None, None, None, "sales"), "year:2024, year:x|a | b": (None, 2024, None, None, None, None, "a | b"), "page:1.5,page: 7 ,Page:8 | q": (None, None, 8, None, None, None, "q"),
        "intent:a b,has_table:YES,section:s,doc_type:d,color:red | ": ("a b", None, None, False, "s", "d", ""), "has_table:True|": (None, None, None, True, None, None, ""), "no filter, year:2024": (None,) * 6 + ("no filter, year:2024",),
        "| x": (None,) * 6 + ("x",), "": (None,) * 6 + ("",), "year:99999999999 | big": (None,) * 6 + ("big",), "a:b:c,section:x:y | q": (None, None, None, None, "x:y", None, "q"), None: (None,) * 7,
    }
    df = spark.createDataFrame([(c,) for c in cases], "query string")
    assert {r.query: tuple(r)[1:] for r in search.with_filters(df).collect()} == cases
    assert df.select(vectors.inline_filters(F.col("query")).alias("f")).filter("query = 'year:2024,year:2025 | sales'").first().f.filters == {"year": "2025"}


def test_registered_requests_are_of_every_kind(spark):
    rows = queries.QUERIES["filtered_search"](spark, "/root/testdata/sf0.1").collect()
    assert {r.rerun for r in rows} == {True, False} and {r.near for r in rows} >= {True}


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.range(50).select(
        "id", F.array(F.rand(1), F.lit(1.0)).alias("vec"), (2000 + F.col("id") % 3).cast("int").alias("year"), F.lit(1).alias("page_number"), F.lit("a").alias("page_intent"), F.lit(True).alias("has_table"), F.lit("s").alias("section"), F.lit("d").alias("doc_type")
    ).write.parquet(path)
    asked = search.with_filters(spark.createDataFrame([(1, [1.0, 0.0], "year:2001 | q"), (2, [1.0, 0.0], "year:2002,intent:a | q")], "query_id long, vec array<double>, query string"))
    found = search.filtered_nearest(asked, spark.read.parquet(path), 100)
    assert "In(year, [2001,2002])" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.id % 3) for r in found.collect()} == {(1, 1), (2, 2)}
