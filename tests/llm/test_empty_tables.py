"""Empty tables, and extra columns with the operators' own names."""

import corpus_pipeline
from filingmill.llm import decontaminate, simhash

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, a long, b string, fp int, row int, component_id long, score double, _a int"


def test_simhash_and_decontamination(spark):
    docs = spark.createDataFrame([], DOCUMENTS)
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0
    assert decontaminate.decontaminate(docs, items).count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_other_columns_alone(spark, tmp_path):
    spark.createDataFrame([(1, "some words of no concern " * 9)], "item_id long, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"the report of company number {'abcdefgh'[i]} and its shares " * (i + 2), "en", "s", 9, i, "b", i, i, i, 0.5, i) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == spark.createDataFrame([], DOCUMENTS).columns
        assert all((r.a, r.fp, r.row, r["_a"]) == (r.doc_id,) * 4 for r in docs.collect()), name
