"""Pages become records in one pass, and sections are those of the patterns alone."""

from pyspark.sql import functions as F

from filingmill.functions import patterns, text
from filingmill.sources import pages


def test_pages_are_cleaned_once(spark):
    rows = spark.createDataFrame([("c", 2024, "A", 1, "word " * 200 + "\n" + "more " * 30), ("c", 2024, "A", 2, "too short"), ("c", 2024, "A", 3, None)], "company string, year int, doc_type string, page_num int, text string")
    made = pages.records(pages.with_steps(rows), mark="\n")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\n{3,}") + plan.count("\n{3,}") == 1  # the last step of cleaning stands in the plan once
    got = made.select("kind", "id", "child_index", "child_count", F.size(text.words(F.col("text")))).collect()
    assert [tuple(r) for r in got] == [
        ("parent", "c_2024_A_page_1_parent", None, 3, 230), ("child", "c_2024_A_page_1_parent_child_0", 0, 3, 150),
        ("child", "c_2024_A_page_1_parent_child_1", 1, 3, 80), ("child", "c_2024_A_page_1_parent_child_2", 2, 3, 30),
    ]


def test_gates_leave_sections_as_they_are(spark):
    phrases = ["Dear Stockholder", "CHAIRMAN's letter", "message from the chairman", "Managing Director's message", "MD overview", "Management's Discussion and Analysis", "MD & A", "our strategy", "Strategic pillars", "operating review", "Divisional results", "segment performance",
               "ESG", "Environmental, Social and Governance", "report on corporate governance", "KEY RISKS", "board' report", "directorsreport", "unconsolidated financial", "group financial statement", "note to the accounts", "notes forming part of financial", "independent auditor", "auditor's report", "statement of assets",
               "profit & loss", "statement of income", "statement of cash flow", "equity reconciliation", "statement of change in equity", "5-year summary", "ten year financial summary", "decade at a glance", "key indicators", "performance highlight", "recognition and award", "award accolades", "our board", "directors profile",
               "senior leadership team", "executive committee", "key management", "shareholder return", "investor relations", "AGM notice", "notice of annual general", "Abbreviations used", None, "", "nothing"]
    plain = F.array_compact(F.array(*(F.when(F.col("t").rlike("(?id)" + p), n) for n, p in patterns.SECTIONS)))
    got = spark.createDataFrame([(p,) for p in phrases], "t string").select("t", text.sections(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in got) and {x for r in got for x in r.a} == {n for n, _ in patterns.SECTIONS}
