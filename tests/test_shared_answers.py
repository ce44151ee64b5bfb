"""Questions of other keys that ask for the same figures share their lines; equal keys are answered as their first question."""

import datetime

from pyspark.sql import functions as F

from filingmill.plans import answers


def test_lines_are_made_once(spark, monkeypatch):
    day = lambda y: datetime.date(y, 3, 31)
    stmts = [("profit_loss", c, item, f"Mar {y}", day(y), float(y * c), "INR_CRORE") for c in (1, 2) for item in ("Sales", "Net Profit") for y in (2001, 2002, 2003)]
    stmts = spark.createDataFrame(stmts, "statement string, company_id long, line_item string, period_label string, fiscal_year_end date, value double, unit string")
    asked = [(i, 1, [], False, None, ["Sales", "Net Profit"], [], False, f"intent {i}") for i in range(40)]
    asked += [(50, 1, [], False, None, ["Net Profit", "Sales"], [], False, "same"), (51, 1, [], False, None, ["Sales", "Net Profit"], [], False, "same"), (52, 7, [], False, None, ["Sales"], [], False, "same")]
    asked = spark.createDataFrame(asked, "question_id long, company_id long, raw_years array<int>, single_year_only boolean, n int, line_items array<string>, derived array<string>, needs_context boolean, intent string")
    counts, inner = [], answers._series_lines
    monkeypatch.setattr(answers, "_series_lines", lambda rows, s: counts.append((rows.count(), s.select("company_id").distinct().count())) or inner(rows, s))
    got = {r.question_id: r for r in answers.answer_questions(asked, stmts).collect()}
    assert counts == [(2, 1)]  # two orders of the items, and one company's statements
    assert len({got[i].answer for i in range(40)}) == 1 and "Sales: Mar 2001: 2001.00" in got[0].answer
    assert got[50].answer == got[51].answer and got[50].answer.index("Net Profit:") < got[50].answer.index("Sales:") and got[0].answer != got[50].answer
    assert got[52].stopped and got[52].cache_key is None
