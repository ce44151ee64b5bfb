"""Statements and analytics: hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from filingmill.functions import scalars
from filingmill.operators import periods, quality, series, state, statements, vectors
from filingmill.plans import answers
from filingmill.sources import statement_pages

HTML = """<h1>Acme Ltd</h1><a>NSE: ACME</a><a href=x>BSE: 500123</a><h2>Profit &amp; Loss</h2><table><tr><th></th><th>Mar 2019</th><th>Mar 2020</th><th>Mar 2021</th><th>Mar 2022</th><th>Mar 2023</th>
<th>Mar 2024</th><th>TTM</th></tr><tr><td>Sales +</td><td>1</td><td>2</td><td>3</td><td>1,234</td><td>(5)</td><td>−6.5</td><td>-</td></tr><tr><td>OPM %</td><td>1%</td><td>2%</td><td>3%</td><td>4%</td><td>5%</td><td>18%</td><td></td></tr>
<tr><td>EPS in Rs</td><td>7</td></tr></table><h2>Balance Sheet</h2><table><tr><th></th><th>Mar 2024</th></tr><tr><td>CFO/OP</td><td>90</td></tr></table>"""


def _stmts(spark, values):
    rows = []
    for item, statement, by_year in values:
        rows += [(statement, 1, item, f"Mar {y}", dt.date(y, 3, 31), v, "INR_CRORE") for y, v in by_year.items()]
    return spark.createDataFrame(rows, "statement string, company_id long, line_item string, period_label string, fiscal_year_end date, value double, unit string")


@pytest.fixture(scope="module")
def stmts(spark):
    return _stmts(spark, [
        ("Sales", "profit_loss", {2020: 100.0, 2021: None, 2022: 150.0, 2023: 120.0, 2024: 180.0}),
        ("Net Profit", "profit_loss", {2021: -10.0, 2022: 15.0, 2023: 0.0, 2024: 30.0}),
        ("Equity Capital", "balance_sheet", {2022: 10.0, 2023: 10.0, 2024: 10.0}),
        ("Reserves", "balance_sheet", {2022: 40.0, 2023: 60.0, 2024: 90.0}),
        ("Borrowings", "balance_sheet", {2022: 25.0, 2023: None, 2024: 50.0}),
    ])


def test_series(spark, stmts):
    yoy = {(r.line_item, r.period_label): r.yoy_pct for r in series.year_over_year(stmts).collect()}
    assert yoy["Sales", "Mar 2020"] is None and yoy["Sales", "Mar 2021"] is None
    assert yoy["Sales", "Mar 2022"] == pytest.approx(50) and yoy["Sales", "Mar 2023"] == pytest.approx(-20)
    assert yoy["Net Profit", "Mar 2022"] == pytest.approx(250) and yoy["Net Profit", "Mar 2024"] is None
    overall = {r.line_item: r for r in series.overall_change(stmts).collect()}
    assert overall["Sales"].change_pct == pytest.approx(80) and overall["Sales"].cagr_pct == pytest.approx((1.8**0.25 - 1) * 100)
    assert overall["Net Profit"].cagr_pct is None and overall["Net Profit"].direction == "up"
    assert overall["Equity Capital"].direction == "flat" and overall["Sales"].n_values == 4


def test_ratios(spark, stmts):
    got = {(r.metric, r.fy): (r.value, r.note) for r in series.derived_metrics(stmts).collect()}
    assert got["net_profit_margin", 2024][0] == pytest.approx(30 / 180) and got["net_profit_margin", 2021][0] is None
    assert got["debt_to_equity", 2022][0] == pytest.approx(0.5) and got["debt_to_equity", 2023][0] is None
    assert got["roe", 2024][0] == pytest.approx(30 / 85) and got["roe", 2024][1] is None
    assert got["roe", 2022][0] == pytest.approx(15 / 50) and "closing equity only" in got["roe", 2022][1]
    assert "not disclosed" in got["roe", 2021][1]


def test_periods_of_questions(spark, stmts):
    asked = [
        (1, 1, [], False, None), (2, 1, [2023], False, None), (3, 1, [2023], True, None), (4, 1, [1999], True, None), (5, 1, [1999], False, 2),
        (6, 1, [2024, 2020], False, None), (7, 1, [2024, 2024], False, None), (8, 1, [1990, 1991], False, None), (9, None, [], False, None), (10, 9, [], False, None),
    ]
    q = spark.createDataFrame(asked, "question_id long, company_id long, raw_years array<int>, single_year_only boolean, n int")
    got = {r.question_id: r for r in periods.resolve_periods(q, stmts).collect()}
    years = {i: r.periods and [int(p[-4:]) for p in r.periods] for i, r in got.items()}
    assert years == {1: [2022, 2023, 2024], 2: [2021, 2022, 2023], 3: [2023], 4: [2024], 5: [2023, 2024], 6: [2020, 2024], 7: [2024], 8: [], 9: None, 10: None}
    assert "couldn't identify" in got[9].stop_message and "any financial data" in got[10].stop_message


def test_answers_and_suggestions(spark, stmts):
    none = []
    q = [
        (1, 1, [2024], True, None, ["sales", "Nothing"], none, True, "x"), (2, 1, [2024], True, None, ["Nothing", "SALES"], None, True, "x"), (3, 1, [2024, 2023], False, None, ["Borrowings"], [" ROE ", "x", "roe"], False, "x"),
        (4, None, [], False, None, ["Sales"], none, False, "x"), (5, 1, [2024], True, None, ["Goodwill"], none, False, "x"), (6, 1, [2024], True, None, ["Net Profit"], none, False, None),
    ]
    df = spark.createDataFrame(q, "question_id long, company_id long, raw_years array<int>, single_year_only boolean, n int, line_items array<string>, derived array<string>, needs_context boolean, intent string")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    key = answers.keyed(df, stmts).filter("question_id = 6").first().cache_key
    empty = "cache_key string, answer_text string, created_at timestamp_ntz, last_accessed_at timestamp_ntz, expires_at timestamp_ntz, hit_count long"
    day = dt.datetime(2024, 5, 1)
    cache = spark.createDataFrame([(key, "as before", day, day, None, 4), ("old", "gone", day, day, day, 1)], empty)

    def search(requests):
        texts = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(f"p{i % 2}").alias("id"), F.lit(t).alias("text")) for i, t in enumerate(("first passage", " second one ", "the first again", " "), 1)))
        return requests.select("cache_key", "i", "p", "line_item", "period", F.inline(texts))

    found = answers.answer_questions(df, stmts, cache, now, search).cache()
    got = {r.question_id: r for r in found.collect()}
    assert (got[6].answer, got[6].from_cache, got[1].from_cache) == ("as before", True, False) and [got[i].n_snippets for i in (1, 2, 3)] == [2, 2, 0]
    assert got[4].stopped and got[5].stopped and got[5].cache_key is None and got[5].answer == got[5].stop_message and "Goodwill" in got[5].answer and got[4].suggestions == []
    assert got[3].answer.endswith("\n" + series.LABELS["roe"] + ": Mar 2023: 0.00%, Mar 2024: 35.29%") and got[3].series[0].direction == "unknown"
    after = {r.cache_key: r for r in answers.cache_after(cache, found, now).collect()}
    assert set(after) == {"old", key, got[1].cache_key, got[3].cache_key} and after[key].hit_count == 5 and after[key].answer_text == "as before"
    assert after[got[1].cache_key].expires_at == dt.datetime(2024, 7, 1) and after["old"].answer_text == "gone"
    assert got[1].cache_key == got[2].cache_key != got[3].cache_key and got[4].cache_key is None
    told = answers.EVIDENCE_HEAD + "1. [sales / Mar 2024]: first passage\n\n2. [sales / Mar 2024]: second one"
    assert got[1].answer == answers.OPENING + "Sales: Mar 2024: 180.00 INR_CRORE" + told and got[2].answer == got[1].answer
    assert got[3].answer.startswith(answers.OPENING + "Borrowings: Mar 2023: not disclosed INR_CRORE, Mar 2024: 50.00 INR_CRORE\n")
    assert got[1].suggestions == ["Want to see Net Profit for the same period?", "Compare this against Mar 2020 as well?", "See Borrowings trend over the last few years?"]
    assert got[3].suggestions[2].startswith("Curious what drove the change in Borrowings?")
    text = {r.line_item: r.text for r in answers.series_texts(stmts).collect()}
    assert "  Mar 2021: not disclosed\n" in text["Sales"] and "(YoY change vs previous period: +50.00%)" in text["Sales"] and text["Sales"].endswith("Direction: up")


def test_html_statements(spark):
    pages = spark.createDataFrame([(1, "ACME", HTML), (2, "X", "<h1>x</h1>"), (3, "Y", None)], "page_id long, symbol string, html string")
    cells = statement_pages.statement_cells(pages).cache()
    tidy = {(r.statement, r.line_item, r.period_label): r for r in statement_pages.tidy(cells).collect()}
    assert tidy["profit_loss", "Sales", "Mar 2022"].value == 1234 and tidy["profit_loss", "Sales", "Mar 2023"].value == -5 and tidy["profit_loss", "Sales", "Mar 2024"].value == -6.5
    assert ("profit_loss", "Sales", "Mar 2019") not in tidy and tidy["profit_loss", "Sales", "TTM"].value is None and tidy["profit_loss", "Sales", "TTM"].fiscal_year_end is None
    assert tidy["profit_loss", "OPM %", "Mar 2024"].unit == "PERCENT" and tidy["balance_sheet", "CFO/OP", "Mar 2024"].unit == "RATIO"
    assert tidy["profit_loss", "EPS in Rs", "Mar 2021"].row_misaligned and tidy["profit_loss", "EPS in Rs", "Mar 2021"].unit == "INR"
    who = {r.page_id: r for r in statement_pages.identities(cells).collect()}
    assert (who[1].name, who[1].nse, who[1].bse, who[1].error) == ("Acme Ltd", "ACME", "500123", "missing: Cash Flows")
    assert who[2].error == who[3].error == "no company name"


def test_cells(spark):
    cases = {"1,05,780": 105780, "(1,234)": -1234, " 18% ": 18, "−3": -3, "": None, "-": None, "—": None, "n/a": None, "(0.1)": -0.1, ".5": 0.5, "1e3": 1000}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalars.clean_number(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases
    dates = {"Mar 2024": dt.date(2024, 3, 31), "Feb 2024": dt.date(2024, 2, 29), "mar 2024": None, "TTM": None, "Mar 24": None}
    df = spark.createDataFrame([(k,) for k in dates], "t string").select("t", scalars.period_end(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == dates
    row = spark.range(1).select(
        scalars.symbol(F.lit(" m&m ")).alias("a"), scalars.symbol(F.lit("a b")).alias("b"), scalars.parsed_day(F.lit("31/12/2024")).alias("c"), scalars.is_clock_time(F.lit("24:00:00")).alias("d"),
        scalars.redacted(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("q"), F.lit("y" * 3000))).alias("e"), scalars.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("f"), scalars.year_in_text(F.lit("x 1999 2023.")).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.f, row.g) == ("M&M", None, dt.date(2024, 12, 31), False, None, 2023)
    assert row.e == {"api_key": "[REDACTED]", "q": "y" * 2000}


def test_filters_and_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "year int, company string")
    keys = {"year", "company"}
    hit = lambda tree: [r.year for r in df.filter(vectors.where(tree, keys)).collect()]
    assert hit({"year": {"$gte": 2}}) == [2, 3] and hit({"$or": [{"year": 1}, {"$and": [{"company": "b"}, {"year": {"$in": [2, 5]}}]}]}) == [1, 2]
    for bad in ({}, {"other": 1}, {"year": {"$like": 1}}, {"year": {"$in": []}}, {"$and": [{"$or": [{"$and": [{"$or": [{"$and": [{"year": 1}]}]}]}]}]}):
        with pytest.raises(ValueError):
            vectors.where(bad, keys)
    with pytest.raises(ValueError):
        state.registry_page(df, F.lit(True), 0)
    good, bad = quality.split(df.withColumn("reasons", quality.reasons({"company": F.col("company") == "b"})))
    assert [r.year for r in good.collect()] == [1] and sorted(r.year for r in bad.collect()) == [2, 3]


def test_alias_paths_agree(spark):
    texts = ["What was net debt of FRANCE?", "(united kingdom)", "InterFrance's sales", "M&M", "ibm", "", None, "nobody", "the United  Kingdom", "Oil-India, France"]
    q = spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")
    names = ["france", "United Kingdom", "m&m", "IBM", "oil-india", "kingdom of x", "ünited", None]
    aliases = spark.createDataFrame([(n, f"S{i}", i) for i, n in enumerate(names)], "alias_text string, screener_symbol string, ord int")
    found = {r.question_id: r.screener_symbol for r in state.alias_in_text(q, aliases).collect()}
    assert found == {0: "S0", 1: "S1", 2: "S0", 3: "S2", 4: "S3", 5: None, 6: None, 7: None, 8: None, 9: "S0"}
    assert {r.screener_symbol for r in state.alias_in_text(q, aliases.limit(0)).collect()} == {None}


def test_many_aliases_with_one_prefix(spark):
    """100,000 aliases that begin alike: each text meets few of them, and no plan compares all with all."""
    named = spark.range(100_000).select(F.concat(F.lit("The India Company "), F.sha2(F.col("id").cast("string"), 256).substr(1, 9)).alias("alias_text"), F.concat(F.lit("S"), "id").alias("screener_symbol"), F.col("id").alias("ord"))
    q = named.filter("ord % 500 = 0").select(F.col("ord").alias("question_id"), F.concat(F.lit("what of "), F.upper("alias_text"), F.lit(" and the india company?")).alias("text"))
    found = state.alias_in_text(q, named)
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    rows = found.collect()
    assert len(rows) == 200 and all(r.screener_symbol == f"S{r.question_id}" for r in rows)
    held = state.anchored(named).groupBy("_gram").count().agg(F.max("count")).first()[0]
    assert held < 400  # no run is the anchor of many


def test_answer_audit(spark):
    df = spark.createDataFrame([("Sales were 1,234 in 2024.", 1, ["1234"], []), ("The ROE beats its peers", 0, ["9"], []), (" ", 0, [], [])], "answer string, n_sources int, values array<string>, metrics_asked array<string>")
    a, b, c = quality.audit_answers(df).collect()
    assert all((a.not_blank, a.no_injection, a.sourced, a.states_value, a.no_unasked_metric, a.labels_ratios, a.no_peers))
    assert not any((b.sourced, b.states_value, b.no_unasked_metric, b.labels_ratios, b.no_peers)) and not c.not_blank


def test_short_rows_and_headings(spark):
    periods_ = [f"Mar {y}" for y in range(2014, 2025)]
    cells = lambda xs: "".join(f"<td>{x}</td>" for x in xs)
    head = "<tr><th></th>" + "".join(f"<th>{p}</th>" for p in periods_) + "</tr>"
    table = lambda rows: f"<table><thead>{head}</thead><tbody>{''.join(rows)}</tbody></table>"
    html = "<h1>Acme</h1><h2>PROFIT &amp; LOSS in short</h2>" + table([f"<tr><td>Sales</td>{cells(range(1, 11))}</tr>", f"<tr><td>Tax</td>{cells([7, 8])}</tr>"])
    rows = statement_pages.tidy(statement_pages.statement_cells(spark.createDataFrame([(1, "A", html)], "page_id long, symbol string, html string"))).collect()
    got = {(r.line_item, r.period_label): (r.value, r.row_misaligned) for r in rows}
    # One value less than periods: the last five values stand under the last five periods. Fewer than five: from the first kept one on, then null.
    assert [got["Sales", p] for p in periods_[-5:]] == [(v, True) for v in (6, 7, 8, 9, 10)]
    assert [got["Tax", p][0] for p in periods_[-5:]] == [7, 8, None, None, None] and len(got) == 10


def test_new_companies_are_numbered_in_order(spark):
    table = spark.createDataFrame([(7, "B", "x")], "company_id long, screener_symbol string, company_name string")
    names = [f"COMPANY{i:03}" for i in range(40)] + ["A", "Z", "Ä", "COMPAN"]
    got = statements.upsert_companies(table, spark.createDataFrame([(n, n.lower()) for n in names] + [("B", None)], "screener_symbol string, company_name string")).collect()
    fresh = sorted((r.company_id, r.screener_symbol) for r in got if r.company_id > 7)
    assert fresh == list(zip(range(8, 8 + len(names)), sorted(names, key=lambda n: n.encode()), strict=True)) and [r.company_name for r in got if r.company_id == 7] == ["x"]


def test_reads_by_requests(spark, stmts):
    asked = [(1, 1, None, [], None), (2, 1, "profit_loss", ["Sales"], ["Mar 2024", "Mar 1900"]), (3, 99, None, [], []), (4, 1, "cash_flow", [], [])]
    df = spark.createDataFrame(asked, "request_id int, company_id long, statement string, line_items array<string>, periods array<string>")
    got = statements.read_statements(df, stmts).groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in got} == {1: stmts.filter("company_id = 1").count(), 2: 1}
    with pytest.raises(ValueError):
        statements.read_only_sql({"t": stmts}, " drop table t")
    assert statements.read_only_sql({"t": stmts}, " SELECT count(*) AS n FROM t WHERE line_item = ?", ["Sales"]).first().n == stmts.filter("line_item = 'Sales'").count()


def test_logs_and_registry_grow(spark, tmp_path):
    row = ("AB_2024_ANNUAL_REPORT.pdf", "AB", 2024, "ANNUAL_REPORT", "SUCCESS", None, "/x", "2024-01-02", "10:00:00")
    df = spark.createDataFrame([row, (*row[:4], "DONE", *row[5:])], "filename string, scrip string, year int, file_type string, status string, reason string, destination_path string, date string, time string")
    for n in (1, 2):
        bad = quality.append_registry(df, str(tmp_path / "registry"))
        assert spark.read.parquet(str(tmp_path / "registry")).count() == n and [r.reasons for r in bad.collect()] == [["status"]]
    hits = spark.createDataFrame([(1, 1, 5, 50, 0.25, "p" * 300, None)], "query_id long, rank int, parent_id long, id long, distance double, parent_text string, child_text string")
    state.log_events(state.retrieval_events(hits), str(tmp_path / "log"))
    state.log_events(state.retrieval_events(hits), str(tmp_path / "log"))
    logged = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(logged) == 2 and '"child_id":50' in logged[0].metadata_json and "p" * 240 + '"' in logged[0].metadata_json


def test_counts_come_back_with_null_keys(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None), (None, "a"), (None, "a"), (3, "b")], "k int, t string")
    assert sorted((r.k or 0, r.t or "", r.n) for r in quality.with_counts(df, ["k", "t"], "n").collect()) == [(0, "a", 2), (0, "a", 2), (1, "", 2), (1, "", 2), (2, "", 1), (3, "b", 1)]
    assert [one.m for one in spark.createDataFrame([(None,), ("{}",), ('{"a": 1, "b": null, "c": "{x}"}',), ('{"a": [1]}',), ('{"a": {"b": 1}}',), ("[1]",), ("no",), ('{"": 1}',)], "t string").select(quality.is_scalar_map(F.col("t")).alias("m")).collect()] == [True, True, True, False, False, False, False, False]


def test_context_hits_stay_in_their_report(spark):
    chunks = [(i, c, y, [float(i % 5), 1.0]) for i, (c, y) in enumerate([("A", 1)] * 6 + [("A", 2)] * 3 + [("B", 1)] * 2)] + [(90, "A", 1, None), (91, "A", 1, [0.0, 0.0])]
    v = spark.createDataFrame(chunks, "id long, company string, year int, vec array<double>")
    q = spark.createDataFrame([(1, "A", 1, [4.0, 1.0]), (2, "B", 1, [1.0, 1.0]), (3, "C", 1, [1.0, 1.0])], "request_id long, company string, year int, vec array<double>")
    got = {}
    for r in vectors.context_hits(q, v).collect():
        got.setdefault(r.request_id, {})[r.rank] = r.id
    assert got[1][1] == 4 and set(got[1].values()) == {4, 3, 2} and set(got[2].values()) == {9, 10} and 3 not in got
