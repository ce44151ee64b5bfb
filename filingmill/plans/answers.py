"""Answering structured questions in one plan: periods, cache key, series, text, suggestions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns
from ..functions.scalars import expiry, metric_key, year_in_text, year_of_period
from ..operators import periods, series, state, vectors
from ..sources import stored

VERSION = "v1"
#: So many characters of passages stand in an answer.
EVIDENCE_CHARS = 12_000
EVIDENCE_HEAD = "\n\nFrom the annual reports:\n"
# How an answer without a language model begins.
OPENING = "I couldn't generate a full narrative answer, but here is the verified data:\n"


def keyed(questions: DataFrame, stmts: DataFrame) -> DataFrame:
    """Adds periods, can_proceed, stop_message, metrics (keys of the phrases that name one) and cache_key; a question that stops
    has no key, as its message is not to be cached."""
    stored_periods = stored.kept(periods.available_periods(_of_asked(questions, stmts)), "periods")
    return _keyed(periods.resolved_in_books(questions.join(stored_periods.withColumnRenamed("periods", "_p"), "company_id", "left")).drop("_p"))


def _of_asked(questions: DataFrame, stmts: DataFrame) -> DataFrame:
    """The statements of companies that are asked about."""
    return stmts.join(stored.kept(questions.select("company_id").distinct(), "companies"), "company_id", "left_semi")


def _keyed(resolved: DataFrame) -> DataFrame:
    named = F.transform(F.coalesce("derived", F.array().cast("array<string>")), metric_key)
    resolved = resolved.withColumn("metrics", F.array_distinct(F.array_compact(named)))
    key = state.structured_key(
        F.col("company_id").cast("string"), F.transform("line_items", F.lower), F.col("metrics"), F.col("periods"),
        F.concat_ws("/", F.coalesce("needs_context", F.lit(False)).cast("string"), F.coalesce("intent", F.lit(""))), F.lit(VERSION),
    )
    return resolved.withColumn("cache_key", F.when(F.col("can_proceed"), key))


def _in_order(c: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"])


def _series_lines(asked: DataFrame, stmts: DataFrame) -> DataFrame:
    """asked: content, company_id, homes (array<struct<i, named, statement>>: the stored items asked for), periods. A line per item: content, i, t, with its
    change, growth and direction over the asked periods beside it."""
    one = asked.select("content", "company_id", F.inline("homes"), "periods")
    one = one.select("content", "company_id", "i", "named", "statement", F.posexplode("periods").alias("p", "period_label"))
    values = stmts.select("company_id", "statement", F.col("line_item").alias("named"), "period_label", "fiscal_year_end", "value", "unit")
    point = one.join(values, ["company_id", "statement", "named", "period_label"], "left")
    whole = series.enriched(point, keys=("content", "i", "named"), order="p")
    words = F.concat(
        "period_label", F.lit(": "), F.when(F.col("value").isNotNull(), F.format_string("%.2f", F.bround("value", 2))).otherwise("not disclosed"), F.coalesce(F.concat(F.lit(" "), "unit"), F.lit(""))
    )
    line = whole.groupBy("content", "i", "named").agg(
        F.array_join(_in_order(F.struct("p", words.alias("t"))), ", ").alias("t"), F.first("change_pct").alias("change_pct"), F.first("cagr_pct").alias("cagr_pct"), F.first("direction").alias("direction")
    )
    return line.select("content", "i", F.concat("named", F.lit(": "), "t").alias("t"), F.struct("named", "change_pct", "cagr_pct", "direction").alias("about"))


def _metric_lines(asked: DataFrame, stmts: DataFrame) -> DataFrame:
    """asked: content, company_id, metrics, periods. A line per ratio asked: content, i, t."""
    one = asked.select("content", "company_id", F.posexplode("metrics").alias("i", "metric"), "periods")
    one = one.select("content", "company_id", "i", "metric", F.posexplode("periods").alias("p", "period_label")).withColumn("fy", year_of_period(F.col("period_label")))
    found = one.join(series.derived_metrics(stmts), ["company_id", "fy", "metric"], "left")
    words = F.concat("period_label", F.lit(": "), F.coalesce(F.concat(series.two_decimals(F.col("value") * 100), F.lit("%")), F.lit("not available")))
    label = F.element_at(F.create_map(*(F.lit(x) for pair in series.LABELS.items() for x in pair)), F.col("metric"))
    line = found.groupBy("content", "i", "metric").agg(F.array_join(_in_order(F.struct("p", words.alias("t"))), ", ").alias("t"))
    return line.select("content", "i", F.concat(label, F.lit(": "), "t").alias("t"))


def evidence(passages: DataFrame, most_chars: int = EVIDENCE_CHARS) -> DataFrame:
    """passages: cache_key, i (place of the line item), p (place of the period), line_item, period, rank, id, text. Returns cache_key, evidence, n_snippets: of each answer
    the passages in the order of items, periods and ranks, each once (where it first comes), numbered, as long as they stay within most_chars; the first one that
    does not fit ends the text. Blank passages are left out."""
    order = ["i", "p", "rank", "id"]
    once = W.partitionBy("cache_key", "id").orderBy(*order)
    # Both windows find their rows in the partitions of this one shuffle.
    first = passages.filter("trim(coalesce(text, '')) <> ''").repartition("cache_key").withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    words = F.concat(F.lit("["), "line_item", F.lit(" / "), "period", F.lit("]: "), F.trim("text"))
    first = first.select("cache_key", *order, words.alias("t"))
    along = W.partitionBy("cache_key").orderBy(*order)
    sized = first.withColumn("_sum", F.sum(F.length("t")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_n", F.row_number().over(along))
    fits = sized.filter(F.col("_sum") <= most_chars)
    listed = F.array_sort(F.collect_list(F.struct("_n", F.concat(F.col("_n").cast("string"), F.lit(". "), "t").alias("t"))))
    return fits.groupBy("cache_key").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("evidence"), F.count("*").alias("n_snippets"))


def report_passages(chunks: DataFrame, encode: Callable[[DataFrame], DataFrame] = vectors.embedded, k: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A search for answer_questions. chunks: id, company, year, vec, text. encode adds embedding to requests with text (as it was added to the chunks'). Of each request the
    k nearest chunks of the company's report of that year are fetched by their ids; only ids and distances go through the search."""

    def search(requests: DataFrame) -> DataFrame:
        asked = requests.withColumn("request_id", F.xxhash64("cache_key", "i", "p"))
        found = encode(asked.withColumn("text", F.concat_ws(" ", "question", F.concat(F.lit("("), "line_item", F.lit(", "), "period", F.lit(")")))))
        hits = vectors.context_hits(found.select("request_id", F.col("company_id").alias("company"), "year", F.col("embedding").alias("vec")), chunks.select("id", "company", "year", "vec"), k)
        named = asked.select("request_id", "cache_key", "i", "p", "line_item", "period").join(hits, "request_id")
        return named.join(chunks.select("id", "text"), "id")

    return search


def answer_questions(questions: DataFrame, stmts: DataFrame, cache: DataFrame | None = None, now: Column | None = None, search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """questions: question_id, company_id, raw_years, single_year_only, n, line_items, derived (phrases for ratios), needs_context,
    intent, and question (its words, if there is a search). cache: cache_key, answer_text, expires_at. search: from requests (cache_key, company_id, question, i, line_item, p,
    period, year) to passages (cache_key, i, p, line_item, period, rank, id, text), see report_passages. Returns question_id,
    cache_key, answer, suggestions, stop_message, stopped, from_cache, periods, series (array of named, change_pct, cagr_pct,
    direction), n_snippets.

    A question stops where its company is unknown or has no data, or where none of what it asks for is stored; the message is then
    its answer. What the cache holds is answered from there; equal questions are answered once. Answers that need
    context are followed by the passages found for their line items and last periods (`evidence`). What is stored of a company, and the resolved questions, are
    stored once for all branches. Questions of other keys that ask for the same figures share their text (`content`), and those that search for the same
    passages a search (`wanted`), so rows of questions are not shuffled to have them made."""
    stmts = _of_asked(questions, stmts)
    books = stored.kept(periods.company_books(stmts), "books")
    resolved = _keyed(periods.resolved_in_books(periods.with_books(questions, books)))
    asked_items = F.transform("line_items", lambda x, i: F.transform(F.filter("_items", lambda y: F.lower(y["line_item"]) == F.lower(x)), lambda y: F.struct(i.alias("i"), y["line_item"].alias("named"), y["home"].alias("statement"))))
    resolved = resolved.withColumn("homes", F.coalesce(F.flatten(asked_items), F.array().cast("array<struct<i:int,named:string,statement:string>>")))
    resolved = periods.with_hints(resolved)
    if "question" not in resolved.columns:
        resolved = resolved.withColumn("question", F.lit(None).cast("string"))
    searches = F.coalesce("needs_context", F.lit(False)) if search else F.lit(False)
    hashed = lambda *columns: F.md5(F.to_json(F.struct(*columns)))
    figures, request = ("company_id", "homes", "metrics", "periods"), ("question", "company_id", "line_items", "periods")
    open_ = F.col("cache_key").isNotNull()
    resolved = resolved.select(
        "question_id", *request, "homes", "metrics", "can_proceed", "stop_message", "hints", "cache_key",
        F.when(open_, hashed(*figures)).alias("content"), F.when(open_ & searches, hashed(*request)).alias("wanted"),
    )
    if cache is None:
        resolved = resolved.withColumn("answer_text", F.lit(None).cast("string"))
    else:
        resolved = state.cache_lookup(resolved, cache, now)
    resolved = stored.kept(resolved, "resolved")
    fresh = resolved.filter("cache_key IS NOT NULL AND answer_text IS NULL")
    asked = stored.kept(fresh.select("content", *figures).distinct(), "asked")
    lines, ratios = _series_lines(asked, stmts), _metric_lines(asked, stmts)
    about = F.struct(F.lit("").alias("named"), F.lit(0.0).alias("change_pct"), F.lit(0.0).alias("cagr_pct"), F.lit("").alias("direction"))
    none = F.when(F.lit(False), about)
    both = lines.select("content", F.lit(0).alias("k"), "i", "t", "about").union(ratios.select("content", F.lit(1).alias("k"), "i", "t", none))
    of_series = F.when(F.col("k") == 0, F.struct("i", "about"))
    body = both.groupBy("content").agg(
        F.concat(F.lit(OPENING), F.array_join(_in_order(F.struct("k", "i", "t")), "\n")).alias("answer"),
        F.transform(F.array_sort(F.collect_list(of_series)), lambda x: x["about"]).alias("series"),
    )
    resolved = _as_first(resolved, fresh)
    if search is None:
        found = resolved.withColumn("n_snippets", F.lit(0).cast("long")).withColumn("evidence", F.lit(None).cast("string"))
    else:
        wanted = fresh.filter("wanted IS NOT NULL").select(F.col("wanted").alias("cache_key"), *request).distinct()
        wanted = context_requests(wanted.withColumn("question_id", F.col("cache_key")), ("cache_key", "question")).filter("searched").drop("question_id")
        passages = evidence(search(wanted)).withColumnRenamed("cache_key", "_wanted")
        # Rows that search for nothing are dealt by their number.
        found = resolved.withColumn("_wanted", F.coalesce("wanted", F.col("question_id").cast("string"))).join(passages, "_wanted", "left")
    out = found.join(stored.kept(body, "bodies"), "content", "left").withColumn("answer", F.concat("answer", F.coalesce(F.concat(F.lit(EVIDENCE_HEAD), "evidence"), F.lit(""))))
    missing = F.array_join(F.transform("line_items", lambda x: F.concat(F.lit("Line item '"), x, F.lit("' not found for '"), F.col("company_id").cast("string"), F.lit("' in any statement table. Call list_available_line_items to see valid names."))), "; ")
    nothing = F.concat(F.lit("I couldn't retrieve the requested data for "), F.col("company_id").cast("string"), F.lit(": "), F.when(F.size("line_items") > 0, missing).otherwise("no data found"))
    hit = F.col("answer_text").isNotNull()
    empty = F.col("can_proceed") & ~hit & F.col("answer").isNull()
    stop = F.coalesce("stop_message", F.when(empty, nothing))
    snippets = F.when(F.col("answer").isNotNull(), F.coalesce("n_snippets", F.lit(0))).otherwise(0).cast("long")
    hints = F.when(F.col("can_proceed"), periods.suggestions(F.col("hints"), snippets > 0))
    return out.select(
        "question_id", F.when(stop.isNull(), F.col("cache_key")).alias("cache_key"), F.coalesce("answer_text", "answer", stop).alias("answer"),
        F.when(stop.isNull(), hints).otherwise(F.array().cast("array<string>")).alias("suggestions"), stop.alias("stop_message"),
        stop.isNotNull().alias("stopped"), hit.alias("from_cache"), "periods", F.when(F.size("series") > 0, F.col("series")).alias("series"), snippets.alias("n_snippets"),
    )


def _as_first(resolved: DataFrame, fresh: DataFrame) -> DataFrame:
    """resolved, with the content of the first question of the same key. Keys whose questions differ in it (in the order of their items, say) are found by hashes alone."""
    own = F.xxhash64("content", "wanted")
    odd = stored.kept(fresh.groupBy("cache_key").agg(F.min(own).alias("a"), F.max(own).alias("b")).filter("a <> b").select("cache_key"), "odd")
    first = fresh.join(odd, "cache_key", "left_semi").groupBy("cache_key").agg(F.min_by(F.struct("content", "wanted"), "question_id").alias("_first"))
    taken = lambda c: F.when(F.col("_first").isNull(), F.col(c)).otherwise(F.col(f"_first.{c}"))
    joined = resolved.join(stored.kept(first, "first"), "cache_key", "left")
    return joined.withColumns({c: taken(c) for c in ("content", "wanted")}).drop("_first")


def cache_after(cache: DataFrame, answers: DataFrame, now: Column, ttl_seconds: int = 30 * 86400) -> DataFrame:
    """cache: cache_key, answer_text, created_at, last_accessed_at, expires_at, hit_count. The cache after answering: answers that did
    not come from it are added or replace expired ones, and hits are counted."""
    ready = answers.filter("NOT stopped").select("cache_key", "answer", "from_cache")
    fresh = ready.filter("NOT from_cache").groupBy("cache_key").agg(F.first("answer").alias("answer_text")).select(
        "cache_key", "answer_text", now.alias("created_at"), now.alias("last_accessed_at"), expiry(now, F.lit(ttl_seconds)).alias("expires_at"), F.lit(0).cast("long").alias("hit_count")
    )
    out = state.merged(cache, fresh, ["cache_key"], replaced=["answer_text", "expires_at"])
    return state.count_hits(out, ready.filter("from_cache").select("cache_key", now.alias("at")))


def store_answers(path: str, answers: DataFrame, now: Column, ttl_seconds: int = 30 * 86400) -> list[int]:
    """cache_after into a stored cache: only the buckets of the answers' keys are read and replaced."""
    keys = answers.filter("NOT stopped").select("cache_key").distinct()
    return stored.upsert_into(path, keys, lambda cache, _: cache_after(cache, answers, now, ttl_seconds))


def classify(questions: DataFrame, names: DataFrame) -> DataFrame:
    """questions: question_id, text. names: alias_text, screener_symbol, ord. Adds symbol, year, period, intent, reason."""
    found = state.alias_in_text(questions, names)
    low, year = F.lower("text"), year_in_text(F.col("text"))
    financial = F.coalesce(low.rlike("|".join(patterns.QUESTION_WORDS)), F.lit(False))
    reason = F.when(F.col("screener_symbol").isNull(), periods.UNKNOWN_COMPANY).when(financial & year.isNull(), periods.UNKNOWN_YEAR)
    return found.select(
        "question_id", F.col("screener_symbol").alias("symbol"), year.alias("year"), F.concat(F.lit("Mar "), year).alias("period"),
        F.when(financial, "financial").otherwise("general").alias("intent"), reason.alias("reason"),
    )


def context_requests(resolved: DataFrame, also: Sequence[str] = (), last: int = 3) -> DataFrame:
    """resolved: question_id, company_id, line_items, periods. A search request per line item and period, with their places i and p and the period's year;
    searched is false for periods before the last ones, which are kept but not searched. Questions without line items ask
    for nothing. also: columns that go along. operators.vectors.context_hits answers the requests."""
    one = resolved.select("question_id", "company_id", *also, F.posexplode("line_items").alias("i", "line_item"), "periods")
    one = one.select("question_id", "company_id", *also, "i", "line_item", F.posexplode("periods").alias("p", "period"), F.size("periods").alias("_n"))
    return one.select("question_id", "company_id", *also, "i", "line_item", "p", "period", year_of_period(F.col("period")).alias("year"), (F.col("p") >= F.col("_n") - last).alias("searched"))


def prompt_context(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, state struct<symbol, line_items, periods>. conv_id, context: the last state as text."""
    last = turns.withColumn("_n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))))
    carried = periods.carried_state(turns).join(last.filter("_n = 1").select("conv_id", "turn"), ["conv_id", "turn"])
    part = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    s = F.col("carried")
    text = F.concat_ws("\n", part("Company", s["symbol"]), part("Line items", F.array_join(s["line_items"], ", ")), part("Periods", F.array_join(s["periods"], ", ")))
    return carried.select("conv_id", text.alias("context"))


def series_texts(stmts: DataFrame) -> DataFrame:
    return series.series_text(series.year_over_year(stmts))
