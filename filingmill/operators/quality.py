"""Checks over tables: each row gets an array of reasons (in checking order, empty if it passes), and tables are split by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import DOC_TYPES, is_clock_time, parsed_day

MOST_TEXT, MOST_RECORDS, MOST_PAGES = 20_000, 50_000, 500
CHUNK_RANGE = (10, 50_000)
STATUSES = ("SUCCESS", "FAILED")


def reasons(checks: dict[str, Column]) -> Column:
    """checks: reason to condition that holds where the row fails; null counts as failing."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items())))


def split(df: DataFrame, reason: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine)"""
    return df.filter(F.size(reason) == 0).drop(reason), df.filter(F.size(reason) > 0)


def with_counts(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Adds how many rows have the same key (null equals null). Counts are summed up before they are joined back, so that rows
    of a key which many share are not gathered."""
    times = df.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key))).agg(F.count("*").alias(name))
    met = F.lit(True)
    for i, c in enumerate(key):
        met = met & df[c].eqNullSafe(F.col(f"_k{i}"))
    return df.join(times, met).drop(*(f"_k{i}" for i in range(len(key))))


def is_scalar_map(metadata: Column) -> Column:
    """Whether a JSON text is a mapping of names to strings, numbers, booleans or null; a null text counts as an empty one."""
    shape = F.schema_of_variant(F.try_parse_json(metadata))
    names = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))
    flat = shape.startswith("OBJECT<") & ~shape.rlike(": (?:ARRAY|OBJECT)<") & ~F.array_contains(names, "")
    return metadata.isNull() | F.coalesce(flat, F.lit(False))


def check_records(records: DataFrame) -> DataFrame:
    """records: collection, id, text, metadata (JSON text). Duplicate ids within a collection, blank ids, texts of 1 to
    MOST_TEXT characters, metadata that is not all scalars, and more than MOST_RECORDS records at once."""
    n = F.length("text")
    counted = with_counts(with_counts(records, ["collection", "id"], "_same"), ["collection"], "_all")
    return counted.withColumn(
        "reasons",
        reasons({
            "id_blank": F.trim("id") == "",
            "text_length": ~n.between(1, MOST_TEXT) | (F.trim("text") == ""),
            "metadata": ~is_scalar_map(F.col("metadata")),
            "id_duplicate": F.col("_same") > 1,
            "too_many_records": F.col("_all") > MOST_RECORDS,
        }),
    ).drop("_same", "_all")


def check_payload(records: DataFrame) -> DataFrame:
    """records: file, kind (parent, child or flat), id, text, as from read_bundles. Each side of a bundle for itself."""
    counted = with_counts(records, ["file", "kind", "id"], "_same")
    return counted.withColumn(
        "reasons",
        reasons({"id_missing": F.col("id") == "", "text_missing": F.trim("text") == "", "id_duplicate": F.col("_same") > 1}),
    ).drop("_same")


def _kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def check_cleaned_files(files: DataFrame) -> DataFrame:
    """files: file, content (JSON). Reasons against files of cleaned pages: a list, not empty, of mappings with all fields, a
    whole page number and text."""
    fields = ("page_num", "original_text", "cleaned_text", "word_count", "is_short", "has_table")
    v = F.try_parse_json("content")
    pages = F.try_variant_get(v, "$", "array<variant>")
    part = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    lacks = lambda x: F.exists(F.array(*map(F.lit, fields)), lambda f: ~F.array_contains(F.json_object_keys(F.to_json(x)), f))
    is_map = lambda x: _kind_of(x).startswith("OBJECT")
    any_of = lambda bad: F.coalesce(F.exists(pages, bad), F.lit(False))
    return files.withColumn(
        "reasons",
        reasons({
            "not_json": v.isNull(),
            "not_a_list": F.coalesce(~_kind_of(v).startswith("ARRAY"), F.lit(False)),
            "empty": F.coalesce(F.size(pages) == 0, F.lit(False)),
            "record_not_a_mapping": any_of(lambda x: ~is_map(x)),
            "field_missing": any_of(lambda x: F.when(is_map(x), lacks(x)).otherwise(False)),
            "page_num": any_of(lambda x: F.coalesce(_kind_of(part(x, "page_num")) != "BIGINT", F.lit(False))),
            "cleaned_text": any_of(lambda x: F.coalesce(_kind_of(part(x, "cleaned_text")) != "STRING", F.lit(False))),
        }),
    )


def check_embedding_files(files: DataFrame) -> DataFrame:
    """files: file, content (JSON). Reasons against files of embedding records: a mapping with two lists, of mappings with
    an id, a text and metadata."""
    v = F.try_parse_json("content")
    whole = F.coalesce(_kind_of(v).startswith("OBJECT"), F.lit(False))
    checks = {"not_json": v.isNull(), "not_a_mapping": v.isNotNull() & ~whole}
    part = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    blank = lambda x, name: F.coalesce((_kind_of(part(x, name)) != "STRING") | (F.trim(F.try_variant_get(x, f"$.{name}", "string")) == ""), F.lit(True))
    for side in ("parents", "children"):
        held = F.try_variant_get(v, f"$.{side}", "variant")
        is_list = F.coalesce(_kind_of(held).startswith("ARRAY"), F.lit(False))
        rows = F.when(is_list, F.try_variant_get(v, f"$.{side}", "array<variant>"))
        any_of = lambda bad, rows=rows: F.coalesce(F.exists(rows, bad), F.lit(False))
        checks |= {
            f"{side}_missing": whole & held.isNull(),
            f"{side}_not_a_list": whole & held.isNotNull() & ~is_list,
            f"{side}_id": any_of(lambda x: blank(x, "id")),
            f"{side}_text": any_of(lambda x: blank(x, "text")),
            f"{side}_metadata": any_of(lambda x: ~F.coalesce(_kind_of(part(x, "metadata")).startswith("OBJECT"), F.lit(False))),
        }
    return files.withColumn("reasons", reasons(checks))


def check_pages(pages: DataFrame) -> DataFrame:
    """pages: document, page_num, text. Duplicate, missing or unordered page numbers (pos is the order in the file), and a
    warning, which is no reason, where a text tries to give instructions."""
    from ..functions.text import injection_flag

    before = F.lag("page_num").over(W.partitionBy("document").orderBy("pos"))
    return with_counts(pages, ["document", "page_num"], "_same").withColumn(
        "reasons",
        reasons({
            "page_number": F.col("page_num") < 1,
            "page_duplicate": F.col("_same") > 1,
            "page_order": F.coalesce(before >= F.col("page_num"), F.lit(False)),
            "text_missing": F.col("text").isNull(),
        }),
    ).withColumn("injection_warning", injection_flag(F.col("text"))).drop("_same")


def document_totals(pages: DataFrame) -> DataFrame:
    """document, n_pages, n_chars, too_many."""
    out = pages.groupBy("document").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))
    return out.withColumn("too_many", F.col("n_pages") > MOST_PAGES)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """document, n_chunks, in_range."""
    return chunks.groupBy("document").agg(F.count("*").alias("n_chunks")).withColumn("in_range", F.col("n_chunks").between(*CHUNK_RANGE))


def check_registry(rows: DataFrame) -> DataFrame:
    """The nine fields of a file registry row, in order; the first reason is the one to report."""
    name = F.regexp_extract("filename", r"(?i)^([A-Za-z0-9]+)_([0-9]{4})_(ANNUAL_REPORT|QUARTERLY_REPORT|INVESTOR_PRESENTATION)\.(?:pdf|json)$", 0)
    part = lambda i: F.regexp_extract("filename", r"(?i)^([A-Za-z0-9]+)_([0-9]{4})_", i)
    return rows.withColumn(
        "reasons",
        reasons({
            "filename": name == "",
            "scrip": ~F.col("scrip").rlike(r"^[A-Za-z0-9]{1,20}$"),
            "year": ~F.col("year").between(1995, 2100),
            "file_type": ~F.upper("file_type").isin(*DOC_TYPES),
            "status": ~F.col("status").isin(*STATUSES),
            "reason": F.coalesce(F.length("reason"), F.lit(0)) > 1000,
            "destination_path": ~F.length("destination_path").between(1, 1024),
            "date": parsed_day(F.col("date")).isNull(),
            "time": ~is_clock_time(F.col("time")),
            "name_scrip": F.upper(part(1)) != F.upper("scrip"),
            "name_year": part(2).try_cast("int") != F.col("year"),
        }),
    )


def append_registry(rows: DataFrame, path: str) -> DataFrame:
    """Appends the rows that pass to the registry at path; returns the others, with their reasons."""
    good, bad = split(check_registry(rows))
    good.write.mode("append").parquet(path)
    return bad


def check_requests(requests: DataFrame, most: int = 10) -> DataFrame:
    """requests: collection, texts, top_k, ids."""
    texts = F.col("texts")
    return requests.withColumn(
        "reasons",
        reasons({
            "collection": ~F.col("collection").rlike(r"^[A-Za-z0-9_\-]{1,64}$"),
            "text_count": ~F.size(texts).between(1, 5),
            "text_length": F.exists(texts, lambda t: t.isNull() | (F.length(F.trim(t)) == 0) | (F.length(t) > 2000)),
            "top_k": ~F.col("top_k").between(1, most),
            "ids": F.coalesce(F.exists("ids", lambda i: i.isNull() | (F.trim(i) == "")), F.lit(False)),
        }),
    )


def file_identity(path: Column) -> Column:
    """struct<scrip, year, doc_type> out of `<scrip>_<year>_<type>.<ext>`, nulls where the name does not fit."""
    pattern = r"([A-Za-z0-9]+)_([0-9]{4})_([A-Za-z_]+)\.[A-Za-z0-9]+$"
    part = lambda i: F.nullif(F.upper(F.regexp_extract(path, pattern, i)), F.lit(""))
    return F.struct(part(1).alias("scrip"), part(2).cast("int").alias("year"), part(3).alias("doc_type"))


def path_problems(path: Column) -> Column:
    """Reasons why `.../<scrip>/<year>/<file>` and the file's own name disagree."""
    parts, own = F.split(path, "/"), file_identity(path)
    return reasons({
        "name": own["scrip"].isNull(),
        "folder_scrip": F.coalesce(F.upper(F.try_element_at(parts, F.lit(-3))) != own["scrip"], F.lit(True)),
        "folder_year": F.coalesce(F.regexp_extract(F.try_element_at(parts, F.lit(-2)), "([0-9]{4})", 1).try_cast("int") != own["year"], F.lit(True)),
    })


def audit_answers(answers: DataFrame) -> DataFrame:
    """answers: answer, n_sources, values (numbers as text), metrics_asked. Boolean columns: not blank, no injection, has
    sources or says it could not, states a stored value, names no metric that was not asked, labels ratios, no peers."""
    from ..functions.text import injection_flag

    low = F.lower("answer")
    metrics = {"roe": r"\broe\b|return on equity", "net_profit_margin": "net profit margin", "debt_to_equity": r"debt[- ]to[- ]equity"}
    unasked = F.lit(False)
    for key, pattern in metrics.items():
        unasked = unasked | (low.rlike(pattern) & ~F.array_contains("metrics_asked", key))
    return answers.withColumns({
        "not_blank": F.coalesce(F.trim("answer") != "", F.lit(False)),
        "no_injection": ~injection_flag(F.col("answer")),
        "sourced": (F.col("n_sources") > 0) | low.rlike("could ?n[o']t|not (available|disclosed|found)"),
        "states_value": F.exists("values", lambda v: F.contains(F.replace(F.col("answer"), F.lit(","), F.lit("")), v)),
        "no_unasked_metric": ~unasked,
        "labels_ratios": ~low.rlike("roe|margin|debt-to-equity") | low.rlike(r"computed|approximat"),
        "no_peers": ~low.rlike(r"\bpeers?\b|\bindustry average\b|\bcompetitors?\b"),
    })
