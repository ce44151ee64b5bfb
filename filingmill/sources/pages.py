"""Reading and writing page arrays, cleaned pages and embedding bundles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType

from ..functions import text
from ..operators.quality import check_payload, file_identity, split
from ..operators.statements import upsert
from ..operators.vectors import embedded

PAGE = StructType().add("page_num", IntegerType()).add("text", StringType()).add("_corrupt", StringType())
RECORD = StructType().add("id", StringType()).add("text", StringType()).add("metadata", MapType(StringType(), StringType()))
BUNDLE = StructType().add("parents", ArrayType(RECORD)).add("children", ArrayType(RECORD))


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages with file, company, year, doc_type; rows that could not be read) from files of JSON page arrays."""
    raw = spark.read.schema(PAGE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    own = file_identity(F.col("file"))
    pages = raw.withColumn("_own", own).select("file", F.col("_own.scrip").alias("company"), F.col("_own.year").alias("year"), F.col("_own.doc_type").alias("doc_type"), "page_num", "text", "_corrupt")
    return pages.filter("_corrupt IS NULL").drop("_corrupt"), pages.filter("_corrupt IS NOT NULL").select("file", "_corrupt")


DOCUMENT = ("company", "year", "doc_type")


def page_arrays(pages: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """pages: the key, page_num, text. The key and content, a document's pages as a JSON array in page order. (A document has 500 pages at most, see
    quality.document_totals.)"""
    listed = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    return pages.groupBy(*key).agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("content"))


def write_pages(arrays: DataFrame, path: str, key: Sequence[str] = DOCUMENT) -> None:
    """arrays: the key and content (see page_arrays). A line of JSON a document, in folders by all of the key but its last column, which goes along."""
    *folders, last = key
    arrays.select(*folders, F.struct(last, "content").alias("d")).select(*folders, F.to_json("d").alias("value")).write.mode("errorifexists").partitionBy(*folders).text(path)


def read_page_arrays(spark: SparkSession, path: str, key: Sequence[str] = DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """(pages: the key, page_num, text; quarantine: the key, position, raw, reason) of what write_pages or another writer of such lines left. One pass reads a line: a document that
    is no JSON or no array goes to the quarantine whole, and of an array the entries that are no mapping, have no whole number or no text; the other entries are good."""
    *_, last = key
    lines = spark.read.text(path).select("*", F.from_json("value", f"{last} string, content string").alias("d")).select("*", f"d.{last}", "d.content").drop("d")
    return _split_arrays(lines.withColumn("content", F.coalesce("content", "value")).drop("value"), key)


def _split_arrays(documents: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    v = F.try_parse_json("content")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    is_array = v.isNotNull() & kind(v).startswith("ARRAY")
    entries = F.when(is_array, F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(F.lit(None).cast("variant")))
    whole = F.when(v.isNull(), "not_json").when(~is_array, "not_an_array")
    part = lambda name: F.try_variant_get("_x", f"$.{name}", "variant")
    reason = F.when(~kind(F.col("_x")).startswith("OBJECT"), "not_a_mapping").when(kind(part("page_num")) != "BIGINT", "page_num").when(kind(part("text")) != "STRING", "text")
    out = documents.withColumn("_whole", whole).select(*key, "content", "_whole", F.posexplode(entries).alias("position", "_x"))
    out = out.withColumn("reason", F.coalesce("_whole", reason))
    good = out.filter("reason IS NULL").select(*key, F.try_variant_get("_x", "$.page_num", "int").alias("page_num"), F.try_variant_get("_x", "$.text", "string").alias("text"))
    raw = F.when(F.col("_whole").isNotNull(), F.col("content")).otherwise(F.to_json("_x"))
    return good, out.filter("reason IS NOT NULL").select(*key, F.when(F.col("_whole").isNull(), F.col("position")).alias("position"), raw.alias("raw"), "reason")


def write_cleaned(pages: DataFrame, path: str) -> None:
    pages.write.mode("errorifexists").partitionBy("company", "year").parquet(path)


def read_bundles(files: DataFrame) -> DataFrame:
    """files: file, content (JSON). A row per record, kind parent, child or flat; a mapping with both keys is a bundle, a list is flat."""
    bundle, flat = F.from_json("content", BUNDLE), F.from_json("content", ArrayType(RECORD))
    tagged = lambda records, kind: F.transform(F.coalesce(records, F.array().cast(ArrayType(RECORD))), lambda r: F.struct(F.lit(kind).alias("kind"), r["id"].alias("id"), r["text"].alias("text"), r["metadata"].alias("metadata")))
    is_list = F.trim("content").startswith("[")
    all_of = F.when(is_list, tagged(flat, "flat")).otherwise(F.concat(tagged(bundle["parents"], "parent"), tagged(bundle["children"], "child")))
    return files.select("file", F.inline(all_of))


def bundles(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Both: key, id, text, metadata (map of strings). Returns key, content: a bundle of each key's records as JSON."""
    side = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "text", F.to_json("metadata").alias("m")))).alias(name))
    # Maps can't be sorted, so metadata travels as text and is put back.
    back = lambda name: F.transform(F.coalesce(name, F.array().cast("array<struct<id:string,text:string,m:string>>")), lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text"), F.from_json(r["m"], MapType(StringType(), StringType())).alias("metadata")))
    both = side(parents, "p").join(side(children, "c"), key, "full")
    return both.select(key, F.to_json(F.struct(back(F.col("p")).alias("parents"), back(F.col("c")).alias("children"))).alias("content"))


def write_bundles(bundled: DataFrame, path: str) -> None:
    """A line of JSON per bundle: its key and content."""
    bundled.write.mode("errorifexists").json(path)


def load_records(files: DataFrame, table: DataFrame, encode=None) -> tuple[DataFrame, DataFrame]:
    """files: file, content (JSON bundles or lists), seq (later ones win). table: collection, id, text, metadata, embedding, seq. Returns (the
    table after embedding and upserting all good records, the records that fail with their reasons). Parents, children and
    flat records go to collections of their own."""
    records = read_bundles(files).join(files.select("file", "seq"), "file")
    good, bad = split(check_payload(records))
    fresh = embedded(good.withColumn("collection", F.col("kind")), encode).select("collection", "id", "text", "metadata", "embedding", "seq")
    return upsert(table, fresh, ["collection", "id"], "seq"), bad


def with_steps(pages: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """pages through functions from DataFrame to DataFrame, one after another; without any, the usual cleaning."""
    for step in steps or (cleaned,):
        pages = pages.transform(step)
    return pages


def manifest(spark: SparkSession, path: str, least: int = 1, most: int = 100 * 1024 * 1024) -> DataFrame:
    """path, length, sha256, identity and whether the size is in bounds, of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), file_identity(F.col("path")).alias("identity"), F.col("length").between(least, most).alias("size_ok"))


def cleaned(pages: DataFrame, min_words: int = text.MIN_WORDS) -> DataFrame:
    """pages: text and any other columns. Adds cleaned_text (prose), raw_tables, has_table, table_type, word_count, is_short,
    page_intent. One stage."""
    c = F.col("_clean")
    out = pages.withColumn("_clean", text.clean_page(F.col("text"))).withColumn("has_table", text.has_table(c))
    out = out.withColumn("_parts", text.split_tables(c)).withColumn("table_type", F.when(F.col("has_table"), text.table_type(c)))
    out = out.withColumn("cleaned_text", F.col("_parts.prose")).withColumn("raw_tables", F.col("_parts.tables"))
    out = out.withColumn("word_count", F.size(text.words(c))).withColumn("is_short", F.col("word_count") < min_words)
    return out.withColumn("page_intent", text.sections(F.col("cleaned_text"))).drop("_clean", "_parts")


def run_summary(pages: DataFrame, key: str) -> DataFrame:
    """Pages in all, kept and skipped as short, per document."""
    return pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.count_if(~F.col("is_short")).alias("n_kept"), F.count_if(F.col("is_short")).alias("n_skipped"))


def records(pages: DataFrame, mark: str = "\n\n") -> DataFrame:
    """Cleaned pages (company, year, doc_type, page_num, cleaned_text, page_intent, is_short) as records, a parent and its chunks: kind, id, parent_id, the columns that name the page,
    page_intent, child_count, child_index (null for a parent), text. Short pages have none. One generator makes all rows of a page, so that a page is cleaned once; it takes an
    expression, as of a column Spark would infer a filter that works out the column again below."""
    name = F.concat_ws("_", "company", "year", "doc_type", F.lit("page"), "page_num")
    base = pages.withColumn("_chunks", F.when(~F.col("is_short"), text.chunks(F.col("cleaned_text"), mark=mark)))
    row = lambda kind, i, t: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("child_index"), t.alias("text"))
    rows = F.concat(F.array(row("parent", F.lit(None), F.col("cleaned_text"))), F.transform("_chunks", lambda t, i: row("child", i, t)))
    about = ["company", "year", "doc_type", "page_num", F.array_join("page_intent", ",").alias("page_intent")]
    out = base.select(F.concat(name, F.lit("_parent")).alias("parent_id"), *about, F.size("_chunks").alias("child_count"), F.inline(rows))
    return out.withColumn("id", F.when(F.col("child_index").isNull(), F.col("parent_id")).otherwise(F.concat("parent_id", F.lit("_child_"), "child_index")))


def parents_and_children(pages: DataFrame, mark: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """The records of cleaned pages as parents and their chunks."""
    both, about = records(pages, mark), ["company", "year", "doc_type", "page_num", "page_intent", "child_count"]
    return both.filter("kind = 'parent'").select("id", "text", *about), both.filter("kind = 'child'").select("parent_id", *about, "child_index", "text", "id")
