"""State kept as tables: answer cache, preferences, aliases, file registry, artifacts and event log. Tables are rewritten
by union and a last-wins window (see operators.statements.upsert); write the result to a new path and switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PREFERENCE_KEYS = ("default_trailing_years", "preferred_unit", "show_suggestions", "default_company", "answer_style")


def cache_key(**parts: Column) -> Column:
    """sha256 of the parts as JSON, keys in order; nulls are left out, so a missing part equals a null one."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256)


def structured_key(symbol: Column, line_items: Column, metrics: Column, periods: Column, context: Column, version: Column) -> Column:
    """A key that depends on what is asked, not on how: lists are sorted."""
    return cache_key(symbol=F.upper(symbol), line_items=F.array_sort(line_items), metrics=F.array_sort(metrics), periods=F.array_sort(periods), context=context, version=version)


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests: cache_key, ... Adds the cached answer_text, null where there is none or it has expired."""
    live = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return requests.join(live.select("cache_key", "answer_text"), "cache_key", "left")


def count_hits(cache: DataFrame, lookups: DataFrame) -> DataFrame:
    """lookups: cache_key, at. hit_count and last_accessed_at brought up to date, one row per key shuffled."""
    seen = lookups.groupBy("cache_key").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    out = cache.join(seen, "cache_key", "left")
    return out.withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).withColumn(
        "last_accessed_at", F.greatest("last_accessed_at", "_at")
    ).drop("_n", "_at")


def merged(table: DataFrame, changes: DataFrame, key: list[str], replaced: list[str], kept: list[str] = ()) -> DataFrame:
    """Full outer join by key: `replaced` columns come from the change where there is one, `kept` ones only where the change
    is not null, all others stay as they were (or come with a new row). changes has one row per key."""
    old, new = table.alias("old"), changes.withColumn("_changed", F.lit(True)).alias("new")
    changed, is_new = F.coalesce("new._changed", F.lit(False)), F.col("old._was").isNull()
    met = old.select("*", F.lit(True).alias("_was")).alias("old").join(new, key, "full")
    value = lambda c: (
        F.when(changed, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in replaced
        else F.coalesce(f"new.{c}", f"old.{c}") if c in kept
        else F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    )
    return met.select(*key, *(value(c).alias(c) for c in table.columns if c not in key))


def purge_expired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the largest `order` of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def updated_status(registry: DataFrame, updates: DataFrame, key: list[str], order: str) -> DataFrame:
    """updates: key, ocr_status, ocr_reason. The latest registry row of each key takes them; older rows stay. The last `order` of a key is
    summed up before anything is shuffled by the key, so a key with many rows is not one task's."""
    last = registry.groupBy(*key).agg(F.max(order).alias("_last"))
    news = updates.select(*key, F.col("ocr_status").alias("_s"), F.col("ocr_reason").alias("_r")).join(last, key)
    out = registry.join(news, key, "left")
    hit = (F.col(order) == F.col("_last")) & F.col("_s").isNotNull()
    out = out.withColumn("ocr_status", F.when(hit, F.col("_s")).otherwise(F.col("ocr_status")))
    return out.withColumn("ocr_reason", F.when(hit, F.col("_r")).otherwise(F.col("ocr_reason"))).select(*registry.columns)


def registry_page(registry: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Newest first, 1 to 1000 rows."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    return registry.filter(condition).orderBy(F.desc("id")).limit(limit)


def preference_maps(preferences: DataFrame) -> DataFrame:
    """user_id, preferences as a map of JSON values."""
    one = latest(preferences, ["user_id", "preference_key"], "updated_at")
    return one.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("preference_key", "preference_value")))).alias("preferences"))


def preference_or(requests: DataFrame, preferences: DataFrame, key: str, default: str) -> DataFrame:
    """requests: user_id, ... Adds value: the user's JSON value of the key, or the default."""
    own = latest(preferences.filter(F.col("preference_key") == key), ["user_id"], "updated_at").select("user_id", "preference_value")
    return requests.join(own, "user_id", "left").withColumn("value", F.coalesce("preference_value", F.lit(default))).drop("preference_value")


def known_preferences(changes: DataFrame, known=PREFERENCE_KEYS) -> DataFrame:
    return changes.filter(F.col("preference_key").isin(*known))


def without_preferences(preferences: DataFrame, deletions: DataFrame) -> DataFrame:
    """deletions: user_id, preference_key."""
    return preferences.join(deletions.select("user_id", "preference_key"), ["user_id", "preference_key"], "left_anti")


def saved_preferences(preferences: DataFrame, changes: DataFrame, known=PREFERENCE_KEYS) -> DataFrame:
    """Both: user_id, preference_key, preference_value (JSON), updated_at. The latest value of each key; changes of keys that
    are not known are left out."""
    return latest(preferences.unionByName(known_preferences(changes, known)), ["user_id", "preference_key"], "updated_at")


def resolve_alias(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """requests: phrase and any other columns. Adds screener_symbol of the alias that is the phrase, whatever its case and outer
    spaces; null if none is, or the phrase is blank."""
    known = aliases.select(F.lower(F.trim("alias_text")).alias("_alias"), "screener_symbol")
    return requests.join(known, F.nullif(F.lower(F.trim("phrase")), F.lit("")) == F.col("_alias"), "left").drop("_alias")


def list_aliases(aliases: DataFrame, screener_symbol: str | None = None) -> DataFrame:
    """All aliases, or one company's, the oldest first."""
    out = aliases if screener_symbol is None else aliases.filter(F.col("screener_symbol") == screener_symbol)
    return out.orderBy("created_at", "alias_text")


def without_aliases(aliases: DataFrame, deletions: DataFrame) -> DataFrame:
    """deletions: alias_text, compared in lower case without outer spaces."""
    gone = deletions.select(F.lower(F.trim("alias_text")).alias("alias_text"))
    return aliases.join(gone, "alias_text", "left_anti")


def list_files(files: DataFrame, status: str | None = None) -> DataFrame:
    """All files, or those of one status, the last changed first."""
    out = files if status is None else files.filter(F.col("status") == status)
    return out.orderBy(F.desc("updated_at"), "pdf_id")


def retrieval_events(hits: DataFrame) -> DataFrame:
    """hits: query_id, rank, parent_id, id (the child), distance, parent_text, child_text. A log row for each hit: query_id,
    event_type, message, metadata_json with both ids, rank, distance and the first 240 characters of both texts."""
    preview = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 240)
    about = F.struct(
        "parent_id", F.col("id").alias("child_id"), "rank", F.round("distance", 6).alias("distance"),
        preview(F.col("parent_text")).alias("parent_preview"), preview(F.col("child_text")).alias("child_preview"),
    )
    return hits.select("query_id", F.lit("retrieval").alias("event_type"), F.concat(F.lit("hit "), "rank").alias("message"), F.to_json(about).alias("metadata_json"))


def log_events(events: DataFrame, path: str) -> None:
    """Appends rows to the event log at path. The log is only ever added to."""
    events.write.mode("append").parquet(path)


def new_aliases(candidates: DataFrame, aliases: DataFrame, companies: DataFrame) -> DataFrame:
    """Confident candidates whose alias is new and whose symbol is known; of equal ones the earliest."""
    named = candidates.filter("confident").withColumn("alias_text", F.lower(F.trim("alias_text"))).filter("alias_text <> ''")
    fresh = named.join(aliases.select("alias_text"), "alias_text", "left_anti").join(companies.select("screener_symbol"), "screener_symbol", "left_semi")
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy("alias_text").orderBy("created_at", "screener_symbol"))).filter("_n = 1").drop("_n")


#: Aliases are met by one of their runs of so many characters.
GRAM = 4


def _runs(text: Column, n: int) -> Column:
    """All distinct runs of n characters."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def anchored(aliases: DataFrame) -> DataFrame:
    """aliases: alias_text, screener_symbol, ord. Adds _alias (lower case) and _gram: of its runs of GRAM characters the one that the fewest aliases have, so that a prefix
    or a word that many share is no one's; a shorter alias is its own. An empty or null alias is in no text and left out."""
    named = aliases.select("*", F.lower("alias_text").alias("_alias")).filter("_alias <> ''")
    runs = F.when(F.length("_alias") >= GRAM, _runs(F.col("_alias"), GRAM)).otherwise(F.array("_alias"))
    grams = named.select("_alias").distinct().select("_alias", F.explode(runs).alias("_gram"))
    counts = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = grams.join(counts, "_gram").groupBy("_alias").agg(F.min(F.struct("_n", "_gram")).alias("_x"))
    return named.join(rarest.select("_alias", "_x._gram"), "_alias")


def alias_in_text(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """questions: question_id, text. aliases: alias_text, screener_symbol, ord. The alias contained in the text with the
    smallest ord, or null. A text meets the aliases whose anchor (see `anchored`) is among its own runs of characters, by an equi-join that Spark
    broadcasts or shuffles as the dictionary's size has it; what meets is then compared in full."""
    dictionary = anchored(aliases)
    lower = F.lower("text")
    lengths = sorted(r[0] for r in dictionary.select(F.length("_gram")).distinct().collect())  # GRAM of them at most
    runs = F.array_distinct(F.flatten(F.array(*(_runs(lower, n) for n in lengths)))) if lengths else F.array().cast("array<string>")
    met = questions.select("question_id", lower.alias("_lower"), F.explode(runs).alias("_gram")).join(dictionary, "_gram").filter(F.contains("_lower", F.col("_alias")))
    best = met.groupBy("question_id").agg(F.min(F.struct("ord", "alias_text", "screener_symbol")).alias("_b"))
    return questions.join(best, "question_id", "left").select("question_id", "text", F.col("_b.alias_text").alias("alias_text"), F.col("_b.screener_symbol").alias("screener_symbol"))


def file_with_parts(files: DataFrame, artifacts: DataFrame, stores: DataFrame) -> DataFrame:
    """Each file with its artifacts and stores as arrays, each side summed up before the join."""
    listed = lambda df, name: df.groupBy("pdf_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "pdf_id"]))).alias(name))
    return files.join(listed(artifacts, "artifacts"), "pdf_id", "left").join(listed(stores, "stores"), "pdf_id", "left")
