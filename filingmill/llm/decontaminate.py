"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Indexing: every text is cut into words once. The index stores, for each row of docs, its sequence of terms (64 bits of hash a
word), and the postings (term, text, position) of all its words, sorted by term within each segment, a segment being the rows
of one input partition. No posting is shuffled, whatever the words' frequencies, and the index serves any benchmark.

Searching: test items are cut into windows of WINDOW words (a shorter item is one window). Of each window the PROBES rarest
terms, by their number of postings, are looked up from the rarest on: a posting says where the window would have to start,
and the list of starts is intersected with that of the next rarest term, give or take SLOP words. What is left is verified
word by word against the text's own terms:
- exact matches: the window's words stand in a row;
- proximity matches: not exact, but each word of the window stands within SLOP words of its place, counted from where the
  rarest word stands (of words equally rare, the first in the window).

Starts are joined by text, window and cell of CELL words, which adaptive execution can split; only texts that hold a
candidate are read again. Vocabulary, probes and result lists are broadcast only if rows and bytes are known to be few.

Two words with the same 64-bit hash would be taken for one; with 10^10 distinct words and a benchmark vocabulary of 10^4 the
chance that any test word is concerned is about 10^-5, and a window of several words needs as many such accidents.

Defined results: null text has no words and no hit; an empty benchmark hits nothing; items without words have no window;
an item with a null id still hits but is not listed; repeated items count once; repeated documents each get their row;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, dropped, small, staged

#: What stands between words: ASCII other than letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
PROBES = 3
SLOP = 2
CELL = 64
#: Up to so many terms are given to the scan of the postings as a filter: files are sorted by term, so it opens only pages that may hold one. (Spark
#: makes a chain of comparisons of them, which with thousands of terms is too deep for a thread's stack.)
SOUGHT = 200


class Index(NamedTuple):
    #: doc_id, a, b (128 bits that name the text), seg, ord (the row), n_words, terms
    texts: DataFrame
    #: term, seg, ord, pos (from 0), sorted by term within each file
    postings: DataFrame


def terms_of(text: Column) -> Column:
    """The hashes of the words, in order. Words are split first and lower-cased one by one, as most are plain ASCII."""
    lowered = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(ascii_lower(w))
    words = F.array_remove(F.split(text, BREAK), "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(lowered(w))), F.array().cast("array<bigint>"))


def build_index(docs: DataFrame) -> Index:
    """docs: doc_id, text. The index of all rows, stored in the shared folder."""
    row = F.monotonically_increasing_id()
    texts = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("key"), "text").alias("b"), row.alias("_row"), terms_of(F.col("text")).alias("terms"))
    texts = staged(
        texts.select(
            "doc_id", "a", "b", F.shiftright("_row", 33).cast("int").alias("seg"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("ord"),
            F.size("terms").cast("long").alias("n_words"), "terms",
        ),
        "texts",
    )
    postings = texts.select("seg", "ord", F.posexplode("terms").alias("pos", "term")).select("term", "seg", "ord", "pos")
    return Index(texts, staged(postings.sortWithinPartitions("term"), "postings"))


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """items: item_id, text. Returns (the distinct windows: pid, phrase (their terms); the items that hold them: pid, item),
    stored."""
    cut = items.select(F.col("item_id").cast("string").alias("item"), terms_of(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    last = F.greatest(F.size("_w") - window, F.lit(0))
    cut = cut.select("item", "_w", F.explode(F.sequence(F.lit(0), last)).alias("_at"))
    cut = staged(cut.select("item", F.slice("_w", F.col("_at") + 1, F.lit(window)).alias("phrase")).distinct(), "windows")
    phrases = staged(cut.select("phrase").distinct().select(F.monotonically_increasing_id().alias("pid"), "phrase"), "phrases")
    return phrases, staged(cut.filter("item IS NOT NULL").join(phrases, "phrase").select("pid", "item"), "items")


def sought(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings that may be of these terms (distinct, stored): few terms are looked up, and for many all postings are read."""
    found = [r.term for r in terms.select("term").limit(SOUGHT + 1).collect()]
    if len(found) > SOUGHT:
        return postings
    postings.sparkSession.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(SOUGHT))
    return postings.filter(F.col("term").isin(found))


def term_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms (distinct, stored) occurs: term, cf. Terms that never occur have no row."""
    return sought(postings, terms).join(terms, "term").groupBy("term").agg(F.count("*").alias("cf"))


def rarest_probes(phrases: DataFrame, counts: DataFrame, probes: int = PROBES) -> DataFrame:
    """pid, need, rank (from 0, the rarest first), off, term: of each phrase whose words all occur, the rarest words and where
    they stand in it."""
    at = phrases.select("pid", F.size("phrase").alias("_n"), F.posexplode("phrase").alias("off", "term"))
    found = at.join(counts, "term").groupBy("pid", "_n").agg(
        F.array_sort(F.collect_list(F.struct("cf", "off", "term"))).alias("_all")
    ).filter(F.size("_all") == F.col("_n"))
    best = found.select("pid", F.slice("_all", 1, probes).alias("_best"))
    best = best.select("pid", F.size("_best").alias("need"), F.posexplode("_best").alias("rank", "_p"))
    return best.select("pid", "need", "rank", F.col("_p.off").alias("off"), F.col("_p.term").alias("term"))


def intersected_starts(postings: DataFrame, probes: DataFrame, slop: int = SLOP, levels: int = PROBES) -> DataFrame:
    """seg, ord, pid, start: where, from the rarest term of a phrase on, each probe's list has a start within slop words. All lists
    are taken from the postings in one reading."""
    terms = staged(probes.select("term").distinct(), "probe_terms")
    start, rank = (F.col("pos") - F.col("off")).alias("start"), F.col("rank")
    lists = sought(postings, terms).join(small(probes), "term").select("seg", "ord", "pid", start, "need", "rank")
    lists = staged(lists.filter(F.col("start") >= F.when(rank > 0, -2 * slop).otherwise(-slop)), "lists")

    def lined(rank: int) -> DataFrame:
        return lists.filter(F.col("rank") == rank).drop("rank")

    cell = lambda at: F.floor(at / CELL).cast("int")
    left, done = lined(0), []
    for rank in range(1, levels):
        done.append(left.filter(F.col("need") == rank).drop("need"))
        cells = F.array_distinct(F.array(cell(F.col("start") - slop), cell(F.col("start") + slop)))
        left = left.filter(F.col("need") > rank).select("*", F.explode(cells).alias("cell"))
        right = lined(rank).select(F.col("seg").alias("s"), F.col("ord").alias("o"), F.col("pid").alias("p"), F.col("start").alias("at"), cell(F.col("start")).alias("c"))
        met = (F.col("seg") == F.col("s")) & (F.col("ord") == F.col("o")) & (F.col("pid") == F.col("p")) & (F.col("cell") == F.col("c"))
        met = met & (F.abs(F.col("start") - F.col("at")) <= slop)
        left = staged(left.join(right, met, "left_semi").drop("cell").distinct(), "starts")
        # Few are left as a rule: then the next list is met where it is read, and not shuffled.
        left = small(left)
    done.append(left.drop("need"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def matches(index: Index, phrases: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Of texts with any: seg, ord, exact and near (arrays of struct<pid, start, n>, n the number of words)."""
    vocabulary = small(staged(phrases.select(F.explode("phrase").alias("term")).distinct(), "vocabulary"))
    counts = staged(term_counts(index.postings, vocabulary), "counts")
    probes = staged(rarest_probes(phrases, counts), "probes")
    starts = staged(intersected_starts(index.postings, probes, slop).join(phrases, "pid"), "starts")
    found = starts.groupBy("seg", "ord").agg(F.collect_list(F.struct("pid", "start", "phrase")).alias("_c"))
    held = small(staged(starts.select("seg", "ord").distinct(), "texts_met"))
    texts = index.texts.join(held, ["seg", "ord"], "left_semi").select("seg", "ord", "terms").join(found, ["seg", "ord"])
    exact = F.expr("filter(_c, c -> c.start >= 0 AND slice(terms, c.start + 1, size(c.phrase)) = c.phrase)")
    near = F.expr(
        f"""filter(array_except(_c, _exact), c -> forall(sequence(0, size(c.phrase) - 1), j -> array_contains(
            slice(terms, greatest(c.start + j - {slop}, 0) + 1, c.start + j + {slop} + 1 - greatest(c.start + j - {slop}, 0)), c.phrase[j])))"""
    )
    short = lambda c: F.transform(c, lambda x: F.struct(x.pid.alias("pid"), x.start.alias("start"), F.size(x.phrase).alias("n")))
    texts = texts.withColumn("_exact", exact).withColumn("_near", near)
    return texts.select("seg", "ord", short(F.col("_exact")).alias("exact"), short(F.col("_near")).alias("near")).filter("size(exact) + size(near) > 0")


def _items(found: DataFrame, of: str, phrase_items: DataFrame) -> DataFrame:
    """seg, ord, the sorted ids (strings) of items whose windows match."""
    one = found.select("seg", "ord", F.explode(F.array_distinct(F.transform(of, lambda x: x.pid))).alias("pid"))
    return one.join(phrase_items, "pid").groupBy("seg", "ord").agg(F.array_sort(F.collect_set("item")).alias(f"{of}_items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, index: Index | None = None) -> DataFrame:
    """docs: doc_id, text (not read where their index is given). items: item_id, text. Returns for each row of docs: doc_id, a, b (the text's name), n_words, n_hit
    (words inside an exact match), items (ids of items that match exactly, sorted strings), exact and near (arrays of
    struct<pid, start, n>), near_items (ids of items that match nearby but for exact places)."""
    index = index or build_index(docs)
    phrases, phrase_items = windows_of(items, window)
    found = staged(matches(index, phrases, window, slop), "matches")
    covered = F.array_distinct(F.flatten(F.transform("exact", lambda x: F.sequence(x.start, x.start + x.n - 1))))
    own = small(phrase_items)
    listed = found.select("seg", "ord", F.size(covered).cast("long").alias("n_hit"), "exact", "near")
    listed = listed.join(_items(found, "exact", own), ["seg", "ord"], "left").join(_items(found, "near", own), ["seg", "ord"], "left")
    listed = small(staged(listed, "listed"))
    rows = index.texts.select("doc_id", "a", "b", "seg", "ord", "n_words").join(listed, ["seg", "ord"], "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c.replace("exact_", ""))
    place = "array<struct<pid:bigint,start:int,n:int>>"
    return rows.select(
        "doc_id", "a", "b", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("exact_items", "array<string>"),
        none("exact", place), none("near", place), none("near_items", "array<string>"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no test window occurs, as they are."""
    index = build_index(docs)
    hit = small(staged(decontaminate(docs, items, window, slop=0, index=index).filter("n_hit > 0").select("a", "b").distinct(), "hit"))
    dropped(*index)
    met = (F.xxhash64(docs.text) == hit.a) & (F.xxhash64(F.lit("key"), docs.text) == hit.b)
    return docs.join(hit, met, "left_anti")
