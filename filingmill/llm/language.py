"""Language identification by a linear-chain conditional random field over words.

Words (runs of letters, that is Unicode categories L*, lower-cased) carry affix and character n-gram features (all 1- to 4-grams of the word between two
boundary marks), the word itself, and its entry in a lexicon learned with the rest; transitions between the languages of
neighbouring words are learned too, from texts that are partly made to switch. Forward-backward gives every word a
distribution over languages, so code-switched text is labelled word by word; a document's language is the one with the
largest mean share.

Training is gradient ascent on the chains' log-likelihood: expected features and transitions come from forward-backward, too.
It takes a bounded sample of labelled rows to the driver: of at most TRAIN_BUCKETS texts a language, all pieces of PIECE_CHARS
characters, and of these at most TRAIN_PIECES a language by hash order, wherever in a text they stand. Everything else, prediction
included, covers every word of every text.
Forward-backward runs for all texts of a batch at once: chains are cut into blocks whose transfer matrices are multiplied, so
one very long text takes no longer than many short ones, and the result is that of the unbroken chain.

Defined results: null text, or text without a letter, is `und` with score 0; a null lang is not learned from; a null
doc_id is not held out and not learned from; without any labelled row everything is `und`; an empty table gives no rows;
repeated rows are each predicted; ties go to the language first by name; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._shared import cut_batches, small, small_batches, staged

TRAIN_BUCKETS = 96
PIECE_CHARS, TRAIN_PIECES = 300, 1000
CHAIN_WORDS = 48
EPOCHS, MINIBATCH, RATE, SEED = 4, 48, 0.5, 11
WIDTH = 1 << 16
GRAMS = 4
BLOCK = 64
LEXICON_COUNT, LEXICON_SHARE = 3, 0.8
UNDETERMINED = "und"
#: Texts of so many bytes are read at a time: their words and shares take many times that.
READ_BYTES = 1024 * 1024
_WORD = re.compile(r"[^\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # WIDTH + 1 rows (the last is zero) of a weight per language
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. What `re` takes for letters has numerals such as ½ in it: these end a word as well."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all n-grams of marked words, [GRAMS, positions] (WIDTH where a gram would leave its word), and where
    each word begins."""
    marked = "\x02" + "\x03\x02".join(words) + "\x03"
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.flatnonzero(points == 2)
    ends = np.append(starts[1:], len(points))
    room = np.repeat(ends, np.diff(np.append(starts, len(points)))) - np.arange(len(points))
    rows = np.empty((GRAMS, len(points)), dtype=np.int64)
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, GRAMS + 1):
        h[: len(points) - n + 1] = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _ODD
        h ^= h >> np.uint64(29)
        rows[n - 1] = np.where(room >= n, (h & np.uint64(WIDTH - 1)).astype(np.int64), WIDTH)
    return rows, starts


def _whole(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Feature rows of the word itself and of its lexicon entry (WIDTH if it has none), [words, 2]."""
    out = np.empty((len(words), 2), dtype=np.int64)
    out[:, 0] = [zlib.crc32(w.encode("utf-8", "surrogatepass")) & (WIDTH - 1) for w in words]
    out[:, 1] = [zlib.crc32(b"lexicon%d" % x) & (WIDTH - 1) if (x := lexicon.get(w, -1)) >= 0 else WIDTH for w in words]
    return out


def emissions(model: Model, words: list[str]) -> np.ndarray:
    """A score per word and language: the mean weight of its features."""
    out = np.empty((len(words), len(model.langs)), dtype=np.float32)
    chunk = 1 << 15
    for i in range(0, len(words), chunk):
        part = words[i : i + chunk]
        rows, starts = _grams(part)
        total = np.zeros((len(part), len(model.langs)), dtype=np.float32)
        count = np.full(len(part), 2, dtype=np.float32)
        for n in range(GRAMS):
            total += np.add.reduceat(model.weights[rows[n]], starts, axis=0)
            count += np.add.reduceat((rows[n] < WIDTH).astype(np.float32), starts)
        total += model.weights[_whole(part, model.lexicon)].sum(axis=1)
        out[i : i + chunk] = total / count[:, None]
    return out


def posteriors(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over chains laid end to end (chain i is scores[bounds[i]:bounds[i + 1]]): a distribution per word."""
    return _forward_backward(scores, bounds, transitions, start)[0]


def expected_pairs(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a distribution per word, the expected number of each transition over all chains)"""
    out, alpha, beta, e, a = _forward_backward(scores, bounds, transitions, start)
    inner = np.ones(len(scores), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    k = np.flatnonzero(inner)
    joint = alpha[k - 1][:, :, None].astype(np.float64) * a[None] * (e[k] * beta[k])[:, None, :]
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    return out, joint.sum(axis=0)


def _forward_backward(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """(distribution, forward and backward shares, exponentials of scores and of transitions), all but the last per word."""
    n, size = scores.shape
    lengths = np.diff(bounds)
    out, alpha, beta = (np.zeros((n, size), dtype=np.float32) for _ in range(3))
    live = np.flatnonzero(lengths > 0)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) if n else out
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    if not len(live):
        return out, alpha, beta, e, a
    first = np.exp(start - start.max()).astype(np.float32)
    blocks = -(-lengths[live] // BLOCK)
    chain = np.repeat(np.arange(len(live)), blocks)
    begin_block = np.concatenate([[0], np.cumsum(blocks)])
    number = np.arange(len(chain)) - begin_block[chain]
    at = bounds[live][chain] + number * BLOCK
    held = np.minimum(lengths[live][chain] - number * BLOCK, BLOCK)

    # The first word of a chain is entered from `first`, not through a transition.
    opens = number == 0
    product = np.tile(np.eye(size, dtype=np.float32), (len(chain), 1, 1))
    for t in range(BLOCK):
        k = np.flatnonzero(held > t)
        if not len(k):
            break
        step = (product[k].reshape(-1, size) @ a).reshape(-1, size, size)
        if t == 0:
            step[opens[k]] = product[k[opens[k]]]
        step *= e[at[k] + t][:, None, :]
        product[k] = step / step.sum(axis=(1, 2), keepdims=True)

    # What enters each block from the left, and from the right.
    left = np.empty((len(chain), size), dtype=np.float32)
    right = np.ones((len(chain), size), dtype=np.float32)
    left[begin_block[:-1]] = first
    for step in range(1, int(blocks.max())):
        k = begin_block[:-1][blocks > step] + step
        v = np.einsum("bi,bij->bj", left[k - 1], product[k - 1])
        left[k] = v / v.sum(axis=1, keepdims=True)
    for step in range(int(blocks.max()) - 2, -1, -1):
        k = begin_block[:-1][blocks > step + 1] + step
        v = np.einsum("bij,bj->bi", product[k + 1], right[k + 1])
        right[k] = v / v.sum(axis=1, keepdims=True)

    forward = left
    for t in range(BLOCK):
        k = np.flatnonzero(held > t)
        if not len(k):
            break
        v = forward[k] @ a
        if t == 0:
            v[opens[k]] = first
        v = np.maximum(v, 1e-30) * e[at[k] + t]
        v /= v.sum(axis=1, keepdims=True)
        forward[k] = v
        alpha[at[k] + t] = v
    backward = right
    for t in range(BLOCK - 1, -1, -1):
        k = np.flatnonzero(held > t)
        if not len(k):
            continue
        here = at[k] + t
        beta[here] = backward[k]
        out[here] = alpha[here] * backward[k]
        v = (e[here] * backward[k]) @ a.T
        backward[k] = v / v.sum(axis=1, keepdims=True)
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-30)
    return out, alpha, beta, e, a


def _chains(rows: list[tuple[str, str]], langs: list[str], rng) -> list[tuple[list[str], list[int]]]:
    """Chains of at most CHAIN_WORDS words with their labels; a third of them switch language once."""
    pieces = [(langs.index(lang), w[i : i + CHAIN_WORDS]) for lang, text in rows for w in (words_of(text),) for i in range(0, len(w), CHAIN_WORDS)]
    order = rng.permutation(len(pieces))
    out = []
    for j, i in enumerate(order):
        label, words = pieces[i]
        if j % 3 == 0 and len(order) > 1:
            other, more = pieces[order[j - 1]]
            cut = int(rng.integers(1, CHAIN_WORDS))
            words, labels = words[:cut] + more[cut:], [label] * len(words[:cut]) + [other] * len(more[cut:])
            out.append((words, labels))
        else:
            out.append((words, [label] * len(words)))
    return [c for c in out if c[0]]


def _lexicon(rows: list[tuple[str, str]], langs: list[str]) -> dict[str, int]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for w in words_of(text):
            counts[w][langs.index(lang)] += 1
    found = {}
    for w, c in counts.items():
        label, most = min(c.items(), key=lambda x: (-x[1], x[0]))
        if most >= LEXICON_COUNT and most >= LEXICON_SHARE * sum(c.values()):
            found[w] = label
    return found


def gradient(model: Model, words: list[str], labels: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """That of the chains' log-likelihood, by weights, transitions and start: seen features less expected ones."""
    scores = emissions(model, words)
    gamma, expected = expected_pairs(scores, bounds, model.transitions, model.start)
    miss = -gamma
    miss[np.arange(len(labels)), labels] += 1
    grams, starts = _grams(words)
    whole = _whole(words, model.lexicon)
    count = 2 + np.add.reduceat((grams < WIDTH).sum(axis=0), starts)
    own = (miss / count[:, None]).astype(np.float32)
    by_weight = np.zeros_like(model.weights)
    each = np.repeat(np.arange(len(words)), np.diff(np.append(starts, grams.shape[1])))
    for row in grams:
        np.add.at(by_weight, row, own[each])
    for column in whole.T:
        np.add.at(by_weight, column, own)
    by_weight[WIDTH] = 0
    first = bounds[:-1][np.diff(bounds) > 0]
    inner = np.ones(len(words), bool)
    inner[first] = False
    k = np.flatnonzero(inner)
    pairs = np.zeros(model.transitions.shape)
    np.add.at(pairs, (labels[k - 1], labels[k]), 1)
    return by_weight, pairs - expected, miss[first].sum(axis=0)


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (lang, text). Gradient ascent on the chains' log-likelihood, with a step per weight (AdaGrad)."""
    langs = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(SEED)
    size = len(langs)
    model = Model(langs, np.zeros((WIDTH + 1, size), np.float32), np.zeros((size, size), np.float32), np.zeros(size, np.float32), _lexicon(rows, langs))
    if not langs:
        return model
    squares = [np.full(x.shape, 1e-6, np.float32) for x in (model.weights, model.transitions, model.start)]
    chains = _chains(rows, langs, rng)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for i in range(0, len(order), MINIBATCH):
            part = [chains[j] for j in order[i : i + MINIBATCH]]
            words = [w for c, _ in part for w in c]
            labels = np.array([x for _, c in part for x in c])
            bounds = np.concatenate([[0], np.cumsum([len(c) for c, _ in part])])
            found = gradient(model, words, labels, bounds)
            for x, g, s in zip((model.weights, model.transitions, model.start), found, squares, strict=True):
                s += (g * g).astype(np.float32)
                x += (RATE * (1 if x is model.weights else 0.2) * g / np.sqrt(s)).astype(np.float32)
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang. Returns lang, doc_id, n, text: at most TRAIN_PIECES pieces a language, by hash order, of at most
    TRAIN_BUCKETS texts a language: of each bucket of a hash the text with the smallest."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", "lang", "text")
    key = F.xxhash64("doc_id")
    least = usable.groupBy("lang", F.pmod(key, F.lit(TRAIN_BUCKETS)).alias("bucket")).agg(F.min(F.struct(key.alias("h"), "doc_id")).alias("x"))
    # Stored, so that its size (TRAIN_BUCKETS rows a language) is known before the join and texts need not be shuffled.
    least = small(staged(least.select("lang", F.col("x.doc_id").alias("doc_id")), "sample"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    # A repeated doc_id counts once for each place and text it has there.
    cut = usable.join(least, ["lang", "doc_id"]).select("lang", "doc_id", F.posexplode(pieces).alias("n", "text")).distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n", "text"))
    return cut.withColumn("_r", rank).filter(F.col("_r") <= TRAIN_PIECES).drop("_r")


def train(docs: DataFrame) -> Model:
    """docs: doc_id, text, lang. The model of the texts that are not held out."""
    rows = sorted((r.lang, r.doc_id, r.n, r.text) for r in training_rows(docs).collect())  # bounded: see training_rows
    return fit([(lang, text) for lang, _, _, text in rows])


def _read_batch(model: Model, texts: list[str | None]):
    """(word lists, bounds, shares per word, mean share per text, whether the text is determined)"""
    lists = [words_of(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
    codes, words = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
    if len(words) and model.langs:
        shares = posteriors(emissions(model, list(words))[codes], bounds, model.transitions, model.start)
        sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(shares, axis=0, dtype=np.float64)])
        mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
    else:
        shares, mean = np.zeros((len(codes), 1)), np.zeros((len(lists), 1))
    return lists, bounds, shares, mean, (np.diff(bounds) > 0) & bool(model.langs)


def _predict(shared, with_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in cut_batches(batches, "text", READ_BYTES):
            lists, bounds, shares, mean, known = _read_batch(model, batch.column("text").to_pylist())
            best = mean.argmax(axis=1)
            out = [
                batch.column("doc_id"),
                pa.array([model.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], pa.string()),
                pa.array(np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0), pa.float64()),
            ]
            if with_words:
                label = shares.argmax(axis=1)
                names = np.array(model.langs or [UNDETERMINED], dtype=object)
                out += [pa.array(lists, pa.list_(pa.string())), pa.array([names[label[i:j]].tolist() for i, j in zip(bounds, bounds[1:], strict=False)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "words", "word_langs"][: len(out)])

    return run


def _keep(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "text", READ_BYTES):
            _, _, _, mean, known = _read_batch(shared.value, batch.column("text").to_pylist())
            yield batch.filter(pa.array(known & (mean.max(axis=1) >= least)))

    return run


def determined(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, as they are, whose language is determined with a score of `least` or more."""
    spark = docs.sparkSession
    small_batches(spark)
    return docs.mapInArrow(_keep(spark.sparkContext.broadcast(model), least), docs.schema)


def identify(docs: DataFrame, model: Model, with_words: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score; with_words adds words and word_langs, the language of each."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([docs.schema["doc_id"]]).add("lang_pred", "string").add("score", "double")
    if with_words:
        schema = schema.add("words", T.ArrayType(T.StringType())).add("word_langs", T.ArrayType(T.StringType()))
    return docs.select("doc_id", "text").mapInArrow(_predict(spark.sparkContext.broadcast(model), with_words), schema)
