"""SentencePiece encoding and decoding by Viterbi over a trie of distinct marked words.

The distinct marked words of a batch are sorted, so that going through them in order is a depth-first walk of their trie.
For every prefix the forward state is the score of its best segmentation and that one's last piece; it depends on the prefix
alone, so the states up to the common prefix of two neighbours are kept and only the rest is computed. Then each word is read back
from its last state.

The score depends on the model's type, which is read from the file:
- unigram: the sum of the pieces' scores, as single-precision numbers; of equal ones that with the longer last piece (the
  library adds up over the whole text, so that its rounding may settle an exact tie otherwise); a character without a piece costs 10 more than the worst piece;
- merges (BPE, as the model given here): of all segmentations the model's own is the one in which every two neighbouring pieces
  are what merging gives for the two together. That is the score: 0 if all neighbours agree, minus infinity otherwise. Exactly one
  piece that ends a prefix continues an agreeing path, so the first found is the best.
Other types, and pieces that hold a mark or a line feed after another character, are refused. For merge models results equal those of the
sentencepiece library, piece for piece, at every text tested (tests/llm/test_text_models.py); only NUL, which the library drops, becomes
a byte piece here. For unigram models the sum is that of the library's, and so are the pieces but for their order: where several orders
of the same pieces have an equal sum, the library's rounding over a whole text picks one and the trie another (in the test, with an alphabet of four
letters that makes such ties common, in under 10 % of the texts).

A marked word is a space mark and the characters up to the next space; line feeds, which no piece holds, bound words as
well. Characters without a piece become byte pieces. Runs of space marks are merged among themselves after that, as pieces never
hold a mark after another character. A mark character in a text is read as a space, as by the library, and so is not given back.

Defined results: null text has no pieces (null when decoded), empty text none; a very long word costs as much as many
short ones; a mark character in a text is read as a space, as by the library; repeated rows are each encoded; an empty table
gives no rows; other columns stay out. The model file is read on the driver and broadcast (its pieces: a few MB).
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import cut_batches, small_batches

MARK = "▁"
# Fixed values of the format.
UNIGRAM, MERGES = 1, 2
UNKNOWN_COST = 10.0
#: A worker remembers the pieces of so many words, of so many characters in all, from batch to batch, and so many neighbours'
#: agreements from task to task: it stays alive between tasks, and runs those of other operators too.
CACHED_WORDS, CACHED_CHARS, CACHED_PAIRS = 150_000, 2_000_000, 400_000
#: Texts of so many bytes are encoded at a time.
READ_BYTES = 1024 * 1024
_END = ""


@dataclass
class Vocabulary:
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    spelled: list[bytes]  # what each id stands for
    name: str = ""  # a hash of the model file
    endings: dict = field(default_factory=dict)  # a trie of the reversed pieces
    kind: int = 2
    unknown_id: int = 0

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Reads a model file; raises ValueError for one that this module can't follow."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids, spelled = {}, {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"")
            else:
                ids[piece], scores[piece] = i, sp.get_score(i)
                spelled.append(piece.replace(MARK, " ").encode())
        with open(path, "rb") as f:
            held = f.read()
        kind = model_type(held)
        if kind not in (UNIGRAM, MERGES):
            raise ValueError(f"a model of type {kind} is neither unigram nor of merges")
        if any("\n" in p or MARK in p.lstrip(MARK) or kind == UNIGRAM and MARK in p[1:] for p in ids):
            raise ValueError("a piece goes beyond its word")
        kept = ids if kind == UNIGRAM else (p for p in ids if merged(p, scores) == [p])
        return cls(ids, scores, byte_ids, spelled, hashlib.sha256(held).hexdigest(), _reversed_trie(kept), kind, sp.unk_id())


def _protobuf_fields(data: bytes):
    """(number, value) of a message's fields; varints as numbers, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 0x80:
                return value

    while at < len(data):
        key = varint()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def model_type(data: bytes) -> int:
    """The type in a model file: field 3 of the trainer's settings, which are field 2; unigram where it isn't set."""
    return next((t for n, settings in _protobuf_fields(data) if n == 2 for m, t in _protobuf_fields(settings) if m == 3), UNIGRAM)


def _reversed_trie(pieces) -> dict:
    root: dict = {}
    for piece in pieces:
        node = root
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[_END] = piece
    return root


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces by merging neighbours, the best scored first and of equals the leftmost."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue: list = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(parts) and (s := scores.get(parts[i] + parts[j])) is not None:
            heapq.heappush(queue, (-s, i, j, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while queue:
        _, i, j, left, right = heapq.heappop(queue)
        if parts[i] != left or parts[j] != right or after[i] != j:
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p is not None]


class Encoder:
    """Words to ids by the shared-prefix walk, with what it has learned so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.chars = 0  # of the words held
        self.again: set[str] = set()  # of the words held, those of more than one batch
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.unknown_score = np.float32(min(vocabulary.scores.values(), default=0.0)) - np.float32(UNKNOWN_COST)

    def agree(self, left: str, right: str) -> bool:
        """Whether merging gives these two pieces for the two together."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[left, right] = merged(left + right, self.v.scores) == [left, right]
        return found

    def of_piece(self, piece: str) -> tuple[int, ...]:
        i = self.v.ids.get(piece)
        if i is not None:
            return (i,)
        return tuple(self.v.byte_ids[b] for b in piece.encode()) if any(self.v.byte_ids) else (self.v.unknown_id,)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet: a depth-first walk over the trie of the sorted words."""
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        best = self._by_score if self.v.kind == UNIGRAM else self._by_agreement
        last: list[str] = [""]  # last[p], score[p]: the last piece and the score of the first p characters' best segmentation
        score: list = [np.float32(0.0)]
        previous = ""
        for word in sorted(words):
            n, common = len(word), 0
            for a, b in zip(word, previous, strict=False):
                if a != b:
                    break
                common += 1
            del last[common + 1 :], score[common + 1 :]
            previous = word
            for p in range(common + 1, n + 1):
                piece, value = best(word, p, last, score)
                last.append(piece)
                score.append(value)
            self.words[word] = self._read_back(word, last)
            self.chars += n

    def _ending(self, word: str, p: int) -> list[str]:
        """The pieces that end at p, the longest last."""
        node, at, found = self.v.endings, p, []
        while at:
            at -= 1
            node = node.get(word[at])
            if node is None:
                break
            piece = node.get(_END)
            if piece is not None:
                found.append(piece)
        return found

    def _by_agreement(self, word: str, p: int, last: list[str], score: list):
        pairs = self.pairs
        for piece in reversed(self._ending(word, p)):
            begin = p - len(piece)
            if not begin:  # merging gives every piece for itself
                return piece, 0.0
            known = pairs.get((last[begin], piece))
            if known or known is None and self.agree(last[begin], piece):
                return piece, score[begin]
        return word[p - 1], score[p - 1]

    def _by_score(self, word: str, p: int, last: list[str], score: list):
        chosen = value = None
        for piece in reversed(self._ending(word, p)):
            found = score[p - len(piece)] + np.float32(self.v.scores[piece])
            if value is None or found > value:
                chosen, value = piece, found
        if word[p - 1] not in self.v.ids:
            unknown = score[p - 1] + self.unknown_score
            if value is None or unknown > value:
                chosen, value = word[p - 1], unknown
        return chosen, value

    def _read_back(self, word: str, last: list[str]) -> bytes:
        out, p = [], len(word)
        while p:
            piece = last[p]
            i = self.v.ids.get(piece)
            out.append((i,) if i is not None else self.of_piece(piece))
            p -= len(piece)
        return array("i", [i for part in reversed(out) for i in part]).tobytes()

    def _forget(self) -> None:
        """Keep the words that have come again since the last time, unless these are too many as well."""
        self.words = {w: self.words[w] for w in self.again}
        self.again = set()
        self.chars = sum(map(len, self.words))
        if 2 * len(self.words) > CACHED_WORDS or 2 * self.chars > CACHED_CHARS:
            self.words, self.chars = {}, 0

    def rest(self) -> None:
        """At the end of a task: the worker stays alive, and what it does next needs no words. Arrow gives back what it holds free."""
        self.words, self.again, self.chars = {}, set(), 0
        pa.default_memory_pool().release_unused()

    def run_of_marks(self, n: int) -> list[int]:
        if n not in self.runs:
            self.runs[n] = [i for p in merged(MARK * n, self.v.scores) for i in self.of_piece(p)]
        return self.runs[n]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        lists = [marked_words(t) for t in texts]
        codes, distinct = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
        if len(self.words) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self._forget()
        self.again.update(w for w in distinct if w in self.words)
        self.learn([w for w in distinct if w not in self.words])
        known = [self.words[w] for w in distinct]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        out, at = [], 0
        mark = self.v.ids.get(MARK)
        for text, words in zip(texts, lists, strict=True):
            mine = codes[at : at + len(words)]
            at += len(words)
            n = sizes[mine]
            first = np.cumsum(n) - n
            ids = flat[np.repeat(starts[mine] - first, n) + np.arange(int(n.sum()))] if len(mine) else np.zeros(0, np.int32)
            if self.v.kind == MERGES and text and ("  " in text or text[0] == " " or MARK in text):
                ids = self._with_runs(ids, mark)
            if self.v.kind == UNIGRAM and len(ids):  # a run of unknown characters is one
                unknown = ids == self.v.unknown_id
                ids = ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]
            out.append(ids)
        return out

    def _with_runs(self, ids: np.ndarray, mark: int) -> np.ndarray:
        """Neighbouring single marks are one run of marks."""
        out: list[int] = []
        for is_mark, part in groupby(ids.tolist(), lambda i: i == mark):
            part = list(part)
            out += self.run_of_marks(len(part)) if is_mark else part
        return np.array(out, np.int32)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this worker process; tasks that follow each other share its agreements."""
    if vocabulary.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.name] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.name]


def marked_words(text: str | None) -> list[str]:
    if not text:
        return []
    spread = MARK + text.replace(MARK, " ").replace(" ", " " + MARK).replace("\n", " \n ")
    return [w for w in spread.split(" ") if w]


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of some ids; bytes that are no UTF-8 become replacement characters. The leading mark's space is dropped."""
    spelled = vocabulary.spelled
    out = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        try:
            for batch in cut_batches(batches, "text", READ_BYTES):
                texts = batch.column("text").to_pylist()
                ids = encoder.encode_batch(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                nulls = pa.array([t is None for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=nulls)],
                    ["doc_id", "ids"],
                )
        finally:
            encoder.rest()

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids (null for null text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.read(model_path))
    schema = T.StructType([docs.schema["doc_id"]]).add("ids", T.ArrayType(T.IntegerType()))
    return docs.select("doc_id", "text").mapInArrow(_encode(shared), schema)


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, shared.value) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_table(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded: doc_id, ids. Returns doc_id, text."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.read(model_path))
    schema = T.StructType([encoded.schema["doc_id"]]).add("text", "string")
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared), schema)


def _digest(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        try:
            for batch in cut_batches(batches, "text", READ_BYTES):
                texts = batch.column("text").to_pylist()
                ids = encoder.encode_batch(texts)
                same = [t is None or decode(x.tolist(), shared.value) == t for t, x in zip(texts, ids, strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id"),
                    "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                    "round_trip": pa.array(same, pa.bool_()),
                }
                if with_ids:
                    columns["ids"] = pa.array([None if t is None else x for t, x in zip(texts, ids, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        finally:
            encoder.rest()

    return run


def encode_digest(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip
    (whether decoding gives just this text back), and ids (null for null text) if asked for. Encoded and decoded whole, in one
    pass."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.read(model_path))
    schema = T.StructType([docs.schema["doc_id"]]).add("n_pieces", "long").add("ids_sha256", "string").add("round_trip", "boolean")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select("doc_id", "text").mapInArrow(_digest(shared, with_ids), schema)
