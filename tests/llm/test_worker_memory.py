"""What a Python worker holds while it reads a large batch, and after its task."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from filingmill.llm import language, pieces
from filingmill.llm.queries import MODEL_PATH


def _batch(n_texts, words_each, rng, vocabulary=None):
    make = lambda: "".join(rng.choice("abcdeilmnorstuéß") for _ in range(rng.randrange(2, 9)))
    known = [make() for _ in range(vocabulary)] if vocabulary else None
    texts = [" ".join(rng.choice(known) if known else make() for _ in range(words_each)) for _ in range(n_texts)] + [None, "", "12 !"]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_languages_of_a_large_batch():
    rng = random.Random(5)
    batch = _batch(400, 1600, rng, vocabulary=3000)
    weights = np.random.default_rng(5).normal(size=(language.WIDTH + 1, 4)).astype(np.float32)
    model = language.Model(["de", "en", "es", "fr"], weights, np.eye(4, dtype=np.float32), np.zeros(4, np.float32), {})
    shared = SimpleNamespace(value=model)
    _, _, _, mean, known = language._read_batch(model, batch.column("text").to_pylist())
    tracemalloc.start()
    found = pa.Table.from_batches(language._predict(shared, False)(iter([batch])))
    kept = pa.Table.from_batches(language._keep(shared, 0.4)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert found["doc_id"].to_pylist() == batch.column("doc_id").to_pylist()
    assert np.allclose(found["score"], np.where(known, mean.max(axis=1), 0), atol=1e-6)
    assert found["lang_pred"].to_pylist() == [model.langs[b] if k else "und" for b, k in zip(mean.argmax(axis=1), known, strict=True)]
    assert kept["doc_id"].to_pylist() == np.flatnonzero(known & (mean.max(axis=1) >= 0.4)).tolist()
    print(f"{batch.nbytes / 1e6:.1f} MB of text, {most:.0f} MB at most")
    assert batch.nbytes > 3e6 and most < 60


@pytest.mark.parametrize("whole", [False, True])
def test_words_are_given_back(monkeypatch, whole):
    if not whole:  # words are forgotten now and then
        for name, most in (("CACHED_WORDS", 500), ("CACHED_CHARS", 5000), ("CACHED_PAIRS", 300), ("READ_BYTES", 4000)):
            monkeypatch.setattr(pieces, name, most)
    vocabulary = pieces.Vocabulary.read(MODEL_PATH)
    rng = random.Random(6)
    batches = [_batch(30, 60, rng), _batch(30, 60, rng, vocabulary=50)]
    held = []
    monkeypatch.setattr(pieces.Encoder, "learn", lambda self, words, f=pieces.Encoder.learn: (held.append(len(self.words)), f(self, words))[1])
    got = pa.Table.from_batches(pieces._digest(SimpleNamespace(value=vocabulary), True)(iter(batches)))
    texts = [t for b in batches for t in b.column("text").to_pylist()]
    want = pieces.Encoder(vocabulary).encode_batch(texts)
    assert got["ids"].to_pylist() == [None if t is None else x.tolist() for t, x in zip(texts, want, strict=True)]
    assert pieces._encoder(vocabulary).words == {}
    assert whole or max(held) < 500 + 1000
