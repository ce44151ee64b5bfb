import itertools
import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from filingmill.llm import language, pieces, secrets
from filingmill.llm.queries import MODEL_PATH

WORDS = {
    "en": "the and of that with from have this will report annual growth shares board meeting".split(),
    "fr": "le les des une avec dans pour cette rapport croissance réunion conseil être été".split(),
    "de": "der die das und nicht mit eine für bericht wachstum sitzung über größe straße".split(),
}


def _texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(5, 80))), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(n))]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 64, 65, 130, 700, 0, 3]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores, moves, start = rng.normal(size=(bounds[-1], 4)).astype(np.float32) * 2, rng.normal(size=(4, 4)), rng.normal(size=4)
    got = language.posteriors(scores, bounds, moves, start)
    total = lambda m, axis: np.log(np.exp(m - m.max()).sum(axis)) + m.max()
    for i, j in zip(bounds, bounds[1:], strict=False):
        if i == j:
            continue
        x, n = scores[i:j].astype(float), j - i
        a, b = np.zeros((n, 4)), np.zeros((n, 4))
        a[0] = start + x[0]
        for t in range(1, n):
            a[t] = x[t] + total(a[t - 1][:, None] + moves, 0)
        for t in range(n - 2, -1, -1):
            b[t] = total(moves + x[t + 1] + b[t + 1], 1)
        p = np.exp(a + b - (a + b).max(1, keepdims=True))
        assert np.abs(p / p.sum(1, keepdims=True) - got[i:j]).max() < 1e-5


def test_gradient_equals_differences_of_the_likelihood(monkeypatch):
    """Against the log-likelihood by enumeration of all label sequences."""
    rng = np.random.default_rng(3)
    langs, words, labels, bounds = ["a", "b", "c"], "ab bc cab abc b ca".split(), np.array([0, 1, 1, 2, 0, 2]), np.array([0, 4, 4, 5, 6])
    monkeypatch.setattr(language, "WIDTH", 64)
    model = language.Model(langs, rng.normal(size=(65, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), {"abc": 1})
    model.weights[64] = 0

    def likelihood():
        scores, total = language.emissions(model, words).astype(float), 0.0
        for i, j in zip(bounds, bounds[1:], strict=False):
            if i == j:
                continue
            of = lambda y, i=i: model.start[y[0]] + sum(scores[i + t, c] for t, c in enumerate(y)) + sum(model.transitions[p, q] for p, q in zip(y, y[1:], strict=False))
            total += of(labels[i:j]) - np.log(sum(np.exp(of(y)) for y in itertools.product(range(3), repeat=j - i)))
        return total

    found = language.gradient(model, words, labels, bounds)
    for x, g in zip((model.weights, model.transitions, model.start), found, strict=True):
        for at in np.ndindex(*x.shape):
            if x is model.weights and at[0] == 64:
                continue
            before, step = x[at], 1e-2
            x[at] = before + step
            up = likelihood()
            x[at] = before - step
            down = likelihood()
            x[at] = before
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_words_are_letters():
    assert language.words_of("x²½y 1/½ Ⅻ ª Straße_ÉTÉ") == ["x", "y", "ª", "straße", "été"]
    assert language.words_of("½ ² ③ 12 _") == [] and language.words_of(None) == []


def test_training_reaches_into_long_texts(spark):
    text = "the and of " * 2000 + "zzzq " * 400 + "with that " * 2000
    long = next(i for i in range(12) if zlib.crc32(b"%d" % i) % 3 != 1)
    docs = spark.createDataFrame([(i, text if i == long else "the and", "en") for i in range(12)], "doc_id long, text string, lang string")
    rows = language.training_rows(docs).collect()
    assert sum(len(r.text) for r in rows if r.doc_id == long) == len(text) and any("zzzq" in r.text for r in rows)


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang in _texts(400)], "doc_id long, text string, lang string, score double")
    model = language.train(docs)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language.held_out(F.col("doc_id")))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    odd = [(1, None, None), (2, "", None), (3, "123 !!", None), (None, "the and of", None), (5, "the and of that " * 20 + "der die das und " * 20, None), (5, "le les des " * 5000, None)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    got = language.identify(df, model, with_words=True).collect()
    assert [r.lang_pred for r in got[:4]] == ["und", "und", "und", "en"] and got[5].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == 0
    switched = got[4].word_langs
    assert set(switched[:70]) == {"en"} and set(switched[90:]) == {"de"}
    kept = language.determined(df, model, 0.5)
    assert kept.columns == df.columns and kept.count() == 3 - (got[4].score < 0.5)
    assert {r.lang_pred for r in language.identify(df, language.train(docs.limit(0))).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_training_never_sees_held_out_rows(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in _texts(200)], "doc_id long, text string, lang string")
    ids = {r.doc_id for r in language.training_rows(docs).collect()}
    held = {r.doc_id for r in docs.filter(language.held_out(F.col("doc_id"))).collect()}
    assert ids and held and not ids & held


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(MODEL_PATH)


def test_pieces_equal_the_library(vocabulary):
    rng = random.Random(5)
    parts = ["a", "b", "the", "ing", "ion", " ", "  ", "\n", "é", "世", "🙂", "0", "1", ".", ",", "\t", "T", "he", "er", "ll", "nn", "aa", "▁", "https://", "　"]
    texts = ["", "a ", " a", "   a", "a    b", "▁a", "\n\n  \n", "x" * 3000, "世 世  世", "<s> </s>"] + [" " * n for n in range(1, 50)] + [" " * n + "世" + " " * n + "b" for n in range(1, 30)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    for text, ids in zip(texts, pieces.Encoder(vocabulary).encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert pieces.decode(ids.tolist(), vocabulary) == text.replace("▁", " ")


def _model_file(path, pieces, kind, byte_fallback):
    """A model file of (piece, score, type), written by hand: nothing is trained."""
    varint = lambda n: bytes([n]) if n < 0x80 else bytes([n & 0x7F | 0x80]) + varint(n >> 7)
    field = lambda n, data: varint(n << 3 | 2) + varint(len(data)) + data
    number = lambda n, value: varint(n << 3) + varint(value)
    one = lambda p, s, t: field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, t))
    settings = field(2, number(3, kind) + number(35, byte_fallback))
    normalizer = field(3, field(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))
    path.write_bytes(b"".join(one(*p) for p in pieces) + settings + normalizer)
    return str(path)


@pytest.mark.parametrize("byte_fallback", [0, 1])
def test_unigram_scores_against_the_library(tmp_path, byte_fallback):
    rng = random.Random(8)
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_fallback]
    names = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(120)} | set("abc")
    names |= {pieces.MARK + n for n in list(names)[:60]} | {pieces.MARK}
    pieces_ += [(n, -rng.random() * 12, 1) for n in sorted(names)]
    path = _model_file(tmp_path / "u.model", pieces_, 1, byte_fallback)
    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary.read(path)
    assert vocabulary.kind == pieces.UNIGRAM
    texts = ["".join(rng.choice("aabbccdd  ez世\n") for _ in range(rng.randrange(0, 40))) for _ in range(1500)] + ["", " ", "a  b", "zz z", "abcd" * 500]
    same = 0
    for text, ids in zip(texts, pieces.Encoder(vocabulary).encode_batch(texts), strict=True):
        own = library.encode(text)
        same += ids.tolist() == own
        # Pieces in another order have an equal sum, and rounding settles which the library takes.
        assert sorted(ids.tolist()) == sorted(own), text
        if byte_fallback:
            assert pieces.decode(ids.tolist(), vocabulary) == text
    assert same > 0.9 * len(texts)


def test_models_that_are_refused(tmp_path):
    plain = [("<unk>", 0.0, 2), ("a", -1.0, 1), (pieces.MARK, -1.0, 1)]
    with pytest.raises(ValueError, match="type 4"):
        pieces.Vocabulary.read(_model_file(tmp_path / "c.model", plain, 4, 0))
    with pytest.raises(ValueError, match="beyond"):
        pieces.Vocabulary.read(_model_file(tmp_path / "w.model", [*plain, ("a" + pieces.MARK, -1.0, 1)], 1, 0))


def test_round_trip_is_told_truly(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a▁b"), (3, None)], "doc_id long, text string")
    got = pieces.encode_digest(df, MODEL_PATH, with_ids=True).collect()
    assert [r.round_trip for r in got] == [True, False, True] and got[2].ids is None and len(got[0].ids) == got[0].n_pieces


def test_nul_survives(vocabulary):
    text = "a\x00b \x00"
    assert pieces.decode(pieces.Encoder(vocabulary).encode_batch([text])[0].tolist(), vocabulary) == text


def test_pieces_on_tables(spark, vocabulary):
    rows = [(1, "Hello  world\n x"), (2, ""), (3, None), (None, "a"), (4, "word " * 30000), (4, "word " * 30000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    encoded = pieces.encode(df, MODEL_PATH)
    assert [r.text for r in pieces.decode_table(encoded, MODEL_PATH).collect()] == [t for _, t in rows]
    digest = pieces.encode_digest(df, MODEL_PATH).collect()
    assert all(r.round_trip for r in digest) and [r.n_pieces for r in digest][:3] == [5, 0, 0]
    assert pieces.encode(df.limit(0), MODEL_PATH).count() == 0


@pytest.fixture(scope="module")
def secret_corpus(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(sum(WORDS.values(), [])) for _ in range(30)) + f" jo.{i}@mail{i % 9}.example.com or {4000000000000000 + i * 7919}") for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def secret_model(secret_corpus):
    return secrets.train(secret_corpus)


def test_column_forest_equals_the_models_own(spark, secret_corpus, secret_model):
    made = secrets.made_findings(spark, secret_model.words.dictionary, secrets.contexts(secret_corpus))
    forest, rows = secrets.fit(made.drop("kind"), secret_model.words)
    own = forest.transform(rows).select(vector_to_array("probability")[1].alias("p"), *secrets.FEATURES)
    column = secrets.forest_score(secrets.written_out(forest), F.struct(*secrets.FEATURES))
    assert own.select(F.max(F.abs(column - F.col("p")))).first()[0] < 1e-9
    assert own.select(F.count("*")).first()[0] == made.count()


@pytest.mark.parametrize("kind", ["cloud_id", "mixed_password", "mail_host"])
def test_kinds_not_trained_on(spark, secret_corpus, kind):
    """Recall of positive kinds, and specificity for negative ones, that the forest has never seen."""
    model = secrets.train(secret_corpus, without=(kind,))
    made = secrets.made_findings(spark, model.words.dictionary, secrets.contexts(secret_corpus)).filter(F.col("kind") == kind)
    right = (secrets.score(F.col("left"), F.col("secret"), F.col("right"), model) >= secrets.THRESHOLD) == (F.col("label") == 1)
    assert made.select(F.avg(right.cast("int"))).first()[0] > 0.8


def test_candidates_of_every_form(spark):
    block = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x-1\n\n" + "QUJD+/=\n" * 9000 + "-----END PGP PRIVATE KEY BLOCK-----"
    cases = {
        'password = "hunter2!x9"': ["hunter2!x9"], "my passwd:letmein": ["letmein"], "pwd = abcdefghijklmnopqrstuvwx": ["abcdefghijklmnopqrstuvwx"],
        "see ABCDEFGHijklmnopQRSTuvwxABCDEFGHijklmn there": ["ABCDEFGHijklmnopQRSTuvwxABCDEFGHijklmn"], f"a {block} b": [block], "a short word = x": [],
        '{"api_key": "Zx9$kkk", "n": 1}': ["Zx9$kkk"], "-----BEGIN PRIVATE KEY-----\nnever ends " * 50: [], "api_key = 'a1b2c3d4e5f6'; token=Summer2024!": ["a1b2c3d4e5f6", "Summer2024!"], "": [],
        "password = hunter2!x9)": ["hunter2!x9"], "(token=abc123)": ["abc123"], "{password: Summer24!}": ["Summer24!"], "password: Summer2024!.": ["Summer2024!"], "pwd=abcdefg]": ["abcdefg"],
        "token=abcdefgh12.": ["abcdefgh12"], 'secret: "p@ss word1"': ["p@ss word1"], 'pass="ab,cd;ef12gh" x': ["ab,cd;ef12gh"], "auth: 'it\"s a; word 9'": ['it"s a; word 9'], "key=`a b c d`": ["a b c d"],
        "token=abc12": [], "(pwd: abc12)": [], 'secret = "never closed 12': [], 'secret = "neverclosed12': ["neverclosed12"], 'token="abc\ndef"': [], "token=((((((((((": ["(" * 10], "token=....}}}}]]]": [], "pwd=" + ")" * 5000 + "x": [")" * 5000 + "x"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string").select("text", secrets.candidates(F.col("text")).alias("c"))
    for r in df.collect():
        assert [x.secret for x in r.c or [] if x.secret is not None] == cases[r.text], r.text[:60]
        if r.c:
            assert "".join(x.gap + (x.secret or "") for x in r.c) == r.text


def test_neighbour_words_are_learned(spark):
    rows = [(1.0, f"see vault {i} entry ", "x", "") for i in range(30)] + [(0.0, f"see ticket {i} entry ", "x", "") for i in range(30)]
    found = secrets.neighbour_words(spark.createDataFrame(rows, "label double, left string, secret string, right string"))
    assert found == (["vault"], ["ticket"])


def test_secrets_found_and_masked(spark, secret_model):
    key, card = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "4111111111111111"
    rows = [
        (1, f'token = "{key}"'), (2, f"card {card} and docs/images/figure-12345.png"), (3, None), (4, ""), (5, "no candidates at all"),
        (6, f'é {card} x token = "{key}" y token = "{key}"'), (6, f'é {card} x token = "{key}" y token = "{key}"'), (None, f'token = "{key}"'),
        (7, "w " * 20000 + f'token = "{key}"'), (8, f"{card} " * 300),
    ]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, score double")
    found = secrets.scan(df, secret_model).collect()
    texts = dict(rows)
    for r in found:
        assert texts[r.doc_id][r.start : r.start + len(r.secret)] == r.secret
        assert r.is_secret == (r.secret == key)
    assert sum(r.is_secret for r in found) == 7
    masked = df.select("doc_id", secrets.redact(F.col("text"), secret_model).alias("t")).collect()
    for (_, text), r in zip(rows, masked, strict=True):
        assert r.t == (text.replace(key, secrets.MASK) if text else text)


def test_secrets_without_rows_or_findings(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = secrets.train(empty)
    assert secrets.scan(empty, model).count() == 0
