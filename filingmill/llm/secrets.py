"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a private key block of any length, a value of 6 or more characters that is assigned to a key word (in quotes all of a line up to
the same quote, else up to a space, comma, semicolon, quote or angle bracket, without full stops and closing brackets at its end), or a run of
16 or more key characters, with or without digits. Its features are its length and make-up, character transitions (also: how many
of its letter pairs are usual in the corpus), how much of it frequent words of the corpus cover, whether it stands in a
path, an address or a host name, and its neighbouring words. Which neighbouring words speak for or against a secret is learned.
The forest (pyspark.ml) is fitted on labelled findings and then written out as SQL expressions, so that scoring is row-local: no
shuffle, no row id, no skew.

Labelled findings: pass your own (label, left, secret, right). Otherwise they are made: EXAMPLES values of each kind in
POSITIVE and NEGATIVE, built by rule from hashes, each put into a place of the corpus (at most CONTEXTS of them, by hash order). A label
follows from the kind alone, never from a feature. The corpus's own candidates stay unlabelled.

Defined results: null or empty text has no findings; a very long text is scanned whole; repeated rows are scanned each;
an empty table gives no rows; columns other than doc_id and text are not returned. Context reaches no further than the
candidate before.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import staged

#: Words that stand before a key.
KEY_WORDS = "token|secret|pass|pwd|api|apikey|key|auth|bearer|credential|private|access|client|signature|session"
_C = r"A-Za-z0-9_+/.~\-"
_BODY = r"[A-Za-z0-9+/=:,.@()<>\s]*+"
_ASSIGNED = rf"(?i:{KEY_WORDS})[A-Za-z_\-]{{0,20}}[\"'\]]?\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}"
QUOTES, QUOTED_CHARS = "\"'`", 4096
CANDIDATE = (
    rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----{_BODY}(?:-(?!----){_BODY})*+-----END [A-Z ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?<=[{QUOTES}])(?<={_ASSIGNED}[{QUOTES}])(?:" + "|".join(rf"(?<={q})[^{q}\r\n]{{6,{QUOTED_CHARS}}}+(?={q})" for q in QUOTES) + ")"
    rf"|(?<=[=:>\s\"'`])(?<=[=:]>?\s{{0,3}}[\"'`]?)(?<={_ASSIGNED}[\"'`]?)"
    r"[^\s\"'`<>,;]{5,}[^\s\"'`<>,;.)\]}]"
    rf"|(?<![{_C}])[{_C}]{{16,}}+={{0,2}}"
)
LEFT_CHARS, RIGHT_CHARS = 60, 20
EXAMPLES, CONTEXTS = 150, 1000
DICTIONARY_WORDS, USUAL_PAIRS = 300, 150
#: At most so many neighbouring words of each sort are learned; of so many words before a candidate.
NEIGHBOURS, WORDS_BEFORE, LEAST_SEEN = 40, 3, 12
TREES, DEPTH, SEED = 30, 5, 7
THRESHOLD = 0.5
MASK = "[SECRET]"

FEATURES = (
    "n_chars", "digits", "uppers", "lowers", "symbols", "hex_only", "digit_only", "distinct", "digit_letter", "case_change",
    "vowel_consonant", "repeats", "usual_pairs", "covered", "has_slash", "after_slash", "has_at", "dotted", "extension", "near_secret", "near_other", "assigned",
    "quoted", "closed", "block", "spaces",
)


class Words(NamedTuple):
    """What is learned beside the forest."""

    dictionary: list[str]
    pairs: list[str]
    near_secret: list[str]
    near_other: list[str]


class Model(NamedTuple):
    forest: list
    words: Words


def _share(secret: Column, pattern: str) -> Column:
    return F.regexp_count(secret, F.lit(pattern)) / F.length(secret)


def words_before(left: Column) -> Column:
    """The last words before a candidate, lower-cased."""
    words = F.array_remove(F.split(F.lower(left), r"[^\p{L}]+"), "")
    return F.array_distinct(F.slice(words, F.greatest(F.size(words) - WORDS_BEFORE + 1, F.lit(1)), F.lit(WORDS_BEFORE)))


def features(left: Column, secret: Column, right: Column, words: Words) -> dict[str, Column]:
    """Each feature as a double."""
    flag = lambda c: c.cast("int").cast("double")
    known = "|".join(sorted(words.dictionary, key=lambda w: (-len(w), w)))
    uncovered = F.regexp_replace(F.lower(secret), known, "") if known else secret
    of = lambda found: F.array(*map(F.lit, found)).cast("array<string>")
    near = lambda found: F.size(F.array_intersect(words_before(left), of(found))).cast("double")
    return {
        "n_chars": F.least(F.length(secret), F.lit(400)).cast("double"),
        "digits": _share(secret, "[0-9]"),
        "uppers": _share(secret, "[A-Z]"),
        "lowers": _share(secret, "[a-z]"),
        "symbols": _share(secret, "[^A-Za-z0-9]"),
        "hex_only": flag(secret.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "digit_only": flag(secret.rlike(r"^[0-9.\-+/]+$")),
        "distinct": F.size(F.array_distinct(F.split(secret, ""))) / F.least(F.length(secret), F.lit(64)),
        "digit_letter": _share(secret, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "case_change": _share(secret, "[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_consonant": _share(F.lower(secret), "[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"),
        "repeats": _share(secret, r"(.)(?=\1)"),
        "usual_pairs": _share(F.lower(secret), f"(?={'|'.join(words.pairs)})") if words.pairs else F.lit(0.0),
        "covered": 1 - F.length(uncovered) / F.length(secret),
        "has_slash": _share(secret, "/"),
        "after_slash": flag(left.rlike(r"[/\\]$") | left.rlike(r"://\S*$")),
        "has_at": flag(left.rlike(r"@$") | right.startswith("@")),
        "dotted": _share(secret, r"\."),
        "extension": flag(secret.rlike(r"\.[A-Za-z]{2,4}$")),
        "near_secret": near(words.near_secret),
        "near_other": near(words.near_other),
        "assigned": flag(left.rlike(r"(?:[=:]|=>)\s*[\"'`]?$")),
        "quoted": flag(left.rlike("[\"'`]$")),
        "closed": flag(right.rlike("^[\"'`;,]")),
        "block": flag(secret.startswith("-----BEGIN")),
        "spaces": _share(secret, r"[\s,;]"),
    }


def _struct(left: Column, secret: Column, right: Column, words: Words) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in features(left, secret, right, words).items()))


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def candidates(text: Column) -> Column:
    """array<struct<gap, secret, left, right>>; the last has the rest of the text as gap and no secret. Null for a text
    without candidates."""

    def joined(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("secret"), F.right(g, F.lit(LEFT_CHARS)).alias("left")))
        with_right = F.zip_with(
            pairs, F.slice(gaps, F.lit(2), F.size(gaps)),
            lambda x, after: F.struct(x.gap.alias("gap"), x.secret.alias("secret"), x.left.alias("left"), F.coalesce(F.left(after, F.lit(RIGHT_CHARS)), F.lit("")).alias("right")),
        )
        return F.when(F.size(gaps) > 1, with_right)

    return _let(F.split(text, CANDIDATE, -1), joined)


def corpus_words(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Over all texts, by number and then by name: the most frequent words of three to six letters a-z, and the most frequent
    pairs of letters in words of up to twelve."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w RLIKE '^[a-z]{2,12}$'")
    counted = staged(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    top = counted.filter("length(w) BETWEEN 3 AND 6").orderBy(F.desc("n"), "w").limit(DICTIONARY_WORDS).collect()  # bounded
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p")
    pairs = counted.select(pair, "n").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(USUAL_PAIRS).collect()
    return [r.w for r in top], sorted(r.p for r in pairs)


def contexts(docs: DataFrame) -> DataFrame:
    """n, before, after: what stands beside some word break of some texts, at most CONTEXTS of them by hash order."""
    at = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text"), F.lit(1))).cast("int") + 1
    cut = docs.filter("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("h"), F.substr("text", at, F.lit(LEFT_CHARS + RIGHT_CHARS)).alias("t"))
    cut = cut.select("h", F.regexp_replace(F.left("t", F.lit(LEFT_CHARS)), r"\S+$", "").alias("before"), F.regexp_extract(F.right("t", F.lit(RIGHT_CHARS)), r"(?s)\s.*", 0).alias("after"))
    some = staged(cut.orderBy("h", "before", "after").limit(CONTEXTS), "contexts")  # bounded: so many short strings
    number = F.row_number().over(W.orderBy("h", "before", "after")) - 1
    return staged(some.select(number.cast("long").alias("n"), "before", "after"), "places")


def _kinds(words: list[str], n: Column, h: Column) -> tuple[dict, dict]:
    """(positive, negative): name of the kind to (text before, value, text after), from a number and a hash (128 hex digits)."""
    b64 = F.translate(F.base64(F.unhex(h)), "=", "")
    alnum, letters = F.translate(b64, "+/", "xY"), F.translate(b64, "0123456789+/", "")
    digits = F.translate(h, "abcdef", "012345")
    cut = lambda c, least, spread: F.substr(c, F.lit(1), (least + F.pmod(F.xxhash64(n), F.lit(spread))).cast("int"))
    listed = F.split(F.lit(" ".join(words or ["word", "other", "there"])), " ")
    word = lambda k: F.element_at(listed, (F.pmod(F.xxhash64(h, F.lit(k)), F.size(listed)) + 1).cast("int"))
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(h), F.lit(len(options))) + 1).cast("int"))
    some = lambda k, sep="": F.array_join(F.slice(F.array(*(word(i) for i in range(6))), F.lit(1), (k + F.pmod(n, F.lit(6 - k + 1))).cast("int")), sep)
    name = pick("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "key", "auth_token", "credential", "private_key", "access_key", "client_secret", "signature", "session_key")
    given = F.concat(name, pick(" = ", "=", ": ", ":", " := ", '": "', ' = "', '="', "='"))
    maybe = F.when(F.pmod(n, F.lit(3)) > 0, given).otherwise("")
    close = pick('"', "", "\n", ";", "'", " ")
    positive = {
        "hex": (maybe, cut(h, 16, 49), close),
        "upper_hex": (maybe, F.upper(cut(h, 24, 41)), close),
        "base64": (maybe, cut(b64, 24, 60), close),
        "cloud_id": (F.when(F.pmod(n, F.lit(3)) == 0, given).otherwise(""), F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(alnum, "0189", "QRST"), 1, 16))), close),
        "forge_token": (maybe, F.concat(pick("ghp_", "gho_", "glpat-", "sk_live_", "xoxb-"), F.substring(alnum, 1, 36)), close),
        "web_token": (F.when(n % 2 == 0, "Authorization: Bearer ").otherwise(maybe), F.concat(F.lit("eyJ"), cut(alnum, 20, 20), F.lit("."), F.substring(alnum, 30, 30), F.lit("."), F.substring(alnum, 5, 40)), close),
        "letters": (maybe, cut(letters, 24, 15), close),
        "lower_letters": (given, F.lower(cut(letters, 16, 17)), close),
        "mixed_password": (given, F.concat(cut(alnum, 5, 6), pick("!", "$", "#x", "%7", "&", "@9"), F.substring(digits, 1, 3)), close),
        "word_password": (given, F.concat(F.initcap(word(1)), F.when(n % 2 == 0, word(2)).otherwise(""), F.substring(digits, 1, 4), pick("!", "#", "$", "?", "!!")), close),
        "phrase": (F.concat(name, pick('": "', ' = "', '="', '": "')), F.concat(word(1), pick("@", "$", "", "!"), cut(alnum, 2, 3), pick(" ", ",", ";", ", ", "; "), word(2), F.substring(digits, 1, 3)), F.lit('"')),
        "key_block": (F.lit(""), F.concat(F.lit("-----BEGIN "), pick("", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), b64, F.lit("\n"), F.substring(b64, 9, 50), F.lit("\n-----END "), pick("", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----")), F.lit("\n")),
    }
    negative = {
        "card": (pick("", "card ", "order no. ", "account: "), F.when(n % 2 == 0, F.substring(digits, 1, 16)).otherwise(F.concat_ws("-", *(F.substring(digits, 1 + 4 * i, 4) for i in range(4)))), F.lit(" ")),
        "phone": (pick("call ", "tel: ", "+"), F.concat(F.substring(digits, 1, 2), pick("-555-", ".555.", "-"), F.substring(digits, 4, 3), pick("-", "."), F.substring(digits, 8, 8)), F.lit(" ")),
        "mail_host": (F.concat(word(1), pick("@", ".7@", ".42@")), F.concat(some(1), F.substring(digits, 1, 1), pick(".example.com", ".mail-server.org", ".company.net")), pick(" ", ".", ",")),
        "path": (pick("see ", "in ", "", 'file = "', "./"), F.concat(some(2, "/"), pick("/figure-", "/images/", "/v"), F.substring(digits, 1, 2), pick(".png", ".html", ".tar.gz", "")), pick(" ", '"', ".")),
        "address": (pick("https://", "http://", "url: https://"), F.concat(F.lit("www."), some(1), F.lit(".org/"), some(2, "-"), F.lit("/"), F.substring(digits, 1, 5)), pick(" ", ")", '"')),
        "time": (pick("on ", "date: ", "", "timestamp="), F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-1"), F.substring(digits, 4, 1), F.lit("T10-00-"), F.substring(digits, 5, 2)), F.lit(" ")),
        "compound": (F.lit(""), F.concat(F.when(F.pmod(n, F.lit(4)) == 0, F.initcap(some(4))).when(F.pmod(n, F.lit(9)) == 1, F.upper(some(4))).otherwise(some(4)), pick("", "", ".", "-", "...")), F.lit(" ")),
        "long_word": (F.lit(""), F.concat(some(4), F.substring(word(7), 1, 3)), pick(" ", ", ", ". ")),
        "edition": (F.lit("the "), F.concat(some(3), F.substring(digits, 1, 4), word(5)), F.lit(" ")),
        "identifier": (pick("", "def ", "the "), F.concat(some(3, "_"), pick("", "_id", "_2")), pick("(", " ", " =")),
        "release": (pick("", "version: ", "release "), F.concat(some(2, "-"), F.lit("-"), F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2), F.lit(".0-rc"), F.substring(digits, 5, 1)), F.lit(" ")),
        "rule": (pick("", "\n"), F.repeat(pick("-", "_", ".", "~", "-.", "/"), (12 + F.pmod(n, F.lit(30))).cast("int")), F.lit("\n")),
        "number": (F.lit(""), F.concat(F.substring(digits, 1, 9), F.lit("."), F.substring(digits, 10, 9)), F.lit(" ")),
        "quoted_words": (F.concat(pick("key", "session", "access", "client", "password hint", "authors", "private", "pass"), pick(' = "', ': "', '="', '": "')), F.concat(F.initcap(word(3)), F.lit(" "), some(2, " "), pick("", ".", ", " , " 2")), F.lit('"')),
        "assigned_word": (F.concat(pick("key", "token", "session", "access", "client", "password", "signature", "authors", "keyword"), pick(": ", ":", " = ")), F.concat(some(2), pick("", "ing", "ed")), pick(" ", ".", ",")),
    }
    return positive, negative


def made_findings(spark: SparkSession, words: list[str], places: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """kind, label, left, secret, right: EXAMPLES values of each kind but those named, in places of the corpus. places: n,
    before, after (see contexts)."""

    def value(h: Column) -> Column:
        kinds = [(label, kind, parts) for label, side in zip((1.0, 0.0), _kinds(words, F.col("id"), h), strict=True) for kind, parts in side.items()]
        return F.coalesce(*(F.when(F.col("kind") == kind, F.struct(F.lit(label).alias("label"), *(c.alias(n) for n, c in zip("bva", parts, strict=True)))) for label, kind, parts in kinds))

    names = [kind for side in _kinds(words, F.col("id"), F.col("h")) for kind in side if kind not in without]
    rows = spark.range(0, EXAMPLES, 1, 1).select("id", F.explode(F.split(F.lit(" ".join(names)), " ")).alias("kind"))
    rows = rows.withColumn("h", F.sha2(F.concat("kind", F.lit(":"), F.col("id").cast("string")), 512))
    # As a function of the hash the long choice among kinds is interpreted: compiled as one expression it is too long.
    rows = rows.select("kind", "h", _let(F.col("h"), value).alias("x")).select("kind", "h", "x.*")
    rows = rows.withColumn("n", F.pmod(F.xxhash64("h"), F.lit(max(1, places.count()))))
    rows = rows.join(F.broadcast(places), "n", "left")  # places: at most CONTEXTS short rows
    left = F.right(F.concat(F.coalesce("before", F.lit("")), F.col("b")), F.lit(LEFT_CHARS))
    right = F.left(F.concat(F.col("a"), F.coalesce("after", F.lit(""))), F.lit(RIGHT_CHARS))
    return rows.select("kind", "label", left.alias("left"), F.col("v").alias("secret"), right.alias("right"))


def neighbour_words(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """Words before labelled findings that speak for a secret, and against one: the largest log odds, of words
    seen LEAST_SEEN times."""
    word = labelled.select("label", F.explode(words_before(F.col("left"))).alias("w"))
    totals = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = lambda label: (F.count_if(F.col("label") == label) + 1) / (totals.get(label, 0) + 2)
    odds = word.groupBy("w").agg(F.log(share(1.0) / share(0.0)).alias("odds"), F.count("*").alias("n")).filter((F.col("n") >= LEAST_SEEN) & (F.abs("odds") >= 1))
    best = lambda sign: [r.w for r in odds.filter(F.col("odds") * sign > 0).orderBy(F.desc(F.col("odds") * sign), "w").limit(NEIGHBOURS).collect()]
    return best(1), best(-1)


def fit(labelled: DataFrame, words: Words) -> tuple[RandomForestClassificationModel, DataFrame]:
    """(the forest, the assembled rows it was fitted on)"""
    f = _struct(F.col("left"), F.col("secret"), F.col("right"), words)
    table = labelled.select("label", f.alias("f")).select("label", "f.*")
    table = staged(table.orderBy("label", *FEATURES).coalesce(1), "labelled")  # one small file: the same bags each time
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows), rows


def written_out(forest: RandomForestClassificationModel) -> list:
    """The forest as a list of trees: a leaf is the share of class 1, a node (feature, threshold, at most, above)."""

    def tree(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0
        split = node.split()
        return (FEATURES[split.featureIndex()], split.threshold(), tree(node.leftChild()), tree(node.rightChild()))

    return [tree(t.rootNode()) for t in forest._java_obj.trees()]


def forest_score(forest: list, f: Column) -> Column:
    """The mean share over all trees, from a struct of features."""

    def column(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, at_most, above = node
        return F.when(f[name] <= threshold, column(at_most)).otherwise(column(above))

    total = column(forest[0])
    for tree in forest[1:]:
        total = total + column(tree)
    return total / len(forest)


def train(docs: DataFrame, labelled: DataFrame | None = None, without: tuple[str, ...] = ()) -> Model:
    """docs: doc_id, text. labelled: label, left, secret, right, used beside the made findings. without: kinds to leave out."""
    dictionary, pairs = corpus_words(docs)
    own = made_findings(docs.sparkSession, dictionary, contexts(docs), without).drop("kind")
    if labelled is not None:
        own = own.unionByName(labelled.select("label", "left", "secret", "right"))
    own = staged(own, "findings")
    words = Words(dictionary, pairs, *neighbour_words(own))
    return Model(written_out(fit(own, words)[0]), words)


def score(left: Column, secret: Column, right: Column, model: Model) -> Column:
    """The forest's share of votes for a secret."""
    return _let(_struct(left, secret, right, model.words), lambda f: forest_score(model.forest, f))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. A row per candidate: doc_id, n (from 1), start (code points before it), secret, left, right,
    score, is_secret."""
    found = docs.select("doc_id", candidates(F.col("text")).alias("_c")).filter("_c IS NOT NULL")
    # Prefix sums by blocks of about the root of the number of candidates: cheap for texts full of them, too.
    found = found.withColumn("_l", F.expr("transform(_c, x -> length(x.gap) + coalesce(length(x.secret), 0))"))
    found = found.withColumn("_k", F.expr("cast(ceil(sqrt(size(_l))) AS int)"))
    found = found.withColumn("_b", F.expr("transform(sequence(0, size(_l) div _k), j -> aggregate(slice(_l, cast(j * _k + 1 AS int), _k), 0L, (s, v) -> s + v))"))
    found = found.withColumn("_s", F.expr("transform(sequence(0, size(_b) - 1), j -> aggregate(slice(_b, 1, j), 0L, (s, v) -> s + v))"))
    one = found.select("doc_id", "_l", "_k", "_s", F.posexplode("_c").alias("_i", "_x")).filter("_x.secret IS NOT NULL")
    start = F.expr("_s[cast(_i div _k AS int)] + aggregate(slice(_l, cast(_i div _k AS int) * _k + 1, _i % _k), 0L, (s, v) -> s + v) + length(_x.gap)")
    f = _struct(F.col("_x.left"), F.col("_x.secret"), F.col("_x.right"), model.words)
    one = one.select("doc_id", (F.col("_i") + 1).alias("n"), start.alias("start"), "_x.secret", "_x.left", "_x.right", f.alias("_f"))
    return one.withColumn("score", forest_score(model.forest, F.col("_f"))).drop("_f").withColumn("is_secret", F.col("score") >= THRESHOLD)


def redact(text: Column, model: Model, mask: str = MASK) -> Column:
    """text with every secret replaced by mask; a text without secrets stays as it is, null stays null."""
    parts = F.transform(
        candidates(text),
        lambda x: F.concat(x.gap, F.when(x.secret.isNull(), "").when(score(x.left, x.secret, x.right, model) >= THRESHOLD, mask).otherwise(x.secret)),
    )
    return F.coalesce(F.array_join(parts, ""), text)
