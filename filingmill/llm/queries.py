"""The registered queries of this subpackage, over the given tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontaminate, language, neighbours, personal, pieces, reputation, secrets, simhash, substrings, warc, whitening

#: The public merge model with byte fallback of this machine; any other SentencePiece model of that kind will do.
MODEL_PATH = os.environ.get("FILINGMILL_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs)).select(
        "doc_id", "n", "start", F.length("secret").alias("n_chars"), "secret", "score", "is_secret"
    )


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS first_id FROM p WHERE strlen(body) >= 1000 GROUP BY body)
SELECT p.page_id, strlen(p.body) AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN g.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g USING (body)
"""


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(_read(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
w AS (
  WITH RECURSIVE r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
  SELECT u, min(v) AS least FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(w.least, vec_id), vec_id) AS component_id, coalesce(least(w.least, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.u LEFT JOIN w ON vec_id = w.u
"""


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document with the page's number: good means quality 1 and not toxic."""
    labels = _read(spark, sf_dir, "labels")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return reputation.judge_urls(_read(spark, sf_dir, "pages"), outcomes).select(
        "page_id", "host", "path", "rule", "verdict"
    )


OP5_SQL = r"""
WITH seen AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
labelled AS (
  SELECT doc_id AS page_id, bool_and(quality = 1 AND coalesce(toxic, 0) = 0) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT host, count(good) AS n, count(*) FILTER (WHERE good) AS k FROM seen LEFT JOIN labelled USING (page_id) GROUP BY host),
named AS (
  SELECT *, regexp_replace(host, '\.?(:[0-9]*)?$', '') AS name FROM counted),
cut AS (
  SELECT *, string_split(name, '.') AS parts,
    CASE WHEN regexp_matches(name, '^[0-9.]+$|^\[') THEN 0
      WHEN regexp_matches(name, '(^|\.)(github\.io|gitlab\.io|blogspot\.com|herokuapp\.com|netlify\.app|pages\.dev|vercel\.app|web\.app|wordpress\.com)$') THEN 2
      WHEN regexp_matches(name, '(^|\.)(ac|co|com|edu|gob|gouv|go|gov|gv|mil|muni|ne|net|nom|or|org|sch)\.[a-z]{2}$') THEN 2 ELSE 1 END AS labels
  FROM named),
hosts0 AS (
  SELECT host, n, k, CASE WHEN labels = 0 THEN name ELSE array_to_string(parts[-(labels + 1):], '.') END AS domain,
    CASE WHEN labels = 0 THEN '' ELSE array_to_string(parts[-labels:], '.') END AS suffix
  FROM cut),
domains0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts0 GROUP BY domain, suffix),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains0 GROUP BY suffix),
suffixes1 AS (SELECT *, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.5) FROM suffixes0) AS prior FROM suffixes0),
rho_s AS (
  SELECT least(greatest(coalesce((sum(n * pow(k / n - prior, 2) / greatest(prior * (1 - prior), 1e-6)) - count(*)) / nullif(sum(n) - count(*), 0), 0.001), 0.001), 0.5) AS rho
  FROM suffixes1 WHERE n > 0),
suffixes AS (SELECT *, ((1 / rho - 1) * prior + k) / ((1 / rho - 1) + n) AS mean FROM suffixes1, rho_s),
domains1 AS (SELECT d.*, s.mean AS prior FROM domains0 d JOIN suffixes s USING (suffix)),
rho_d AS (
  SELECT least(greatest(coalesce((sum(n * pow(k / n - prior, 2) / greatest(prior * (1 - prior), 1e-6)) - count(*)) / nullif(sum(n) - count(*), 0), 0.001), 0.001), 0.5) AS rho
  FROM domains1 WHERE n > 0),
domains AS (SELECT *, ((1 / rho - 1) * prior + k) / ((1 / rho - 1) + n) AS mean FROM domains1, rho_d),
hosts1 AS (SELECT h.*, d.mean AS prior FROM hosts0 h JOIN domains d USING (domain)),
rho_h AS (
  SELECT least(greatest(coalesce((sum(n * pow(k / n - prior, 2) / greatest(prior * (1 - prior), 1e-6)) - count(*)) / nullif(sum(n) - count(*), 0), 0.001), 0.001), 0.5) AS rho
  FROM hosts1 WHERE n > 0),
hosts2 AS (SELECT *, 1 / rho - 1 + n AS size, ((1 / rho - 1) * prior + k) / ((1 / rho - 1) + n) AS mean FROM hosts1, rho_h),
ab AS (SELECT host, greatest(size * mean, 0.01) AS a, greatest(size * (1 - mean), 0.01) AS b FROM hosts2),
reach AS (SELECT host, a, b, ln(a / b) AS middle, 10 / sqrt(a * b / (a + b)) + 10 * (1 / a + 1 / b) AS reach FROM ab),
grid AS (SELECT host, a, b, middle, reach, i, middle - reach + 2 * reach / 512 * i AS x FROM reach, (SELECT unnest(generate_series(0, 512)) AS i)),
dens AS (
  SELECT host, x, reach, i, exp(a * x - (a + b) * (greatest(x, 0) + ln(1 + exp(-abs(x)))) - (a * middle - (a + b) * (greatest(middle, 0) + ln(1 + exp(-abs(middle)))))) AS d FROM grid),
cum AS (SELECT host, x, reach, i, d, sum(d) OVER (PARTITION BY host ORDER BY i) AS c, sum(d) OVER (PARTITION BY host) AS t FROM dens),
hosts AS (SELECT host, 1 / (1 + exp(-arg_min(x - 2 * reach / 512 * (0.5 - (0.05 * t - c + d) / d), i))) AS lower_bound FROM cum WHERE c >= 0.05 * t GROUP BY host),
rules(rule, verdict, own, rest) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'allow', 'example.org', '/en/1'),
    ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
ruled AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM seen) s JOIN rules r ON (s.host = r.own OR ends_with(s.host, '.' || r.own)) AND starts_with(s.path, r.rest)
  GROUP BY host, path)
SELECT s.page_id, s.host, s.path, r.rule, coalesce(r.verdict, CASE WHEN h.lower_bound >= 0.6 THEN 'allow' ELSE 'block' END) AS verdict
FROM seen s JOIN hosts h USING (host) LEFT JOIN ruled r ON s.host = r.host AND s.path = r.path
"""


def op6_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT r, s, md5(array_to_string(w[s + 1 : s + 35], ' ')) AS h
  FROM (SELECT r, w, unnest(generate_series(0, len(w) - 35)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, unnest(generate_series(s, s + 34)) AS x FROM g SEMI JOIN rep USING (h)),
wd AS (SELECT r, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS x FROM d),
k AS (SELECT wd.r, string_agg(word, ' ' ORDER BY wd.x) AS kept, count(*) AS n FROM wd ANTI JOIN cov ON wd.r = cov.r AND wd.x = cov.x GROUP BY wd.r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def op7_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + 10], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(generate_series(0, len(w) - n)) AS s FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT g.r, g.n, g.s, p.item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS x FROM (SELECT DISTINCT r, n, s FROM h)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS v FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)
"""


def op8_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(_read(spark, sf_dir, "documents"), MODEL_PATH)


def op10_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    return chat.conversation_digest(chat.prefix_target_examples(conversations.unionByName(extra)))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS cnt,
    length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS n_text,
    length(replace(replace(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'), '\', '\s'), chr(10), '\n')) AS n_role
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
r AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN n_text + 7 ELSE n_text + n_role + 14 END) OVER (PARTITION BY conv_id ORDER BY n) AS prefix_chars FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix_chars) FILTER (WHERE role = 'assistant' OR n = cnt) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

def op11_whitening_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
      + 4 * CAST(100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 5 * length(w.t) AS INT)
      + 8 * CAST(regexp_matches(w.t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > least, false) AS INT) AS mask
  FROM w JOIN firsts USING (t) LEFT JOIN said ON w.doc_id = said.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, CAST(step AS INT) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    coalesce(list_sum(list_transform(generate_series(1, step - 1), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS earlier
  FROM o, (SELECT unnest(generate_series(1, 5)) AS step)),
r AS (
  SELECT part, filter_order, step, bit, CAST(sum(n) FILTER (WHERE mask & (earlier | bit) = 0) AS BIGINT) AS kept,
    CAST(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (WHERE mask & earlier <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (WHERE mask = bit) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0) AS BIGINT) AS good_lost,
    CAST(sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
  coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

def op13_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = personal.identify(docs, personal.train(docs))
    order = F.array(*(F.lit(k) for k in personal.KINDS))
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    placed = lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["start"].alias("start"), said(x).alias("said"))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, placed)), lambda x: x["said"]), ",")
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    return found.select(
        "doc_id",
        *(F.expr(f"size(filter(base, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in personal.KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", F.transform("added", plain))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


QUERIES = {
    "op1_secret_forest": op1_secret_forest,
    "op2_warc_zstd": op2_warc_zstd,
    "op3_nn_descent": op3_nn_descent,
    "op4_crf_language": op4_crf_language,
    "op5_host_reputation": op5_host_reputation,
    "op6_debruijn_substrings": op6_debruijn_substrings,
    "op7_positional_decontamination": op7_positional_decontamination,
    "op8_simhash_anchors": op8_simhash_anchors,
    "op9_shared_prefix_pieces": op9_shared_prefix_pieces,
    "op10_prefix_target_chat": op10_prefix_target_chat,
    "op11_whitening_blocks": op11_whitening_blocks,
    "op12_filter_diagrams": op12_filter_diagrams,
    "op13_skip_chain_pii": op13_skip_chain_pii,
}
ORACLE_SQL = {"op3_nn_descent": OP3_SQL, "op6_debruijn_substrings": OP6_SQL, "op7_positional_decontamination": OP7_SQL, "op2_warc_zstd": OP2_SQL, "op5_host_reputation": OP5_SQL, "op10_prefix_target_chat": OP10_SQL, "op12_filter_diagrams": OP12_SQL}
