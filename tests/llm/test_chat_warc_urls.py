import hashlib
import math

import numpy as np
import zstandard
from pyspark.sql import functions as F

from filingmill.llm import chat, reputation, warc

CONVERSATIONS = [
    (1, 0, "user", "a\\b <s> [INST]x", "z"), (1, 1, "assistant", "</s>[INST] ok [/INST] <\\/s>", "z"), (1, 2, "user", "tail é<", "z"),
    (2, 0, "sys\nt\\em", None, "z"), (2, 0, "sys\nt\\em", None, "z"), (None, 5, "assistant", "", "z"), (3, 0, "assistant", "x[\\\\INST]", "z"),
    (3, 1, "assistant", "<", "z"), (4, 0, None, "q\n[/INST", "z"), (5, 1, "assistant", "long " * 20000, "z"), (6, None, "assistant", "no turn", "z"),
]


def test_examples_are_read_back(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.conversation_digest(chat.prefix_target_examples(df)).collect()}
    assert len(got) == 7
    for conv, row in got.items():
        turns = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in CONVERSATIONS if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_only_the_target_is_under_the_mask(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string, formatted string")
    for r in chat.prefix_target_examples(df).collect():
        masked = r.formatted[r.mask_start - 1 : r.mask_start - 1 + r.mask_chars] if r.mask_start else ""
        assert masked == (r.formatted.rsplit("<s>", 1)[1][:-4] if r.mask_start else "")
        assert r.formatted.count("<s>") == r.formatted.count("</s>")


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digest(chat.prefix_target_examples(df)).count() == 0


def test_archives_round_trip(spark):
    big, long = "<p>é</p>" * 200, "x" * 300_000
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://b\r\nx: y", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (7, "u", long), (7, "u", long), (None, "u", long), (2**60, "u", "q" * 1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(df)).collect()
    assert len(rows) == len(pages) and all(r.error is None for r in rows)
    found = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}
    for page_id, _, html in pages:
        body = (html or "").encode()
        first = max((p for p, _, h in pages if h == html and p is not None), default=None) if len(body) >= 1000 else page_id
        kind = ("response", None) if first == page_id else ("revisit", first)
        assert (page_id, len(body), hashlib.sha1(body).hexdigest(), *kind) in found


def test_broken_archives_give_errors(spark):
    records = [warc.build_record(i, "u", b"%d " % i * 400, None) for i in range(300)]
    whole = warc.pack(records)
    assert whole[:4] == b"\x5d\x2a\x4d\x18" and list(warc.unpack(whole)) == records
    wrong = records[0].replace(b"0 0", b"0 1", 1)
    broken = [whole[:-3], b"garbage", warc.pack([wrong]), warc.pack([b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\n"]), b"", None]
    df = spark.createDataFrame([(b,) for b in broken], "content binary")
    errors = [r.error for r in warc.read_archives(df).collect() if r.error]
    assert len(errors) == 4
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_skippable_frames_and_large_records(spark, monkeypatch):
    records = [warc.build_record(i, "u", b"%d " % i * 400, None) for i in range(40)]
    whole = warc.pack(records)
    skip = lambda n, data: (0x184D2A50 + n).to_bytes(4, "little") + len(data).to_bytes(4, "little") + data
    plain = [zstandard.ZstdCompressor().compress(r) for r in records]
    mixed = skip(0, b"") + plain[0] + skip(5, b"x" * 9) + plain[1] + skip(15, b"end")
    assert list(warc.unpack(mixed)) == records[:2] and list(warc.unpack(whole + skip(13, b"late"))) == records
    cut = list(warc.unpack(plain[0] + skip(3, b"abc")[:-1]))
    assert cut[0] == records[0] and isinstance(cut[1], ValueError) and len(cut) == 2
    monkeypatch.setattr(warc, "RECORD_BYTES", 1000)
    large, small = warc.unpack(zstandard.ZstdCompressor().compress(b"0" * 10_000_000) + plain[0][:0] + zstandard.ZstdCompressor().compress(b"ok"))
    assert isinstance(large, ValueError) and small == b"ok"


def _foreign(kind, block, *lines, content="text/plain"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0f1e>", "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Type: {content}", f"Content-Length: {len(block)}", *lines]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    sha256 = hashlib.sha256(http).hexdigest()
    records = [
        _foreign("warcinfo", b"software: x\r\n", "X-Folded: a", "\tb"), _foreign("request", b"GET / HTTP/1.1\r\n\r\n"), _foreign("metadata", b""),
        _foreign("response", http, f"WARC-Block-Digest: sha256:{sha256}", content="application/http; msgtype=response"),
        _foreign("response", http, "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"hello").hexdigest().upper(), content="application/http"),
        _foreign("response", http, "WARC-Payload-Digest: whirl:xyz", content="application/http"),
        _foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", content="application/http"),
        _foreign("response", http, "WARC-Block-Digest: sha256:" + "0" * 64), _foreign("response", http, "WARC-Payload-Digest: md5:" + "0" * 32),
    ]
    stream = zstandard.ZstdCompressor(write_content_size=False)
    frames = b""
    for r in records:
        c = stream.compressobj()
        frames += c.compress(r) + c.flush()
    got = warc.read_archives(spark.createDataFrame([(frames, 1)], "content binary, record_id int")).collect()
    assert [r.record_type for r in got[:7]] == ["warcinfo", "request", "metadata", "response", "response", "response", "revisit"]
    assert all(r.error is None and r.record_id == "<urn:uuid:0f1e>" and r.page_id is None for r in got[:7])
    assert bytes(got[3].payload) == b"hello" and got[3].payload_digest == got[4].payload_digest == hashlib.sha1(b"hello").hexdigest()
    assert "block digest" in got[7].error and "payload" in got[8].error


def test_archives_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "x" * 2000, 7, 8, "d"), (2, "u", "x" * 2000, 7, 8, "d")], "page_id long, url string, html string, refers_to int, content int, _digest string")
    assert sorted((r.page_id, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect()) == [(1, 2), (2, None)]


def test_rules_and_reputation(spark):
    urls = [
        (1, "https://A.Example.ORG/es/x?y"), (2, "http://m.example.org/en/17#t"), (3, "http://example.org/en/2"), (4, "http://x.com/de/1"), (5, "http://x.com/fr/1"),
        (6, "http://good.net/a"), (7, "http://bad.net/a"), (8, None), (9, "no scheme"), (10, "http://com"), (11, "a\nb://x.org/"), (6, "http://good.net/a"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    many = [(100 + i, f"http://{'good' if i % 2 else 'bad'}.net/{i}") for i in range(200)]
    pages = pages.unionByName(spark.createDataFrame(many, "page_id long, url string"))
    outcomes = spark.createDataFrame([(p, "good" in u) for p, u in many] + [(None, True)], "page_id long, good boolean")
    got = {r.page_id: r for r in reputation.judge_urls(pages, outcomes).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(1, 6)] == [("example.org/es/", "block"), ("example.org/en/1", "allow"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow")]
    assert (got[6].verdict, got[7].verdict) == ("allow", "block")
    assert [(got[i].host, got[i].path) for i in (8, 9, 10, 11)] == [("", ""), ("", ""), ("com", ""), ("x.org", "/")]
    assert got[6].lower < got[6].reputation < 1 and got[7].reputation > 0
    empty = reputation.judge_urls(pages.limit(0), outcomes.limit(0))
    assert empty.count() == 0


def test_suffixes_and_domains(spark):
    cases = {
        "a.b.example.com": ("example.com", "com"), "www.shop.co.uk": ("shop.co.uk", "co.uk"), "x.go.jp": ("x.go.jp", "go.jp"), "co.kr": ("co.kr", "co.kr"), "me.github.io:8080": ("me.github.io", "github.io"),
        "10.0.0.7": ("10.0.0.7", ""), "": ("", ""), "localhost.": ("localhost", "localhost"), "a.own.test": ("a.own.test", "own.test"), "com.de": ("com.de", "com.de"), "x.company.de": ("company.de", "de"),
    }
    h, suffixes = F.col("h"), (*reputation.SUFFIXES, "own.test")
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", reputation.domain_of(h, suffixes), reputation.suffix_of(h, suffixes))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == cases


def test_beta_quantile_against_integration(spark):
    rows = [(a, b) for a in (0.01, 0.3, 1.0, 2.5, 40.0, 3000.0) for b in (0.01, 0.4, 1.0, 7.0, 900.0)] + [(1e6, 2e6)]
    for a, b, q in spark.createDataFrame(rows, "a double, b double").select("a", "b", reputation.beta_quantile(F.col("a"), F.col("b"))).collect():
        # The integral over log odds, on a far finer grid.
        x = np.linspace(-1, 1, 2_000_001) * (40 / math.sqrt(a * b / (a + b)) + 30 * (1 / a + 1 / b)) + math.log(a / b)
        d = a * x - (a + b) * np.logaddexp(0, x)
        c = np.cumsum(np.exp(d - d.max()))
        assert abs(np.interp(math.log(q / (1 - q)) if 0 < q < 1 else math.copysign(math.inf, q - 0.5), x, c / c[-1]) - 0.05) < 2e-3 or q in (0, 1), (a, b, q)
    assert abs(spark.range(1).select(reputation.beta_quantile(F.lit(1.0), F.lit(1.0))).first()[0] - 0.05) < 1e-3


def test_reputation_ties_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x/y", "n", 2, "h"), (1, "http://a.org/x/y", "n", 2, "h"), (2, None, "n", 2, "h")], "page_id long, url string, host string, n int, rule string")
    rules = (("a.org/x/", "block"), ("org/x/y", "allow"), ("a.org/x/y", "allow"), ("b.org/x/y", "block"), ("a.org/x/y", "block"))
    got = reputation.judge_urls(pages, pages.select("page_id", F.lit(True).alias("good"), "host"), rules).collect()
    assert [(r.rule, r.verdict) for r in got if r.page_id == 1] == [("a.org/x/y", "allow")] * 2 and [r.host for r in got if r.page_id == 2] == [""]
    tied = (("org/x/", "block"), ("a.org/", "allow"))  # of rules as long as each other the first by name
    assert [(r.rule, r.verdict) for r in reputation.judge_urls(pages, pages.select("page_id", F.lit(True).alias("good")), tied).collect() if r.page_id == 1] == [("a.org/", "allow")] * 2
