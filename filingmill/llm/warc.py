"""WARC archives with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task packs its rows into archives of about ARCHIVE_BYTES; an archive is one row (name, content), so a task
that is run again replaces its own output and nothing is written beside Spark's committed files. The dictionary of an
archive is trained from its own first records, at most DICTIONARY_SAMPLES of them; where that is too little to train
from, the archive has none. Reading: an archive is a row with a `content` column (also what `binaryFile` gives for
*.warc.zst files). The frames are walked by their block headers, skippable frames of other kinds are passed over wherever they stand, each is decoded by itself with the dictionary, and every record's
header lines, Content-Length, block digest and payload digest are checked; what fails is a row with `error`. Archives of other
writers are read, too: frames without a content size, all record types (the payload of those other than response and revisit
is their block), digests by SHA-1, SHA-256 and others that hashlib knows, in base 32 or hex, and any form of record id. A
digest by an unknown algorithm is not checked; without a payload digest one is worked out.

A record has an HTTP response as its block. Of pages with equal payloads of MIN_REVISIT bytes or more that with the largest
page_id is the `response`; the others are `revisit` records that refer to it and keep the HTTP header alone.

Defined results: null html is an empty payload; null url leaves the target out; a null page_id never becomes the response
of others, and gets a record id of its own from its digest; rows that repeat a response's page_id are responses too; an
empty table gives no archives; other columns are not read. Pages that share one payload may be a third of all rows: only
(digest, length, page_id) maxima are shuffled for them, and the join back is one that adaptive execution splits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, staged

ARCHIVE_BYTES = 8 * 1024 * 1024
DICTIONARY_BYTES = 32 * 1024
DICTIONARY_SAMPLES = 256
LEVEL = 3
#: The largest record that is read; a frame that holds more is an error row.
RECORD_BYTES = 256 * 1024 * 1024
MIN_REVISIT = 1000
# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
#: Frames of user data have 0x50 to 0x5F before these bytes.
SKIPPABLE_TAIL = b"\x2a\x4d\x18"
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2000-01-01T00:00:00Z"

RECORDS = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_id string, error string"


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:payload:{digest}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    digest = _base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {RECORD_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{_base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {target}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """One archive."""
    dictionary = None
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records[:DICTIONARY_SAMPLES])
    except zstandard.ZstdError:  # too few or too small samples to train from
        pass
    head = b""
    if dictionary is not None:
        held = dictionary.as_bytes()
        head = struct.pack("<II", SKIPPABLE_MAGIC, len(held)) + held
    cctx = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return head + b"".join(map(cctx.compress, records))


def is_skippable(head: bytes) -> bool:
    """Whether a frame of user data begins here, which holds no record."""
    return head[1:4] == SKIPPABLE_TAIL and head[0] >> 4 == 5


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at `at` ends, from its header and block headers alone."""
    head = data[at : at + 18]
    if is_skippable(head):
        end = at + 8 + int.from_bytes(head[4:8], "little")
        if len(head) < 8 or end > len(data):
            raise ValueError("a skippable frame is cut off")
        return end
    params = zstandard.get_frame_parameters(head)
    at += zstandard.frame_header_size(head)
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a block header is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a block has a reserved type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * params.has_checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def unpack(data: bytes) -> Iterator[bytes | Exception]:
    """The records of an archive; an exception in place of one that can't be decoded. A broken frame structure ends it."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        held = data[8 : 8 + size]
        if len(held) < size:
            yield ValueError("the dictionary is cut off")
            return
        try:
            if held[:4] == struct.pack("<I", FRAME_MAGIC):
                held = zstandard.ZstdDecompressor().decompress(held)
            if held[:4] != struct.pack("<I", DICTIONARY_MAGIC):
                raise ValueError("the leading frame holds no dictionary")
        except (zstandard.ZstdError, ValueError) as e:
            yield e
            return
        dictionary, at = zstandard.ZstdCompressionDict(held), 8 + size
    dctx = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            end = frame_end(data, at)
        except (zstandard.ZstdError, ValueError) as e:
            yield e
            return
        if not is_skippable(data[at : at + 4]):
            yield _inflated(dctx, data[at:end])
        at = end


def _inflated(dctx: zstandard.ZstdDecompressor, frame: bytes) -> bytes | Exception:
    """A frame's record, at most RECORD_BYTES of it: a frame that would grow beyond (its header need not tell the size) is an error."""
    try:
        with dctx.stream_reader(frame) as reader:
            out = reader.read(RECORD_BYTES + 1)
            while len(out) <= RECORD_BYTES and (more := reader.read(RECORD_BYTES + 1 - len(out))):
                out += more
    except zstandard.ZstdError as e:
        return e
    return out if len(out) <= RECORD_BYTES else ValueError(f"a record has more than {RECORD_BYTES} bytes")


def _digest_fits(given: str, data: bytes) -> bool:
    """Whether a labelled digest is that of data; true for an algorithm unknown here."""
    algorithm, _, value = given.partition(":")
    try:
        own = hashlib.new(algorithm.lower().replace("-", ""), data).digest()
    except (ValueError, TypeError):
        return True
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _hex(given: str) -> str:
    """A labelled digest as bare hex; as it is where it is neither hex nor base 32."""
    value = given.partition(":")[2]
    if re.fullmatch(r"(?:[0-9A-Fa-f]{8})+", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return value


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space continues the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8")).split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line or header end")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#-'*+\-.0-9A-Z^-z|~]+", name):
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    return fields


def parse_record(raw: bytes) -> dict:
    """The columns of RECORDS; raises ValueError for a record that is not well formed."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no WARC version line or header end")
    fields = _fields(head)
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block with its end has {len(rest)} bytes")
    block, kind, digest = rest[:size], fields["warc-type"], fields.get("warc-payload-digest", "")
    if (d := fields.get("warc-block-digest")) and not _digest_fits(d, block):
        raise ValueError("the block digest differs")
    payload, length = block, size
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("the HTTP header does not end")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        length = int(stated[1]) if stated else len(payload)
        whole = kind == "response" and "warc-truncated" not in fields
        if whole and (len(payload) != length or digest and not _digest_fits(digest, payload)):
            raise ValueError("the payload's length or digest differs")
    elif kind == "response" and fields.get("content-type", "").startswith("application/http"):
        raise ValueError("the block is no HTTP response")
    elif digest and kind != "revisit" and not _digest_fits(digest, payload):
        raise ValueError("the payload's length or digest differs")
    if kind == "revisit" and payload:
        raise ValueError("a revisit has a payload")
    of = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    return {
        "page_id": of("warc-record-id"), "record_type": kind, "refers_to": of("warc-refers-to"), "url": fields.get("warc-target-uri"),
        "payload_bytes": length, "payload_digest": _hex(digest) if digest else hashlib.sha1(payload).hexdigest(),
        "payload": None if kind == "revisit" else payload, "record_id": fields["warc-record-id"], "refers_to_id": fields.get("warc-refers-to"), "error": None,
    }


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for page_id, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
            number = None if pd.isna(page_id) else int(page_id)
            record = build_record(number, url, (html or "").encode("utf-8"), None if pd.isna(refers) else int(refers))
            held.append(record)
            size += len(record)
            if size >= ARCHIVE_BYTES:
                yield pd.DataFrame({"content": [pack(held)], "records": [len(held)]})
                held, size = [], 0
    if held:
        yield pd.DataFrame({"content": [pack(held)], "records": [len(held)]})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows, size = [], 0
            for raw in unpack(content or b""):
                try:
                    if isinstance(raw, Exception):
                        raise ValueError(str(raw))
                    rows.append(parse_record(raw))
                    size += len(raw)
                except ValueError as e:
                    rows.append(dict.fromkeys(columns) | {"error": str(e)})
                if size >= ARCHIVE_BYTES // 4:
                    yield _frame(rows, columns)
                    rows, size = [], 0
            if rows:
                yield _frame(rows, columns)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    for name in ("page_id", "refers_to", "payload_bytes"):
        out[name] = out[name].astype("Int64")
    return out


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: the page whose record has the same payload, for those that only refer to it."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(body).alias("_digest"), F.octet_length(body).alias("_bytes"))
    shared = (
        keyed.filter(F.col("_bytes") >= MIN_REVISIT).groupBy("_digest", "_bytes")
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return keyed.join(shared, ["_digest", "_bytes"], "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. Returns the written archives: content, records."""
    small_batches(pages.sparkSession)
    numbers = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}  # else pandas makes floats of them
    packed = with_revisits(pages).withColumns(numbers).mapInPandas(_write, "content binary, records long")
    return staged(packed, "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """archives: content. Returns the columns of RECORDS, a row per record; null but for error where one is broken."""
    small_batches(archives.sparkSession)
    return archives.select("content").mapInPandas(_read, RECORDS)
