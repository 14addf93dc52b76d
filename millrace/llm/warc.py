"""WARC derivatives: of each response a metadata record and a plain-text conversion record.

Both refer to the response's WARC-Record-ID; they keep its target URI, date and HTTP headers, its payload digest, and
have digests of their own blocks. Digests are labelled SHA-256 in hex; record ids are name-based, so that a rerun gives
the same records.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "p|div|br|h1|h2|h3|h4|h5|h6|li|ul|ol|tr|table|article|section|nav|title|head|body|header|footer|pre|blockquote"
#: What becomes of HTML, in this order. RE2 reads the same patterns.
STEPS = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)[^>]*>", " "),
    (rf"(?i)</?({BLOCK})([ /][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)


def html_text(html: Column) -> Column:
    for pattern, by in STEPS:
        html = F.regexp_replace(html, pattern, by)
    return html


def uuid_of(*name: Column) -> Column:
    h = F.md5(F.concat_ws("|", *name))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses_of(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as response records: what read_warc gives, and page_id."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", uuid_of(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("record_id"), F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_headers"), html.alias("payload"), digest(html).alias("payload_digest"),
    )


def derivatives(responses: DataFrame, *keep: str) -> DataFrame:
    """record_type (metadata, conversion), record_id, refers_to, target_uri, date, content_type, payload_digest (of the
    response), block_digest, content_length (bytes), block: two rows per response, and the columns keep.

    A null payload counts as empty: its conversion is empty, and so is that of a payload without text. Null headers or
    URIs stay null (in the block: empty). Repeated responses give repeated records. Broken markup never fails: what has
    no closing > stays text. An empty table gives an empty result. Other columns are not read.
    """
    payload = F.coalesce("payload", F.lit(""))
    none = lambda c: F.coalesce(c, F.lit(""))
    fields = F.concat_ws("\r\n", F.concat(F.lit("sourceDigest: "), none("payload_digest")), F.concat(F.lit("sourceLength: "), F.octet_length(payload).cast("string")), F.concat(F.lit("sourceHeaders: "), F.regexp_replace(none("http_headers"), "\r?\n", " | ")), F.lit(""))
    one = lambda kind, content, block: F.struct(F.lit(kind).alias("record_type"), F.lit(content).alias("content_type"), block.alias("block"))
    both = responses.select(*keep, "record_id", "target_uri", "date", "payload_digest", F.explode(F.array(one("metadata", "application/warc-fields", fields), one("conversion", "text/plain", html_text(payload)))).alias("r"))
    return both.select(
        *keep, "r.record_type", uuid_of(F.col("r.record_type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "r.content_type", "payload_digest", digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


class _Plain(io.RawIOBase):
    """The bytes of a file, gzip members taken apart one after the other. What can't be unpacked ends its member; the next
    one goes on."""

    def __init__(self, data: bytes):
        self.pieces, self.left = self._read(data), b""

    @staticmethod
    def _read(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
        view, pos = memoryview(data), 0
        if data[:2] != b"\x1f\x8b":
            yield from (bytes(view[k : k + step]) for k in range(0, len(data), step))
            return
        while (pos := data.find(b"\x1f\x8b\x08", pos)) >= 0:
            member, start = zlib.decompressobj(31), pos
            try:
                while pos < len(data) and not member.eof:
                    part = view[pos : pos + step]
                    yield member.decompress(part)
                    pos += len(part) - len(member.unused_data)
            except zlib.error:
                pos = start + 3

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left:
            if (piece := next(self.pieces, None)) is None:
                return 0
            self.left = piece
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzipped (one member or one for each record) or not.

    What is no record (garbage between records, a Content-Length that is missing or no number, a block that the file's end
    cuts off, a gzip member that can't be unpacked) is skipped up to the next line that begins with WARC/ and gives one row
    of type damaged, of which all else is null. An empty file has no records.
    """
    f, damaged = io.BufferedReader(_Plain(data)), False
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            if not damaged:
                yield {"record_type": "damaged"}
            damaged = True
            continue
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = head.get("content-length", "")
        block = f.read(int(size)) if size.isascii() and size.isdigit() else None
        damaged = block is None or len(block) < int(size)
        if damaged:
            yield {"record_type": "damaged"}
            continue
        http, payload = (block.split(b"\r\n\r\n", 1) + [b""])[:2] if head.get("content-type", "").startswith("application/http") else (b"", block)
        yield {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "content_type": head.get("content-type"), "payload_digest": head.get("warc-payload-digest"), "block_digest": head.get("warc-block-digest"), "http_headers": http.decode("utf-8", "replace") or None, "payload": payload.decode("utf-8", "replace")}


RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, http_headers string, payload string"
#: Records, and characters of their payloads, that are handed on at once.
BATCH, BATCH_CHARS = 1000, 1 << 24


def read_warc(spark, path: str) -> DataFrame:
    """The records of WARC files (of up to 2 GB, which is what Spark reads as one value), one file to a task; records are
    handed on a batch at a time. For broken files see parse."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows, chars = [], 0
                for r in parse(bytes(content)):
                    rows.append(r)
                    chars += len(r.get("payload") or "")
                    if len(rows) >= BATCH or chars >= BATCH_CHARS:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, chars = [], 0
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def serialise(row: dict) -> bytes:
    """A derivative as a WARC record."""
    block = (row["block"] or "").encode()
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Refers-To": row["refers_to"], "WARC-Target-URI": row["target_uri"], "WARC-Date": row["date"], "Content-Type": row["content_type"], "WARC-Payload-Digest": row["payload_digest"], "WARC-Block-Digest": row["block_digest"], "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def warc_bytes(records: DataFrame) -> DataFrame:
    """record (binary): every derivative as a gzip member; members put one after the other are a WARC file."""
    return records.mapInPandas(lambda pdfs: (pd.DataFrame({"record": [gzip.compress(serialise(r), mtime=0) for r in pdf.to_dict("records")]}) for pdf in pdfs), "record binary")


def op5_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses_of(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), "page_id")


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    text = "coalesce(html, '')"
    for pattern, by in STEPS:
        text = f"regexp_replace({text}, '{q(pattern)}', '{q(by)}', 'g')"
    uuid = lambda x: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({x}) AS h))"
    head = "'HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8'"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH r AS (
  SELECT page_id, url, {uuid("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")} AS rid, 'sha256:' || sha256(coalesce(html, '')) AS pd, strlen(coalesce(html, '')) AS n, {text} AS body FROM pages
), d AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'sourceDigest: ' || pd || {crlf} || 'sourceLength: ' || n || {crlf} || 'sourceHeaders: ' || {head} || {crlf} AS block FROM r
  UNION ALL SELECT *, 'conversion', 'text/plain', body FROM r
)
SELECT page_id, record_type, {uuid("record_type || '|' || rid")} AS record_id, rid AS refers_to, url AS target_uri, CAST(NULL AS VARCHAR) AS date, content_type, pd AS payload_digest,
  'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length, block FROM d
"""


OP5_SQL = _sql()
