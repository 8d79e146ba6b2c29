"""Operator 9: WARC archives, index first.

Writing: one gzip member per record. Pages whose payload digest occurs more
than once keep one response (the largest page_id); the others become revisit
records that name it. Every written record yields an index row (archive,
offset, length, url, digest, type). Reading starts from that index: the
selected rows are grouped by stretch of archive, their byte ranges sorted and
coalesced into few reads, and only those bytes are fetched and parsed; the
digest of every response is computed again from the bytes read.

Defined results: null html is an empty payload (also deduplicated); a null
url writes no target URI; a null page_id never becomes the response of a
group that has an id, and is a response where its payload has no id at all;
rows that repeat the response's page_id are responses as well; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mandisight.llm import store
from mandisight.llm.common import fresh_path, table, written

#: Payloads below this many bytes are never replaced by a revisit.
MIN_REVISIT_BYTES = 0
#: A new archive starts behind this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Index rows are read by stretches of this many archive bytes.
STRETCH_BYTES = 4 << 20
GAP_BYTES = 64 << 10
RUN_BYTES = 8 << 20
#: Archive bytes that a reading task is meant to fetch.
TASK_BYTES = 16 << 20
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = ("archive string, offset long, length long, stretch long, page_id long, url string, "
                "payload_digest string, payload_bytes long, record_type string, refers_to long")


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, level: int = 6) -> bytes:
    """One gzip member holding a response or, with ``refers_to``, a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {WARC_DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level, mtime=0)


def record_id(page_id) -> str:
    return "urn:x-page:none" if page_id is None else f"urn:x-page:{page_id}"


def parse_record(member: bytes) -> dict:
    """Headers of a record (lower-case names), with its HTTP length and payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[:int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http-length"] = int(next(x for x in http.decode("latin-1").split("\r\n") if
                                  x.lower().startswith("content-length:")).split(":")[1])
    out["payload"] = payload
    return out


def id_of(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_responses(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and ``keeper``: the response of its payload where that is shared."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("_sha1"))
    # One row per payload leaves each task, however many pages share it. Only shared payloads are kept, as a written
    # table of known size: while that is small it is broadcast, and the pages are not shuffled to meet it.
    shared = (rows.where(F.octet_length("html") >= min_bytes).groupBy("_sha1")
              .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("_n"))
              .where((F.col("_n") > 1) & F.col("keeper").isNotNull()).drop("_n"))
    shared = written(shared, "shared-payloads")
    return rows.join(shared, "_sha1", "left").select("page_id", "url", "html", "keeper")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES, stretch_bytes: int = STRETCH_BYTES,
                   level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; returns the index, a written table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, uri, at = None, "", 0
        for batch in batches:
            rows = []
            ids, keepers = batch["page_id"].astype("Int64"), batch["keeper"].astype("Int64")
            for page_id, url, html, keeper in zip(ids, batch["url"], batch["html"], keepers, strict=True):
                page_id = None if page_id is pd.NA else int(page_id)
                refers_to = None if keeper is pd.NA or keeper == page_id else int(keeper)
                payload = html.encode("utf-8")
                digest = base32_sha1(payload)
                member = record_bytes(page_id, url, payload, digest, refers_to, level)
                if out is None or at >= archive_bytes:
                    if out:
                        out.close()
                    uri, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.create(uri)
                out.write(member)
                rows.append((uri, at, len(member), at // stretch_bytes, page_id, url, digest, len(payload),
                             "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")]).astype(
                {"page_id": "Int64", "refers_to": "Int64"})
        if out:
            out.close()

    return written(with_responses(pages, min_bytes).mapInPandas(run, INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame, gap: int = GAP_BYTES, most: int = RUN_BYTES, keep_html: bool = False) -> DataFrame:
    """Records of the selected index rows, read from the archives."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ranges = list(zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True))
        out = []
        with store.open_random(key[0]) as file:
            for start, length, members in store.coalesce(ranges, gap, most):
                data = memoryview(file.read_at(length, start))
                for i in members:
                    offset, n = ranges[i]
                    rec = parse_record(bytes(data[offset - start:offset - start + n]))
                    digest = rec["warc-payload-digest"].removeprefix("sha1:")
                    kind = rec["warc-type"]
                    if kind == "response" and base32_sha1(rec["payload"]) != digest:
                        raise ValueError(f"{key[0]} at {offset}: payload does not match its digest")
                    out.append((id_of(rec["warc-record-id"]), rec["http-length"], digest, kind,
                                id_of(rec["warc-refers-to"]) if kind == "revisit" else None,
                                *([rec["payload"].decode("utf-8") if kind == "response" else None] if keep_html else [])))
        return pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                          *(["html"] if keep_html else [])]).astype(
            {"page_id": "Int64", "refers_to": "Int64"})

    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
              + ", html string" * keep_html)
    # Index rows are small but stand for archive bytes: the number of tasks follows those.
    held = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("archive", "stretch", "offset", "length").repartition(
        max(1, -(-held // TASK_BYTES)), "archive", "stretch")
    return dealt.groupBy("archive", "stretch").applyInPandas(run, schema)


def op9_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return read_records(write_archives(pages, fresh_path(spark, "warc")))


# Base32 of the SHA-1: five hexadecimal digits are 20 bits, four letters.
SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
hashed AS (SELECT *, sha1(html) AS h FROM payloads)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM hashed
"""
