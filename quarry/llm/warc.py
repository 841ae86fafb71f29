"""WARC writing, reading and transaction assembly.

Writing: each page becomes a request, a response or revisit, and a metadata record, each gzip member of its own, tied
by WARC-Concurrent-To. Reading parses the archives record by record, checks each payload's digest and assembles the
records of a transaction by their concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common
from .token_files import filesystem

FILE_BYTES, CHUNK = 128 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 1, mtime=0)


def _line(text: str | None) -> str:
    """A header value: no line breaks."""
    return re.sub(r"[\r\n]+", " ", text or "")


def transaction(page_id: str, url: str | None, payload: bytes, sha: str, response: str | None, copy: str | None = None) -> bytes:
    """The three records of a capture. response: the page that holds an equal payload, if this one revisits it."""
    stem, uri = f"urn:page:{page_id}:{sha}" + (f":{copy}" if copy else ""), _line(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common_fields = [("WARC-Date", DATE)] + [("WARC-Target-URI", uri)] * bool(uri)
    main = [("WARC-Record-ID", f"<{stem}>"), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if response is None:
        out = _member([("WARC-Type", "response"), *main, *common_fields], http + payload)
    else:
        out = _member([("WARC-Type", "revisit"), *main, ("WARC-Refers-To", f"<urn:page:{response}:{sha}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common_fields], http)
    path = _line(re.sub(r"^[a-z]+://[^/]*", "", uri)) or "/"
    out = _member([("WARC-Type", "request"), ("WARC-Record-ID", f"<{stem}:request>"), ("WARC-Concurrent-To", f"<{stem}>"), ("Content-Type", "application/http; msgtype=request"), *common_fields], f"GET {path} HTTP/1.1\r\n\r\n".encode()) + out
    return out + _member([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<{stem}:metadata>"), ("WARC-Concurrent-To", f"<{stem}>"), ("Content-Type", "application/warc-fields"), *common_fields], f"page-id: {page_id}\r\n".encode())


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives and returns their manifest (path, n_pages); files of failed attempts are not in it.

    Of equal payloads the page with the largest id is the response, the others revisit it. Rows that repeat an id with
    its payload get record ids of their own by their row number, all but the first. Null html: an empty payload. Null
    ids are written as "null" and are a response only if no page with an id has the payload. Null urls: no target URI.
    Empty table: no archive.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["sha"] = [digest((t or "").encode("utf-8", "surrogatepass")) for t in b["html"]]
            yield b

    d = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    d = d.mapInPandas(sums, "page_id string, url string, html string, sha string").withColumn("page_id", F.col("page_id").cast("long"))
    # Stored with row numbers, so that these are the same whenever a task is run again.
    d = common.stored(d.withColumn("row", F.monotonically_increasing_id()), "warc-pages")
    same = d.groupBy("sha", "page_id").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    last = d.groupBy("sha").agg(F.max("page_id").alias("response"))
    # Only pages that revisit another or occur more than once need more than their own row.
    told = same.join(last, "sha").filter("n > 1 or page_id < response or (page_id is null and response is not null)")
    told = common.stored(told.select(F.col("sha").alias("t_sha"), F.col("page_id").alias("t_id"), "first", "n", F.when(F.expr("page_id is null or page_id < response"), F.col("response")).alias("response")), "warc-told")
    d = d.join(told, F.expr("sha = t_sha and page_id <=> t_id"), "left")
    d = d.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page"), "sha", "url", "html", F.col("response").cast("string").alias("response"), F.when(F.expr("row > first"), F.col("row").cast("string")).alias("copy"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for page, sha, url, html, response, copy in b[["page", "sha", "url", "html", "response", "copy"]].itertuples(index=False):
                if out is None:
                    name, n, size = f"{base}/pages-{attempt:08d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                    out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: quarry\r\nformat: WARC File Format 1.1\r\n"))
                raw = transaction(page, url, (html or "").encode("utf-8", "surrogatepass"), sha, response or None, copy or None)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    out.close()
                    yield pd.DataFrame({"path": [name], "n_pages": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "n_pages": [n]})

    return common.stored(d.mapInPandas(run, "path string, n_pages long"), "warc-manifest")


def _members(f) -> Iterator[bytes]:
    """The decompressed gzip members of an archive, one held at a time."""
    raw, z, parts = b"", None, []
    while True:
        if not raw:
            raw = f.read(CHUNK)
            if not raw:
                break
        z = z or zlib.decompressobj(31)
        parts.append(z.decompress(raw))
        raw = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = None, []
    if z is not None:
        raise ValueError("archive ends within a record")


def parse(member: bytes) -> dict | None:
    """A record's row; None for record types that belong to no capture. The payload is what follows HTTP headers."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind, block = h.get("warc-type", ""), rest[: int(h.get("content-length", 0))]
    if kind not in ("request", "response", "revisit", "metadata"):
        return None
    http, payload = b"", block
    if "application/http" in h.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
    said = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    length = len(payload)
    if kind == "revisit":  # the payload is elsewhere; its length is in the HTTP headers kept
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length = int(m[1]) if m else None
    elif kind == "response":
        found = digest(payload)
        if said not in (None, found):
            raise ValueError(f"payload of {h.get('warc-record-id')} does not match its digest")
        said = found
    bare = lambda k: h[k].strip("<>") if k in h else None
    return {"record_id": bare("warc-record-id"), "warc_type": kind, "concurrent_to": bare("warc-concurrent-to"), "refers_to": bare("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "payload_bytes": length, "payload_digest": said, "payload": payload}


def read_records(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per request, response, revisit and metadata record of the archives; request payloads are empty.

    Header fields that a record lacks are null. An archive that ends within a record or whose payload does not match its
    digest ends the run. Empty manifest: no row. Without payloads only those of metadata records are returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = filesystem(folder)
        for b in batches:
            for path in b["path"]:
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as f:
                    for member in _members(f):
                        if (r := parse(member)) is not None:
                            if not payloads and r["warc_type"] != "metadata":
                                r["payload"] = None
                            rows.append(r)
                            size += len(r["payload"] or b"") + 300
                            if size >= 4 << 20:
                                yield pd.DataFrame(rows).astype({"payload_bytes": "Int64"})
                                rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows).astype({"payload_bytes": "Int64"})

    n = max(1, min(manifest.count(), 100_000))  # a task an archive
    return manifest.select("path").repartitionByRange(n, "path").mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), request, metadata and the number of records.

    Records belong to the capture their concurrent-to names, or to their own if they name none. Of several records of
    a kind the smallest id is taken; a kind that is missing is null. Partial aggregation keeps one of each kind, so a
    capture with very many records is no hot group. Records without any id form no capture.
    """
    row = F.struct("record_id", "warc_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload")
    pick = lambda *kinds: F.min_by(row, F.when(F.col("warc_type").isin(*kinds), F.col("record_id")))
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).filter("capture_id is not null")
    return keyed.groupBy("capture_id").agg(pick("response", "revisit").alias("response"), pick("request").alias("request"), pick("metadata").alias("metadata"), F.count("*").alias("n_records"))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """pages written as archives, read back and assembled; nulls and repeats as in `write`."""
    folder = common.work_path(spark, "warc")
    captures = assemble(read_records(write(common.table(spark, sf_dir, "pages"), folder), folder, payloads=False))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1).try_cast("long")
    return captures.select(
        F.regexp_extract(F.col("metadata.payload").cast("string"), r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        page(F.col("response.refers_to")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([32768, 1024, 32, 1],
         lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, g * 5 + 1, 5) AS BIGINT) // d) % 32 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM r
"""
