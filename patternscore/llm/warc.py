"""WARC archives of pages: written with revisit records for repeated payloads, read back by boundary-chain verification.

Writing stays in DataFrame operations: each record is one text, and the text writer's line end is the last byte
of the record's closing blank lines. Reading: each archive's task emits, for every place that looks like a record
start, the offset of the record that would follow; pointer jumping from offset 0 then keeps what the chain reaches,
so magic strings and whole records inside payloads are no records. Only offsets and header fields, never payloads, are shuffled.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, joined_dealt

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Header fields that candidates() reads.
_NAMES = (b"content-length", b"warc-type", b"warc-record-id", b"warc-payload-digest", b"warc-refers-to")
#: Bytes of a record beside url and payload, at most (two page numbers, a digest, lengths and fixed text).
_FRAME = 1024
#: Records of up to most_bytes / records_per_file bytes are written first, then those of up to so many times that, and so on.
_STEP = 16
_FIELDS = "file string, size long, start long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, records_per_file: int = 10_000, most_bytes: int = 1 << 28, hot_rows: int = 20_000) -> None:
    """Write one record per row of pages(page_id, url, html) to gzip-compressed archives under path.

    An archive holds at most ``records_per_file`` records and, before compression, ``most_bytes`` bytes; a larger record has its own.
    Records are written by size class, each class in files of as many records as surely fit.

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id is a response and the others are revisits
    without payload. Rows that repeat the smallest page_id are responses too. A null html is empty, a null url is left out,
    line ends in a url are deleted; a null page_id is never the smallest unless all are null.
    hot_rows: pages of one payload beyond which they are dealt over several tasks.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(F.coalesce("url", F.lit("")), "\r\n", "").alias("url"), html.alias("body"), F.octet_length(html).alias("n"), F.sha2(html, 256).alias("digest"))
    first = base.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    base = joined_dealt(base, first.drop("copies"), ["digest"], "page_id", hot_rows, "left", first.select("digest", F.col("copies").alias("count")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("body")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        F.when(F.col("url") != "", F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block),
        F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )
    whole = F.col("n") + F.octet_length("url") + _FRAME
    bounds = [max(1, most_bytes // records_per_file)]
    while bounds[-1] < most_bytes:
        bounds.append(bounds[-1] * _STEP)
    size_class = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        size_class = F.when(whole <= bounds[i], i).otherwise(size_class)
    sizes = pages.select(F.octet_length(html).alias("n"), F.coalesce("url", F.lit("")).alias("url")).select(size_class.alias("c"))
    classes = sorted(r["c"] for r in sizes.distinct().collect())  # at most a few
    for c in classes or [0]:
        fit = records_per_file if c == 0 else max(1, min(records_per_file, most_bytes // bounds[c])) if c < len(bounds) else 1
        part = base.where(size_class == c) if len(classes) > 1 else base
        out = part.select(record.alias("value")).write.mode("append" if c != min(classes, default=0) else "error")
        out.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", fit).text(path)


def _urn(value: bytes) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?[0-9]+)>", value)
    return int(m[1]) if m else None


def candidates(data: bytes) -> list[tuple]:
    """(start, next, page_id, payload_bytes, payload_digest, record_type, refers_to) of everything in data that parses as a record."""
    out = []
    # From the last magic string to the first: those before one blank line share it, so each header line is parsed once.
    ends, end = [], -1
    magics = list(MAGIC.finditer(data))
    for m in magics:
        if end < m.end() - 2:
            end = data.find(b"\r\n\r\n", m.end() - 2)
            if end < 0:
                break
        ends.append(end)
    until, head, known = -1, {}, {}
    for k in reversed(range(len(ends))):
        m, end = magics[k], ends[k]
        if end != until:
            until, head, known = end, {}, {}
        own = {}
        for line in data[m.end() : min(end, magics[k + 1].end() - 2) if k + 1 < len(ends) and ends[k + 1] == end else end].split(b"\r\n"):
            name, sep, value = line.partition(b":")
            if sep and (name := name.strip().lower()) in _NAMES:
                own.setdefault(name, value.strip())
        head = head | own  # the first of a name counts
        if not re.fullmatch(rb"[0-9]{1,18}", head.get(b"content-length", b"")):
            continue
        a, b = end + 4, end + 4 + int(head[b"content-length"])
        if data[b : b + 4] != b"\r\n\r\n":
            continue
        kind = head.get(b"warc-type", b"").decode("latin-1")
        cut = data.find(b"\r\n\r\n", a, b)
        http, payload = (data[a:cut], data[cut + 4 : b]) if cut >= 0 else (b"", data[a:b])
        if kind == "revisit":
            said = re.search(rb"(?i)\r\ncontent-length: *([0-9]{1,18})", http)
            n, digest = int(said[1]) if said else 0, head.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("latin-1")
        else:
            if b not in known:
                known[b] = len(payload), hashlib.sha256(payload).hexdigest()
            n, digest = known[b]
        out.append((m.start(), b + 4, _urn(head.get(b"warc-record-id", b"")), n, digest, kind, _urn(head.get(b"warc-refers-to", b""))))
    return out[::-1]


def _scanner():
    names = ("start", "next", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def f(batch):
        out = {k: [] for k in ("file", "size", *names)}
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            found = candidates(data)
            if data and not found:
                raise ValueError(f"{path.as_py()}: no record in {len(data)} bytes")
            for row in found:
                out["file"].append(path.as_py())
                out["size"].append(len(data))
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
        return out

    return f


def reached(start: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Which records (sorted by start) the chain from offset 0 reaches, by pointer jumping."""
    n = len(start)
    jump = np.searchsorted(start, succ)
    jump = np.where((jump < n) & (start[np.minimum(jump, n - 1)] == succ), jump, n)
    jump, on = np.append(jump, n), np.zeros(n + 1, bool)
    on[0] = n > 0 and start[0] == 0
    while True:
        before = on.sum()
        on[jump[on]] = True
        on[n] = False
        if on.sum() == before:
            return on[:n]
        jump = jump[jump]


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("start", ignore_index=True)
    kept = rows[reached(rows["start"].to_numpy(), rows["next"].to_numpy())]
    end = kept["next"].max() if len(kept) else 0
    if end != rows["size"][0]:
        raise ValueError(f"{rows['file'][0]}: its records end at byte {end} of {rows['size'][0]}")
    return kept


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under path that each archive's chain reaches: file, size, start, next and header fields.

    An archive whose chain ends before the archive does is an error. An archive must be under 2 GB (Spark's limit for a binary file), which bounds its group of offsets.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return arrow_pass(files, lambda: _scanner(), _FIELDS, rows=1).groupBy("file").applyInPandas(_chain, _FIELDS)


def page_records(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
