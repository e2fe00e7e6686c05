"""WARC archives with an index of their records.

Writing: each task writes archives of gzip members, a member per record, of about ARCHIVE bytes each, and returns the index rows: path,
offset, length, url and digest. The index is a table; an archive that a lost attempt left behind is in no row of it.

Pages with equal payloads of LEAST_SHARED bytes or more share one response record, that of the smallest page_id; the others
are revisit records, which hold headers alone and name the address and page of the response they refer to. Record ids are made
from a record's archive and place, so that none comes twice. An address that doesn't fit into a header line as it is stands
there escaped, and whole in a field of our own; any other is left alone.

Reading: the selected index rows are sorted by path and offset, and neighbours whose gap is small are joined to ranges of at
most RANGE bytes (a longer record is a range of its own). Each range is read once, and its records are parsed and checked.

Defined results: null html is an empty payload, a null url an empty one. Rows that repeat a page_id are records each; of equal
payloads under one smallest page_id the copies are responses all. A null page_id has a response record and is never referred
to. An empty table gives an empty index, and no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files
from .store import fresh_dir, materialize
from .words import chunks

LEAST_SHARED = 100
RANGE, GAP, ARCHIVE = 4 << 20, 64 << 10, 1 << 30
INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload_ok boolean, payload binary"
#: Fixed: no clock is read, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"


#: Fields of our own: the page's number, that of the page referred to, and an address that isn't a line.
PAGE, REFERS, EXACT_URL = "Page-ID", "Refers-To-Page-ID", "Exact-Target-URI"


def _line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _record(record_id: uuid.UUID, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id.urn}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"{PAGE}: {page_id}")
    if _line(url) != url:
        head.append(f"{EXACT_URL}: {_line(url.replace('%', '%25'))}")
    if revisit:
        head += [f"WARC-Refers-To-Target-URI: {_line(refers_url or '')}", f"WARC-Refers-To-Date: {DATE}", f"{REFERS}: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """One record's headers, payload (None for revisits) and payload length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"fields": fields, "payload": None if fields["WARC-Type"] == "revisit" else payload, "payload_bytes": length}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at = None, None, 0
        for batch in chunks(batches, "html"):
            rows = []
            for page_id, url, html, digest, to, to_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "refers_url"))):
                if out is not None and at >= ARCHIVE:
                    out.close()
                    out, at = None, 0
                if out is None:
                    path = files.new_name(folder, "pages", ".warc.gz")
                    out = files.writer(path)
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{at}")
                member = pack.compress(_record(record_id, page_id, url or "", (html or "").encode("utf-8", "surrogatepass"), digest, to, to_url)) + pack.flush()
                out.write(member)
                rows.append((path, at, len(member), url, digest, page_id, "response" if to is None else "revisit"))
                at += len(member)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame) -> DataFrame:
    """Archive every row of `pages` (page_id, url, html). Returns the written index."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    shared = rows.where((F.octet_length("html") >= LEAST_SHARED) & F.col("page_id").isNotNull())
    firsts = shared.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("head"), F.max("page_id").alias("last")).where("head.page_id < last")
    # only payloads that occur more than once come here: few rows, or else a sort-merge join whose hot digests Spark splits
    linked = rows.join(firsts.select("digest", F.col("head.page_id").alias("first"), F.col("head.url").alias("refers_url")), "digest", "left")
    linked = linked.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    return materialize(linked.select("page_id", "url", "html", "digest", "refers_to", "refers_url").mapInArrow(_write(fresh_dir(spark, "warc")), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for path, start, end, records in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "records"))):
            data = files.reader(path).read_at(end - start, start)
            rows = []
            for r in records:
                got = parse(zlib.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]], 31))
                f, payload = got["fields"], got["payload"]
                digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                number = lambda x: int(f[x]) if x in f else None  # noqa: E731, B023
                ok = payload is None or (len(payload) == got["payload_bytes"] and hashlib.sha256(payload).hexdigest() == digest == r["digest"])
                url = f[EXACT_URL].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if EXACT_URL in f else f["WARC-Target-URI"]
                rows.append((number(PAGE), url, f["WARC-Type"], number(REFERS), got["payload_bytes"], digest, ok, payload))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


def read(index: DataFrame) -> DataFrame:
    """The records of the given index rows, by RECORD."""
    by_place = W.partitionBy("path").orderBy("offset")
    # a range ends where a gap is too wide or the bytes since the path's start pass the next multiple of RANGE
    rows = index.select("path", "offset", "length", "digest").withColumn("gap", F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_place))
    rows = rows.withColumn("jump", F.sum(F.when(F.col("gap") > GAP, 1).otherwise(0)).over(by_place))
    ranges = rows.groupBy("path", "jump", F.expr(f"offset div {RANGE}").alias("piece")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length", "digest"))).alias("records"))
    return ranges.mapInArrow(_read, RECORD)
