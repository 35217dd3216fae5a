"""WARC archives with an index that is written first and byte-range reads that follow it.

`write_archives` writes gzip members, one a record, into files of the shared folder, and returns
the index: file, offset, length, URL and digest of each record. `read_records` takes any selection
of index rows, sorts it by file and offset, joins neighbouring ranges into one read each, and
parses the records.

Of records with equal payloads of at least `least` bytes, the one with the largest page_id is a
response and the others are revisits of it.

Scale: ids meet by digest in a join of narrow rows whose hot keys Spark can split; payloads move
once, by page and digest, however many copies one has. An archive's name belongs to one attempt of
one task, and the index names only files of attempts that succeeded, so a lost executor leaves at
most files that nothing refers to. A task holds one range of READ_BYTES or one record, if that is
larger.

Defined results: a null html is an empty payload; null page_ids count as smaller than all others
(and are responses if no equal payload has an id); rows that repeat a page_id and payload are all
responses or all revisits of the largest; a null url is left out of the record; other columns are
ignored; an empty table gives no files and no rows.
"""

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, table, task_name, written

LEAST_BYTES = 0
FILE_BYTES = 1 << 30
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
LEVEL = 4
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(record: bytes) -> dict:
    """What a record says, its payload's digest computed anew; a wrong one is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record at this offset")
    warc = headers(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    id_of = lambda x: int(m[1]) if x and (m := re.search(r":(-?\d+)>", x)) else None
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    kind = warc["warc-type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} does not have its digest")
    n = len(payload) if kind == "response" else int(headers(http)["content-length"])
    return {"page_id": id_of(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": n, "payload_digest": digest, "refers_to": id_of(warc.get("warc-refers-to"))}


def elect(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, leader): leader is the largest page_id with an equal payload, null for a response."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html"), F.sha1(payload).alias("digest"))
    keyed = p.where(F.octet_length("html") >= least).select(F.col("page_id").alias("own"), F.col("digest").alias("of"))
    leaders = keyed.groupBy(F.col("of").alias("equal")).agg(F.max("own").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    leaders = written(leaders, "warc-leaders")
    revisits = keyed.join(leaders, F.col("of") == F.col("equal")).where(F.coalesce("own", F.lit(-(1 << 63))) < F.col("leader"))
    revisits = revisits.groupBy("own", "of").agg(F.max("leader").alias("leader"))
    # payloads are dealt by page, so copies of one are not gathered, and stream past narrow rows unsorted
    p = p.join(revisits.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left")
    return p.select("page_id", "url", "html", "leader")


def write_archives(elected: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records as each task has them, and returns the index, itself written to the shared folder."""

    def write(batches):
        out = None
        for batch in batches:
            rows = {k: [] for k in ("page_id", "file", "offset", "length", "url", "payload_digest", "record_type")}
            for page_id, url, html, leader in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = base32_sha1(payload)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, payload, digest, leader, leader is not None)) + packer.flush()
                if out is None or offset + len(member) > file_bytes:
                    if out is not None:
                        out.close()
                    uri, offset = f"{folder}/{task_name()}.warc.gz", 0
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                out.write(member)
                for k, v in zip(rows, (page_id, uri, offset, len(member), url, digest, "revisit" if leader is not None else "response"), strict=True):
                    rows[k].append(v)
                offset += len(member)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))
        if out is not None:
            out.close()

    return written(elected.select("page_id", "url", "html", "leader").mapInArrow(write, INDEX), "warc-index")


def _ranges(rows, most: int, gap: int):
    """Groups (file, offset, length) rows in sorted order into reads of neighbouring ranges."""
    group = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] > group[-1][1] + group[-1][2] + gap or row[1] + row[2] - group[0][1] > most):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def read_records(index: DataFrame, payloads: bool = False, most: int = READ_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records that `index` selects: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and payload if asked for (null for a revisit)."""

    def read(batches):
        fs = at = handle = None
        for batch in batches:
            found = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            size = 0
            for group in _ranges(zip(*(c.to_pylist() for c in batch.columns), strict=True), most, gap):
                if at != group[0][0]:
                    at = group[0][0]
                    fs, path = filesystem(at)
                    handle = fs.open_input_file(path)
                start = group[0][1]
                data = handle.read_at(max(o + n for _, o, n in group) - start, start)
                for _, o, n in group:
                    for k, v in parse_record(zlib.decompress(data[o - start : o - start + n], 31)).items():
                        found[k].append(v if payloads or k != "payload" else None)
                size += len(data)
                if payloads and size > most:
                    yield batch_of(found)
                    found, size = {k: [] for k in found}, 0
            yield batch_of(found)

    def batch_of(found):
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(v, t) for v, t in zip(found.values(), types, strict=True)], list(found))

    # a stretch of a file is one task's; within it, ranges come in the order of the file. Rows are
    # small and what they stand for is not, so the number of tasks follows the bytes to read
    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / (2 * most)).alias("stretch"))
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // (2 * most) + 1
    rows = rows.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    out = rows.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if payloads else out.drop("payload")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(elect(table(spark, sf_dir, "pages")), shared_dir(spark, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS leader FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < leader THEN leader END AS refers_to
FROM d
"""
