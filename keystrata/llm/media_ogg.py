"""Media columns in the Ogg container: write and read physical streams of several logical ones.

Reading verifies every page's checksum, puts packets together again from the lacing values,
also across pages, keeps the logical streams apart by serial number and takes the packets'
times from the granule positions. One row is one physical stream, so rows are independent: no
shuffle, and a task holds one stream at a time.

Defined results: a null text is an empty one; rows with equal texts give equal values, repeated
rows stay repeated; doc_id may be null; other columns of the input are ignored; an empty table
gives an empty table. A page with a wrong checksum is skipped and counted in `bad_pages`, the
packets of its stream that it interrupts are dropped and counted in samples as `lost`, and a stream
that is cut off has the duration of what is there.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import string_bytes, table

RATE = 8000
STREAMS = 2
PACKET = 4096
UNIT = 64
MAGIC = b"\x7fKSAMP8"
CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
_IDENTITY = struct.Struct("<7sBIBBQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """The container's CRC (0x04C11DB7, most significant bit first, no inversion), by way of
    zlib's mirrored one over mirrored bytes."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def logical_pages(packets: list[bytes], granules: list[int], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) of a logical stream; the first packet has a page of its own."""
    pages, sequence = [], 0

    def flush(lacing, body, granule, flags):
        nonlocal sequence
        head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + bytes(lacing)
        page = head + body
        pages.append((granule, page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]))
        sequence += 1

    flush([len(packets[0])], packets[0], 0, FIRST | (LAST if len(packets) == 1 else 0))
    lacing, body, granule, continued = [], [], -1, 0
    for k, (packet, end) in enumerate(zip(packets[1:], granules[1:], strict=True), 1):
        at, sizes = 0, [255] * (len(packet) // 255) + [len(packet) % 255]
        for i, size in enumerate(sizes):
            if len(lacing) == 255:
                flush(lacing, b"".join(body), granule, continued)
                lacing, body, granule, continued = [], [], -1, CONTINUED if i else 0
            lacing.append(size)
            body.append(packet[at : at + size])
            at += size
        granule = end
        if k == len(packets) - 1:
            flush(lacing, b"".join(body), granule, continued | LAST)
    return pages


def encode(payload: bytes, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """8-bit samples dealt packet by packet over `streams` logical streams, pages interleaved by time."""
    seed, packet = zlib.crc32(payload), PACKET
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    pages = []
    for s in range(streams):
        packets, granules = [_IDENTITY.pack(MAGIC, 1, rate, s, streams, len(payload))], [0]
        for k in range(s, len(parts), streams):
            packets.append(parts[k])
            granules.append(min((k + 1) * packet, len(payload)))
        pages += [(g if i else -2, s, i, p) for i, (g, p) in enumerate(logical_pages(packets, granules, (seed + s) & 0xFFFFFFFF))]
    order, last = [], {}
    for g, s, i, p in pages:  # a page on which no packet ends stands with the next that has one
        last[s] = max(last.get(s, -2), g)
        order.append((last[s], i, s, p))
    order.sort(key=lambda x: (x[0] if x[1] else -2, x[2], x[1]))
    return b"".join(p for *_, p in order)


def read_pages(data: bytes):
    """Yields (serial, sequence number, flags, granule, lacing, body) of each whole page whose checksum
    holds; None for a bad one."""
    at = data.find(b"OggS")
    while 0 <= at and at + 27 <= len(data):
        _, version, flags, granule, serial, sequence, checksum, n = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or len(page) < end - at or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            yield None
            at = data.find(b"OggS", at + 4)
            continue
        yield serial, sequence, flags, granule, lacing, page[27 + n :]
        at = end if data[end : end + 4] == b"OggS" else data.find(b"OggS", end)


def demultiplex(data: bytes) -> tuple[dict, dict]:
    """({serial: [(granule or -1, packet)]}, counts) of a physical stream. A packet ends with its stream's
    next gap in page numbers, whatever pages of other streams are damaged."""
    streams, open_packets, following, count = {}, {}, {}, {"pages": 0, "bad_pages": 0}
    for page in read_pages(data):
        count["pages"] += 1
        if page is None:
            count["bad_pages"] += 1
            continue
        serial, sequence, flags, granule, lacing, body = page
        packets = streams.setdefault(serial, [])
        part = open_packets.pop(serial, None)
        if sequence != following.get(serial, sequence):
            part = None
        following[serial] = sequence + 1
        skip = bool(flags & CONTINUED) and part is None
        part, at, done = (part or []) if flags & CONTINUED else [], 0, []
        for size in lacing:
            part.append(body[at : at + size])
            at += size
            if size < 255:
                if not skip:
                    done.append(b"".join(part))
                part, skip = [], False
        if lacing and lacing[-1] == 255 and not skip:
            open_packets[serial] = part
        packets += [(-1, p) for p in done[:-1]] + [(granule, p) for p in done[-1:]]
    return streams, count


def packet_times(found: list[tuple[int, bytes]], of: int) -> list[tuple[int, bytes]]:
    """(time in samples at the packet's end, packet) of a logical stream that has every `of`-th packet. Only
    the last packet that ends on a page has a granule position; those before it count back from there."""
    timed, position, step = [], None, 0
    for granule, packet in reversed(found):
        position = granule if granule >= 0 or position is None else position - step
        timed.append((position, packet))
        step = (of - 1) * PACKET + len(packet)
    return timed[::-1]


def decode(data: bytes) -> tuple[bytes, dict]:
    """The samples of a stream that `encode` wrote, in the order of their times, and what was seen. The
    duration is the last time that a granule position gives; `lost` are samples announced and not found."""
    streams, count = demultiplex(data)
    parts, rate, total, packets = [], RATE, 0, 0
    for found in streams.values():
        packets += len(found)
        if not found or not found[0][1].startswith(MAGIC):
            continue
        _, _, rate, _, of, total = _IDENTITY.unpack(found[0][1])
        parts += packet_times(found[1:], of)
    parts.sort(key=lambda x: x[0])
    samples = b"".join(p for _, p in parts)
    end = parts[-1][0] if parts else 0
    return samples, count | {"streams": len(streams), "packets": packets, "duration_ms": end * 1000 // rate, "lost": total - len(samples)}


def feature(samples: bytes, seen: dict) -> str:
    x = np.frombuffer(samples, np.uint8)
    level = np.bincount(x, minlength=256)
    mean = int((level * np.arange(256)).sum()) // max(1, len(x))
    crossings = int(np.count_nonzero(np.diff(x > 96))) if len(x) else 0
    numbers = [("streams", seen["streams"]), ("pages", seen["pages"]), ("bad_pages", seen["bad_pages"]), ("packets", seen["packets"]), ("lost", seen["lost"]), ("duration_ms", seen["duration_ms"]), ("mean", mean), ("peak", int(x.max(initial=0))), ("crossings", crossings)]
    return ";".join(f"{k}={v}" for k, v in numbers)


def _texts_to_media(batches):
    for batch in batches:
        data, offsets = string_bytes(batch.column(1))
        size = max(1, int(4e6 // max(1, len(data) / max(1, batch.num_rows))))
        for row in range(0, batch.num_rows, size):
            media, lengths = [], []
            for a, b in zip(offsets[row : row + size], offsets[row + 1 : row + size + 1], strict=False):
                text = data[a:b].tobytes()
                media.append(encode(text + bytes(-len(text) % UNIT or (0 if text else UNIT))))
                lengths.append(b - a)
            yield pa.record_batch([batch.column(0).slice(row, len(media)), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read_media(batches):
    for batch in batches:
        rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in batch.column(2):
            stored = media.as_py() or b""
            samples, seen = decode(stored)
            rows["payload_bytes"].append(len(samples))
            rows["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(samples[-UNIT:]))
            rows["media_bytes"].append(len(stored))
            rows["media_sha256"].append(hashlib.sha256(stored).hexdigest())
            rows["feature"].append(feature(samples, seen))
        ints = ("payload_bytes", "tail_crc32", "media_bytes")
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(v, pa.int64() if k in ints else pa.string()) for k, v in rows.items())], ["doc_id", "n_bytes", *rows])


def text_to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as 8-bit samples in an Ogg stream."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_texts_to_media, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of the samples read back from the `media` column."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _read_media,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op9_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(text_to_media(table(spark, sf_dir, "documents")))
