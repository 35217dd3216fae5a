"""Removal of repeated passages: every byte in a LENGTH-byte string that also starts earlier goes.

Suffixes are sorted to a depth of LENGTH bytes and blockwise. A suffix belongs to the bucket of its
anchor, the smallest-hash K-gram within its LENGTH bytes (the last one, on ties), so equal suffixes
share a bucket and their distance to the anchor wherever they stand, and consecutive suffixes
mostly share an anchor; a run of suffixes with one anchor travels as one row. One bucket after the
other is taken in the order of Spark's external sort. A bucket with one run has nothing to compare,
and runs with equal bytes are repeats of the first. Suffixes of buckets with different runs are
compared by the cover: positions at every STEP bytes from the anchor are its samples, so whatever
the pair, both suffixes reach a sample after the same STEP - 1 bytes at most. Samples have ranks,
found once for each text from its prefix sums: names of LENGTH - STEP + 1 bytes, equal for equal
bytes. A suffix is then a rank and STEP - 1 bytes around it, and is sorted by these.

Only which suffixes are equal and which is first matters here, so ranks need not be in the order
of the bytes, and distances to a common anchor do what residues of a modulus do in a difference
cover: one residue covers all pairs.

Scale: the text is not shuffled for the search, only one row of 48 bytes for about 33 bytes of
text, and for open buckets one for STEP bytes; repeats within a task are settled before. Buckets
are streamed: one of equal runs needs constant memory, and a rank's only what different bytes
around it need, at most STEP - 1 for a suffix, however many documents quote it. Texts of documents with
something to settle are moved once, into buckets by document, where all later joins find them; the
list of those documents is broadcast while it is short. Marks of a document are joined
intervals, fewer than it has bytes.

Defined results: null texts are empty; texts of fewer than LENGTH bytes are never changed and
match nothing; doc_ids (any long) order documents, null ones come last, in the order of a hash of
their text, as do texts that share a doc_id; rows that repeat doc_id and text are the same
document and get the same result; other columns are carried along by `remove_repeats`; very long
texts are cut into overlapping pieces for the search; an empty table gives an empty table.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, mix, powers, prefix_hash, small, span_hash, table, written, written_for_joins

LENGTH = 100
K = 36
STEP = 5
PIECE_BYTES = 4 << 20
SCAN_BYTES = 512 << 10
FLUSH_RUNS = 400_000
LAST = (1 << 63) - 1
U = np.uint64
_LOW = U(0xFFFFFF)


def suffix_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """Runs of suffixes with one anchor: (key, digest, row, start, suffixes, anchor - start)."""
    n = len(data)
    lens = np.diff(offsets)
    if n < length or lens.max(initial=0) < length:
        none = np.zeros(0, np.int64)
        return none.view(U), none.view(U), none, none, none, none
    sums = prefix_hash(data)
    _, down = powers(n + 1)
    grams = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    x = grams ^ (grams >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x &= ~_LOW
    x |= _LOW - np.arange(len(x), dtype=U)  # the last of equal ones is the smallest
    w = length - k + 1
    grid = np.full(-(-len(x) // w) * w, ~U(0), U)
    grid[: len(x)] = x
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    suffixes = n - length + 1
    least = np.minimum(behind[:suffixes], ahead[w - 1 : w - 1 + suffixes])
    anchor = (_LOW - (least & _LOW)).astype(np.int64)
    step = np.zeros(n + 1, np.int8)
    long = lens >= length
    step[offsets[:-1][long]] += 1
    step[offsets[1:][long] - length + 1] -= 1
    inside = np.flatnonzero(np.cumsum(step[:suffixes], dtype=np.int8))
    at = anchor[inside]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    start, end, a = inside[first], inside[last], at[first]
    digest = span_hash(sums, start, end + length) ^ mix(((a - start) << 8 | (end - start)).astype(U))
    row = np.searchsorted(offsets[1:], start, side="right")
    return mix(grams[a]), digest, row, start - offsets[row], end - start + 1, a - start


def place(start, suffixes, shift):
    """Start, number of suffixes (0: an interval's start) and anchor's distance in one long."""
    return (start << 16) | (suffixes << 8) | shift


def start_of(p):
    return (p >> 16) & 0xFFFFFFFF


def settle_here(key, digest, doc, tag, where, length):
    """Of equal runs all but the earliest are repeats. Returns (open rows, repeats)."""
    both = key ^ mix(digest)
    order = np.argsort(both)
    same = both[order][1:] == both[order][:-1]
    if not same.any():
        return np.ones(len(key), bool), np.zeros(0, np.int64)
    some = np.zeros(len(key), bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    at = np.flatnonzero(some)
    at = at[np.lexsort((where[at] >> 16, tag[at], doc[at], digest[at], key[at]))]
    new = np.concatenate(([True], (key[at][1:] != key[at][:-1]) | (digest[at][1:] != digest[at][:-1])))
    head = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    repeat = at[(doc[at] != doc[head]) | (tag[at] != tag[head]) | (where[at] >> 16 != where[head] >> 16)]
    keep = np.ones(len(key), bool)
    keep[repeat] = False
    return keep, repeat


def join_intervals(doc, tag, where, length):
    """(doc, tag, place of start, end) of the runs' bytes, touching and overlapping ones joined."""
    order = np.lexsort((start_of(where), tag, doc))
    doc, tag, start = doc[order], tag[order], start_of(where[order])
    end = start + ((where[order] >> 8) & 0xFF) - 1 + length
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])))  # ends rise with starts
    first = np.flatnonzero(new)
    return doc[first], tag[first], place(start[first], 0, 0), np.maximum.reduceat(end, first)


def _run_rows(batches, length, k):
    held = []

    def flush():
        key, digest, doc, tag, where = (np.concatenate(c) for c in zip(*held, strict=True))
        keep, repeat = settle_here(key, digest, doc, tag, where, length)
        columns = [key[keep].view(np.int64), digest[keep].view(np.int64), doc[keep], tag[keep], where[keep]]
        if len(repeat):
            d, g, p, end = join_intervals(doc[repeat], tag[repeat], where[repeat], length)
            columns = [np.concatenate(x) for x in zip(columns, (mix(d.view(U) ^ p.view(U)).view(np.int64), end, d, g, p), strict=True)]
        return pa.record_batch([pa.array(c) for c in columns], ["key", "digest", "doc", "tag", "place"])

    size = 0
    for batch in batches:
        docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b, data, offsets in blocks(batch.column(2), SCAN_BYTES):
            for base in range(0, max(1, len(data)), PIECE_BYTES) if b - a == 1 else (0,):
                whole = b - a > 1
                part = data if whole else data[base : base + PIECE_BYTES + length - 1]
                key, digest, row, start, suffixes, shift = suffix_runs(part, offsets if whole else np.array([0, len(part)]), length, k)
                held.append((key, digest, docs[a:b][row], tags[a:b][row], place(start + base, suffixes, shift)))
                size += len(key)
            if size >= FLUSH_RUNS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _settle_buckets(batches, length):
    """Rows by key, digest, doc, tag and place. Yields intervals of repeats (as place with no suffixes,
    key: the end) and the runs of buckets with different ones."""
    run = (None,) * 5  # key, digest, doc, tag, place of the current run's first row
    pending = None  # a bucket's only run so far

    for batch in batches:
        key, digest, doc, tag, where = (batch.column(i).to_numpy() for i in range(5))
        if not len(key):
            continue
        given = (where >> 8) & 0xFF == 0
        out = [(digest[given], doc[given], tag[given], where[given])]
        key, digest, doc, tag, where = (x[~given] for x in (key, digest, doc, tag, where))
        if len(key):
            lead = [np.concatenate((np.array([x if x is not None else 0], np.int64), y)) for x, y in zip(run, (key, digest, doc, tag, where), strict=True)]
            new_key = lead[0][1:] != lead[0][:-1]
            new_key[0] |= run[0] is None
            new_run = new_key | (lead[1][1:] != lead[1][:-1])
            head = np.maximum.accumulate(np.where(np.concatenate(([True], new_run)), np.arange(len(key) + 1), 0))[1:]
            repeat = ~new_run & ((doc != lead[2][head]) | (tag != lead[3][head]) | (where >> 16 != lead[4][head] >> 16))
            if repeat.any():
                d, g, p, end = join_intervals(doc[repeat], tag[repeat], where[repeat], length)
                out.append((end, d, g, p))
            heads = np.flatnonzero(new_run)
            follows = ~new_key[heads]  # another run of the bucket stands before it
            if len(heads):
                if pending is not None and follows[0]:
                    out.append(tuple(np.array([x]) for x in pending))
                if not follows[0] or pending is not None:
                    pending = None
                several = follows.copy()
                several[:-1] |= follows[1:]
                at = heads[several]
                out.append((key[at], doc[at], tag[at], where[at]))
                if not several[-1]:
                    pending = (key[heads[-1]], doc[heads[-1]], tag[heads[-1]], where[heads[-1]])
            last = head[-1]
            run = tuple(int(x[last]) for x in lead)
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.record_batch([pa.array(c) for c in columns], ["key", "doc", "tag", "place"])


def pieces_of(data: np.ndarray, begin: np.ndarray, suffixes: np.ndarray, shift: np.ndarray, length: int = LENGTH):
    """Cuts runs (first suffix, number of suffixes, distance of the anchor, all in `data`) where the cover
    has samples, every STEP bytes from the anchor. The suffixes up to a sample share all bytes but
    STEP - 1 at the ends: (run, rank of the sample, bytes around it, first suffix, suffixes, number of
    the first). The rank is a name, equal for equal bytes, taken from the sums over the text."""
    most = shift // STEP
    count = most - (shift - suffixes + 1) // STEP + 1
    run = np.repeat(np.arange(len(begin)), count)
    q = most[run] - (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    far, near = np.minimum(shift[run], STEP * q + STEP - 1), np.maximum((shift - suffixes + 1)[run], STEP * q)
    anchor = (begin + shift)[run]
    sample = anchor - STEP * q
    rank = mix(span_hash(prefix_hash(data), sample, sample + length - STEP + 1) ^ mix(q.astype(U)))
    padded = np.zeros(len(data) + 12, U)
    padded[4 : len(data) + 4] = data
    word = padded[:-3] << U(24) | padded[1:-2] << U(16) | padded[2:-1] << U(8) | padded[3:]
    first = STEP * q + STEP - 1 - far
    # bytes that no suffix of the piece has say nothing
    before = word[sample] & (U(1) << (8 * (STEP - 1 - first)).astype(U)) - U(1)
    unused = (8 * (STEP - 1 - first - (far - near))).astype(U)
    behind = word[sample + length - STEP + 1 + 4] >> unused << unused
    return run, rank, before << U(32) | behind, anchor - far, far - near + 1, first


def _cut_pieces(batches, length):
    """The open runs of documents by the samples of the cover; equal pieces of a task are settled."""
    held, size = [], 0

    def flush():
        key, around, doc, tag, where = (np.concatenate(c) for c in zip(*held, strict=True))
        keep, repeat = settle_here(key, mix(around ^ mix((where & 0xFFFF).astype(U))), doc, tag, where, length)
        columns = [key[keep].view(np.int64), around[keep].view(np.int64), doc[keep], tag[keep], where[keep]]
        if len(repeat):
            d, g, p, end = join_intervals(doc[repeat], tag[repeat], where[repeat], length)
            columns = [np.concatenate(x) for x in zip(columns, (mix(d.view(U) ^ p.view(U)).view(np.int64), end, d, g, p), strict=True)]
        return pa.record_batch([pa.array(c) for c in columns], ["key", "around", "doc", "tag", "place"])

    for batch in batches:
        docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b, data, offsets in blocks(batch.column(2), SCAN_BYTES):
            marks = batch.column(3).slice(a, b - a)
            row = np.repeat(np.arange(b - a), np.asarray(marks.value_lengths()))
            where = marks.flatten().field(1).to_numpy()
            open_runs = (where >> 8) & 0xFF > 0
            row, where = row[open_runs], where[open_runs]
            begin = offsets[row] + start_of(where)
            # one very long text is a block of its own: it is taken window by window
            for base in range(0, max(1, len(data)), PIECE_BYTES):
                now = np.flatnonzero((begin >= base) & (begin < base + PIECE_BYTES)) if len(data) > PIECE_BYTES else np.arange(len(begin))
                if not len(now):
                    continue
                low = max(0, base - STEP)
                part = data[low : base + PIECE_BYTES + 2 * length] if len(data) > PIECE_BYTES else data
                low = low if len(data) > PIECE_BYTES else 0
                r, w = row[now], where[now]
                run, rank, around, start, suffixes, first = pieces_of(part, begin[now] - low, (w >> 8) & 0xFF, w & 0xFF, length)
                held.append((rank, around, docs[a:b][r[run]], tags[a:b][r[run]], place(start + low - offsets[r[run]], suffixes, first)))
                size += len(run)
                if size >= FLUSH_RUNS:
                    yield flush()
                    held, size = [], 0
    if size:
        yield flush()


def _settle_pieces(batches, length):
    """Rows by key, doc, tag and place: of equal suffixes all but the first are repeats. Between two
    batches only the different suffixes at the last rank are kept, no more than STEP - 1 bytes can tell apart."""
    kept = None  # key and (suffix, doc, tag, start)
    for batch in batches:
        key, around, doc, tag, where = (batch.column(i).to_numpy() for i in range(5))
        given = (where >> 8) & 0xFF == 0
        out = [(around[given], doc[given], tag[given], where[given])]
        key, around, doc, tag, where = (x[~given] for x in (key, around, doc, tag, where))
        if len(key):
            suffixes = (where >> 8) & 0xFF
            row = np.repeat(np.arange(len(key)), suffixes)
            k = np.arange(len(row)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
            start = start_of(where)[row] + k
            k = (k + (where & 0xFF)[row]).astype(U)
            inner = U(8) * (U(STEP - 1) - k)
            both = around.view(U)[row]
            bytes_ = ((both >> U(32)) & ((U(1) << inner) - U(1))) << U(8) * k | (both & U(0xFFFFFFFF)) >> inner
            suffix = mix(key.view(U)[row] ^ mix(bytes_ << U(8) | k))
            columns = [suffix, doc[row], tag[row], start]
            before = 0
            if kept is not None and kept[0] == key[0]:
                before = len(kept[1][0])
                columns = [np.concatenate(x) for x in zip(kept[1], columns, strict=True)]
            suffix, d, g, start = columns
            _, first, which = np.unique(suffix, return_index=True, return_inverse=True)
            head = first[which]
            repeat = np.flatnonzero((d != d[head]) | (g != g[head]) | (start != start[head]))
            repeat = repeat[repeat >= before]
            if len(repeat):
                dd, gg, p, end = join_intervals(d[repeat], g[repeat], place(start[repeat], 1, 0), length)
                out.append((end, dd, gg, p))
            last = first[(first >= before + np.searchsorted(row, np.searchsorted(key, key[-1]))) | (first < before if key[0] == key[-1] else False)]
            kept = key[-1], [x[last] for x in columns]
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.record_batch([pa.array(c) for c in columns], ["key", "doc", "tag", "place"])


def removed_mask(n: int, marks, later) -> np.ndarray:
    """Which bytes lie in one of the intervals."""
    step = np.zeros(n + 1, np.int32)
    for values in (marks, later):
        if values is not None and len(values):
            end, where = values.field(0).to_numpy(), values.field(1).to_numpy()
            whole = (where >> 8) & 0xFF == 0
            np.add.at(step, start_of(where[whole]), 1)
            np.add.at(step, end[whole], -1)
    return np.cumsum(step[:n]) > 0


def _finish(batches, with_text):
    for batch in batches:
        rows = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
        for text, marks, later in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            raw = (text.as_py() or "").encode()
            gone = removed_mask(len(raw), marks.values, later.values)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows["n_removed"].append(int(gone.sum()))
            rows["n_spans"].append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["kept"].append(kept.decode("utf-8", "ignore") if with_text else None)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True))], ["doc", "tag", *rows])


def _identity(docs: DataFrame):
    """A document's place in the order (doc, then tag) and its text. The tag has 63 bits of the text's
    digest, which tell texts with one doc_id apart, and by its sign whether there is a doc_id: those
    without have the greatest doc and come behind that one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    tag = F.shiftright(F.xxhash64(text), 1) + F.when(doc_id.isNull(), F.lit(1 << 62)).otherwise(F.lit(-(1 << 62)))
    return F.coalesce(doc_id, F.lit(LAST)).alias("doc"), tag.alias("tag"), text.alias("text")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(*_identity(docs))


def settled(docs: DataFrame, length: int = LENGTH, k: int = K, with_text: bool = False) -> DataFrame:
    """(doc, tag, n_removed, n_spans, kept_sha256, kept) of the documents of which bytes may go."""
    d = _identified(docs)
    runs = d.mapInArrow(lambda b: _run_rows(b, length, k), "key long, digest long, doc long, tag long, place long")
    runs = runs.repartition("key").sortWithinPartitions("key", "digest", "doc", "tag", "place")
    marks = runs.mapInArrow(lambda b: _settle_buckets(b, length), "key long, doc long, tag long, place long")
    lists = written(marks.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "place")).alias("marks")), "suffix-marks")

    texts = d.join(small(lists.select("doc", "tag")), ["doc", "tag"], "left_semi")
    # the merge keeps both sides dealt by document, as they are written: no later join moves a text
    texts = written_for_joins(texts.join(lists.hint("merge"), ["doc", "tag"]), "suffix-texts", "doc", "tag")

    pieces = texts.mapInArrow(lambda b: _cut_pieces(b, length), "key long, around long, doc long, tag long, place long")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "doc", "tag", "place")
    later = pieces.mapInArrow(lambda b: _settle_pieces(b, length), "key long, doc long, tag long, place long")
    later = later.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "place")).alias("later"))
    rows = texts.join(later, ["doc", "tag"], "left").select("doc", "tag", "text", "marks", "later").dropDuplicates(["doc", "tag"])
    return rows.mapInArrow(lambda b: _finish(b, with_text), "doc long, tag long, n_removed long, n_spans long, kept_sha256 string, kept string")


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = settled(docs, length).drop("kept")
    own = _identified(docs).select("doc", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    zero = F.lit(0).cast("long")
    out = own.join(found, ["doc", "tag"], "left")
    doc_id = F.when(~((F.col("doc") == LAST) & (F.col("tag") >= 0)), F.col("doc"))
    return out.select(doc_id.alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, size: str | None = "n_chars") -> DataFrame:
    """The documents without repeated passages; a text that is cut within a character loses it."""
    found = settled(docs, length, with_text=True).where("n_removed > 0").select("doc", "tag", "kept")
    doc, tag, _ = _identity(docs)
    out = docs.select(doc, tag, *[F.col(c).alias(f"column {i}") for i, c in enumerate(docs.columns)]).join(found, ["doc", "tag"], "left")
    columns = {c: F.col(f"`column {i}`") for i, c in enumerate(docs.columns)}
    columns["text"] = F.coalesce("kept", columns["text"])
    if size in columns:
        columns[size] = F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(columns[size])
    return out.select(*[v.alias(c) for c, v in columns.items()])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))
