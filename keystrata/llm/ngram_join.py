"""N-gram Jaccard join: which documents share at least THRESHOLD percent of their word n-grams.

The document by n-gram incidence matrix is multiplied with its transpose block by block. Columns
are ordered, rare n-grams before frequent ones, else by hash. The first block of a document is so
long that a pair without a common column there cannot reach the bound that follows from the two
sizes (n - ceil(T n) + 1 columns); its product over columns of at most FREQUENT sets, a join on
the column, gives candidate pairs, which go when count plus what can still come lies below the
bound. Sets with more frequent columns in their first block are multiplied in streams: all sets
with the same rarest such column, in blocks of BLOCK_ROWS sets by BLOCK_COLUMNS columns, overlap
counts added up over the columns until no pair of a block can reach its bound. Pairs of different
streams, candidates and pairs that share another frequent column, are compared once for all
columns they share, in chunks of at most CHUNK_ROWS sets, unless they are linked by others
already. Nothing is estimated: only pairs that cannot link, or are known to be in one component,
are skipped.

Scale:
* Documents with equal sets are one row of the matrix.
* Document frequencies are counted exactly over all documents, as delta-coded, sorted hash slots
  in fixed-size counters; slots, and tasks to count them in, grow with the text. They only order
  the columns, so that a passage that thousands of documents share is in no first block that has
  rarer columns; the HEAVIEST of them at most are broadcast, and which ones has no effect on the
  result.
* A stream is dealt by salt into parts of at most about STREAM_ROWS sets and STREAM_COLUMNS
  columns, so no column, however frequent, has to fit into a task. A stream's components are
  known when it ends; a group of thousands of near copies costs some block products and is one
  label from then on.
* No window runs over a column or a component; counts are partial sums before they are shuffled.

Defined results: null texts and texts without words have an empty set and link with nothing;
fewer than five words are one n-gram; equal sets link; repeated rows are rows of the same set;
null doc_ids are nodes as well, but no component takes its name from them (a component of null
doc_ids only has a null name); very long texts are read whole; other columns are ignored; an
empty table gives an empty table. Sets are told apart by 64-bit digests, n-grams by 63 bits.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, LOWER, blocks, mix, prefix_hash, small, span_hash, table, words, written
from .components import connected_components

N = 5
THRESHOLD = 80
FREQUENT = 24
HEAVIEST = 1_000_000
SLOT_BITS = 24
LEAST_BITS, MOST_BITS = 24, 44
FLUSH_TOKENS = 2_000_000
STREAM_ROWS = 4096
STREAM_COLUMNS = 4_000_000
CHUNK_ROWS = 16
BLOCK_ROWS = 256
BLOCK_COLUMNS = 4096
SPARSE = 8
U = np.uint64
_SALT = mix(np.arange(1, 33, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every row's distinct word n-grams, by row and hash."""
    low = LOWER[data]
    begin, end, row = words(low, offsets, NOT_SPACE)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = span_hash(prefix_hash(low), begin, end)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    firsts = np.cumsum(counts) - counts
    rows, hashes = [], []
    if len(h) >= n:
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        rows.append(row[at])
        hashes.append(mix(sum(h[at + j] * _SALT[j] for j in range(n))))
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        if len(few):
            rows.append(few)
            hashes.append(mix(sum(h[firsts[few] + j] * _SALT[j] for j in range(k)) + _SALT[n + k]))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def pack(slots: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slots, sorted within the parts that begin at `starts`, as 16-bit differences, a blob for each
    part; 65535 stands for a step without a slot."""
    d = np.diff(slots, prepend=0)
    d[starts] = slots[starts]
    steps, rest = d // 65535, d % 65535
    ends = np.cumsum(steps + 1)
    out = np.full(int(ends[-1]), 65535, np.uint16)
    out[ends - 1] = rest
    offsets = 2 * np.append(np.concatenate(([0], ends))[starts], ends[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpack(blob: bytes) -> np.ndarray:
    d = np.frombuffer(blob, np.uint16)
    return np.cumsum(d, dtype=np.int64)[d != 65535]


def frequent_slots(docs: DataFrame, n: int = N, least: int = FREQUENT, most: int = HEAVIEST) -> tuple[np.ndarray, int]:
    """Slots (leading hash bits, so many that few n-grams share one) of n-grams in at least `least`
    documents, sorted, the `most` heaviest; and the number of bits."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).head()[0] or 0
    bits = min(max(LEAST_BITS, math.ceil(math.log2(size + 1))), MOST_BITS)

    def slots_of(batches):
        held, size = [], 0

        def flush():
            s = np.sort(np.concatenate(held)).view(np.int64)
            bucket = s >> SLOT_BITS
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            return pa.record_batch([pa.array(bucket[starts]), pack(s & ((1 << SLOT_BITS) - 1), starts)], ["bucket", "slots"])

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                _, h = ngram_sets(data, offsets, n)
                held.append(h >> U(64 - bits))
                size += len(h)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(batches):
        bucket, counts = None, np.zeros(1 << SLOT_BITS, np.uint16)

        def heavy():
            at = np.flatnonzero(counts >= least)
            return pa.record_batch([pa.array((bucket << SLOT_BITS) + at, pa.int64()), pa.array(counts[at].astype(np.int64))], ["slot", "df"])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield heavy()
                        counts[:] = 0
                    bucket = b
                s = unpack(blob.as_py())
                first = np.flatnonzero(np.diff(s, prepend=-1))
                times = np.diff(np.append(first, len(s)))
                counts[s[first]] = np.minimum(counts[s[first]].astype(np.int64) + times, 65535)
        if bucket is not None:
            yield heavy()

    slots = docs.select(F.col("text").cast("string")).mapInArrow(slots_of, "bucket long, slots binary")
    heavy = slots.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "slot long, df long")
    kept = heavy.orderBy(F.desc("df"), "slot").limit(most).select("slot").toPandas()["slot"].to_numpy()
    return np.sort(kept.astype(U)), bits


def ordered_sets(data, offsets, heavy: np.ndarray, bits: int, n: int):
    """(first, last, columns, node) by row: its columns in ascending global order, and its set's digest."""
    row, h = ngram_sets(data, offsets, n)
    slot = h >> U(64 - bits)
    frequent = np.zeros(len(h), bool)
    if len(heavy) and len(h):
        at = np.minimum(np.searchsorted(heavy, slot), len(heavy) - 1)
        frequent = heavy[at] == slot
    columns = (h >> U(1)) | (frequent.astype(U) << U(63))
    order = np.argsort(row.astype(np.uint16) * 2 + frequent if len(offsets) <= 32_000 else row * 2 + frequent, kind="stable")
    columns = columns[order]
    edges = np.searchsorted(row, np.arange(len(offsets)))
    first, last = edges[:-1], edges[1:]
    sums = lambda x: np.diff(np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U)))[edges])
    size = (last - first).astype(U)
    node = mix(sums(mix(h ^ _SALT[20])) + size * _SALT[21])
    return first, last, columns, node.view(np.int64)


def prefix_length(size: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    return np.where(size > 0, size - -(-size * threshold // 100) + 1, 0)


def reaches(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sorted column arrays overlap enough, added up block by block."""
    t = threshold
    need = -(-t * (len(a) + len(b)) // (100 + t))  # 100 i >= t (|a| + |b| - i)
    if min(len(a), len(b)) < need:
        return False
    if len(b) > len(a):
        a, b = b, a
    count = 0
    for at in range(0, len(b), BLOCK_COLUMNS):
        part = b[at : at + BLOCK_COLUMNS]
        lo, hi = np.searchsorted(a, part[0]), np.searchsorted(a, part[-1], side="right")
        if hi > lo:
            rows = a[lo:hi]
            place = np.searchsorted(rows, part)
            place[place == len(rows)] = 0
            count += int(np.count_nonzero(rows[place] == part))
        if count + min(len(b) - at - len(part), len(a) - hi) < need:
            return False
    return count >= need


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (indices of rows, the smallest of a component) after the links a, b."""
    while True:
        la, lb = labels[a], labels[b]
        open_links = la != lb
        if not open_links.any():
            return labels
        a, b, la, lb = a[open_links], b[open_links], la[open_links], lb[open_links]
        labels = labels.copy()
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels != labels[labels]).any():
            labels = labels[labels]


def block_components(sets: list[np.ndarray], threshold: int = THRESHOLD) -> np.ndarray:
    """The component of every set among `sets` (ascending by size), as the first index in it.

    Only columns of two sets and more count. Those of at most SPARSE sets give their pairs; the
    others are multiplied in dense blocks, rows by BLOCK_ROWS and columns by BLOCK_COLUMNS. A pair
    of row blocks ends when no pair of its sets can reach the bound, and is not begun when all its
    sets are in one component."""
    t, m = threshold, len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    labels = np.arange(m)
    column, row = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(column, kind="stable")
    column = column[order]
    same = column[1:] == column[:-1]
    shared = np.zeros(len(column), bool)
    shared[1:] |= same
    shared[:-1] |= same
    row, column = row[order[shared]], column[shared]
    if not len(row):
        return labels
    new = np.concatenate(([True], column[1:] != column[:-1]))
    column = np.cumsum(new) - 1
    held = np.bincount(column)
    narrow = held[column] <= SPARSE
    r, c = row[narrow], column[narrow]
    codes = []
    for d in range(1, SPARSE):
        at = np.flatnonzero(c[d:] == c[:-d])
        codes.append(r[at] * m + r[at + d])
    code, few = np.unique(np.concatenate(codes), return_counts=True)
    few_a, few_b = code // m, code % m
    nb = -(-m // BLOCK_ROWS)
    unit = few_a // BLOCK_ROWS * nb + few_b // BLOCK_ROWS
    by_unit = np.argsort(unit, kind="stable")
    unit = unit[by_unit]
    row, column = row[~narrow], column[~narrow]
    by_row = np.argsort(row, kind="stable")
    row, column = row[by_row], column[by_row]
    edges = np.searchsorted(row, np.arange(0, nb + 1) * BLOCK_ROWS)
    have = [np.unique(column[edges[k] : edges[k + 1]]) for k in range(nb)]

    def dense(k, among):
        r, c = row[edges[k] : edges[k + 1]] - k * BLOCK_ROWS, column[edges[k] : edges[k + 1]]
        at = np.minimum(np.searchsorted(among, c), len(among) - 1)
        in_it = among[at] == c
        x = np.zeros((min(m, (k + 1) * BLOCK_ROWS) - k * BLOCK_ROWS, len(among)), np.float32)
        x[r[in_it], at[in_it]] = 1
        return x

    for i in range(nb):
        for j in range(i, nb):
            a0, a1, b0, b1 = i * BLOCK_ROWS, min(m, (i + 1) * BLOCK_ROWS), j * BLOCK_ROWS, min(m, (j + 1) * BLOCK_ROWS)
            if 100 * n[a1 - 1] < t * n[b0] or (labels[a0:a1] == labels[a0]).all() and (labels[b0:b1] == labels[a0]).all():
                continue
            counts = np.zeros((a1 - a0, b1 - b0), np.float32)
            some = by_unit[np.searchsorted(unit, i * nb + j) : np.searchsorted(unit, i * nb + j, side="right")]
            counts[few_a[some] - a0, few_b[some] - b0] = few[some]
            need = -(-t * (n[a0:a1, None] + n[None, b0:b1]) // (100 + t))
            both = np.intersect1d(have[i], have[j], assume_unique=True)
            for at in range(0, len(both), BLOCK_COLUMNS):
                if not (counts + (len(both) - at) >= need).any():
                    break
                part = both[at : at + BLOCK_COLUMNS]
                x = dense(i, part)
                counts += x @ (x if i == j else dense(j, part)).T
            a, b = np.nonzero(counts >= need)
            a, b = a + a0, b + b0
            labels = merged(labels, a[a < b], b[a < b])
    return labels


def component_members(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n, node, digest, label) for every row of docs: its set's size and digest, its text's
    digest, and its component, which is null for the empty set."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.withColumn("digest", text_digest(F.col("text")))
    heavy = spark.sparkContext.broadcast(frequent_slots(texts.select("text"), n))

    def first_blocks(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                first, last, columns, node = ordered_sets(data, offsets, *heavy.value, n)
                take = prefix_length(last - first, threshold)
                at = np.repeat(first - np.cumsum(take) + take, take) + np.arange(take.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))), pa.int32()), pa.array((columns[at] ^ (U(1) << U(63))).view(np.int64)))  # signed order is column order
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(last - first, pa.int64()), pa.array(node), batch.column(2).slice(a, b - a), lists], ["doc_id", "n", "node", "digest", "prefix"])

    def whole_sets(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                first, last, columns, node = ordered_sets(data, offsets, *heavy.value, n)
                blobs = [columns[i:j].tobytes() for i, j in zip(first, last, strict=True)]
                yield pa.record_batch([pa.array(node), pa.array(last - first, pa.int32()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(blobs, pa.binary())], ["node", "n", "token", "salt", "columns"])

    rows = written(hashed.mapInArrow(first_blocks, "doc_id long, n long, node long, digest long, prefix array<long>"), "ngram-rows")
    sets = rows.where("n > 0").groupBy("node").agg(F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix"))
    posting = sets.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    times = posting.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("times")).where("times > 1")
    posting = written(posting.join(times, "token").select("token", "node", "n", F.col("pos").cast("int").alias("pos"), "times"), "ngram-posting")
    few, many = posting.where(F.col("times") <= FREQUENT), posting.where(F.col("times") > FREQUENT)
    # sets with columns of many sets: how many, and the first of them, by which they are multiplied
    hubs = many.groupBy("node").agg(F.count(F.lit(1)).alias("others"), F.min(F.struct("pos", "token")).alias("x"), F.first("n").alias("n"))
    hubs = written(hubs.select("node", "n", "others", F.col("x.token").alias("token")), "ngram-hubs")

    # product of the first blocks over columns of few sets, and the bound on what can still come
    t = threshold
    sizes_meet = (100 * F.col("na") >= t * F.col("nb")) & (100 * F.col("nb") >= t * F.col("na"))
    counts = few.select("token", F.col("node").alias("a"), F.col("n").alias("na")).join(few.select("token", F.col("node").alias("b"), F.col("n").alias("nb")), "token")
    counts = counts.where((F.col("a") < F.col("b")) & sizes_meet).groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    others = small(hubs.select("node", "others"))
    counts = counts.join(others.toDF("a", "others_a"), "a", "left").join(others.toDF("b", "others_b"), "b", "left")
    # where one first block ends the count is complete, but for columns of many sets
    zero = F.lit(0)
    to_come = F.least(F.coalesce("others_a", zero), F.coalesce("others_b", zero)) + F.ceil(F.greatest("na", "nb") * t / 100) - 1
    candidates = written(counts.where((100 + t) * (F.col("count") + to_come) >= t * (F.col("na") + F.col("nb"))).select("a", "b"), "ngram-candidates")

    # whole sets of all that is in either, from one row each, in streams by their first column of many sets
    parts = hubs.groupBy("token").agg(F.ceil(F.greatest(F.count(F.lit(1)) / STREAM_ROWS, F.sum("n") / STREAM_COLUMNS)).alias("parts"))
    parts = small(written(parts.where("parts > 1"), "ngram-parts"))
    nothing = F.lit(None).cast("long")
    active = rows.where("n > 0").select("node", F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest").alias("who"), nothing.alias("token"), F.lit(0).alias("used"))
    active = active.unionByName(hubs.select("node", "token", F.lit(1).alias("used")), True)
    active = active.unionByName(candidates.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).alias("used")), True)
    active = active.groupBy("node").agg(F.min("who").alias("who"), F.max("token").alias("token"), F.max("used").alias("used")).where("used = 1")
    salt = F.when(F.col("token").isNull(), F.xxhash64("node")).otherwise(F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
    active = written(active.join(parts, "token", "left").select("who.late", "who.id", "who.digest", "token", salt.alias("salt")), "ngram-active")
    chosen = hashed.select("text", F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest").join(small(active), ["late", "id", "digest"])
    matrix = chosen.select("text", "token", "salt").mapInArrow(whole_sets, "node long, n int, token long, salt long, columns binary")
    matrix = matrix.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "node")

    def streams(batches):
        """Rows of one stream after the other, with their component in it and their chunk of that."""
        key, held, seen = None, [], None

        def settle():
            sets = [np.frombuffer(x, U) for _, _, x in held]
            labels = block_components(sets, threshold) if len(sets) > 1 else np.zeros(1, np.int64)
            node = np.array([x for x, _, _ in held], np.int64)
            order = np.argsort(labels, kind="stable")
            first = np.searchsorted(labels[order], labels[order])
            chunk = np.empty(len(order), np.int32)
            chunk[order] = (np.arange(len(order)) - first) // CHUNK_ROWS
            # a component is called after its smallest node
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, labels, node)
            token, salt = key
            same = [pa.array(np.full(len(node), x if x is not None else 0, np.int64), mask=np.full(len(node), x is None)) for x in (token, salt)]
            return pa.record_batch([pa.array(node), pa.array([x for _, x, _ in held], pa.int32()), *same, pa.array(least[labels]), pa.array(chunk), pa.array([x for _, _, x in held], pa.binary())], ["node", "n", "token", "salt", "label", "chunk", "columns"])

        for batch in batches:
            for node, size, token, salt, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (token, salt) != key:
                    if held:
                        yield settle()
                    key, held, seen = (token, salt), [], None
                if node != seen:  # rows of one set, where many without a doc_id repeat a text
                    held.append((node, size, blob))
                    seen = node
        if held:
            yield settle()

    matrix = written(matrix.mapInArrow(streams, "node long, n int, token long, salt long, label long, chunk int, columns binary"), "ngram-matrix", "lz4")

    # pairs of components of different streams that share a column of many sets, by chunks
    placed = small(matrix.select("node", F.xxhash64("token", "salt").alias("stream"), "label", "chunk"))
    side = many.join(placed, "node").groupBy("token", "stream", "label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))  # columns from this one on
    side = written(side, "ngram-sides")
    several = small(written(side.groupBy("token").agg(F.min("stream").alias("lo"), F.max("stream").alias("hi")).where("lo < hi").select("token"), "ngram-shared"))
    side = side.join(several, "token", "left_semi")
    left, right = side.toDF("token", "sa", "la", "lo_a", "hi_a", "ra"), side.toDF("token", "sb", "lb", "lo_b", "hi_b", "rb")
    ranges_meet = (100 * F.col("hi_a") >= t * F.col("lo_b")) & (100 * F.col("hi_b") >= t * F.col("lo_a"))
    overlap_bound = (100 + t) * F.least("ra", "rb") >= t * (F.col("lo_a") + F.col("lo_b"))
    labels = left.join(right, "token").where((F.col("sa") < F.col("sb")) & ranges_meet & overlap_bound).select("la", "lb").distinct()
    chunks = small(written(matrix.groupBy("label", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "ngram-chunks"))
    units = labels.join(chunks.toDF("la", "ca", "lo_a", "hi_a"), "la").join(chunks.toDF("lb", "cb", "lo_b", "hi_b"), "lb").where(ranges_meet)
    of_a, of_b = (placed.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("chunk").alias(f"c{x}")) for x in "ab")
    found = candidates.join(of_a, "a").join(of_b, "b").where("la <> lb")
    units = units.select("la", "ca", "lb", "cb").unionByName(found.select("la", "ca", "lb", "cb"))
    one, other = F.struct(F.col("la").alias("label"), F.col("ca").alias("chunk")), F.struct(F.col("lb").alias("label"), F.col("cb").alias("chunk"))
    units = written(units.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).distinct(), "ngram-pairs")
    sets = matrix.groupBy("label", "chunk").agg(F.collect_list("columns").alias("columns"))  # CHUNK_ROWS of them at most
    units = units.select(F.col("x.label").alias("la"), F.col("x.chunk").alias("ca"), F.col("y.label").alias("lb"), F.col("y.chunk").alias("cb"))
    units = units.join(sets.toDF("la", "ca", "columns_a"), ["la", "ca"]).join(sets.toDF("lb", "cb", "columns_b"), ["lb", "cb"]).select("la", "lb", "columns_a", "columns_b")

    def verify(batches):
        for batch in batches:
            keep = [any(reaches(x, y, threshold) for x in of_a for y in of_b) for of_a, of_b in ([[np.frombuffer(s, U) for s in c.as_py()] for c in pair] for pair in zip(batch.column(2), batch.column(3), strict=True))]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    further = connected_components(units.mapInArrow(verify, "a long, b long"))
    of_set = matrix.select("node", "label").join(small(further.toDF("label", "to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    members = rows.select("doc_id", "n", "node", "digest").join(small(written(of_set, "ngram-labels")), "node", "left")
    return members.withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "node")))


def jaccard_components(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    members = component_members(docs, n, threshold)
    # the names of components of several rows; a row on its own has its own
    names = members.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    out = members.join(small(written(names, "ngram-names")), "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("rows") > 1, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_one(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """Of each component one row with a doc_id, the smallest, which names it, and one without if it has
    such; of several the text with the smallest digest. Rows without words link with
    nothing and stay, but for rows that repeat doc_id and text, which are one document."""
    members = component_members(docs, n, threshold).select("doc_id", "digest", "label")
    first = F.struct("doc_id", "digest")
    linked = members.where("label is not null").groupBy("label", F.col("doc_id").isNull().alias("late")).agg(F.min(first).alias("x")).select("x.doc_id", "x.digest")
    # repeats of a row without a doc_id and without words are not known to be one document
    alone = members.where("label is null and doc_id is not null").select("doc_id", "digest").distinct()
    keep = linked.unionByName(alone).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_late"), F.col("digest").alias("_digest"))
    names = {c: f"column {i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(a) for c, a in names.items()])
    doc_id, text = F.col(f"`{names['doc_id']}`").cast("long"), F.col(f"`{names['text']}`").cast("string")
    rows = rows.select("*", F.coalesce(doc_id, F.lit(0)).alias("_id"), doc_id.isNull().alias("_late"), text_digest(text).alias("_digest"))
    one = rows.join(keep, ["_id", "_late", "_digest"], "left_semi").dropDuplicates(["_id", "_late", "_digest"])
    empty = rows.where(doc_id.isNull() & ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]")))
    return one.unionByName(empty).select(*[F.col(f"`{a}`").alias(c) for c, a in names.items()])


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
