"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words go into one automaton. Documents stream through it word by word: the
state holds the longest suffix of the words so far that occurs in any item, and its length. Every
word inside an occurrence of a window (WINDOW consecutive item words; a shorter item is one
window) is hit.

Scale: documents are read once where they lie, without a shuffle. The benchmark is cut into
shards of about SHARD_WORDS item words, as many as it takes, in the shared folder; each shard's
automaton is built in the workers that read it there, and documents meet the shards one after the
other, HELD_BYTES of text at a time. Nothing of the benchmark goes through the driver. A worker keeps KEPT automata, so benchmarks of as many shards are
built once a worker, larger ones once for HELD_BYTES. A word pair that no item holds can't lie in a window, so only runs of known pairs that
are long enough for a window walk through the automaton.

Defined results: null and empty texts have no words, no hits and the digest of the empty string;
items without words have no windows; items with equal text all count; a null item_id takes
part in hits but not in lists of items; repeated item_ids count once; repeated documents give
repeated rows; without items nothing is hit; other columns are ignored by the digests and carried
along by `decontaminate`.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, blocks, filesystem, mix, prefix_hash, shared_dir, span_hash, table, words

WINDOW = 10
SHARD_WORDS = 200_000
HELD_BYTES = 32 << 20
KEPT = 3
MOST_WRITERS = 200
MAX_SPAN = 200
MAX_COVERAGE = 0.5


class Automaton:
    """Suffix automaton of several word sequences; states say which items' windows end there."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int = WINDOW):
        self.next, self.link, self.length = [{}], [-1], [0]
        sequences = [(k, w.tolist()) for k, w in items if len(w)]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        #: state -> (length of the window that ends there, items that hold it)
        self.ends: dict[int, list[tuple[int, set]]] = {}
        self.shortest = min([window, *(len(s) for _, s in sequences)], default=window)
        for item, sequence in sequences:
            size, state = min(window, len(sequence)), 0
            for i, word in enumerate(sequence):
                state = self.next[state][word]  # whole prefixes of items are paths from the root
                if i + 1 >= size:
                    self._mark(self._cut(state, size), size, item)
        self.found: list[tuple | None] = [None] * len(self.next)
        self.vocabulary = np.unique(np.concatenate([w for _, w in items if len(w)])) if sequences else np.zeros(0, np.uint64)
        pairs = [w[:-1] * np.uint64(3) + mix(w[1:]) for _, w in items if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state({}, -1, self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
        else:
            q = self.next[last][word]
            self.link[new] = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _cut(self, state: int, size: int) -> int:
        """The state of the last `size` words of what `state` stands for."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, state: int, size: int, item) -> None:
        for known, items in self.ends.setdefault(state, []):
            if known == size:
                items.add(item)
                return
        self.ends[state].append((size, {item}))

    def windows(self, state: int) -> tuple:
        """(size, items) of all windows that end in `state`, by way of its suffix links."""
        got = self.found[state]
        if got is None:
            up = self.link[state]
            got = self.found[state] = tuple(self.ends.get(state, ())) + (self.windows(up) if up > 0 else ())
        return got

    def stream(self, sequence: list[int]):
        """(index of the last word, window size, items) of every window occurrence."""
        step, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, word in enumerate(sequence):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
                if matched >= self.shortest:
                    for size, items in self.windows(state):
                        if size <= matched:
                            yield i, size, items


def text_words(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    begin, end, row = words(low, offsets, ALNUM)
    return begin, end, row, span_hash(prefix_hash(low), begin, end) if len(begin) else np.zeros(0, np.uint64)


def _known(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def find_hits(automaton: Automaton, row: np.ndarray, hashes: np.ndarray, hit: np.ndarray, items: dict) -> None:
    """Sets hit for words in windows and adds to items[row]; all arrays are by word."""
    n = len(hashes)
    alive = _known(automaton.vocabulary, hashes)
    joined = np.zeros(n, bool)  # with the word before
    if n > 1:
        both = np.flatnonzero(alive[1:] & alive[:-1] & (row[1:] == row[:-1])) + 1
        joined[both] = _known(automaton.pairs, hashes[both - 1] * np.uint64(3) + mix(hashes[both]))
    first = np.flatnonzero(alive & ~joined)
    if not len(first):
        return
    after = alive.copy()
    after[:-1] &= ~joined[1:]
    last = np.flatnonzero(after)
    long = last - first + 1 >= automaton.shortest
    for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
        for i, size, found in automaton.stream(hashes[a : b + 1].tolist()):
            hit[a + i + 1 - size : a + i + 1] = True
            items.setdefault(int(row[a]), set()).update(found)


def shards(benchmark: DataFrame, limit: int = SHARD_WORDS) -> list[str]:
    """Folders with the items in shards of about `limit` words (an item that is longer makes its shard
    larger), written to the shared folder; the driver holds their names only."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words_of = F.floor(F.octet_length("text") / 2) + 1  # no text has more
    n = -(-(items.agg(F.sum(words_of)).head()[0] or 0) // limit)
    if not n:
        return []
    folder = shared_dir(benchmark.sparkSession, "benchmark")
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    dealt.repartition(min(n, MOST_WRITERS), "shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(folder)
    return [f"{folder}/shard={k}" for k in range(n)]


_built: dict = {}


def _automaton(shard: str, window: int) -> Automaton:
    """A worker keeps the KEPT automata that it used last, known by their shards' folders, which are new in
    every run."""
    automaton = _built.pop((shard, window), None)
    if automaton is None:
        fs, path = filesystem(shard)
        items = []
        for file in fs.get_file_info(FileSelector(path, allow_not_found=True)):  # a shard may have no items
            if file.path.endswith(".parquet"):
                for batch in pq.ParquetFile(fs.open_input_file(file.path)).iter_batches(columns=["item", "text"]):
                    for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        raw = np.frombuffer(text.encode(), np.uint8)
                        items.append((item, text_words(raw, np.array([0, len(raw)]))[3]))
        while len(_built) >= KEPT:
            del _built[next(iter(_built))]
        automaton = Automaton(items, window)
    _built[shard, window] = automaton
    return automaton


def _scan(column: pa.Array, parts: list, window: int):
    """Yields per block (first row, end row, bytes, offsets, begin, end, row, hit, items)."""
    held, size = [], 0

    def met():
        """The held blocks meet one shard after the other, whose automata are built one at a time."""
        for part in parts:
            automaton = _automaton(part, window)
            for *_, row, hit, items, hashes in held:
                find_hits(automaton, row, hashes, hit, items)
        return [x[:-1] for x in held]

    for a, b, data, offsets in blocks(column):
        begin, end, row, hashes = text_words(data, offsets)
        held.append((a, b, data, offsets, begin, end, row, np.zeros(len(begin), bool), {}, hashes))
        size += len(data)
        if len(parts) < 2 or size >= HELD_BYTES:
            yield from met()
            held, size = [], 0
    yield from met()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digest of every document's hits."""
    parts = shards(benchmark)

    def digest(batches):
        for batch in batches:
            for a, b, _, _, _, _, row, hit, items in _scan(batch.column(1), parts, window):
                n_words = np.bincount(row, minlength=b - a)
                n_hit = np.bincount(row[hit], minlength=b - a)
                names = [sorted(x for x in items.get(i, ()) if x is not None) for i in range(b - a)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                        pa.array(n_hit > 0),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, schema)


def clean_text(data: bytes, begin, end, hit, max_span: int, max_coverage: float) -> str | None:
    """The text without its hit spans, the blank that follows each included; None if a span has
    more than max_span words or more than max_coverage of the words are hit."""
    spans = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    first, last = spans[::2], spans[1::2]
    if hit.sum() > max_coverage * len(hit) or np.any(last - first > max_span):
        return None
    kept, at = [], 0
    for i, j in zip(first, last, strict=True):
        kept.append(data[at : begin[i]])
        at = end[j - 1]
        while at < len(data) and data[at] in b" .,;:!?":
            at += 1
    return (b"".join(kept) + data[at:]).decode("utf-8", "ignore")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = MAX_SPAN, max_coverage: float = MAX_COVERAGE, length: str | None = "n_chars") -> DataFrame:
    """The documents without benchmark passages: spans are cut out of the text, and a document goes
    if a span is longer than max_span words or spans cover more than max_coverage of its words."""
    parts = shards(benchmark)
    at = docs.columns.index("text")

    def clean(batches):
        for batch in batches:
            for a, b, data, offsets, begin, end, row, hit, _ in _scan(batch.column(at), parts, window):
                part, texts, keep = batch.slice(a, b - a), batch.column(at).slice(a, b - a), None
                if hit.any():
                    texts, keep = texts.to_pylist(), np.ones(b - a, bool)
                    edges = np.searchsorted(row, np.arange(b - a + 1))
                    for r in np.unique(row[hit]):
                        w, z = slice(edges[r], edges[r + 1]), offsets[r]
                        texts[r] = clean_text(data[z : offsets[r + 1]].tobytes(), begin[w] - z, end[w] - z, hit[w], max_span, max_coverage)
                        keep[r] = texts[r] is not None
                    texts = pa.array(texts, batch.schema.field(at).type)
                out = pa.record_batch([texts if i == at else c for i, c in enumerate(part.columns)], schema=batch.schema)
                yield out if keep is None else out.filter(pa.array(keep))

    out = docs.mapInArrow(clean, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
    return out.withColumn(length, F.length("text").cast("long")) if length in docs.columns else out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
