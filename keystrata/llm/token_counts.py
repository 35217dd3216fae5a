"""Token counts of documents in flat token files without an index.

A token file is 16-bit little-endian ids, one document after the other, an end-of-document id
after each. Blocks of a file are searched for that id on their own, each in one vectorised
comparison; a prefix scan over the blocks' summaries (separators seen, place of the last one)
then says which documents a block's separators end and how many tokens came before the block.

`write_token_files` makes such files from texts with a public byte-pair vocabulary, whose path is
a parameter; it is read once and sent to the tasks (a vocabulary has a fixed size).

Scale: no shuffle but for one small row a block and the counts themselves. A task holds one block.
A file's name belongs to one attempt of one task. Long documents span blocks and need nothing
special.

Defined results: null and empty texts have 0 tokens; text that looks like a special token is
ordinary text; ids at the end of a file without a separator are a document with `ended` false;
repeated rows and null doc_ids are documents like others; other columns are ignored; empty files
and tables give no rows.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, table, task_name, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 29
#: Fixed value: how the public vocabulary's training cut text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def encoder(vocabulary: bytes):
    """The tokenizer, built once a worker for each vocabulary."""
    if vocabulary not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _encoders[vocabulary] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Writes flat files and returns the order of documents in them: doc_id, file, ordinal. Ids have 16 bits, and
    `end` must be none of the vocabulary's."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    ids = {int(line.split()[1]) for line in content.splitlines() if line.strip()}
    if end in ids or not 0 <= end <= 0xFFFF or max(ids, default=0) > 0xFFFF:
        raise ValueError(f"{vocabulary} has ids beyond 16 bits, or the separator {end} is one of its ids")
    ranks = docs.sparkSession.sparkContext.broadcast(content)

    def write(batches):
        out, size, ordinal = None, 0, 0
        for batch in batches:
            encode = encoder(ranks.value).encode_ordinary
            files, ordinals = [], []
            for text in batch.column(1):
                ids = np.array([*encode(text.as_py() or ""), end], "<u2")
                if out is None or size >= FILE_TOKENS:
                    if out is not None:
                        out.close()
                    uri, size, ordinal = f"{folder}/{task_name()}.tokens", 0, 0
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                out.write(ids.tobytes())
                files.append(uri)
                ordinals.append(ordinal)
                ordinal, size = ordinal + 1, size + len(ids)
            yield pa.record_batch([batch.column(0), pa.array(files, pa.string()), pa.array(ordinals, pa.int64())], ["doc_id", "file", "ordinal"])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "doc_id long, file string, ordinal long")
    return written(rows, "token-order")


def count_tokens(files: DataFrame, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the files of column `file`."""

    def cut(batches):
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                fs, path = filesystem(uri)
                n = fs.get_file_info(path).size // 2
                rows += [(uri, k, b, min(block_tokens, n - b)) for k, b in enumerate(range(0, n, block_tokens))]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "block", "start", "n"])

    def scan(batches):
        for batch in batches:
            for uri, block, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(2 * n, 2 * start), "<u2")
                ends = np.flatnonzero(ids == end) + start
                # tokens before each separator, counted from the separator before it or the block's start
                counts = np.diff(ends, prepend=start - 1) - 1
                last = int(ends[-1]) if len(ends) else None
                arrays = [[uri], [block], [start], [n], [len(ends)], [last], [counts]]
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(v, t) for v, t in zip(arrays, types, strict=True)], ["file", "block", "start", "n", "n_ends", "last_end", "counts"])

    blocks = files.select("file").distinct().mapInArrow(cut, "file string, block long, start long, n long")
    seen = blocks.repartition("file", "block").mapInArrow(scan, "file string, block long, start long, n long, n_ends long, last_end long, counts array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = seen.select(
        "file", "counts", "n_ends", "start", "n",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("base"),
        (F.col("start") - 1 - F.coalesce(F.max("last_end").over(before), F.lit(-1))).alias("carried"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("is_last"),
        F.coalesce("last_end", F.col("start") - 1).alias("upto"),
    )
    tail = F.col("start") + F.col("n") - 1 - F.col("upto") + F.when(F.col("n_ends") == 0, F.col("carried")).otherwise(0)
    whole = scanned.select("file", "base", "carried", F.posexplode("counts").alias("k", "n_tokens")).select(
        "file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("n_tokens") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended")
    )
    open_end = scanned.where(F.col("is_last") & (tail > 0)).select("file", (F.col("base") + F.col("n_ends")).alias("ordinal"), tail.alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(open_end)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens, by way of flat token files."""
    order = write_token_files(docs, shared_dir(docs.sparkSession, "tokens"), vocabulary)
    counts = count_tokens(order)
    # the order is small in its file and large in memory, so it is not for broadcasting
    return order.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
