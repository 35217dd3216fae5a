import hashlib
import random

import numpy as np

from keystrata.llm import suffix_dedup


def brute(rows, length=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            if k in seen:
                gone[i : i + length] = True
            seen.add(k)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((doc_id, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma délta zeta theta 北京 omega".split())
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(10, 60)) for _ in range(4)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 450, "ab" * 200, "-" * 130]
    for _ in range(25):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 10))]
        texts.append(rng.choice(["", "\n"]).join(parts))
    return texts + texts[-3:]


def test_against_brute_force(spark, make_docs, monkeypatch):
    texts = corpus(3)
    got = suffix_dedup.repeat_digest(make_docs(texts, extra=True)).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


def test_small_pieces_blocks_and_batches(spark, make_docs, monkeypatch):
    texts = corpus(4)
    for name, value in (("PIECE_BYTES", 150), ("FLUSH_RUNS", 5), ("SCAN_BYTES", 700)):
        monkeypatch.setattr(suffix_dedup, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = suffix_dedup.repeat_digest(make_docs(texts)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


def test_one_passage_quoted_differently_everywhere(spark, make_docs):
    """Many different runs meet in the buckets of one passage, in batches of a few rows."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) + passage[rng.randint(0, 30) :] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = suffix_dedup.repeat_digest(make_docs(texts)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


def test_large_and_null_ids(spark, make_docs):
    """Any long is a doc_id; the greatest one still comes before rows without."""
    long = " ".join(f"word{i}" for i in range(40))
    texts = [f"{c} {long} {c}" for c in "abcdef"]
    ids = [(1 << 63) - 1, (1 << 62) + 7, -(1 << 63), -5, None, 1 << 62]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_digest(make_docs(texts, ids)).collect()}
    assert got == {i: 0 if i == -(1 << 63) else len(long) + 2 for i in ids}


def test_repeated_rows_null_ids_and_empty_table(spark, make_docs):
    long = " ".join(f"word{i}" for i in range(60))
    docs = make_docs([long, long, long, "y" + long, None], [1, 1, None, None, None])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.repeat_digest(docs).collect()), key=repr)
    n = len(long)
    assert got == sorted([(1, n, 0), (1, n, 0), (None, n, n), (None, n + 1, n), (None, 0, 0)], key=repr)
    assert suffix_dedup.repeat_digest(docs.limit(0)).count() == 0


def test_removal_keeps_columns_and_counts(spark, make_docs):
    long = " ".join(f"wörd{i}" for i in range(60))
    docs = make_docs(["start " + long, long + " end", "short"], extra=True)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {0: ("start " + long, len(long) + 6), 1: (" end", 4), 2: ("short", 5)}


def test_many_texts_of_one_id_are_told_apart(spark, make_docs):
    """Texts under one doc_id, more than 15 bits of a digest could name."""
    long = " ".join(f"word{i}" for i in range(40))
    texts = [f"{i} {long} {i}" for i in range(1500)]
    docs = make_docs(texts, [1] * len(texts))
    in_order = [r.text for r in docs.selectExpr("text", "xxhash64(text) AS h").orderBy("h").collect()]
    got = suffix_dedup.repeat_digest(docs).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(r[1:] for r in brute(list(enumerate(in_order))))
