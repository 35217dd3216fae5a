import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from keystrata.llm import decontaminate, license_scan, media_ogg, mixing, quality_crf, token_counts, toxicity_chain, warc
from keystrata.llm.common import string_bytes, table
from keystrata.llm.labelled import logistic, training_sample

from ..conftest import SMALL
from .conftest import random_words


def windows_brute(docs, items, window=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    known = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            known[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc_id, text in docs:
        w, found = split(text), set()
        hit = [False] * len(w)
        for n in set(map(len, known)):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    found |= known[tuple(w[i : i + n])]
                    hit[i : i + n] = [True] * n
        out.append((doc_id, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out)


def test_decontamination_against_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(1)
    items = [(i, random_words(rng, rng.choice([1, 2, 5, 10, 11, 30]), 40)) for i in range(30)] + [(30, ""), (31, None), (32, "W1 w2! w3"), (33, "w1 w2 w3")]
    texts = [None, "", "...", "w1, W2;w3"] + [random_words(rng, rng.randint(1, 200), 40) for _ in range(40)]
    texts += [f"{random_words(rng, 5)} {t} {random_words(rng, 5)}" for _, t in items if t]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = windows_brute(list(enumerate(texts)), items)
    assert sorted(map(tuple, decontaminate.contamination(make_docs(texts, extra=True), bench).collect())) == want
    monkeypatch.setattr(decontaminate.shards, "__defaults__", (25,))  # several automata
    assert sorted(map(tuple, decontaminate.contamination(make_docs(texts), bench).collect())) == want
    assert decontaminate.contamination(make_docs(texts).limit(0), bench).count() == 0
    assert decontaminate.contamination(make_docs(texts), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_cuts_spans(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = " ".join(f"z{i}" for i in range(30))
    docs = make_docs([f"{long} {item}. {long}", item, long, None], extra=True)
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: f"{long} {long}", 2: long, 3: None}


def test_ogg_round_trip_and_damage():
    rng = random.Random(2)
    for n in (0, 1, 64, 255, 4096, 65_025, 300_000):
        payload = rng.randbytes(n)
        data = media_ogg.encode(payload)
        samples, seen = media_ogg.decode(data)
        assert samples == payload and seen["bad_pages"] == 0 and seen["streams"] == 2
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    samples, seen = media_ogg.decode(bytes(broken))
    assert seen["bad_pages"] == 1 and samples != payload


def test_ogg_times_come_from_granules():
    """The duration of a stream that is cut off is that of what is there, whatever its header says."""
    payload = random.Random(3).randbytes(50_000)
    data = media_ogg.encode(payload)
    _, whole = media_ogg.decode(data)
    assert whole["duration_ms"] == 50_000 * 1000 // media_ogg.RATE and whole["lost"] == 0
    streams, _ = media_ogg.demultiplex(data)
    for found in streams.values():
        s = media_ogg._IDENTITY.unpack(found[0][1])[3]
        ends = [min((k + 1) * media_ogg.PACKET, len(payload)) for k in range(s, -(-len(payload) // media_ogg.PACKET), media_ogg.STREAMS)]
        assert [t for t, _ in media_ogg.packet_times(found[1:], media_ogg.STREAMS)] == ends
    starts = [i for i in range(len(data)) if data[i : i + 4] == b"OggS"]
    samples, seen = media_ogg.decode(data[: starts[len(starts) // 2]])
    assert payload.startswith(samples[: media_ogg.PACKET]) and seen["lost"] == 50_000 - len(samples) > 0
    assert seen["duration_ms"] < whole["duration_ms"]


def test_ogg_packets_over_damaged_pages():
    """Long packets of two streams in turns over several pages: a bad page costs its stream's packet, not the other's."""
    rng = random.Random(4)
    packets = {s: [b"head", *(rng.randbytes(100_000) for _ in range(2))] for s in (1, 2)}
    pages = {s: [p for _, p in media_ogg.logical_pages(x, [0, 1, 2], s)] for s, x in packets.items()}
    mixed = [(s, p) for some in zip(pages[1], pages[2], strict=True) for s, p in zip((1, 2), some, strict=True)]
    streams, seen = media_ogg.demultiplex(b"".join(p for _, p in mixed))
    assert {s: [p for _, p in found] for s, found in streams.items()} == packets and seen["bad_pages"] == 0
    k = next(i for i, (s, _) in enumerate(mixed) if s == 1 and i > 1)  # holds the first part of one packet only
    broken = bytearray(mixed[k][1])
    broken[200] ^= 1
    streams, seen = media_ogg.demultiplex(b"".join(bytes(broken) if i == k else p for i, (_, p) in enumerate(mixed)))
    assert seen["bad_pages"] == 1 and [p for _, p in streams[2]] == packets[2]
    assert [p for _, p in streams[1]] == [packets[1][0], packets[1][2]]


def test_ogg_checksum():
    crc = 0
    for byte in b"page":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert media_ogg.page_checksum(b"page") == crc


def test_ogg_rows(spark, make_docs):
    texts = [None, "", "a", "é" * 3000, "é" * 3000]
    rows = {r.doc_id: r for r in media_ogg.media_features(media_ogg.text_to_media(make_docs(texts, extra=True))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    assert rows[3].asDict() | {"doc_id": 4} == rows[4].asDict() and rows[0].media_sha256 == rows[1].media_sha256
    assert media_ogg.text_to_media(make_docs(texts).limit(0)).count() == 0


def test_warc_records(spark, tmp_path):
    html = ["<p>same</p>", "<p>same</p>", None, "", "é" * 5000, "<p>same</p>", "<p>same</p>"]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://x/{i} \r\n", h, "k") for i, h in zip([5, 3, 8, 9, 1, None, 5], html, strict=True)], "page_id long, url string, html string, digest string")
    index = warc.write_archives(warc.elect(pages), str(tmp_path / "a"), file_bytes=300)
    assert index.select("file").distinct().count() > 1
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(index, most=100, gap=10).collect()), key=repr)
    want = [(5, 11, "response", None), (5, 11, "response", None), (3, 11, "revisit", 5), (None, 11, "revisit", 5), (8, 0, "revisit", 9), (9, 0, "response", None), (1, 10_000, "response", None)]
    assert got == sorted(want, key=repr)
    some = warc.read_records(index.where("page_id = 1"), payloads=True).collect()
    assert [bytes(r.payload).decode() for r in some] == ["é" * 5000]
    empty = warc.write_archives(warc.elect(pages.limit(0)), str(tmp_path / "b"))
    assert warc.read_records(empty).count() == 0


def test_token_counts(spark, make_docs, tmp_path):
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.encoder(f.read()).encode_ordinary
    texts = [None, "", "hello <|endoftext|> world", "word " * 3000, "x", "x"]
    order = token_counts.write_token_files(make_docs(texts, extra=True), str(tmp_path / "t"))
    want = {i: len(encode(t or "")) for i, t in enumerate(texts)}
    for block in (1, 7, 1000, 1 << 20):
        counts = token_counts.count_tokens(order, block_tokens=block).join(order, ["file", "ordinal"]).collect()
        assert {r.doc_id: r.n_tokens for r in counts} == want and all(r.ended for r in counts)
    np.array([1, 2, 50256, 50256, 3, 4, 5], "<u2").tofile(tmp_path / "open.tokens")
    files = spark.createDataFrame([(str(tmp_path / "open.tokens"),)], "file string")
    for block in (1, 2, 3, 100):
        got = sorted((r.ordinal, r.n_tokens, r.ended) for r in token_counts.count_tokens(files, block_tokens=block).collect())
        assert got == [(0, 2, True), (1, 0, True), (2, 3, False)]
    assert token_counts.token_counts(make_docs(texts).limit(0)).count() == 0


def test_mixing_fills_targets(spark, make_docs, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", *[random_words(rng, rng.randint(1, 40)) for _ in range(400)]]
    docs = make_docs(texts, extra=True)
    rows = mixing.mix_sources(docs, keep=("source", "lang")).collect()
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert abs(sum(r[0].target for r in by.values()) - 1.5 * total) < 1e-6
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 20 and group[0].target <= 2 * group[0].source_size
    again = mixing.mix_sources(docs.repartition(5), keep=("source", "lang")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs.where("text = '' or text is null")).collect()} == {0}


def test_license_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "Some work. This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "LICENSE", mit), (2, "a/b/LICENSE", gpl), (3, "a/b/c/x.py", "print"), (4, "a/y.py", ""), (5, "a/b/z.py", "# " + mit), (6, None, None), (6, None, None), (7, "ab/q", "the and of")]
    files = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, statement string")
    got = sorted(((r.doc_id, r.own_license, r.license, r.inherited_from) for r in license_scan.scan_licenses(files).collect()), key=repr)
    assert got == [(1, "MIT", "MIT", None), (2, "GPL-3.0", "GPL-3.0", None), (3, None, "GPL-3.0", "a/b"), (4, None, "MIT", ""), (5, "MIT", "MIT", None), (6, None, None, None), (6, None, None, None), (7, None, "MIT", "")]
    assert license_scan.scan_licenses(files.limit(0)).count() == 0


def held_out_accuracy(df, labels, label):
    rows = df.join(labels, "doc_id").where("held_out").selectExpr(f"avg(cast(predicted = {label} as int)) as a", "count(*) as n").first()
    return rows.a, rows.n


def test_quality_on_held_out_documents(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    accuracy, n = held_out_accuracy(quality_crf.quality_scores(docs, labels), labels, "quality")
    assert n > 50 and accuracy > 0.93


def test_token_files_refuse_ids_that_do_not_fit(spark, make_docs, tmp_path):
    small = tmp_path / "small.tiktoken"
    small.write_bytes(b"YQ== 0\nYg== 50256\n")
    with pytest.raises(ValueError):
        token_counts.write_token_files(make_docs(["a"]), str(tmp_path / "t"), str(small))
    small.write_bytes(b"YQ== 0\nYg== 65536\n")
    with pytest.raises(ValueError):
        token_counts.write_token_files(make_docs(["a"]), str(tmp_path / "t"), str(small))


def test_decontamination_with_null_and_repeated_items(spark, make_docs):
    """Null item_ids hit and are not listed; repeated ones count once; long texts are searched whole."""
    passage = " ".join(f"k{i}" for i in range(12))
    bench = spark.createDataFrame([(None, passage), (4, passage), (4, passage), (5, "lone"), (None, None)], "item_id long, text string")
    texts = ["filler words here " * 30_000 + passage, passage, "a lone word", None]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(make_docs(texts), bench).collect()}
    assert got == {0: (12, 1), 1: (12, 1), 2: (1, 1), 3: (0, 0)}


def test_quality_edges(spark, make_docs):
    texts = [None, "", "\n\n", "Fine text here.\nAnd more.", "x" * 100_000, "x" * 100_000]
    docs = make_docs(texts, extra=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_crf.quality_scores(docs, labels).collect()} == {0.5}
    sf = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    both = sf[0].unionByName(make_docs(texts, [None, 10**9, 10**9 + 1, 10**9 + 2, 10**9 + 3, 10**9 + 3]))
    rows = quality_crf.quality_scores(both, sf[1]).where("doc_id is null or doc_id >= 1000000000").collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 10**9 + 3}) == 1
    assert quality_crf.quality_scores(docs.limit(0), labels).count() == 0
    kept = quality_crf.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 6


def test_field_gradient_matches_enumeration():
    """Marginals of a short chain against all labellings."""
    rng = np.random.default_rng(0)
    score, t = rng.normal(size=4), rng.normal(size=(2, 2))
    ahead, behind = quality_crf.marginals(np.zeros(4, int), score, t)
    weights = {y: np.exp(sum(score[i] * y[i] for i in range(4)) + sum(t[y[i], y[i + 1]] for i in range(3))) for y in np.ndindex(2, 2, 2, 2)}
    for i in range(4):
        want = sum(w for y, w in weights.items() if y[i]) / sum(weights.values())
        assert abs(1 / (1 + np.exp(-(ahead[i] + behind[i] - score[i]))) - want) < 1e-9


def test_toxicity_on_held_out_documents(spark):
    sf = SMALL.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    df = toxicity_chain.toxicity_scores(docs, labels)
    accuracy, _ = held_out_accuracy(df, labels, "toxic")
    assert accuracy > 0.97
    false = df.join(labels, "doc_id").where("held_out and toxic = 0 and predicted = 1").count()
    assert false <= 5


def test_chain_inputs_are_out_of_fold():
    """What a later category learns from against one model for each document, which it is not in the fold of."""
    rng = np.random.default_rng(2)
    base = (rng.random((60, 5)) < 0.3).astype(float)
    targets = [(base[:, 0] + base[:, 1] + rng.random(60) > 1).astype(float), (base[:, 1] + rng.random(60) > 0.8).astype(float), (base[:, 2] + rng.random(60) > 0.9).astype(float)]
    models, x = toxicity_chain.fit_chain(base, targets)
    seen = np.concatenate([base, np.ones((60, 1))], axis=1)
    for k in (0, 1):
        p = np.zeros(60)
        for i in range(60):
            others = [j for j in range(60) if j % toxicity_chain.FOLDS != i % toxicity_chain.FOLDS]
            p[i] = 1 / (1 + np.exp(-seen[i] @ logistic(seen[others], targets[k][others], toxicity_chain.L2)))
        seen = np.concatenate([seen[:, :-1], p[:, None], np.ones((60, 1))], axis=1)
    assert np.allclose(seen, x, atol=1e-9)
    assert all(np.allclose(w, logistic(seen[:, [*range(5), *range(5, 5 + k), 7]], t, toxicity_chain.L2), atol=1e-6) for k, ((w, _), t) in enumerate(zip(models, targets, strict=True)))
    # in prediction, a category's own probability takes the place
    terms = np.arange(1, 6).astype(np.uint64)
    row, term = np.nonzero(base)
    got = toxicity_chain.chain({"terms": terms, "models": models}, row, terms[term], 60)
    z = np.concatenate([base, np.ones((60, 1))], axis=1)
    for k, (w, _) in enumerate(models):
        p = 1 / (1 + np.exp(-z @ w))
        assert np.allclose(got[:, k], p)
        z = np.concatenate([z[:, :-1], p[:, None], np.ones((60, 1))], axis=1)


def test_kinds_of_toxicity():
    """Toxic documents with different words are of different kinds."""
    x = np.zeros((40, 6))
    x[:12, [0, 1]] = x[12:20, [2, 3]] = x[20:24, [4, 5]] = 1
    y = (np.arange(40) < 24).astype(float)
    assert toxicity_chain.toxic_kinds(x, y).tolist() == [0] * 12 + [1] * 8 + [2] * 4 + [-1] * 16


def test_given_categories_and_long_labelled_texts(spark, make_docs):
    """Label columns take the place of kinds; a labelled text of any length, null or repeated takes part."""
    texts = ["you vile toad " * 5000 if i % 3 == 0 else None if i % 7 == 0 else f"a fine day number {i} for all of us" for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), int(i % 6 == 0) if i % 5 else None) for i in range(60)], "doc_id long, quality int, toxic int, rude int")
    sample = training_sample(make_docs(texts), labels, "toxic", others=("rude",))
    fold = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(sample[0]) == sorted(texts[i] or "" for i in fold) and sample[2].sum() == sum(i % 6 == 0 and i % 5 > 0 for i in fold)
    out = toxicity_chain.toxicity_scores(make_docs(texts), labels, categories=("rude",))
    assert out.columns == ["doc_id", "held_out", "p_rude", "score", "predicted"]
    rows = out.collect()
    assert all(r.held_out == (r.doc_id not in fold) for r in rows)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in rows)


def test_toxicity_edges(spark, make_docs):
    docs = make_docs([None, "", "idiot", "a b"], [None, 1, 2, 2], extra=True)
    labels = spark.createDataFrame([(2, 1, 1), (None, None, None), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity_chain.toxicity_scores(docs, labels).collect()
    assert len(rows) == 4 and {r.predicted for r in rows} == {0}
    assert toxicity_chain.toxicity_scores(docs.limit(0), labels).count() == 0


def test_string_bytes_of_slices_and_nulls():
    import pyarrow as pa

    column = pa.array(["ab", None, "é", ""]).slice(1)
    data, offsets = string_bytes(column)
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2, 2]


def test_mixing_takes_tied_rows_one_by_one(spark, make_docs):
    texts = ["same words " * 3] * 50 + [None, ""]
    rows = mixing.mix_sources(make_docs(texts, ids=[7] * 50 + [8, None]).withColumn("source", mixing.F.lit("a")), weights=(1,), share=0.7).collect()
    assert [r.taken for r in rows if r["size"]].count(6) == 35 and sum(r.taken for r in rows) == 210


def test_license_headers_and_files(spark):
    """Real texts, wrapped and behind comment marks, with other holders than the templates'."""
    text = {n: body for n, body in license_scan.FULL_TEMPLATES if len(body) > 400}
    gpl = next(b for n, b in license_scan.FULL_TEMPLATES if n == "GPL-3.0" and b.startswith("This program"))
    gpl2 = gpl.replace("version 3", "version 2")
    comment = lambda mark, t: "".join(f"{mark} {line}\n" for line in t.splitlines())
    mit = text["MIT"].replace("Copyright (c)", "Copyright (c) 2019 Jane Q. Doe and the Frobnicate authors")
    bsd = text["BSD-3-Clause"].replace("Copyright (c)", "Copyright 2011 Acme Research").replace("\n", "\r\n")
    apache = next(b for n, b in license_scan.FULL_TEMPLATES if n == "Apache-2.0" and b.startswith("Licensed"))
    rows = [
        (1, "m/LICENSE", mit, "MIT"),
        (2, "b/COPYING.txt", bsd, "BSD-3-Clause"),
        (3, "g/x.py", "#!/usr/bin/python\n" + comment("#", "frob.py - frobs things\n\nCopyright (C) 2020 Jane Doe\n\n" + gpl) + "import os\nprint(os)\n", "GPL-3.0"),
        (4, "h/x.c", "/*\n" + comment(" *", gpl2) + " */\nint main;\n", "GPL-2.0"),
        (5, "a/x.go", comment("//", "Copyright 2024 The Foo Authors.\n\n" + apache) + "package foo\n", "Apache-2.0"),
        (6, "r/README", "# Frob\n\nIt frobs.\n\n## Licence\n\n" + mit, "MIT"),
        (7, "s/x.sh", "# This software is licensed under\n# the MIT license.\nls\n", "MIT"),
        (8, "t/x.py", "# Licensed under the Apache\n# License, Version 2.0.\n", "Apache-2.0"),
        (9, "u/x", "The museum has a permission desk. Visitors with a driving licence get a discount.", None),
        (10, "v/LICENSE", text["GPL-3.0"], "GPL-3.0"),
    ]
    files = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in license_scan.scan_licenses(files).collect()}
    assert got == {r[0]: r[3] for r in rows}
    assert license_scan.scan_licenses(files.unionByName(spark.createDataFrame([(11, "m/x.py", "print")], files.schema))).where("doc_id = 11").first().license == "MIT"


def test_mixing_with_unequal_odds(spark, make_docs):
    """Documents of importance 3, 1 and a half, and null, against the sampling written out."""
    rng = random.Random(11)
    texts = [random_words(rng, rng.randint(0, 60)) for _ in range(240)] + [None]
    docs = make_docs(texts)
    importance = lambda i: {0: 3.0, 1: 1.0, 2: 0.5, 3: None}[i % 4]
    column = mixing.F.when(mixing.F.col("doc_id") % 4 == 0, 3.0).when(mixing.F.col("doc_id") % 4 == 1, 1.0).when(mixing.F.col("doc_id") % 4 == 2, 0.5)
    rows = mixing.mix_sources(docs, keep=("source",), importance=column).collect()
    text = dict(enumerate(texts))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    want = {}
    for source in {r.source for r in rows}:
        group, quota = [], None
        for r in (r for r in rows if r.source == source):
            u = (int(md5(f"{mixing.SEED}|{r.doc_id}|{md5(text[r.doc_id] or '')}")[:12], 16) + 0.5) / (1 << 48)
            w = importance(r.doc_id)
            copies = min(2.0, r.target / r.source_size * (1.0 if w is None else w))
            whole, p, odds = int(copies), copies - int(copies), u / (1 - u)
            group.append((odds * (1 - p) / (odds * (1 - p) + p), r.doc_id, r["size"], whole))
            quota = (r.target if quota is None else quota) - whole * r["size"]
        upto = 0
        for _, doc_id, size, whole in sorted(group):
            upto += size
            want[doc_id] = size * min(2, whole + (size > 0 and upto - size / 2 <= quota))
    assert {r.doc_id: r.taken for r in rows} == want
    assert sum(want[i] for i in want if i % 4 == 0) > sum(want[i] for i in want if i % 4 == 2)


def test_license_units_are_counted_by_id(spark):
    """Texts are hashed before and not along with each of their words, and their words are counted once."""
    texts = {n: " ".join(body.split()) for n, body in license_scan.FULL_TEMPLATES if len(body) > 400}
    units = spark.createDataFrame([(t,) for t in [*texts.values(), "the and of it", "permission for geese", "", None, *texts.values()]], "unit string")
    scores = license_scan.unit_scores(units, license_scan.FULL_TEMPLATES, 0.7, 8)
    lines = license_scan.statement_scores(units.toDF("statement"), license_scan.Weights())
    for df in (scores, lines):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        generated = [i for i, line in enumerate(plan) if "Generate explode" in line]
        assert len(generated) == 1 and min(i for i, line in enumerate(plan) if "md5(" in line) > generated[0]
    rows = {r.id: (license_scan.FULL_TEMPLATES[-r.best.which - 8][0], r.best.cosine, r.words) for r in scores.collect()}
    assert rows == {hashlib.md5(t.encode()).hexdigest(): (n, 1.0, len(license_scan.words_of(t))) for n, t in texts.items()}
    assert license_scan.unit_scores(units, license_scan.FULL_TEMPLATES[:1], 0.7, 8).count() <= 1
    assert license_scan.unit_scores(units, [], 0.7, 8).count() == 0
