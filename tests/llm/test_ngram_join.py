import random
import re
from itertools import combinations

import numpy as np

from keystrata.llm import ngram_join
from keystrata.llm.components import connected_components

from .conftest import random_words


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return sorted(out, key=repr)


def brute_by_text(rows):
    """`brute` over different texts, whose rows then share size and component."""
    texts = sorted({t for _, t in rows})
    group = {texts[k]: (n, c) for k, n, c in brute(list(enumerate(texts)))}
    names = {}
    for doc_id, t in rows:
        c = group[t][1]
        names[c] = min((x for x in (names.get(c), doc_id) if x is not None), default=None)
    return sorted(((doc_id, group[t][0], names[group[t][1]]) for doc_id, t in rows), key=repr)


def corpus(seed, copies=6):
    rng = random.Random(seed)
    passage = random_words(rng, 30)
    texts = [None, "", "  \n ", "one", "one two", "One  TWO", "one two three four", "a b c d e", "A b c D e"]
    for _ in range(12):
        base = random_words(rng, rng.randint(5, 120)).split()
        for _ in range(rng.randint(1, copies)):
            other = list(base)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = random_words(rng, 1, 500)
            texts.append(" ".join(other))
    texts += [f"{random_words(rng, 20)} {passage} {random_words(rng, 20)}" for _ in range(15)]
    return texts


def test_against_brute_force(spark, make_docs):
    for seed in (1, 2):
        texts = corpus(seed)
        rows = list(enumerate(texts))
        got = ngram_join.jaccard_components(make_docs(texts, extra=True)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_large_group_of_near_copies(spark, make_docs, monkeypatch):
    """More copies than FREQUENT go through the rounds over frequent columns."""
    monkeypatch.setattr(ngram_join, "STREAM_ROWS", 7)
    rng = random.Random(5)
    base = random_words(rng, 80, 400).split()
    texts = []
    for _ in range(60):
        other = list(base)
        for _ in range(rng.randint(0, 2)):
            other[rng.randrange(len(other))] = random_words(rng, 1, 500)
        texts.append(" ".join(other))
    texts += [random_words(rng, 60, 400) for _ in range(5)]
    got = ngram_join.jaccard_components(make_docs(texts)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids_and_empty_table(spark, make_docs):
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", "x y z u v w", None]
    ids = [4, 4, None, None, 2]
    got = ngram_join.jaccard_components(make_docs(texts, ids)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (None, 2, None), (2, 0, 2)], key=repr)
    assert ngram_join.jaccard_components(make_docs(texts, ids).limit(0)).count() == 0
    kept = ngram_join.keep_one(make_docs(texts, ids))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 4, None, None]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    labels = dict(map(tuple, connected_components(edges).collect()))
    assert labels == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_one_tells_texts_of_one_id_apart(spark, make_docs):
    """Unlinked texts under one doc_id all stay; of copies without a doc_id one does."""
    a, b, c, d = ("a b c d e f", "g h i j k l m", "n o p q r s", "t u v w x y")
    texts = [a, b, c, c, d, d, d, a, None, None]
    ids = [7, 7, 7, 7, None, None, None, None, None, None]
    kept = ngram_join.keep_one(make_docs(texts, ids, extra=True))
    assert kept.columns == make_docs(texts, ids, extra=True).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, a), (7, b), (7, c), (None, a), (None, d), (None, None), (None, None)], key=repr)


def test_block_components_against_pairs(monkeypatch):
    """Near copies, sets of other sizes and sets with some common columns, in blocks of a few rows and columns."""
    for name, value in (("BLOCK_ROWS", 7), ("BLOCK_COLUMNS", 16), ("SPARSE", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    for seed in range(20):
        rng = np.random.default_rng(seed)
        pool = np.sort(rng.choice(1 << 60, 400, replace=False).astype(np.uint64))
        sets = []
        for _ in range(6):
            base = rng.choice(pool, rng.integers(5, 80), replace=False)
            for _ in range(rng.integers(1, 12)):
                other = base.copy()
                other[: rng.integers(0, 2 + len(base) // 6)] = rng.integers(1 << 61, 1 << 62)
                sets.append(np.unique(other))
        sets.sort(key=len)
        want = np.arange(len(sets))
        for i, j in combinations(range(len(sets)), 2):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                want[want == max(want[i], want[j])] = min(want[i], want[j])
                assert ngram_join.reaches(sets[i], sets[j])
        assert (ngram_join.block_components(sets) == want).all()


def test_many_rows_without_an_id(spark, make_docs):
    """A thousand rows without a doc_id, some of one text, meet their sets once each."""
    rng = random.Random(8)
    texts = [random_words(rng, 30, 300) for _ in range(20)]
    texts += [f"{t} more" for t in texts]
    texts = [texts[k % len(texts)] for k in range(1000)]
    got = ngram_join.jaccard_components(make_docs(texts, [None] * 997 + [5, 6, 7])).collect()
    assert sorted(map(tuple, got), key=repr) == brute_by_text(list(zip([None] * 997 + [5, 6, 7], texts, strict=True)))
