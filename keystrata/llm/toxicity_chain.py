"""Toxicity categories by a classifier chain of linear models over words.

Categories are predicted one after the other: each model sees the words of the whole text and the
probabilities of the categories before it. In training those probabilities are out of fold, from
models that have not seen the document, so later models learn how far to trust them. The last
category is the documents' label itself. The ones before are further label columns where `labels`
has such; where it has the one label only, they are the KINDS that its toxic documents fall into, by
clusters of the telling words that they have, the largest kind first.

Features are the presence of TERMS words and stems, those that tell toxic from other documents best (by the
z-score of their log odds) in a sample without copies of at most MOST_DOCS labelled documents outside the
held-out fold. Fitting is on the driver; the model is a few thousand numbers.

Scale: one pass over the text where it lies, no shuffle; a task holds a block of whole documents.

Defined results: null and empty texts have no words and get the chain's base probabilities;
documents without labels are scored like others; repeated rows give repeated rows; null doc_ids
are not held out; without labels, or with labels of one kind, every probability is 0; other
columns are ignored; an empty table gives an empty table.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, mix, prefix_hash, span_hash, table, words
from .labelled import chunks, held_out, logistic, sigmoid, training_sample

TERMS = 400
STEM_BYTES = (6, 8)
SKETCH = 8
FOLDS = 4
MOST_DOCS = 6000
TOXIC_FROM = 0.5
LEAST_DOCS = 3
L2 = 0.3
KINDS = 3
LABEL = "toxic"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, and of the stems (leading STEM_BYTES) of longer ones."""
    low = LOWER[data]
    begin, end, row = words(low, offsets, ALNUM)
    if not len(begin):
        return row, np.zeros(0, np.uint64)
    sums = prefix_hash(low)
    rows, hashes = [row], [span_hash(sums, begin, end)]
    for size in STEM_BYTES:
        long = end - begin > size
        rows.append(row[long])
        hashes.append(mix(span_hash(sums, begin[long], begin[long] + size) ^ np.uint64(size)))
    return np.concatenate(rows), np.concatenate(hashes)


def _hash_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every text's distinct words and stems."""
    parts = []
    for first, data, offsets in chunks(texts):
        row, h = _distinct(*word_hashes(data, offsets))
        parts.append((row + first, h))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def presence(row, h, terms, n) -> np.ndarray:
    """n by terms matrix of 0 and 1; terms are sorted hashes."""
    x = np.zeros((n, len(terms)))
    if len(terms) and len(h):
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        found = terms[at] == h
        x[row[found], at[found]] = 1
    return x


def _distinct(row, h):
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    return row[new], h[new]


def not_copies(row, h, n: int) -> np.ndarray:
    """Which of n documents share less than SKETCH - 2 of their SKETCH smallest hashes of rarer
    words with every document before; copies would make chance words look telling."""
    values, which, counts = np.unique(h, return_inverse=True, return_counts=True)
    rare = counts[which] <= max(2, n // 10)
    row, h = row[rare], h[rare]
    edges = np.searchsorted(row, np.arange(n + 1))
    keep, seen = np.ones(n, bool), {}
    for i in range(n):
        sketch = h[edges[i] : edges[i] + min(SKETCH, edges[i + 1] - edges[i])].tolist()
        shared = Counter(j for x in sketch for j in seen.get(x, ()))
        if len(sketch) == SKETCH and shared and max(shared.values()) >= SKETCH - 2:
            keep[i] = False
            continue
        for x in sketch:
            seen.setdefault(x, []).append(i)
    return keep


def choose_terms(row, h, y, most: int = TERMS) -> np.ndarray:
    """Words that occur in at least LEAST_DOCS toxic documents and speak most clearly for them."""
    values, which = np.unique(h, return_inverse=True)
    pos = np.bincount(which, y[row], len(values))
    neg = np.bincount(which, 1 - y[row], len(values))
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((pos + 0.5) / (n1 - pos + 0.5)) - np.log((neg + 0.5) / (n0 - neg + 0.5))
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    z[pos < LEAST_DOCS] = -np.inf
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(values[best[z[best] > 1.5]])


def toxic_kinds(x: np.ndarray, y: np.ndarray, k: int = KINDS, rounds: int = 20) -> np.ndarray:
    """Which of k kinds a toxic document is of, -1 for others: spherical k-means over weighted presence,
    started from documents that are far from each other; the largest kind is 0."""
    rows = np.flatnonzero(y)
    v = x[rows] * np.log((1 + len(rows)) / (1 + x[rows].sum(axis=0)))
    v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    centres = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(centres) < min(k, len(rows)):
        centres.append(int(np.argmin((v @ v[centres].T).max(axis=1))))
    c = v[centres]
    for _ in range(rounds):
        of = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[of == i].sum(axis=0) for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    out = np.full(len(y), -1)
    out[rows] = np.argsort(np.argsort(-np.bincount(of, minlength=len(c)), kind="stable"))[of]
    return out


def out_of_fold(x: np.ndarray, target: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Every document's probability by a model of the folds it is not in."""
    fold, out = np.arange(len(target)) % folds, np.zeros(len(target))  # the sample comes in the order of a hash
    for f in range(folds):
        rest = fold != f
        out[~rest] = sigmoid(x[~rest] @ logistic(x[rest], target[rest], L2))
    return out


def fit_chain(base: np.ndarray, targets: list[np.ndarray]) -> tuple[list[tuple], np.ndarray]:
    """A model for every category, and the inputs of the last one: words, then the out-of-fold
    probabilities of the categories before it, then 1."""
    one = np.ones((len(base), 1))
    x, models = np.concatenate([base, one], axis=1), []
    for k, target in enumerate(targets):
        constant = target.min() == target.max()
        models.append((None if constant else logistic(x, target, L2), float(target[0])))
        if k < len(targets) - 1:
            p = target if constant else out_of_fold(x, target)
            x = np.concatenate([x[:, :-1], p[:, None], one], axis=1)
    return models, x


def fit(texts: list[str], y: np.ndarray, others: np.ndarray) -> dict | None:
    if len(y) == 0 or y.min() == y.max():
        return None
    row, h = _hash_of(texts)
    keep = not_copies(row, h, len(y))
    row, h, y, others = np.cumsum(keep)[row[keep[row]]] - 1, h[keep[row]], y[keep], others[keep]
    if y.min() == y.max():
        return None
    terms = choose_terms(row, h, y)
    base = presence(row, h, terms, len(y))
    kinds = toxic_kinds(base, y) if not others.shape[1] else None
    before = [(kinds == i).astype(float) for i in range(KINDS)] if kinds is not None else list(others.T)
    return {"terms": terms, "models": fit_chain(base, [*before, y])[0]}


def chain(model: dict | None, row, h, n, categories: int = KINDS + 1) -> np.ndarray:
    """n by categories matrix of probabilities."""
    if model is None:
        return np.zeros((n, categories))
    x = np.concatenate([presence(row, h, model["terms"], n), np.ones((n, 1))], axis=1)
    out = []
    for weights, constant in model["models"]:
        p = np.full(n, constant) if weights is None else sigmoid(x @ weights)
        out.append(p)
        x = np.concatenate([x[:, :-1], p[:, None], np.ones((n, 1))], axis=1)
    return np.stack(out, axis=1)


def toxicity_scores(docs: DataFrame, labels: DataFrame, toxic_from: float = TOXIC_FROM, categories: tuple[str, ...] = ()) -> DataFrame:
    """Probabilities of all categories, the last one's (LABEL) as score, and what follows from it. `categories` are
    columns of `labels`, in the order of the chain; without any, kinds are found."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels, LABEL, MOST_DOCS, categories)))
    before = categories or tuple(f"kind_{i + 1}" for i in range(KINDS))

    def score(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                p = chain(model.value, *word_hashes(data, offsets), b - a, len(before) + 1)
                columns = [pa.array(p[:, i]) for i in range(p.shape[1])]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *columns, pa.array((p[:, -1] >= toxic_from).astype(np.int32))], names)

    names = ["doc_id", *(f"p_{c}" for c in before), "score", "predicted"]
    schema = "doc_id long, " + ", ".join(f"`{c}` double" for c in names[1:-1]) + ", predicted int"
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, schema)
    return out.select("doc_id", held_out().alias("held_out"), *[F.col(f"`{c}`") for c in names[1:]])


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
