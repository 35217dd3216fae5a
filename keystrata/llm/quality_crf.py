"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features are shares of upper case, symbols, table bars, repeated
words and the like, of itself and of the lines before and after. Forward-backward marginals of
the lines, weighted by their lengths, give the share of good text, and a logistic curve makes it
the probability that the document's label is 1.

Labels are of documents, so lines are labelled in two steps: a logistic regression learns the
documents' labels line by line; then lines of good documents are good, and lines of bad ones are
bad where that regression finds them likelier bad than an average line. The field is trained on
those by gradient steps, on the driver, from at most MOST_DOCS labelled documents outside the
held-out fold. The model is a few dozen numbers.

Scale: one pass over the text where it lies, no shuffle; a task holds a block of whole documents.

Defined results: null and empty texts are one empty line and get a score like others; documents
without labels are scored like others; repeated rows give repeated rows; null doc_ids are not held
out; without any labels, or labels of one kind only, every score is 0.5; other columns are ignored
(carried along by `keep_good`); an empty table gives an empty table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, blocks, prefix_hash, span_hash, table, words
from .labelled import chunks, held_out, logistic, sigmoid, training_sample

GOOD_FROM = 0.3
STEPS = 120
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes([*range(97, 123), *range(128, 256)]), b"0123456789", b"|\t", b"#$%&*@^~<>{}[]\\/_=+`", b"!", b".?!\"')"]
_TABLES = np.zeros((len(_CLASSES), 256), np.int32)
for _i, _c in enumerate(_CLASSES):
    _TABLES[_i, list(_c)] = 1
OWN, SHARED = 9, 5


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each line, its bytes, its features). Every row has a line, be it empty."""
    breaks = np.flatnonzero(data == 10) + 1
    breaks = breaks[~np.isin(breaks, offsets)]
    row = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1))
    start = np.concatenate((offsets[:-1], breaks))
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = np.concatenate((start[1:], offsets[-1:]))
    last = np.concatenate((row[1:] != row[:-1], [True]))
    end[last] = offsets[row[last] + 1]
    size = end - start
    sums = np.zeros((len(_CLASSES), len(data) + 1), np.int32)
    for i, t in enumerate(_TABLES):
        np.cumsum(t[data], out=sums[i, 1:])
    upper, lower, digits, bars, symbols, shouts, _ = (sums[:, end] - sums[:, start]).astype(np.float64)
    begin, stop, _ = words(data, offsets, NOT_SPACE)
    line = np.searchsorted(end, begin, side="right")
    h = span_hash(prefix_hash(data), begin, stop) if len(begin) else np.zeros(0, np.uint64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    n_words = np.bincount(line, minlength=len(row)).astype(np.float64)
    repeats = np.bincount(line[again], minlength=len(row)).astype(np.float64)
    tail = np.maximum(end - 1, start)
    tail = np.where((size > 1) & (data[np.minimum(tail, max(len(data) - 1, 0))] == 10) if len(data) else False, tail - 1, tail)
    closed = _TABLES[6][data[np.minimum(tail, len(data) - 1)]] * (size > 0) if len(data) else np.zeros(len(row))
    letters = upper + lower + 1
    own = np.stack(
        [upper / letters, 5 * symbols / (size + 1), bars / (n_words + 1), shouts / (n_words + 1), repeats / (n_words + 1), digits / (size + 1), np.log1p(size) / 8, closed, np.minimum(size / (n_words + 1) / 10, 3)],
        axis=1,
    )
    before, after = np.zeros((len(row), SHARED)), np.zeros((len(row), SHARED))
    same = row[1:] == row[:-1]
    before[1:][same] = own[:-1, :SHARED][same]
    after[:-1][same] = own[1:, :SHARED][same]
    return row, size, np.concatenate([own, before, after, np.ones((len(row), 1))], axis=1)


def _message(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of good after a step from log odds a; t[i, j]: from label i to label j."""
    return np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])


def marginals(row: np.ndarray, score: np.ndarray, t: np.ndarray):
    """Forward and backward log odds of every line (both with the line's own score). Lines are by
    row; rows advance side by side, the longest first."""
    counts = np.bincount(row)
    counts = counts[counts > 0]
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    left = np.searchsorted(-counts, -np.arange(1, counts.max(initial=0) + 1), side="right")  # rows of more than t lines
    ahead, behind = score.copy(), score.copy()
    for step in range(1, len(left)):
        at = first[: left[step]] + step
        ahead[at] += _message(ahead[at - 1], t)
        at = first[: left[step]] + counts[: left[step]] - 1 - step
        behind[at] += _message(behind[at + 1], t.T)
    return ahead, behind


def train_field(row, x, y, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) that make the lines' labels likely, by Adam with an L2 penalty."""
    w, t = logistic(x, y, 1.0), np.zeros((2, 2))
    theta = np.concatenate((w, t.ravel()))
    m = v = np.zeros(len(theta))
    same = np.flatnonzero(row[1:] == row[:-1])
    y1 = y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y1[same], y1[same + 1]), 1)
    for step in range(1, steps + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        score = x @ w
        ahead, behind = marginals(row, score, t)
        p = sigmoid(ahead + behind - score)
        a, b = ahead[same], behind[same + 1]
        pair = np.stack([np.zeros(len(a)) + t[0, 0], b + t[0, 1], a + t[1, 0], a + b + t[1, 1]])
        pair = np.exp(pair - pair.max(axis=0))
        expected = (pair / pair.sum(axis=0)).sum(axis=1)
        gradient = np.concatenate((x.T @ (p - y), expected - seen.ravel())) / len(y) + np.concatenate((1e-4 * w, 1e-2 * t.ravel()))
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def good_share(row, size, x, model) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, by row."""
    w, t = model["weights"], model["transitions"]
    score = x @ w
    ahead, behind = marginals(row, score, t)
    p = sigmoid(ahead + behind - score)
    weight = size + 1.0
    return np.bincount(row, weight * p) / np.bincount(row, weight)


def fit(texts: list[str], y: np.ndarray) -> dict | None:
    if len(y) == 0 or y.min() == y.max():
        return None
    parts = [(first, *line_features(data, offsets)) for first, data, offsets in chunks(texts)]
    row = np.concatenate([first + r for first, r, _, _ in parts])
    size, x = (np.concatenate([part[i] for part in parts]) for i in (2, 3))
    label = y[row]
    rough = x @ logistic(x, label)
    prior = np.log(label.mean() / (1 - label.mean()))
    label = np.where((label == 0) & (rough > prior), 1.0, label)
    weights, transitions = train_field(row, x, label)
    model = {"weights": weights, "transitions": transitions}
    share = good_share(row, size, x, model)
    model["curve"] = logistic(np.stack([share, np.ones(len(y))], axis=1), y, 1e-2)
    return model


def scores(model: dict | None, data, offsets) -> np.ndarray:
    if model is None:
        return np.full(len(offsets) - 1, 0.5)
    share = good_share(*line_features(data, offsets), model)
    return sigmoid(share * model["curve"][0] + model["curve"][1])


def quality_model(docs: DataFrame, labels: DataFrame) -> dict | None:
    return fit(*training_sample(docs, labels, "quality")[:2])


def quality_scores(docs: DataFrame, labels: DataFrame, good_from: float = GOOD_FROM) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels))

    def score(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                s = scores(model.value, data, offsets)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= good_from).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, good_from: float = GOOD_FROM) -> DataFrame:
    """The documents that score at least good_from, unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            good = [scores(model.value, data, offsets) >= good_from for _, _, data, offsets in blocks(batch.column(at))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
