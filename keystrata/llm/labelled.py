"""Bounded samples of labelled documents for fitting, and the fold that is never learnt from."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
MOST_DOCS = 4000


def held_out(doc_id="doc_id"):
    """crc32 of the id as text modulo FOLDS is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_DOCS, others: tuple[str, ...] = ()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, 0/1 labels, a column of 0/1 for each of the other labels, where null is 0) of at most `most`
    labelled documents outside the held-out fold, the same ones in every run: those whose id has the
    smallest hashes, whole texts of any length; a null text is empty. The bound keeps the sample
    fit for the driver, where models are fitted."""
    chosen = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"_y{i}") for i, c in enumerate((label, *others))])
    # a margin for labels without a document
    chosen = chosen.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(2 * most)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_id").orderBy(F.md5(F.col("_id").cast("string")), "_id", "_text").limit(most).drop("_id").toPandas()
    y = rows.drop(columns="_text").to_numpy(np.float64)
    return [t or "" for t in rows["_text"]], y[:, 0], y[:, 1:]


def chunks(texts: list[str], size: int = 1 << 20):
    """Yields (first text, bytes, offsets) of about `size` bytes of whole texts at a time."""
    first, raw, held = 0, [], 0
    for i, text in enumerate(texts):
        raw.append(text.encode())
        held += len(raw[-1])
        if held >= size or i == len(texts) - 1:
            yield first, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
            first, raw, held = i + 1, [], 0


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of an L2-regularised logistic regression by Newton steps; the last column of x is 1."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
