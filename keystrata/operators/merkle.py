"""Merkle trees over the rows of a frame: root, inclusion proofs and their verification.

Leaves and inner nodes have different prefixes, the last node of an odd level stands for both
children of its parent, a single leaf is the root, and a tree of no rows has a root of its own.
Hashes are SHA-256 in lower-case hex.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordering import numbered

LEAF, INNER, EMPTY = b"\x00", b"\x01", b"empty"
HEIGHT = 10


def _parent(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.lit(INNER), F.unhex(a), F.unhex(b)), 256)


def leaves(df: DataFrame, order: str, value: Column) -> DataFrame:
    """(i, h): the leaf hashes by their place."""
    h = F.sha2(F.concat(F.lit(LEAF), value.cast("binary")), 256)
    return numbered(df.select(F.col(order).alias("k"), h.alias("h")), "k", "h", place="i").select("i", "h", F.col("_total").alias("n"))


def _fold(level: DataFrame, height: int) -> DataFrame:
    """(i, h) of the nodes `height` levels up: a group has 2^height nodes at most, and is folded whole."""
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
    level = level.groupBy(F.shiftright("i", height).alias("i")).agg(nodes.alias("x"))

    def parents(x, _):
        child = lambda j: F.get(x, j)
        return F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(2)), lambda j: _parent(child(j), F.coalesce(child(j + 1), child(j))))

    return level.select("i", F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.col("x"), parents)[0].alias("h"))


def layers(df: DataFrame, order: str, value: Column, height: int = HEIGHT) -> list[tuple[int, int, DataFrame]]:
    """(level, nodes, frame of i and h) for the leaves and every `height` levels up to the root."""
    level = written(leaves(df, order, value), "merkle-0")
    first = level.first()
    n = 0 if first is None else first["n"]
    at, out = 0, [(0, n, level.select("i", "h"))]
    while n > 1:
        up = min(height, (n - 1).bit_length())
        at, n = at + up, -(-n // (1 << up))
        out.append((at, n, written(_fold(out[-1][2], up), f"merkle-{at}")))
    return out


def root(df: DataFrame, order: str, value: Column) -> str:
    """Only the root reaches the driver, and a level costs one shuffle for every HEIGHT levels."""
    _, n, top = layers(df, order, value)[-1]
    return top.first()["h"] if n else hashlib.sha256(EMPTY).hexdigest()


@dataclass(frozen=True)
class Proof:
    """The siblings from the leaf up; the bits of `index` say on which side they stand."""

    index: int
    siblings: tuple[str, ...]


def _hash(prefix: bytes, *parts: bytes) -> str:
    return hashlib.sha256(b"".join((prefix, *parts))).hexdigest()


def proof(df: DataFrame, order: str, value: Column, index: int) -> Proof:
    """Proof that the row at `index` is in the tree. Of every stored layer the driver reads the group
    around the row's node, 2^HEIGHT nodes at most."""
    found = layers(df, order, value)
    if not 0 <= index < found[0][1]:
        raise IndexError(f"{index} of {found[0][1]} rows")
    siblings = []
    for (low, _, level), (high, _, _) in zip(found, found[1:], strict=False):
        node, up = index >> low, high - low
        group = [r["h"] for r in level.where(F.shiftright("i", up) == (node >> up)).orderBy("i").collect()]
        at = node & ((1 << up) - 1)
        for _ in range(up):
            sibling = at ^ 1
            siblings.append(group[sibling] if sibling < len(group) else group[at])
            group = [_hash(INNER, bytes.fromhex(group[j]), bytes.fromhex(group[j + 1] if j + 1 < len(group) else group[j])) for j in range(0, len(group), 2)]
            at >>= 1
    return Proof(index, tuple(siblings))


def verify(value: bytes, p: Proof, expected: str) -> bool:
    """Whether the value's leaf leads to the root `expected`."""
    h = _hash(LEAF, value)
    for level, sibling in enumerate(p.siblings):
        left, right = (sibling, h) if p.index >> level & 1 else (h, sibling)
        h = _hash(INNER, bytes.fromhex(left), bytes.fromhex(right))
    return h == expected
