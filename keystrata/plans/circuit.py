"""A small typed expression tree over booleans and unsigned integers that compiles to columns.
The type "word" is u64 held as a bigint of the same bits, see `functions.unsigned`.

Trees are checked without widening (operands have one type), simplified where Spark's optimizer
may not (x - x, x * 0 and double negation on inputs that are never null), and measured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import unsigned

ARITHMETIC = ("add", "sub", "mul")
LOGIC = ("and", "or", "xor")
COMPARE = ("eq", "ne", "lt", "le", "gt", "ge")


class Node:
    def __add__(self, other):
        return Binary("add", self, _node(other, self))

    def __sub__(self, other):
        return Binary("sub", self, _node(other, self))

    def __mul__(self, other):
        return Binary("mul", self, _node(other, self))

    def __and__(self, other):
        return Binary("and", self, other)

    def __or__(self, other):
        return Binary("or", self, other)

    def __xor__(self, other):
        return Binary("xor", self, other)

    def __invert__(self):
        return Unary("not", self)

    def __neg__(self):
        return Unary("neg", self)

    def compare(self, op: str, other) -> Binary:
        return Binary(op, self, _node(other, self))


def _node(x, like: Node) -> Node:
    return x if isinstance(x, Node) else Constant(x, type_of(like))


@dataclass(frozen=True)
class Load(Node):
    name: str
    kind: str


@dataclass(frozen=True)
class Constant(Node):
    value: int | bool
    kind: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    x: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


def type_of(e: Node) -> str:
    """The type of a well-formed tree; TypeError for any other."""
    if isinstance(e, (Load, Constant)):
        return e.kind
    if isinstance(e, Unary):
        kind = type_of(e.x)
        if (kind == "bool") != (e.op == "not"):
            raise TypeError(f"{e.op} of {kind}")
        return kind
    left, right = type_of(e.left), type_of(e.right)
    if left != right:
        raise TypeError(f"{e.op} of {left} and {right}")
    if e.op in LOGIC and left != "bool" or e.op in ARITHMETIC and left == "bool":
        raise TypeError(f"{e.op} of {left}")
    return "bool" if e.op in COMPARE else left


def compile_to_column(e: Node) -> Column:
    kind = type_of(e)
    if isinstance(e, Load):
        return F.col(e.name)
    if isinstance(e, Constant):
        return F.lit(e.value) if kind == "bool" else unsigned.constant(e.value, kind)
    if isinstance(e, Unary):
        x = compile_to_column(e.x)
        return ~x if e.op == "not" else unsigned.neg(x, kind)
    a, b = compile_to_column(e.left), compile_to_column(e.right)
    if e.op in ARITHMETIC:
        return getattr(unsigned, e.op)(a, b, kind)
    if type_of(e.left) == "word":
        a, b = unsigned.ordered(a), unsigned.ordered(b)
    return {"and": a & b, "or": a | b, "xor": a != b, "eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[e.op]


def evaluate(op: str, a, b, kind: str):
    """Of two constants, wrapping."""
    if op in ARITHMETIC:
        n = a + b if op == "add" else a - b if op == "sub" else a * b
        return n % (1 << unsigned.bits_of(kind))
    return {"and": a and b, "or": a or b, "xor": a != b, "eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


def simplify(e: Node) -> Node:
    """An equal tree for inputs that are never null, constants folded and identities used."""
    if isinstance(e, Unary):
        x = simplify(e.x)
        if isinstance(x, Unary) and x.op == e.op:
            return x.x
        if isinstance(x, Constant):
            return Constant(not x.value, "bool") if e.op == "not" else Constant(evaluate("sub", 0, x.value, x.kind), x.kind)
        return Unary(e.op, x)
    if not isinstance(e, Binary):
        return e
    a, b = simplify(e.left), simplify(e.right)
    kind = type_of(a)
    if isinstance(a, Constant) and isinstance(b, Constant):
        return Constant(evaluate(e.op, a.value, b.value, kind), type_of(e))
    if a == b and e.op in ("and", "or"):
        return a
    if a == b and e.op in ("sub", "xor", "ne", "lt", "gt", "eq", "le", "ge"):
        return Constant(0, kind) if e.op == "sub" else Constant(e.op in ("eq", "le", "ge"), "bool")
    neutral = {"add": 0, "mul": 1, "and": True, "or": False, "xor": False}
    absorbing = {"mul": 0, "and": False, "or": True}
    for x, y in ((a, b), (b, a)):
        if isinstance(x, Constant) and e.op in neutral and x.value == neutral[e.op]:
            return y
        if isinstance(x, Constant) and e.op in absorbing and x.value == absorbing[e.op]:
            return x
    if e.op == "sub" and isinstance(b, Constant) and b.value == 0:
        return a
    return Binary(e.op, a, b)


def measure(e: Node) -> dict[str, int]:
    """Depth (a leaf has 1), operations, and those among them that are expensive on ciphertexts."""
    if isinstance(e, (Load, Constant)):
        return {"depth": 1, "gates": 0, "bootstraps": 0}
    parts = [measure(x) for x in ((e.x,) if isinstance(e, Unary) else (e.left, e.right))]
    heavy = e.op == "mul" or e.op in COMPARE
    return {"depth": 1 + max(p["depth"] for p in parts), "gates": 1 + sum(p["gates"] for p in parts), "bootstraps": heavy + sum(p["bootstraps"] for p in parts)}
