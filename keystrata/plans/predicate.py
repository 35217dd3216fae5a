"""Predicates on columns, and a builder for queries on a collection.

`col("x") > 3` and its like build a tree that compiles to one Spark column, so Catalyst can push
it to the scan. Literals are bound where they stand.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blobs import PLAINTEXT_BYTES
from ..operators.keyed import page, read_cursor


class Predicate:
    def __and__(self, other):
        return Both("and", self, other)

    def __or__(self, other):
        return Both("or", self, other)

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True, eq=False)
class Compare(Predicate):
    op: str
    name: str
    value: object


@dataclass(frozen=True, eq=False)
class Both(Predicate):
    op: str
    left: Predicate
    right: Predicate


@dataclass(frozen=True, eq=False)
class Not(Predicate):
    x: Predicate


class Name:
    def __init__(self, name: str):
        self.name = name

    def __eq__(self, value):
        return Compare("==", self.name, value)

    def __ne__(self, value):
        return Compare("!=", self.name, value)

    def __gt__(self, value):
        return Compare(">", self.name, value)

    def __ge__(self, value):
        return Compare(">=", self.name, value)

    def __lt__(self, value):
        return Compare("<", self.name, value)

    def __le__(self, value):
        return Compare("<=", self.name, value)

    __hash__ = None


def col(name: str) -> Name:
    return Name(name)


def compile_predicate(p: Predicate, limit: int | None = None, left_first: bool = False) -> Column:
    """`limit`: longer byte values are opaque, comparing them is unknown. `left_first`: an unknown
    left side makes the whole unknown, as where sides are evaluated one after the other; Spark's
    own logic would look at the right side as well."""
    if isinstance(p, Not):
        return ~compile_predicate(p.x, limit, left_first)
    if isinstance(p, Both):
        a, b = compile_predicate(p.left, limit, left_first), compile_predicate(p.right, limit, left_first)
        if not left_first:
            return a & b if p.op == "and" else a | b
        decided = F.lit(p.op == "or")
        return F.when(a.isNull(), F.lit(None).cast("boolean")).when(a == decided, decided).otherwise(b)
    x, y = F.col(p.name), F.lit(p.value)
    result = {"==": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[p.op]
    return result if limit is None else F.when(F.octet_length(x) <= limit, result)


def columns_of(p: Predicate) -> list[str]:
    if isinstance(p, Compare):
        return [p.name]
    return sorted({c for x in ((p.x,) if isinstance(p, Not) else (p.left, p.right)) for c in columns_of(x)})


def filter_typed(df: DataFrame, p: Predicate) -> DataFrame:
    return df.where(compile_predicate(p))


def filter_plain(df: DataFrame, p: Predicate, limit: int = PLAINTEXT_BYTES) -> DataFrame:
    """Rows of which the predicate is true or, for opaque values, unknown."""
    return df.where(F.coalesce(compile_predicate(p, limit, left_first=True), F.lit(True)))


def require_plain(df: DataFrame, column: str, limit: int = PLAINTEXT_BYTES) -> DataFrame:
    """df for a reader that cannot compute on opaque values: running it fails if the column holds one."""
    value = F.col(column)
    return df.where(F.when(F.octet_length(value) > limit, F.raise_error(F.lit(f"{column} holds opaque values, which need compute"))).isNull())


def flag_matches(df: DataFrame, p: Predicate, name: str = "predicate_result") -> DataFrame:
    """All rows with the predicate's result, for a reader who decides; rows of which it can't be told go."""
    return df.withColumn(name, compile_predicate(p)).where(F.col(name).isNotNull())


@dataclass(frozen=True)
class Query:
    """An immutable description of a read; `run` gives the lazy DataFrame."""

    source: DataFrame
    predicate: Predicate | None = None
    columns: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    skip: int = 0
    most: int | None = None
    size: int | None = None
    after: str | None = None

    def where(self, p: Predicate) -> Query:
        return replace(self, predicate=p if self.predicate is None else self.predicate & p)

    def select(self, *columns: str) -> Query:
        return replace(self, columns=columns)

    def sort_by(self, name: str, ascending: bool = True) -> Query:
        return replace(self, order=(*self.order, (name, ascending)))

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def page_size(self, n: int) -> Query:
        return replace(self, size=n)

    def cursor(self, text: str) -> Query:
        return replace(self, after=text)

    def page(self, key: str, kind: str = "string") -> DataFrame:
        """One page by key: `limit` rows, else `page_size`, else 100, from behind the cursor, with the cursor to go
        on from and whether anything follows. `kind` is the key's type, which a cursor does not hold."""
        df = self.source if self.predicate is None else filter_typed(self.source, self.predicate)
        if self.after is not None:
            df = df.where(F.col(key) > F.lit(read_cursor(self.after)).cast(kind))
        n = self.most if self.most is not None else 100 if self.size is None else self.size
        return page(df.select(*dict.fromkeys((*self.columns, key))) if self.columns else df, key, n, offset=self.skip)

    def run(self) -> DataFrame:
        df = self.source if self.predicate is None else filter_typed(self.source, self.predicate)
        if self.order:
            df = df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in self.order])
        df = df.offset(self.skip) if self.skip else df
        df = df if self.most is None else df.limit(self.most)
        return df.select(*self.columns) if self.columns else df


def query(df: DataFrame) -> Query:
    return Query(df)
