"""Fixed-width unsigned integers in Spark columns.

Spark has no unsigned types and throws on overflow, so values are held in the next wider type and
every operation wraps explicitly: the result never depends on session settings.

Decimals are slow, so 64 bits are also computed on as a "word", the bigint of the same bits (any
bigint is one, a negative one stands for itself plus 2^64): `word` and `value` lead from u64 and back.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: type -> (bits, the Spark type that holds it)
TYPES = {"u8": (8, "smallint"), "u16": (16, "int"), "u32": (32, "bigint"), "u64": (64, "decimal(20,0)")}


def bits_of(kind: str) -> int:
    return 64 if kind == "word" else TYPES[kind][0]


def constant(n: int, kind: str) -> Column:
    if kind == "word":
        return F.lit(str(n - (1 << 64) if n >> 63 else n)).cast("bigint")
    return F.lit(str(n)).cast(TYPES[kind][1])


def word(value: Column) -> Column:
    """The word of any integer or decimal value modulo 2^64."""
    x, top = value.cast("decimal(37,0)"), _modulus(63, "decimal(20,0)")
    return F.when((x >= -top) & (x < top), x).otherwise(F.pmod(x + top, _modulus(64, "decimal(20,0)")) - top).cast("bigint")


def value(word: Column) -> Column:
    """The u64 of a word."""
    x = word.cast("decimal(20,0)")
    return F.when(word < 0, (x + _modulus(64, "decimal(20,0)")).cast("decimal(20,0)")).otherwise(x)


def text(word: Column) -> Column:
    """The digits of a word's value, without a decimal."""
    half = F.shiftrightunsigned(word, 1)
    last = (half % 5) * 2 + word.bitwiseAND(F.lit(1))
    return F.when(word < 0, F.concat(F.call_function("div", half, F.lit(5)).cast("string"), last.cast("string"))).otherwise(word.cast("string"))


def ordered(word: Column) -> Column:
    """A bigint that is less where the word's value is less."""
    return word.bitwiseXOR(F.lit(-(1 << 63)))


def _low(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0xFFFFFFFF))


def _high(word: Column) -> Column:
    return F.shiftrightunsigned(word, 32)


def _add_words(a: Column, b: Column, carry: int = 0) -> Column:
    low = _low(a) + _low(b) + F.lit(carry)
    return F.shiftleft(_high(a) + _high(b) + _high(low), 32).bitwiseOR(_low(low))


def _mul_words(a: Column, b: Column) -> Column:
    """By halves, of which the lower one of b is cut again, so that no product leaves a bigint."""
    half = F.lit(0xFFFF)
    upper = _low(a) * F.shiftright(_low(b), 16)
    low = _low(a) * b.bitwiseAND(half) + F.shiftleft(upper.bitwiseAND(half), 16)
    cross = mul(_high(a), _low(b), "u32") + mul(_low(a), _high(b), "u32")
    return F.shiftleft(cross + _high(low) + F.shiftright(upper, 16), 32).bitwiseOR(_low(low))


def _modulus(bits: int, kind: str) -> Column:
    return F.lit(str(1 << bits)).cast(kind)


def wrap(value: Column, kind: str) -> Column:
    """Any integer or decimal value modulo 2^bits, in the type that holds `kind`."""
    bits, spark_type = TYPES[kind]
    return F.pmod(value.cast("decimal(38,0)"), _modulus(bits, "decimal(38,0)")).cast(spark_type)


def _wrap(value: Column, kind: str) -> Column:
    """A bigint, of which the low bits count, in the type that holds `kind`, of up to 32 bits."""
    bits, spark_type = TYPES[kind]
    return value.bitwiseAND(F.lit((1 << bits) - 1)).cast(spark_type)


def add(a: Column, b: Column, kind: str) -> Column:
    if kind == "word":
        return _add_words(a, b)
    if kind == "u64":
        return value(_add_words(word(a), word(b)))
    return _wrap(a.cast("bigint") + b.cast("bigint"), kind)


def sub(a: Column, b: Column, kind: str) -> Column:
    if kind == "word":
        return _add_words(a, F.bitwise_not(b), 1)
    if kind == "u64":
        return value(sub(word(a), word(b), "word"))
    return _wrap(a.cast("bigint") - b.cast("bigint"), kind)


def mul(a: Column, b: Column, kind: str) -> Column:
    if kind == "word":
        return _mul_words(a, b)
    if kind == "u64":
        return value(_mul_words(word(a), word(b)))
    a, b = a.cast("bigint"), b.cast("bigint")
    if kind in ("u8", "u16"):
        return _wrap(a * b, kind)
    # by halves of b, so that no product leaves a bigint
    half = F.lit(0xFFFF)
    return _wrap(a * b.bitwiseAND(half) + (a * F.shiftright(b, 16)).bitwiseAND(half) * F.lit(1 << 16), kind)


def neg(a: Column, kind: str) -> Column:
    """Two's complement."""
    if kind == "word":
        return sub(constant(0, "word"), a, "word")
    if kind == "u64":
        return value(neg(word(a), "word"))
    return _wrap(-a.cast("bigint"), kind)


def low_bits(word: Column, kind: str) -> Column:
    """A word modulo 2^bits, in the type that holds `kind`."""
    if kind in ("word", "u64"):
        return word if kind == "word" else value(word)
    return _wrap(word, kind)
