"""Functions over binary values: bytewise updates, checksums, display forms, key bounds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAINTEXT_BYTES = 64


def byte_array(value: Column) -> Column:
    """The bytes as integers 0 to 255; of an empty value, an empty array."""
    at = F.sequence(F.lit(1), F.octet_length(value))
    number = lambda i: F.conv(F.hex(F.substring(value, i, F.lit(1))), 16, 10).cast("int")
    return F.when(F.octet_length(value) > 0, F.transform(at, number)).when(value.isNotNull(), F.array().cast("array<int>"))


def from_bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))


def _bytewise(value: Column, operand: bytes, fill: int, combine) -> Column:
    other = F.array(*[F.lit(b) for b in operand]) if operand else F.array().cast("array<int>")
    fill = F.lit(fill)
    return from_bytes(F.zip_with(byte_array(value), other, lambda x, y: F.pmod(combine(F.coalesce(x, fill), F.coalesce(y, fill)), F.lit(256))))


def add_bytes(value: Column, operand: bytes) -> Column:
    """Byte by byte modulo 256; the shorter side goes on with zeros."""
    return _bytewise(value, operand, 0, lambda x, y: x + y)


def mul_bytes(value: Column, operand: bytes) -> Column:
    """Byte by byte modulo 256; the shorter side goes on with ones."""
    return _bytewise(value, operand, 1, lambda x, y: x * y)


def is_text_safe(value: Column) -> Column:
    """Printable ASCII, tabs and line ends only."""
    return F.regexp_like(F.hex(value), F.lit("^(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])*$"))


def display(value: Column) -> Column:
    """Text as it is, anything else as BASE64: and its base64 form."""
    return F.when(is_text_safe(value), F.decode(value, "UTF-8")).otherwise(F.concat(F.lit("BASE64:"), F.base64(value)))


def is_intact(value: Column, checksum: Column) -> Column:
    return F.crc32(value) == checksum


def looks_encrypted(value: Column) -> Column:
    """A leading 0x01, or JSON with a cipher_type."""
    return F.coalesce((F.substring(value, 1, 1) == F.lit(b"\x01")) | F.get_json_object(value.cast("string"), "$.cipher_type").isNotNull(), F.lit(False))


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with this prefix; None if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def human_bytes(n: Column) -> Column:
    """1536 -> 1.50 KB."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units[1:], 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.2f", n / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_duration(nanos: Column) -> Column:
    """Nanoseconds as 12ns, 1.50ms, 3.25s, 2m 5s or 1h 30m."""
    seconds = F.floor(nanos / 1_000_000_000)
    shown = lambda unit, name: F.concat(F.format_string("%.2f", nanos / float(unit)), F.lit(name))
    pair = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))
    return (
        F.when(nanos < 1_000, F.concat(nanos.cast("string"), F.lit("ns")))
        .when(nanos < 1_000_000, shown(1_000, "µs"))
        .when(seconds < 1, shown(1_000_000, "ms"))
        .when(seconds < 60, shown(1_000_000_000, "s"))
        .when(seconds < 3600, pair(F.floor(seconds / 60), "m", seconds % 60, "s"))
        .otherwise(pair(F.floor(seconds / 3600), "h", F.floor(seconds % 3600 / 60), "m"))
    )
