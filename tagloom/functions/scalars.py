"""Scanner functions over strings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name characters of XML 1.0, in Java's notation
NAME_START = (
    r"A-Za-z_:\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}"
    r"\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
)
NAME_CHAR = NAME_START.replace("_:", "_") + r"0-9.\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}-"


def code_points(s: Column) -> Column:
    """The string's code points, one array element each."""
    return F.filter(F.split(s, ""), lambda x: x != "")


def n_code_points(s: Column) -> Column:
    return F.char_length(s)


def utf16_length(s: Column) -> Column:
    """UTF-16 units, in which columns are counted."""
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("bigint")


def take_until(s: Column, stop: str, include: bool = False) -> Column:
    """What precedes the first ``stop`` character, which ``include`` takes along; all of the string if there is none."""
    return take_until_one_found(s, [stop], include)


def take_until_one_found(s: Column, stops: list[str], include: bool = False) -> Column:
    """What precedes the first of several characters; null for an empty string."""
    chars = "".join(f"\\x{{{ord(c):x}}}" for c in stops)
    return F.when(s != "", F.regexp_extract(s, f"^([^{chars}]*{f'[{chars}]?' if include else ''})", 1))


def skip_whitespace(s: Column) -> Column:
    """The string without its leading characters up to U+0020."""
    return F.regexp_replace(s, r"^[\x00-\x20]+", "")


def has_more_than_whitespace(s: Column) -> Column:
    return skip_whitespace(s) != ""


def is_name_start_char(c: Column) -> Column:
    """Whether the first code point can begin a name."""
    return c.rlike(f"^[{NAME_START}]")


def is_name_char(c: Column) -> Column:
    """Whether the first code point can stand in a name; ':' only begins one."""
    return c.rlike(f"^[{NAME_CHAR}]")


def to_char_code(c: Column) -> Column:
    """The first code point's number."""
    return F.ascii(c)


def code_point_bytes(lead: Column) -> Column:
    """Bytes of a code point by its lead byte (0 to 255); 1 for a byte that leads nothing."""
    return F.when(lead.between(0xC0, 0xDF), 2).when(lead.between(0xE0, 0xEF), 3).when(lead.between(0xF0, 0xF7), 4).otherwise(1)


def ascii_compare(a: Column, b: Column) -> Column:
    """Equality without regard to the case of ASCII letters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def ascii_contains(chars: str, c: Column) -> Column:
    """Whether ``c`` is one of ``chars``."""
    return c.isin(list(chars))


def remaining_bytes(raw: Column) -> Column:
    """The bytes at the end of ``raw`` that begin a code point without completing it; null if there are none."""
    n = F.octet_length(raw)

    def lead(back: int) -> Column:
        return F.conv(F.hex(F.substring(raw, n - back + 1, F.lit(1))), 16, 10).cast("int")

    out = F.lit(None).cast("binary")
    for back in (3, 2, 1):
        need = F.when(lead(back) >= 0xF0, 4).when(lead(back) >= 0xE0, 3).when(lead(back) >= 0xC0, 2).otherwise(1)
        out = F.when((n >= back) & (need > back), F.substring(raw, n - back + 1, F.lit(back))).otherwise(out)
    return out


def read_u32(raw: Column, at: Column | int = 0) -> Column:
    """The little-endian unsigned 32-bit number at a byte offset."""
    return _number(raw, at, 4).cast("bigint")


def read_u64(raw: Column, at: Column | int = 0) -> Column:
    """The little-endian unsigned 64-bit number at a byte offset, as a decimal."""
    return _number(raw, at, 8).cast("decimal(20,0)")


def _number(raw: Column, at: Column | int, n: int) -> Column:
    spot = (at if isinstance(at, Column) else F.lit(at)) + 1
    digits = [F.hex(F.substring(raw, (spot + k).cast("int"), F.lit(1))) for k in reversed(range(n))]
    return F.conv(F.concat(*digits), 16, 10)


def read_position(raw: Column, at: Column | int = 0) -> Column:
    """Line and character from two 64-bit numbers at a byte offset."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.struct(read_u64(raw, at).cast("bigint").alias("line"), read_u64(raw, at + 8).cast("bigint").alias("character"))


def read_string(raw: Column, start: Column | int, length: Column | int) -> Column:
    """The text of ``length`` bytes at a byte offset."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return F.decode(F.substring(raw, (start + 1).cast("int"), length.cast("int")), "UTF-8")
