"""Identities and deterministic splits from digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of an identity are joined with a NUL, so that no two lists of parts agree.
SEPARATOR = "\0"


def digest(*parts: Column | str) -> Column:
    """SHA-256 (hex) of the parts as text, joined with NULs; null if a part is."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    joined = columns[0]
    for column in columns[1:]:
        joined = F.concat(joined, F.lit(SEPARATOR), column)
    return F.sha2(joined, 256)


def stable_id(*parts: Column | str, length: int = 24) -> Column:
    """The first hex digits of the parts' digest."""
    return F.substring(digest(*parts), 1, length)


#: Hex digits whose number fits into a long.
BLOCK = 15


def hex_modulo(hex_digits: Column, modulus: int, digits: int = 64) -> Column:
    """A hexadecimal number of at most ``digits`` digits, modulo ``modulus`` (below 2^31).

    A sum over blocks of digits, each times its place's power of 16: plain
    arithmetic, so that code generation works out ``hex_digits`` once.
    """
    filled, out = F.lpad(hex_digits, digits, "0"), None
    for end in range(digits, 0, -BLOCK):
        begin = max(0, end - BLOCK)
        block = F.conv(F.substring(filled, begin + 1, end - begin), 16, 10).cast("long")
        term = block % modulus * pow(16, digits - end, modulus) % modulus
        out = term if out is None else out + term
    return out % modulus


def weighted_bucket(hex_digits: Column, weights: dict[str, int], digits: int = 64) -> Column:
    """The bucket that a digest falls in, by integer weights, in the given order."""
    place, upto, out = hex_modulo(hex_digits, sum(weights.values()), digits), 0, F
    for name, weight in weights.items():
        upto += weight
        out = out.when(place < upto, name)
    return out


def length_prefixed(column: Column) -> Column:
    """A text's bytes after their number, as eight big-endian bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(column).cast("long")), 16, "0")), column.cast("binary"))


def crc_hex(column: Column) -> Column:
    """CRC-32 of a text as eight hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(column.cast("binary")))), 8, "0")
