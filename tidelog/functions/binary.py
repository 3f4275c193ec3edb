"""Little-endian numbers in binary columns, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def piece(raw: Column, offset, size) -> Column:
    """Bytes of a binary column; offset (0-based) and size are numbers or Columns."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    return F.substring(raw, start, size if isinstance(size, Column) else F.lit(size))


def _swapped(value: Column, size: int) -> Column:
    """A number of `size` bytes with its bytes in the opposite order."""
    out = F.shiftleft(value.bitwiseAND(F.lit(0xFF)), 8 * (size - 1))
    for k in range(1, size):
        move = 8 * (size - 1 - 2 * k)
        byte = value.bitwiseAND(F.lit(0xFF << (8 * k)))
        out = out.bitwiseOR(F.shiftleft(byte, move) if move >= 0 else F.shiftrightunsigned(byte, -move))
    return out


def _unsigned(raw: Column, base: Column, size: int) -> Column:
    """Up to 4 bytes as BIGINT, null if they are not there."""
    taken = piece(raw, base, size)
    big_endian = F.when(F.octet_length(taken) == size, F.conv(F.hex(taken), 16, 10).cast("bigint"))
    # the number is made once, and then swapped
    return big_endian if size == 1 else F.get(F.transform(F.array(big_endian), lambda v: _swapped(v, size)), F.lit(0))


def le_unsigned(raw: Column, offset, size: int) -> Column:
    """An unsigned number; 8 bytes give DECIMAL(20,0), fewer BIGINT. Null if the bytes are not there."""
    base = offset if isinstance(offset, Column) else F.lit(offset)
    if size <= 4:
        return _unsigned(raw, base, size)
    high = _unsigned(raw, base + 4, size - 4).cast("decimal(20,0)")
    return (high * F.lit(1 << 32).cast("decimal(11,0)") + _unsigned(raw, base, 4)).cast("decimal(20,0)" if size == 8 else "bigint")


def le_signed(raw: Column, offset, size: int) -> Column:
    """A two's-complement number as BIGINT."""
    base = offset if isinstance(offset, Column) else F.lit(offset)
    if size == 8:
        return F.shiftleft(le_signed(raw, base + 4, 4), 32).bitwiseOR(_unsigned(raw, base, 4))
    free = 64 - 8 * size
    return F.shiftright(F.shiftleft(le_unsigned(raw, base, size), free), free)


def le_bytes(value: Column, size: int) -> Column:
    """The number's lowest bytes, least first; negative numbers in two's complement."""
    v = value.cast("bigint")
    digits = F.lpad(F.hex(v), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def hexdump(raw: Column) -> Column:
    """Hex digits of each byte, with a space between bytes."""
    return F.trim(F.regexp_replace(F.hex(raw), "(..)", "$1 "))


def contains(raw: Column, needle: bytes) -> Column:
    return F.contains(raw, F.lit(needle))
