"""Little-endian fields of BINARY columns, decoded and encoded on the JVM.

A field is a short slice of the bytes, so its cost does not depend on the packet
length. Numbers go through ``conv``; floats are rebuilt from sign, exponent and fraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippleframe.functions.vectors import let


def _bytes(data: Column, at, width: int) -> Column:
    """Hex text of ``width`` bytes from ``at``; the slice is cut before it is converted."""
    return F.hex(raw(data, at, width))


def uint(data: Column, at, width: int) -> Column:
    """Unsigned integer at byte ``at`` of a binary column; 8-byte values are decimals."""
    h = _bytes(data, at, width)
    text = F.concat(*[F.substr(h, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(width))]) if width > 1 else h
    return F.conv(text, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")


def sint(data: Column, at, width: int) -> Column:
    top = 1 << (8 * width - 1)
    value = uint(data, at, width)
    return F.when(value >= top, value - 2 * top).otherwise(value)


def float32(data: Column, at) -> Column:
    return let(uint(data, at, 4), _float_of)


def _float_of(bits: Column) -> Column:
    sign = F.when(bits >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 23).bitwiseAND(255)
    fraction = bits.bitwiseAND((1 << 23) - 1).cast("double") / (1 << 23)
    normal = (1.0 + fraction) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))
    return (
        F.when((exponent == 255) & (fraction > 0), F.lit(float("nan")))
        .when(exponent == 255, sign * float("inf"))
        .when(exponent == 0, sign * fraction * 2.0**-126)
        .otherwise(sign * normal)
    )


def raw(data: Column, at, length) -> Column:
    """Bytes [at, at + length)."""
    at = F.lit(at) if isinstance(at, int) else at
    length = F.lit(length) if isinstance(length, int) else length
    return F.substr(data, (at + 1).cast("int"), length.cast("int"))


def hex_uint(value: Column, width: int) -> Column:
    """Hex text of an unsigned integer, least significant byte first."""

    def text(v):
        return F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(255)), 2, "0") for i in range(width)])

    return let(value.cast("bigint"), text)


def hex_sint(value: Column, width: int) -> Column:
    value = value.cast("bigint")
    return hex_uint(value if width == 8 else value.bitwiseAND((1 << (8 * width)) - 1), width)


def hex_float32(value: Column) -> Column:
    """Hex text of a normal float32, for values that the format holds exactly."""
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))

    def encode(v):
        def bits(e):
            fraction = F.round((F.abs(v) / power(e) - 1) * (1 << 23)).cast("bigint")
            sign = F.when(v < 0, F.lit(1 << 31)).otherwise(F.lit(0))
            return let(sign + (e + 127).cast("bigint") * (1 << 23) + fraction, lambda w: hex_uint(w, 4))

        def settle(e):
            # The logarithm can be one off next to a power of two.
            return F.when(power(e) > F.abs(v), e - 1).when(power(e + 1) <= F.abs(v), e + 1).otherwise(e)

        exponent = let(F.floor(F.log2(F.abs(v))), settle)
        return F.when(v == 0, F.lit("00000000")).otherwise(let(exponent, bits))

    return let(value.cast("double"), encode)
