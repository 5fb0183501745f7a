"""Packing of small integer codes into one key, and distances between codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_for(values: int) -> int:
    """Bits of a code with so many values."""
    return max(1, (values - 1).bit_length())


def encode_by_bits(codes: Column, k: int, bits: int) -> Column:
    """Code j in bits j * bits and up: the first code is lowest. k * bits is at most 63."""
    if k * bits > 63:
        raise ValueError(f"{k} codes of {bits} bits don't fit a key of 63 bits")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(codes[j].cast("long"), bits * j) for j in range(k)])


def decode_by_bits(key: Column, k: int, bits: int) -> Column:
    mask = F.lit((1 << bits) - 1).cast("long")
    return F.array(*[F.shiftrightunsigned(key, bits * j).bitwiseAND(mask).cast("int") for j in range(k)])


def encode_by_place(codes: Column, k: int, width: int = 8) -> Column:
    """Zig-zag codes in decimal places, ``width`` digits each, the first lowest; higher digits of a code are dropped. k * width is at most 38.

    x > 0 becomes 2x, x < 0 becomes -2x - 1 and 0 stays 0.
    """
    if k * width > 38:
        raise ValueError(f"{k} codes of {width} digits don't fit a decimal of 38")
    wide = "decimal(38,0)"
    parts = []
    for j in range(k):
        x = codes[j].cast("long")
        zig = F.when(x > 0, 2 * x).when(x < 0, -2 * x - 1).otherwise(F.lit(0))
        digits = F.pmod(zig, F.lit(10**width).cast("long")).cast("string")
        # as text, since products of decimals lose digits beyond their precision
        parts.append(F.lpad(digits, width, "0"))
    return F.concat(*reversed(parts)).cast(wide)


def decode_by_place(key: Column, k: int, width: int = 8) -> Column:
    text = F.lpad(key.cast("string"), k * width, "0")
    out = []
    for j in range(k):
        value = F.substring(text, width * (k - 1 - j) + 1, width).cast("long")
        odd = F.pmod(value, F.lit(2)) == 1
        out.append(F.when(odd, -(F.shiftright(value, 1) + 1)).otherwise(F.shiftright(value, 1)))
    return F.array(*out)


def code_distance(a: Column, b: Column) -> Column:
    """How many codes of two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)


def key_distance(a: Column, b: Column, k: int, bits: int) -> Column:
    """How many of the k bit groups of two keys differ."""
    if bits == 1:
        return F.bit_count(a.bitwiseXOR(b))
    mask = F.lit((1 << bits) - 1).cast("long")
    differ = a.bitwiseXOR(b)
    return reduce(lambda x, y: x + y, [(F.shiftrightunsigned(differ, bits * j).bitwiseAND(mask) != 0).cast("int") for j in range(k)])
