"""Numbers in binary records, read and written in generated code: little-endian words and IEEE single floats, by way of hexadecimal digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(data, start) -> Column:
    """The unsigned 32-bit number of the four bytes from `start` (from 0) on, the lowest first; null beyond the end."""
    h = F.hex(F.substring(data, start + F.lit(1), F.lit(4)))
    turned = F.concat(*[F.substring(h, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)])
    return F.when(F.length(h) == 8, F.conv(turned, 16, 10).cast("long"))


def float_of(bits: Column) -> Column:
    """The single float of 32 bits, as a double; infinite and undefined ones are those of a double."""
    sign = F.when(bits >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
    e, m = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    whole = F.pow(F.lit(2.0), (e - 127).cast("double")) * (1 + m / F.lit(float(1 << 23)))
    odd = F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(e == 0, m * F.lit(2.0**-149)).when(e == 255, odd).otherwise(whole)


def _let(x: Column, f) -> Column:
    """f(x) with x made once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _little(x: Column) -> Column:
    h = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.concat(*[F.substring(h, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)])


def single_hex(x: Column) -> Column:
    """The digits of the bytes of a finite number's nearest single float. Numbers too small for its usual form become 0."""
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))

    def bits(d: Column, e: Column) -> Column:
        return (F.when(d < 2.0**-126, F.lit(0)).otherwise((e + 127) * (1 << 23) + (d / two(e) - 1) * (1 << 23))).cast("long")

    exponent = lambda d: _let(F.floor(F.log2(d)), lambda g: F.when(d >= two(g + 1), g + 1).when(d < two(g), g - 1).otherwise(g))
    size = _let(F.abs(x.cast("float").cast("double")), lambda d: _let(exponent(d), lambda e: bits(d, e)))
    return _let(size + F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0)), _little)
