"""Q16.16 and (wide_*) Q32.32 fixed-point columns: raw BIGINT values, value times 65536 or 2^32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE, LOWEST, HIGHEST = 1 << 16, -(1 << 31), (1 << 31) - 1


def from_int(v: Column) -> Column:
    return F.shiftleft(v.cast("long"), 16)


def from_fraction(n: str, d: str) -> Column:
    """Truncated towards zero; null for a zero denominator."""
    return F.expr(f"if({d} = 0, null, (cast({n} as bigint) * 65536) div nullif({d}, 0))")


def wrapped(x: Column) -> Column:
    """Two's complement on 32 bits."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def add(a: Column, b: Column) -> Column:
    return wrapped(a + b)


def sub(a: Column, b: Column) -> Column:
    return wrapped(a - b)


def mul(a: Column, b: Column) -> Column:
    """Rounds down."""
    return F.shiftright(a * b, 16)


def div(a: str, b: str) -> Column:
    """Truncated towards zero; null for a zero divisor."""
    return F.expr(f"if({b} = 0, null, ({a} * 65536) div nullif({b}, 0))")


def checked(x: Column) -> Column:
    """Null outside the 32-bit range."""
    return F.when((x >= LOWEST) & (x <= HIGHEST), x)


def to_float(x: Column) -> Column:
    return x / F.lit(65536.0)


def to_int(x: Column) -> Column:
    """Rounds down."""
    return F.shiftright(x, 16)


def fraction(x: Column) -> Column:
    return x.bitwiseAND(65535)


def negate(x: Column) -> Column:
    return wrapped(-x)


def absolute(x: Column) -> Column:
    return F.when(x < 0, wrapped(-x)).otherwise(x)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: raw values are ordered like what they stand for."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def _decimal(name: str) -> str:
    return f"cast({name} as decimal(20, 0))"


def wide_add(a: str, b: str) -> Column:
    """Two's complement on 64 bits."""
    return F.expr(f"cast(pmod({_decimal(a)} + {_decimal(b)} + 9223372036854775808BD, 18446744073709551616BD) - 9223372036854775808BD as bigint)")


def wide_mul(a: str, b: str) -> Column:
    """Rounds down; the product must fit in 64 bits."""
    product = f"cast({_decimal(a)} * {_decimal(b)} as decimal(38, 0))"
    return F.expr(f"({product} - pmod({product}, 4294967296BD)) div 4294967296BD")


def wide_div(a: str, b: str) -> Column:
    """Truncated towards zero; null for a zero divisor."""
    return F.expr(f"({_decimal(a)} * 4294967296BD) div nullif({_decimal(b)}, 0BD)")
