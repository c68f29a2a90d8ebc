"""Arithmetic, bits, powers, logarithms and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import INF, NAN, _c, divide

__all__ = ["divide"]
_TWO64 = "18446744073709551616"


def wrap(x: Column) -> Column:
    """A whole number of any size as a long that wraps around, as machine integers do."""
    two64 = F.lit(_TWO64).cast("decimal(38,0)")
    low = F.pmod(x.cast("decimal(38,0)"), two64)
    return F.when(low >= F.lit("9223372036854775808").cast("decimal(38,0)"), low - two64).otherwise(low).cast("long")


def add(a: Column, b: object, wrapping: bool = False) -> Column:
    return wrap(a.cast("decimal(20,0)") + _c(b).cast("decimal(20,0)")) if wrapping else a + _c(b)


def subtract(a: Column, b: object, wrapping: bool = False) -> Column:
    return wrap(a.cast("decimal(20,0)") - _c(b).cast("decimal(20,0)")) if wrapping else a - _c(b)


def multiply(a: Column, b: object) -> Column:
    return a * _c(b)


def negate(a: Column) -> Column:
    return -a


def bit_and(a: Column, b: object) -> Column:
    return a.bitwiseAND(_c(b))


def bit_or(a: Column, b: object) -> Column:
    return a.bitwiseOR(_c(b))


def bit_xor(a: Column, b: object) -> Column:
    return a.bitwiseXOR(_c(b))


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def shift_left(a: Column, n: int, bits: int = 64) -> Column:
    """A shift outside the type's width gives the value unchanged."""
    return F.shiftleft(a, n) if 0 <= n < bits else a


def shift_right(a: Column, n: int, bits: int = 64) -> Column:
    return F.shiftright(a, n) if 0 <= n < bits else a


def sign(a: Column, integral: bool = False) -> Column:
    return F.signum(a).cast("long") if integral else F.signum(a)


def sqrt(a: Column) -> Column:
    """NaN for a negative number."""
    return F.when(a < 0, F.lit(NAN)).otherwise(F.sqrt(a))


def _log(x: Column, value: Column, zero: float = 0.0) -> Column:
    return F.when(x == zero, F.lit(-INF)).when(x < zero, F.lit(NAN)).otherwise(value)


def ln(x: Column) -> Column:
    """Minus infinity at 0, NaN below."""
    return _log(x, F.ln(x))


def log10(x: Column) -> Column:
    return _log(x, F.log10(x))


def log2(x: Column) -> Column:
    return _log(x, F.log2(x))


def log1p(x: Column) -> Column:
    return _log(x, F.log1p(x), -1.0)


def logb(x: Column, base: float) -> Column:
    return _log(x, F.log(x) / F.log(F.lit(float(base))))


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def round_to_multiple(x: Column, m: float, mode: str = "half_to_even") -> Column:
    """The multiple of ``m`` that a mode picks."""
    q = x / F.lit(float(m))
    down, up = F.floor(q).cast("double"), F.ceil(q).cast("double")
    zero, away = trunc(q), F.when(q < 0, down).otherwise(up)
    half = F.abs(q - trunc(q)) == 0.5
    modes = {
        "down": down,
        "up": up,
        "towards_zero": zero,
        "towards_infinity": away,
        "half_down": F.when(half, down).otherwise(F.rint(q)),
        "half_up": F.when(half, up).otherwise(F.rint(q)),
        "half_towards_zero": F.when(half, zero).otherwise(F.rint(q)),
        "half_towards_infinity": F.when(half, away).otherwise(F.rint(q)),
        "half_to_even": F.rint(q),
        "half_to_odd": F.when(half, F.when(F.pmod(down, F.lit(2.0)) == 0, up).otherwise(down)).otherwise(F.rint(q)),
    }
    return modes[mode] * float(m)


def clip(x: Column, low: object, high: object, skip_null: bool = False) -> Column:
    """Bounds on x; a null stays null, or becomes the upper bound if nulls are skipped."""
    bounded = F.greatest(F.least(x, _c(high)), _c(low))
    return bounded if skip_null else F.when(x.isNotNull(), bounded)
