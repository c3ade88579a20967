"""Numbers. Results that are not finite are left as they are; validation reports them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PI, E, PHI = math.pi, math.e, (1 + math.sqrt(5)) / 2
CONSTANTS = {
    "pi": PI, "e": E, "phi": PHI, "sqrt2": math.sqrt(2), "sqrt_e": math.sqrt(E), "sqrt_pi": math.sqrt(PI), "sqrt_phi": math.sqrt(PHI),
    "ln2": math.log(2), "log2_e": 1 / math.log(2), "ln10": math.log(10), "log10_e": 1 / math.log(10),
}


def double(x: Column) -> Column:
    return x.cast("double")


def floor(x: Column) -> Column:
    return double(F.floor(x))


def ceil(x: Column) -> Column:
    return double(F.ceil(x))


def round_away(x: Column) -> Column:
    """Halves away from zero."""
    return trunc(double(x) + F.when(x < 0, -0.5).otherwise(0.5))


def round_even(x: Column) -> Column:
    return F.rint(double(x))


def trunc(x: Column) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def logb(x: Column) -> Column:
    """The exponent of two below |x|; of 0 minus infinity."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(floor(F.log2(F.abs(double(x)))))


def ilogb(x: Column) -> Column:
    return F.when(x == 0, F.lit(-(1 << 31))).otherwise(logb(x)).cast("long")


def pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n)


def scaleb(x: Column, n: Column) -> Column:
    return double(x) * F.pow(F.lit(2.0), n)


ldexp = scaleb


def modf(x: Column) -> Column:
    """[integer part, rest], both with the sign of x."""
    return F.array(trunc(x), double(x) - trunc(x))


def _of_numbers(function, n: int = 1, kind: str = "double"):
    if n == 1:
        return F.pandas_udf(lambda x: pd.Series(function(x.to_numpy(float, na_value=np.nan))).where(x.notna()), kind)
    return F.pandas_udf(lambda x, y: pd.Series(function(x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan))).where(x.notna() & y.notna()), kind)


def nextafter(x: Column, y: Column) -> Column:
    """The next double from x towards y."""
    return _of_numbers(np.nextafter, 2)(double(x), double(y))


def fma(x: Column, y: Column, z: Column) -> Column:
    """x * y + z, rounded once."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([math.fma(*v) if not any(map(pd.isna, v)) else None for v in zip(a, b, c, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(double(x), double(y), double(z))


def frexp(x: Column) -> Column:
    """mantissa in [0.5, 1) and exponent."""

    def run(x: pd.Series) -> pd.DataFrame:
        mantissa, exponent = np.frexp(x.to_numpy(float, na_value=np.nan))
        return pd.DataFrame({"mantissa": mantissa, "exponent": exponent.astype(np.int32)})

    return F.when(x.isNotNull(), F.pandas_udf(run, "mantissa double, exponent int")(double(x)))


def erf(x: Column) -> Column:
    return _of_numbers(np.vectorize(math.erf, otypes=[float]))(double(x))


def erfc(x: Column) -> Column:
    return _of_numbers(np.vectorize(math.erfc, otypes=[float]))(double(x))


def gamma(x: Column) -> Column:
    """Null at its poles and where it overflows."""

    def one(v: float) -> float:
        try:
            return math.gamma(v)
        except (ValueError, OverflowError):
            return np.nan

    return F.nanvl(_of_numbers(np.vectorize(one, otypes=[float]))(double(x)), F.lit(None).cast("double"))


def log_gamma(x: Column) -> Column:
    """The logarithm of the absolute value; infinite at the poles."""

    def one(v: float) -> float:
        try:
            return math.lgamma(v)
        except ValueError:
            return np.inf

    return _of_numbers(np.vectorize(one, otypes=[float]))(double(x))


def absolute(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def dim(x: Column, y: Column) -> Column:
    return F.greatest(double(x) - double(y), F.lit(0.0))


def copysign(x: Column, y: Column) -> Column:
    return F.abs(double(x)) * F.when(y < 0, -1.0).otherwise(1.0)


def remainder(x: Column, y: Column) -> Column:
    """x - y * the quotient cut off towards zero; null if y is 0."""
    return F.when(y != 0, double(x) % double(y))


mod = remainder


def is_nan(x: Column) -> Column:
    return F.when(x.isNotNull(), F.isnan(double(x)))


def is_inf(x: Column) -> Column:
    return F.abs(double(x)) == F.lit(float("inf"))


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def multiple_of(x: Column, n: float) -> Column:
    """Exact for whole n; for others the quotient may be off a whole number by 1e-9."""
    if n == int(n):
        return x % int(n) == 0
    quotient = double(x) / F.lit(float(n))
    return F.abs(quotient - F.rint(quotient)) < 1e-9


def finite(x: Column) -> Column:
    """x, or null where it is infinite or no number."""
    return F.when(~F.isnan(double(x)) & (F.abs(double(x)) < F.lit(float("inf"))), x)


def divide(x: Column, y: Column) -> Column:
    """Always a double; null if y is 0."""
    return F.try_divide(double(x), double(y))


def quo(x: Column, y: Column) -> Column:
    """Quotient of integers, cut off towards zero; null if y is 0."""
    return F.when(y != 0, F.floor(F.abs(x) / F.abs(y)) * F.signum(x).cast("long") * F.signum(y).cast("long"))


def rem(x: Column, y: Column) -> Column:
    return F.when(y != 0, x % y)


def euclid_mod(x: Column, y: Column) -> Column:
    """The remainder that is not negative."""
    return F.when(y != 0, F.pmod(x, F.abs(y)))


def euclid_div(x: Column, y: Column) -> Column:
    """The quotient that belongs to euclid_mod()."""
    return F.when(y != 0, F.floor((x - F.pmod(x, F.abs(y))) / F.abs(y)) * F.signum(y).cast("long"))
