"""Sums of doubles that do not depend on the order of rows, as aggregate expressions.

A double is written as whole numbers of 2^0, 2^-40, 2^-80, 2^-120 and 2^-160, each digit at most half of the next larger
unit away from zero.  Digits are found without rounding and summed as decimals, so partial sums merge exactly, whatever the
partitions are; carries are settled once, on the sums.  The result is exact for numbers below 2^62 that are multiples of
2^-160: any double of 1e-32 and more, and all but the last digits of smaller ones.  A sum of zero is exactly zero.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

BITS, DIGITS = 40, 5
_UNIT = 1 << BITS
_WIDE = "decimal(38,0)"
#: Larger numbers, infinities and NaN are left to a plain sum.
_LIMIT = float(1 << 62)


def _digits(x: Column) -> list[Column]:
    """Whole numbers d0, d1, ... with x = d0 + d1 / 2^40 + d2 / 2^80 + ..."""
    rounded = [F.rint(x * float(1 << BITS * k)) for k in range(DIGITS)]
    return [rounded[0]] + [b - a * float(_UNIT) for a, b in zip(rounded, rounded[1:])]


def _settled(sums: list[Column]) -> Column:
    """The double nearest to the number with these summed digits, but for an error in its last bit."""
    half, unit = F.lit(_UNIT // 2).cast(_WIDE), F.lit(_UNIT).cast(_WIDE)
    terms = F.array(*[F.struct(s.cast(_WIDE).alias("digit"), F.lit(2.0 ** (-BITS * k)).alias("weight")) for k, s in list(enumerate(sums))[:0:-1]])
    start = F.struct(F.lit(0).cast(_WIDE).alias("carry"), F.lit(0.0).alias("value"))

    def step(acc: Column, term: Column) -> Column:
        digit = (term["digit"] + acc["carry"]).cast(_WIDE)
        rest = (F.pmod((digit + half).cast(_WIDE), unit) - half).cast(_WIDE)
        return F.struct(((digit - rest).cast(_WIDE) / unit).cast(_WIDE).alias("carry"), (acc["value"] + rest.cast("double") * term["weight"]).alias("value"))

    return F.aggregate(terms, start, step, lambda acc: acc["value"] + (sums[0].cast(_WIDE) + acc["carry"]).cast("double"))


def exact_sum(column: Column | str, over: WindowSpec | None = None) -> Column:
    """Sum of a double column, inside ``agg`` or over a window; null where there is nothing to add."""
    x = F.col(column) if isinstance(column, str) else column
    x = x.cast("double")
    plain = ~(F.abs(x) < _LIMIT)  # also infinities; a comparison with NaN is true in Spark, so NaN is asked for
    tame = F.when(~plain & ~F.isnan(x), x)

    def total(c: Column) -> Column:
        s = F.sum(c)
        return s if over is None else s.over(over)

    sums = [total(d.cast("long").cast("decimal(20,0)")) for d in _digits(tame)]
    wild = total(F.when(plain | F.isnan(x), x))
    exact = F.when(sums[0].isNotNull(), _settled(sums))
    return F.when(wild.isNull(), exact).otherwise(wild + F.coalesce(exact, F.lit(0.0)))
