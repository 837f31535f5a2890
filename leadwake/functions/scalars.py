"""Column expressions shared by the operators.  All of them stay inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Governance suffixes that are not corporate-event markers.
GOVERNANCE_SEGMENTS = ("NM", "N1", "N2", "MA", "MB")

ISIN_PATTERN = "^[A-Z]{2}[A-Z0-9]{4}[A-Z0-9]{3}[A-Z0-9]{3}$"
OUTSIDE_BANDS = "elegivel_fora_top100"


def instrument_kind(spec: Column) -> Column:
    """First token of the specification, letters and digits only, upper case."""
    first = F.element_at(F.split(F.trim(spec), r"\s+"), 1)
    return F.upper(F.regexp_replace(first, "[^A-Za-z0-9]", ""))


def event_token(spec: Column) -> Column:
    """Corporate-event marker in token 1, else token 2, else the empty string."""
    tokens = F.split(F.trim(spec), r"\s+")

    def marker(i: int) -> Column:
        tok = F.coalesce(F.get(tokens, F.lit(i)), F.lit(""))
        is_event = (tok.startswith("E") | tok.startswith("*")) & ~tok.isin(*GOVERNANCE_SEGMENTS)
        return F.when(is_event, tok)

    return F.coalesce(marker(1), marker(2), F.lit(""))


def issuer_of(isin: Column) -> Column:
    clean = F.upper(F.trim(isin))
    return F.when(clean.rlike(ISIN_PATTERN), F.substring(clean, 3, 4))


def valid_price(price: Column) -> Column:
    return price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < F.lit(float("inf")))


def band_of(position: Column, bands: tuple[int, ...]) -> Column:
    expr = F.lit(OUTSIDE_BANDS)
    for b in sorted(bands, reverse=True):
        expr = F.when(position <= b, F.lit(f"top{b}")).otherwise(expr)
    return F.when(position.isNull(), F.lit(OUTSIDE_BANDS)).otherwise(expr)


def smallest_band(position: Column, bands: tuple[int, ...]) -> Column:
    expr = F.lit(None).cast("int")
    for b in sorted(bands, reverse=True):
        expr = F.when(position <= b, F.lit(b)).otherwise(expr)
    return expr


def hash_key(*parts: Column | str | int) -> Column:
    """Deterministic pseudo-random sort key; independent of partitioning and row order."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_int(modulus: Column, *parts: Column | str | int) -> Column:
    """Deterministic pseudo-random integer in [0, modulus)."""
    head = F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long")
    return head % modulus


def normal_two_sided(z: Column) -> Column:
    """P(|N(0,1)| > |z|) by Hart's rational approximation, which keeps full double accuracy.

    The coefficients are fixed published values (Hart 1968, as given by West 2005).
    """
    a = F.abs(z)
    tail = F.exp(-a * a / 2)
    num = F.lit(3.52624965998911e-02)
    for c in (0.700383064443688, 6.37396220353165, 33.912866078383,
              112.079291497871, 221.213596169931, 220.206867912376):
        num = num * a + F.lit(c)
    den = F.lit(8.83883476483184e-02)
    for c in (1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
              637.333633378831, 793.826512519948, 440.413735824752):
        den = den * a + F.lit(c)
    frac = a + F.lit(0.65)
    for k in (4, 3, 2, 1):
        frac = a + F.lit(float(k)) / frac
    far = tail / frac / F.lit(2.506628274631)
    one = F.when(a < 7.07106781186547, tail * num / den).when(a <= 37, far).otherwise(0.0)
    return F.when(z.isNotNull(), F.least(F.lit(1.0), 2 * one))


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's distribution with a whole number of degrees of freedom, by its finite series in the angle."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos2, odd = F.cos(angle) * F.cos(angle), df % 2
    terms = F.floor((df - 2 - odd) / 2).cast("int")  # terms after the first

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * cos2 * F.when(odd == 1, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, add, lambda acc: acc["total"])
    inside = F.when(df == 1, angle * 2 / math.pi).when(odd == 1, (angle + F.sin(angle) * F.cos(angle) * total) * 2 / math.pi).otherwise(F.sin(angle) * total)
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), 1 - inside))
