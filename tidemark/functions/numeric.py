"""Arithmetic of bands, scaling and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Central wavelengths (nm) of green, red and near infrared: fixed values of the floating-algae index.
GREEN, RED, NIR = 560.0, 665.0, 860.0


def reflectance(dn: Column, scale: float = 10000.0) -> Column:
    return dn.cast("double") / scale


def ndwi(green: Column, nir: Column) -> Column:
    return (green - nir) / (green + nir + EPS)


def fai(green: Column, red: Column, nir: Column) -> Column:
    """Red above the straight line from green to near infrared."""
    return red - (green + (nir - green) * ((RED - GREEN) / (NIR - GREEN)))


def red_nir(red: Column, nir: Column) -> Column:
    return red / (nir + EPS)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """x moved into [low, high]; null stays null, which greatest and least alone would skip."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.greatest(lit(low), F.least(lit(high), x)))


def to_byte(x: Column, low: Column | float, high: Column | float) -> Column:
    """Scaled from [low, high] to 0-255 and truncated; NaN and null give 0."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    y = F.when(~F.isnan(x), (x - lit(low)) / (lit(high) - lit(low)))
    return F.coalesce((clamp(y, 0.0, 1.0) * 255).cast("int"), F.lit(0))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def standardise(x: Column, mu: Column, sigma: Column, *, log: bool = True) -> Column:
    return ((F.log1p(x) if log else x) - mu) / sigma


def destandardise(z: Column, mu: Column, sigma: Column, *, log: bool = True) -> Column:
    y = z * sigma + mu
    return F.expm1(y) if log else y


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cross_entropy(p: Column, y: Column, eps: float = 1e-7) -> Column:
    q = clamp(p, eps, 1 - eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def season(month: Column) -> Column:
    """winter, spring, summer or autumn; December is winter of its own year. Null for null."""
    names = F.array(*[F.lit(x) for x in ("winter", "spring", "summer", "autumn")])
    return F.when(month.isNotNull(), F.element_at(names, (F.floor((month % 12) / 3) + 1).cast("int")))
