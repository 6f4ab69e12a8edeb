"""Statistics as Column expressions; nothing here divides by zero under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def safe(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0.0))


def pearson(x: str, y: str, least: int = 2) -> Column:
    """Aggregate: Pearson r, 0 with fewer than least rows or without variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    n = F.count("*").cast("double")
    vx = n * F.sum(a * a) - F.sum(a) * F.sum(a)
    vy = n * F.sum(b * b) - F.sum(b) * F.sum(b)
    r = safe(n * F.sum(a * b) - F.sum(a) * F.sum(b), F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))))
    return F.when(F.count("*") < least, 0.0).otherwise(F.coalesce(r, F.lit(0.0)))


def normal_tail(t: Column) -> Column:
    """2 (1 - Phi(|t|)) by the polynomial 7.1.26 of Abramowitz and Stegun."""
    z = F.abs(t) / 1.4142135623730951
    k = 1.0 / (1.0 + 0.3275911 * z)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    return poly * F.exp(-z * z)


def welch_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    se = F.sqrt(v1 / n1 + v2 / n2)
    return F.when((n1 >= 2) & (n2 >= 2), safe(m1 - m2, se))


def cohens_d(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif((n1 + n2 - 2).cast("double"), F.lit(0.0)))
    return F.when((n1 >= 2) & (n2 >= 2), safe(m1 - m2, pooled))


def wilson(correct: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    n = total.cast("double")
    p = safe(correct.cast("double"), n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.when(total == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), middle - half), 4))
    return low, F.when(total == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), middle + half), 4))


def fisher(r: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Confidence interval of a correlation; (r, r) for fewer than four points or a perfect one."""
    point = (n < 4) | (F.abs(r) >= 1)
    inside = F.when(point, 0.0).otherwise(r)
    se = z / F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))
    end = lambda s: F.when(point, r).otherwise(F.round(F.tanh(F.atanh(inside) + s * se), 4))
    return end(-1.0), end(1.0)


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.8, "strong").when(a >= 0.6, "moderate").when(a >= 0.4, "weak").otherwise("very weak")


def stars(p: Column) -> Column:
    return F.when(p.isNull(), "n/a").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")
