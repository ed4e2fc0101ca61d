"""Tail probabilities that Spark lacks, as Arrow functions in plain mathematics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def poisson_upper(n: float, lam: float) -> float:
    """P(X >= n) for Poisson mean ``lam``, without cancellation or underflow of the mean; null gives nan."""
    if n != n or lam != lam:
        return math.nan
    if n <= 0 or lam <= 0:
        return 1.0
    front = math.exp(n * math.log(lam) - lam - math.lgamma(n + 1))
    if lam < n + 1:  # the series of the tail itself
        total = term = 1.0
        k = n
        while term > total * 1e-17:
            k += 1
            term *= lam / k
            total += term
        return min(1.0, front * total)
    total = term = 1.0  # the terms below n, from the largest down
    k = n - 1
    front = math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
    while k > 0 and term > total * 1e-17:
        term *= k / lam
        total += term
        k -= 1
    return max(0.0, 1.0 - front * total)


@F.pandas_udf(T.DoubleType())
def poisson_tail(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for n, lam in parts:
        yield pd.Series([poisson_upper(a, b) for a, b in zip(n.astype(float), lam.astype(float))])


@F.pandas_udf(T.DoubleType())
def chi2_tail(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Upper tail of chi-squared with one degree of freedom; null for null."""
    for x in parts:
        yield x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v is not None and v == v else None).astype(float)
