"""Polynomial and interaction features."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import numeric_columns


def polynomial_terms(columns: Sequence[str], degree: int = 2, interaction_only: bool = False) -> list[tuple[str, tuple[int, ...]]]:
    """(name, column-index tuple) of every monomial of total degree 2..degree,
    in degree order and lexicographic order within a degree; names ``a^2``,
    ``a b``, ``a^2 b``."""
    cols = list(columns)
    gen = combinations if interaction_only else combinations_with_replacement
    out = []
    for d in range(2, degree + 1):
        for combo in gen(range(len(cols)), d):
            parts = []
            for i in sorted(set(combo)):
                k = combo.count(i)
                parts.append(cols[i] if k == 1 else f"{cols[i]}^{k}")
            out.append((" ".join(parts), combo))
    return out


def polynomial_size(n_columns: int, degree: int, interaction_only: bool = False, bias: bool = False) -> int:
    """Number of new columns (the estimate shown before generating)."""
    return len(polynomial_terms([str(i) for i in range(n_columns)], degree, interaction_only)) + int(bias)


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2, interaction_only: bool = False,
                        include_bias: bool = False) -> DataFrame:
    """Append the monomials of ``columns`` (and a bias column ``1``).

    Needs at least two numeric columns; degree 2 or 3.  All products are added
    in one projection; a missing input gives a missing product.
    """
    if degree not in (2, 3):
        raise ValueError("degree must be 2 or 3")
    num = set(numeric_columns(df, include_bool=False))
    cols = list(columns)
    if len(cols) < 2 or any(c not in num for c in cols):
        raise ValueError("need at least two numeric columns")
    x = [F.col(c).cast("double") for c in cols]
    new = []
    for name, combo in polynomial_terms(cols, degree, interaction_only):
        e = x[combo[0]]
        for i in combo[1:]:
            e = e * x[i]
        new.append(e.alias(name))
    if include_bias:
        new.append(F.lit(1.0).alias("1"))
    return df.select(*[F.col(c) for c in df.columns], *new)
