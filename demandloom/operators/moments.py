"""Least squares from running moments: sums of products over the rows before a row, and the solution at that row.

A window adds up each product once; every origin of a series then solves its own small system from the sums, as plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

#: A pivot below it means a column that the others explain: it takes no part.
TINY = 1e-9


def with_moments(df: DataFrame, x: list[Column], y: Column, use: Column, before: WindowSpec) -> DataFrame:
    """Add a_i_j (i <= j) and a_i_y, the sums of products over the rows of ``before`` where ``use`` holds, and their number ``rows``."""
    n = len(x)
    add = lambda v: F.coalesce(F.sum(F.when(use, v)).over(before), F.lit(0.0))            # noqa: E731
    cols = {f"a_{i}_{j}": add(x[i] * x[j]) for i in range(n) for j in range(i, n)} | {f"a_{i}_y": add(x[i] * y) for i in range(n)}
    return df.withColumns(cols | {"rows": F.count(F.when(use, F.lit(1))).over(before)})


def solved(df: DataFrame, n: int, ridge: list[float] | None = None) -> DataFrame:
    """Add w_0 .. w_{n-1}, the solution of (X'X + ridge) w = X'y, by elimination; drops the moments."""
    if ridge:
        df = df.withColumns({f"a_{i}_{i}": F.col(f"a_{i}_{i}") + r for i, r in enumerate(ridge) if r})
    for k in range(n - 1):
        pivot = F.col(f"a_{k}_{k}")
        df = df.withColumns({f"f_{i}": F.when(F.abs(pivot) > TINY, F.col(f"a_{k}_{i}") / pivot).otherwise(0.0) for i in range(k + 1, n)})
        df = df.withColumns({f"a_{i}_{j}": F.col(f"a_{i}_{j}") - F.col(f"f_{i}") * F.col(f"a_{k}_{j}")
                             for i in range(k + 1, n) for j in [*range(i, n), "y"]}).drop(*[f"f_{i}" for i in range(k + 1, n)])
    for k in reversed(range(n)):
        rest = F.col(f"a_{k}_y")
        for j in range(k + 1, n):
            rest = rest - F.col(f"a_{k}_{j}") * F.col(f"w_{j}")
        df = df.withColumn(f"w_{k}", F.when(F.abs(F.col(f"a_{k}_{k}")) > TINY, rest / F.col(f"a_{k}_{k}")).otherwise(0.0))
    return df.drop(*[f"a_{i}_{j}" for i in range(n) for j in [*range(i, n), "y"]])


def dot(x: list[Column]) -> Column:
    out = F.col("w_0") * x[0]
    for i, c in enumerate(x[1:], 1):
        out = out + F.col(f"w_{i}") * c
    return out


def solved_sql(source: str, x: list[str], y: str, use: str, before: str, ridge: list[float] | None = None) -> str:
    """The same in SQL: ``source`` with rows and w_0, w_1, ..."""
    n = len(x)
    cell = [(i, j) for i in range(n) for j in [*range(i, n), "y"]]
    term = lambda i, j: f"({x[i]}) * ({y if j == 'y' else x[j]})"                          # noqa: E731
    sums = ", ".join(f"coalesce(sum(CASE WHEN {use} THEN {term(i, j)} END) OVER w, 0)" + (f" + {ridge[i]}" if ridge and i == j else "") + f" AS a_{i}_{j}" for i, j in cell)
    q = f"SELECT *, {sums}, count(CASE WHEN {use} THEN 1 END) OVER w AS rows FROM {source} WINDOW w AS ({before} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    for k in range(n - 1):
        fs = ", ".join(f"CASE WHEN abs(a_{k}_{k}) > {TINY} THEN a_{k}_{i} / a_{k}_{k} ELSE 0 END AS f_{k}_{i}" for i in range(k + 1, n))
        new = ", ".join(f"a_{i}_{j} - f_{k}_{i} * a_{k}_{j} AS a_{i}_{j}" for i in range(k + 1, n) for j in [*range(i, n), "y"])
        q = f"SELECT * REPLACE ({new}) FROM (SELECT *, {fs} FROM ({q}))"
    for k in reversed(range(n)):
        rest = " ".join([f"a_{k}_y"] + [f"- a_{k}_{j} * w_{j}" for j in range(k + 1, n)])
        q = f"SELECT *, CASE WHEN abs(a_{k}_{k}) > {TINY} THEN ({rest}) / a_{k}_{k} ELSE 0 END AS w_{k} FROM ({q})"
    return q
