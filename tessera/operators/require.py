"""Fail-closed checks: a stage that finds a violated invariant publishes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """An input or a result breaks an invariant."""


def require(df: DataFrame, condition: Column | str, message: str) -> DataFrame:
    """df, where any row that breaks the condition (or leaves it null) aborts the job that reads it."""
    ok = F.expr(condition) if isinstance(condition, str) else condition
    guard = F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(guard)


def require_none(bad: DataFrame, message: str) -> None:
    """Raise at once if there is any row."""
    if bad.limit(1).count():
        raise Violation(message)


def same_rows(left: DataFrame, right: DataFrame, message: str) -> None:
    """Raise unless both hold the same rows, equally often."""
    require_none(left.exceptAll(right), message)
    require_none(right.exceptAll(left), message)


def violations(df: DataFrame, **checks: Column | str) -> DataFrame:
    """(check, violations): how many rows break each named condition."""
    sums = [F.sum((~F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False))).cast("long")).alias(n) for n, c in checks.items()]
    row = df.agg(*sums)
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("violations")) for n in checks])).alias("x")).select("x.*")


def ratios(**values: float) -> None:
    """Raise unless every named value is a finite number within 0 and 1."""
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1:
            raise ValueError(f"{name} must be within 0 and 1")


def positive(**values: float) -> None:
    """Raise unless every named value is a finite number above 0."""
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 < v < float("inf"):
            raise ValueError(f"{name} must be finite and positive")


def within(low: float, high: float, **values: float) -> None:
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not low <= v <= high:
            raise ValueError(f"{name} must be {low} to {high}")


def at_most(df: DataFrame, n: int, message: str) -> DataFrame:
    """df if it has up to n rows; more raise instead of being cut off."""
    if n < 1:
        raise ValueError("a limit is positive")
    if df.limit(n + 1).count() > n:
        raise Violation(message)
    return df
