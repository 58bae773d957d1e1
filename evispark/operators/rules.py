"""Rule tables: named conditions that report every problem of a row at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleViolation(ValueError):
    """Raised by ``fail_fast`` for the first problem found."""


def problems(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules a row breaks, in rule order; a condition that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))


def check(df: DataFrame, rules: list[tuple[str, Column]], name: str = "problems") -> DataFrame:
    return df.withColumn(name, problems(rules))


def valid(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return check(df, rules, "_problems").where(F.size("_problems") == 0).drop("_problems")


def rejects(df: DataFrame, key: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule."""
    # Outer, as an inner explosion would first test the size of the array and so judge every rule twice.
    named = check(df, rules, "_problems").select(*key, F.explode_outer("_problems").alias("reason"))
    return named.where("reason IS NOT NULL")


def fail_fast(df: DataFrame, key: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """Raise on the first problem, else hand the rows on. Runs a job that stops at one hit."""
    hit = rejects(df, key, rules).take(1)
    if hit:
        raise RuleViolation(", ".join(f"{k}={v}" for k, v in hit[0].asDict().items()))
    return df
