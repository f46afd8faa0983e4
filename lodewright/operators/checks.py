"""Argument guards; they raise on the driver before a plan runs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def positive(name: str, value: float) -> None:
    if value <= 0:
        raise ValueError(f"{name} must be positive")


def not_negative(name: str, value: float) -> None:
    if value < 0:
        raise ValueError(f"{name} must not be negative")


def aligned(what: str, a: int, b: int) -> None:
    if a != b:
        raise ValueError(f"{what}: {a} and {b} do not align")


def unique(df: DataFrame, *keys: str) -> None:
    twice = df.groupBy(*keys).count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"{', '.join(keys)} must be unique; {twice[0].asDict()} is not")
