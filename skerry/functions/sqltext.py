"""Helpers for expressions written as SQL text that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float) -> str:
    """A DOUBLE literal: plain decimals would be DECIMAL in Spark."""
    text = f"{float(x):.17e}"
    return f"({text})" if x < 0 else text


def horner(x: str, coefficients: list[float]) -> str:
    """Sum of coefficients[k] * x**k."""
    out = num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {num(c)})"
    return out


def column(text: str) -> Column:
    return F.expr(text)
