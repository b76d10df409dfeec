"""Vectors as 14 scalar columns: quantisation, distances, bounds. All of it stays inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.schemas import DIM, HI, LO, SCALE, Q, V


def f32(x) -> Column:
    return F.lit(x).cast("float")


def pad(vector: Column) -> list[Column]:
    """14 floats of an array: short ones are filled with 0, long ones cut; null elements are 0."""
    return [F.coalesce(F.get(vector, F.lit(i)), F.lit(0)).cast("float") for i in range(DIM)]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, f32(high)), f32(low))


def quantize(x: Column) -> Column:
    """Times SCALE in single precision, halves away from zero."""
    scaled = clamp(x, -1.0, 1.0) * f32(SCALE)
    return F.when(scaled >= 0, scaled + f32(0.5)).otherwise(scaled - f32(0.5)).cast("int")


def vector_columns(vector: Column) -> list[Column]:
    """v0..v13 and q0..q13 of an array column."""
    values = pad(vector)
    return [*(x.alias(n) for x, n in zip(values, V, strict=True)), *(quantize(x).alias(n) for x, n in zip(values, Q, strict=True))]


def int_distance(a: list[Column], b: list[Column]) -> Column:
    """Squared distance of quantised vectors. A square fits an int, their sum needs a long."""
    return reduce(lambda s, x: s + x, ((x - y).cast("long") * (x - y) for x, y in zip(a, b, strict=True)))


def float_distance(a: list[Column], b: list[Column]) -> Column:
    """Squared distance in single precision, summed from left to right."""
    return reduce(lambda s, x: s + x, ((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def box_bound(q: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    """Least squared distance from q to a box; 0 inside."""
    gaps = [F.greatest(a - x, x - b, F.lit(0)).cast("long") for x, a, b in zip(q, lo, hi, strict=True)]
    return reduce(lambda s, x: s + x, (g * g for g in gaps))


def columns(names: list[str], frame: str | None = None) -> list[Column]:
    return [F.col(f"{frame}.{n}" if frame else n) for n in names]


def box_columns(frame: str | None = None) -> tuple[list[Column], list[Column]]:
    return columns(LO, frame), columns(HI, frame)
