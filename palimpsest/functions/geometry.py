"""Boxes as struct<x0, y0, x1, y1> in points, the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def shared(a: Column, b: Column) -> Column:
    """The area that both boxes cover."""
    return area(box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])))


def overlap_fraction(a: Column, b: Column) -> Column:
    """The share of `a` that `b` covers; an empty box is not covered."""
    return F.coalesce(shared(a, b) / F.when(area(a) > 0, area(a)), F.lit(0.0))


def touches(a: Column, b: Column, gap: float = 0.0) -> Column:
    return (a["x0"] - gap <= b["x1"]) & (b["x0"] - gap <= a["x1"]) & (a["y0"] - gap <= b["y1"]) & (b["y0"] - gap <= a["y1"])


def centre_inside(a: Column, b: Column) -> Column:
    x, y = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def is_sane(b: Column, least_side: float = 2.0) -> Column:
    return (b["x1"] - b["x0"] >= least_side) & (b["y1"] - b["y0"] >= least_side)


def page_share(y: Column, height: Column) -> Column:
    """Where on its page a height lies, from 0 to 1."""
    return F.least(F.greatest(y / F.when(height > 0, height), F.lit(0.0)), F.lit(1.0))


def rounded(b: Column) -> Column:
    return box(*[F.bround(b[c], 0) for c in ("x0", "y0", "x1", "y1")])
