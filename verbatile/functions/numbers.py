"""Column functions on numbers: speech tempo, budgets, sample sizes, boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tempo_chain(factor: Column) -> Column:
    """Factors between 0.5 and 2 whose product is the given one, which is positive."""
    up = F.greatest(F.ceil(F.log2(factor) - 1e-12) - 1, F.lit(0)).cast("int")
    down = F.greatest(F.ceil(-F.log2(factor) - 1e-12) - 1, F.lit(0)).cast("int")
    rest = factor / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    return F.concat(F.array_repeat(F.lit(2.0), up), F.array_repeat(F.lit(0.5), down), F.array(rest))


def character_budget(seconds: Column, per_second: Column, ratio: float = 1.0) -> Column:
    """Characters that fit into a window, four at least."""
    return F.greatest(F.lit(4), F.floor(seconds * per_second * ratio)).cast("int")


def length_scale(scale: Column, allowed: Column, measured: Column, least: float, most: float) -> Column:
    """The next speed of a voice, so that what was measured fits with three per cent to spare."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.try_divide(scale * allowed, measured) * 0.97))


def zero_error_sample(accuracy: float, confidence: float) -> int:
    """How many samples without an error prove the accuracy."""
    return math.ceil(math.log(1 - confidence) / math.log(accuracy))


def pitch_style(hertz: Column) -> Column:
    return F.when(hertz >= 175, "high").when(hertz <= 150, "low").when(hertz.isNotNull(), "neutral")


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Shared over joint area of boxes (left, top, right, bottom); 0 without any area."""
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    area = lambda x: side(x[0], x[2]) * side(x[1], x[3])
    both = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))
