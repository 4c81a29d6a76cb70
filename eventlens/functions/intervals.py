"""Expressions over intervals of seconds; a null start or end makes an interval untimed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timed(s: Column, e: Column) -> Column:
    return s.isNotNull() & e.isNotNull()


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part; negative if there is a hole."""
    return F.least(e1, e2) - F.greatest(s1, s2)


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common part over hull; 0 for untimed or empty intervals."""
    both = timed(s1, e1) & timed(s2, e2)
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(both & (hull > 0), F.greatest(F.lit(0.0), overlap(s1, e1, s2, e2)) / F.nullif(hull, F.lit(0.0))).otherwise(0.0)


def midpoint(s: Column, e: Column) -> Column:
    return (s + e) / 2


def repaired(s: Column, e: Column, duration: Column) -> tuple[Column, Column]:
    """Annotations without length stand for the whole clip; untimed ones stay untimed."""
    empty = timed(s, e) & (e - s <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(s), F.when(empty, duration).otherwise(e)


def window_label(ws: Column, we: Column, es: Column, ee: Column, cls: Column, window_cov: float = 0.5, event_cov: float = 0.5, least: float = 1.0) -> Column:
    """Class, 'normal', or null where the window should be dropped."""
    common = overlap(ws, we, es, ee)
    of_window = F.when(we - ws > 0, common / F.nullif(we - ws, F.lit(0.0))).otherwise(0.0)
    of_event = F.when(ee - es > 0, common / F.nullif(ee - es, F.lit(0.0))).otherwise(1.0)
    return (
        F.when(~timed(es, ee), F.lit("normal"))
        .when(common <= 0, F.lit("normal"))
        .when(common < least, F.lit(None).cast("string"))
        .when((of_window >= window_cov) | (of_event >= event_cov), cls)
    )
