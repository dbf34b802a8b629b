"""Interval and box arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Temporal intersection over union; 0 where the union is not positive."""
    shared = overlap_seconds(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def midpoint_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.abs((s1 + e1) / 2 - (s2 + e2) / 2)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, closed: bool = False) -> Column:
    """Positive overlap, or with closed also a touch."""
    return ((s1 <= e2) & (s2 <= e1)) if closed else ((s1 < e2) & (s2 < e1))


def bbox_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def bounded_context(raw_start: Column, raw_end: Column, before: float, after: float, duration: Column, cap: float) -> tuple[Column, Column]:
    """Padded window: context before and after, clipped to the clip, total length at most cap.

    A raw interval of cap or more gets no padding. A scarce budget is split in proportion to the context that
    fits on each side, and what one side cannot use goes to the other.
    """
    length = raw_end - raw_start
    b = F.least(F.lit(before), F.greatest(raw_start, F.lit(0.0)))
    a = F.least(F.lit(after), F.greatest(duration - raw_end, F.lit(0.0)))
    budget = F.greatest(F.lit(0.0), F.lit(cap) - length)
    share = F.when(a + b > 0, budget * b / (a + b)).otherwise(0.0)
    fits = a + b <= budget
    first = F.when(fits, b).otherwise(F.least(b, share))
    return raw_start - first, raw_end + F.when(fits, a).otherwise(F.least(a, budget - first))


def frame_to_time(frame: Column, fps: float) -> Column:
    return frame / F.lit(float(fps))


def time_to_frame(seconds: Column, fps: float) -> Column:
    """Truncated."""
    return (seconds * fps).cast("int")


def inclusive_end(frame: Column, fps: float) -> Column:
    """The time at which an inclusive last frame ends."""
    return (frame + 1) / F.lit(float(fps))
