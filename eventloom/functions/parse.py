"""Lenient parsers and the uncertainty gate, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """true, 1, yes and y in any case; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes", "y"), F.lit(False))


def number(c: Column, default: float) -> Column:
    """A number, or default where blank or unreadable; 0.0 stays."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("double"), F.lit(default))


def item_count(c: Column) -> Column:
    """A whole number of 1 or more, else null."""
    x = F.trim(c).try_cast("double")
    return F.when((x >= 1) & (x == F.floor(x)), x.cast("int"))


def frame_rate(c: Column) -> Column:
    """a/b or a plain number; null for a zero denominator or anything unreadable."""
    a, b = F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(c, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(F.contains(c, F.lit("/")), F.when(b != 0, a / b)).otherwise(c.try_cast("double"))


def gated(names: list[str], probabilities: list[Column], least: float, margin: float) -> Column:
    """The first most probable name, or uncertain where it is under least or leads by under margin."""
    best = F.greatest(*probabilities)
    ranked = F.sort_array(F.array(*probabilities), False)
    lead = ranked[0] - ranked[1] if len(probabilities) > 1 else F.lit(1.0)
    first = F.coalesce(*[F.when(p == best, F.lit(n)) for n, p in zip(names, probabilities, strict=True)])
    return F.when((best < least) | (lead < margin), "uncertain").otherwise(first)
