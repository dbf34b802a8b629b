"""Wrist trajectories against regions: measurements, tolerated gaps, raw interactions and contact times.

Inputs have the key columns, a time, and whether the point is inside the (expanded) region. A null `inside` counts as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.geometry import expanded_points, segment_distance


def region_measurements(obs: DataFrame, keys: list[str], time: str = "t_h", x: str = "wrist_x", y: str = "wrist_y", inside: str = "inside", order: str = "sample_index", reach: int = 2, cosine: float = 0.5) -> DataFrame:
    """obs with entered, dwell_s, speed and reversal.

    Dwell counts from the latest entry and is 0 outside; speed is 0 on a first row or without time passed. The direction
    reverses where the last two steps of `reach` rows have a cosine below -cosine.
    """
    by = Window.partitionBy(*keys).orderBy(time, order)
    now = F.coalesce(inside, F.lit(False))
    rows = obs.withColumn("entered", now & ~F.coalesce(F.lag(inside).over(by), F.lit(False)))
    entry = F.last(F.when(F.col("entered"), F.col(time)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    dt = F.col(time) - F.lag(time).over(by)
    speed = F.when(dt > 0, F.hypot(F.col(x) - F.lag(x).over(by), F.col(y) - F.lag(y).over(by)) / dt).otherwise(0.0)

    def step(c: str, at: int) -> Column:
        return (F.col(c) if at == 0 else F.lag(c, at).over(by)) - F.lag(c, at + reach).over(by)

    bx, by_, ax, ay = step(x, 0), step(y, 0), step(x, reach), step(y, reach)
    size = F.hypot(ax, ay) * F.hypot(bx, by_)
    turned = F.when((F.hypot(ax, ay) > 1e-9) & (F.hypot(bx, by_) > 1e-9), (ax * bx + ay * by_) / size < -cosine)
    return rows.withColumns({"dwell_s": F.when(now, F.col(time) - entry).otherwise(0.0), "speed": speed, "reversal": F.coalesce(turned, F.lit(False))})


def cadence_gap(obs: DataFrame, keys: list[str], time: str = "t_h", least: float = 0.5, fps: float = 2.0, most: float = 2.0) -> DataFrame:
    """(keys..., gap): the largest of least, 1.5 frames and 1.5 upper medians of the positive time steps, the last at most `most`."""
    by = Window.partitionBy(*keys).orderBy(time)
    steps = obs.withColumn("__d", F.col(time) - F.lag(time).over(by)).filter("__d > 0").select(*keys, "__d")
    ranked = steps.withColumns({"__r": F.row_number().over(Window.partitionBy(*keys).orderBy("__d")) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    middle = ranked.filter("__r = __n div 2").select(*keys, F.col("__d").alias("__m"))
    floor = max(least, 1.5 / fps)
    return obs.select(*keys).distinct().join(middle, keys, "left").select(*keys, F.greatest(F.lit(floor), F.least(F.lit(most), 1.5 * F.col("__m"))).alias("gap"))


def raw_interactions(obs: DataFrame, keys: list[str], time: str = "t_h", max_gap: float = 6.0, tolerance: float = 1.0, min_duration: float = 0.0, min_confidence: float = 0.1) -> DataFrame:
    """Stretches of confident rows inside the region.

    Rows of one time are one, qualifying if any of them is. A stretch ends where two consecutive times are more than max_gap apart,
    or where rows that don't qualify last more than tolerance after its last qualifying row.
    """
    ok = F.coalesce(F.col("inside"), F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    rows = obs.groupBy(*keys, time).agg(F.bool_or(ok).alias("ok"), F.max("confidence").alias("confidence"))
    by = Window.partitionBy(*keys).orderBy(time)
    rows = rows.withColumns({"before": F.lag(time).over(by), "before_ok": F.lag("ok").over(by)})
    rows = rows.withColumn("stretch", F.sum(F.when(F.col(time) - F.col("before") > max_gap, 1).otherwise(0)).over(by)).filter("ok")
    last, last_stretch = F.lag(time).over(by), F.lag("stretch").over(by)
    ends = last.isNull() | (last_stretch != F.col("stretch")) | (~F.col("before_ok") & (F.col("before") - last > tolerance))
    rows = rows.withColumn("ends", F.when(ends, 1).otherwise(0)).withColumn("island", F.sum("ends").over(by))
    found = rows.groupBy(*keys, "island").agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count("*").alias("n_rows"), F.avg("confidence").alias("mean_confidence"))
    return found.filter(F.col("t_end") - F.col("t_start") >= min_duration).drop("island")


def contact_time(obs: DataFrame, keys: list[str], time: str = "t_h", order: str = "sample_index") -> DataFrame:
    """(keys..., contact_s): the first step from outside to inside, else the first row inside, else the closest row, else the midpoint."""
    by = Window.partitionBy(*keys).orderBy(time, order)
    rows = obs.withColumn("__enters", F.col("inside") & ~F.lag("inside").over(by))
    t = F.col(time)
    near = F.min_by(F.when(F.col("distance").isNotNull(), t), F.struct(F.coalesce("distance", F.lit(float("inf"))), time))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__enters"), t)), F.min(F.when(F.col("inside"), t)), near, (F.min(t) + F.max(t)) / 2).alias("contact_s"))


def pose_regions(poses: DataFrame, polygons: dict[str, list[tuple[float, float]]], x: str = "wrist_x", y: str = "wrist_y", margin: float | None = None, frame: tuple[float, float] | None = None) -> DataFrame:
    """Every observation with every region: region_id, inside (the boundary within 1e-9 too) and distance, 0 inside; with a margin also inside_expanded, for
    the polygon expanded by it and held to the frame.

    Polygons of 3 or more vertices are a camera's configuration; their edges become plain code-generated columns, so that nothing is joined or shuffled.
    """
    px, py = F.col(x), F.col(y)
    rows, found = poses, []

    def against(points: list[tuple[float, float]]) -> tuple[Column, Column]:
        edges = list(zip(points, [*points[1:], points[0]], strict=True))
        near = F.least(*[segment_distance(px, py, *map(F.lit, (*a, *b))) for a, b in edges])
        odd = F.lit(False)
        for (ax, ay), (bx, by) in edges:
            if ay != by:
                odd = odd != (((F.lit(ay) > py) != (F.lit(by) > py)) & (px < F.lit(bx - ax) * (py - ay) / F.lit(by - ay) + ax))
        return near, odd

    for i, (name, points) in enumerate(polygons.items()):
        near, odd = against(points)
        rows = rows.withColumns({f"__d{i}": near, f"__o{i}": odd})
        inside = F.col(f"__o{i}") | (F.col(f"__d{i}") <= 1e-9)
        fields = [F.lit(name).alias("region_id"), inside.alias("inside"), F.when(inside, 0.0).otherwise(F.col(f"__d{i}")).alias("distance")]
        if margin is not None:
            near, odd = against(expanded_points(points, margin, *(frame or (None, None))))
            rows = rows.withColumns({f"__e{i}": near, f"__f{i}": odd})
            fields.append((F.col(f"__f{i}") | (F.col(f"__e{i}") <= 1e-9)).alias("inside_expanded"))
        found.append(F.struct(*fields))
    return rows.select(*poses.columns, F.explode(F.array(*found)).alias("m")).select(*poses.columns, "m.*")
