"""Point and polygon functions over array<struct<x, y>> columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(polygon: Column) -> Column:
    """Array of (a, b): each vertex with the next, the last with the first."""
    return F.zip_with(polygon, F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / n))).otherwise(0.0)
    return F.sqrt((x - ax - t * dx) * (x - ax - t * dx) + (y - ay - t * dy) * (y - ay - t * dy))


def against(x: Column, y: Column, edge_list: Column) -> Column:
    """struct(d, odd) from one pass over edges(): the distance to the boundary (infinite without edges), and whether a ray to the right crosses an odd number of edges."""

    def step(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay).otherwise(1e-30) + ax)
        return F.struct(F.least(acc["d"], segment_distance(x, y, ax, ay, bx, by)).alias("d"), (acc["odd"] != crossed).alias("odd"))

    return F.aggregate(edge_list, F.struct(F.lit(float("inf")).alias("d"), F.lit(False).alias("odd")), step)


def inside_and_distance(x: Column, y: Column, edge_list: Column) -> Column:
    """struct(inside, distance) of a polygon of 3 or more edges: the boundary (within 1e-9) is inside, the distance is 0 there."""
    inside = lambda s: s["odd"] | (s["d"] <= 1e-9)
    return F.transform(F.array(against(x, y, edge_list)), lambda s: F.struct(inside(s).alias("inside"), F.when(inside(s), 0.0).otherwise(s["d"]).alias("distance")))[0]


def point_in_polygon(x: Column, y: Column, polygon: Column, inclusive: bool = True) -> Column:
    """False for fewer than 3 vertices; inclusive takes points within 1e-9 of the boundary as inside."""
    inside = F.transform(F.array(against(x, y, edges(polygon))), lambda s: (s["odd"] | (s["d"] <= 1e-9)) if inclusive else s["odd"])[0]
    return (F.size(polygon) >= 3) & inside


def point_polygon_distance(x: Column, y: Column, polygon: Column) -> Column:
    """0 inside, else the distance to the boundary; infinite for an empty polygon."""
    distance = F.transform(F.array(against(x, y, edges(polygon))), lambda s: F.when((F.size(polygon) >= 3) & (s["odd"] | (s["d"] <= 1e-9)), 0.0).otherwise(s["d"]))[0]
    return F.when(F.size(polygon) == 0, float("inf")).otherwise(distance)


def expand_polygon(polygon: Column, margin: float, width: float | None = None, height: float | None = None) -> Column:
    """Every vertex moved away from the vertex mean by margin; with a frame size, vertices are held to its last pixels. A vertex at the mean stays."""
    n = F.size(polygon)
    mean = F.struct((F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p["x"]) / n).alias("x"), (F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p["y"]) / n).alias("y"))
    hold = lambda c, top: c if top is None else F.greatest(F.lit(0.0), F.least(c, F.lit(float(top) - 1)))

    def moved(p: Column, c: Column) -> Column:
        dx, dy = p["x"] - c["x"], p["y"] - c["y"]
        d = F.sqrt(dx * dx + dy * dy)
        f = (d + margin) / d
        return F.when(d < 1e-9, F.struct(p["x"].alias("x"), p["y"].alias("y"))).otherwise(F.struct(hold(c["x"] + dx * f, width).alias("x"), hold(c["y"] + dy * f, height).alias("y")))

    # a lambda over the mean binds it once
    return F.transform(F.array(mean), lambda c: F.transform(polygon, lambda p: moved(p, c)))[0]


def expanded_points(points: list[tuple[float, float]], margin: float, width: float | None = None, height: float | None = None) -> list[tuple[float, float]]:
    """expand_polygon() of a configured polygon."""
    cx, cy = (sum(p[i] for p in points) / len(points) for i in (0, 1))
    hold = lambda c, top: c if top is None else max(0.0, min(c, float(top) - 1))
    out = []
    for x, y in points:
        d = ((x - cx) ** 2 + (y - cy) ** 2) ** 0.5
        f = (d + margin) / d if d >= 1e-9 else 1.0
        out.append((x, y) if d < 1e-9 else (hold(cx + (x - cx) * f, width), hold(cy + (y - cy) * f, height)))
    return out
