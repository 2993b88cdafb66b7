"""Operators on one line or one group at a time whose logic is sequential: simplifying and thinning.
They run as Arrow functions over rows, or over groups that are small by nature (labels of one name)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COORDS = "array<struct<x:double,y:double>>"


def simplify_points(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Keeps the ends, and splits where a vertex is further than tolerance from the chord; without recursion."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        (ax, ay), (bx, by) = points[lo], points[hi]
        span = math.hypot(bx - ax, by - ay)
        worst, far = -1, tolerance
        for i in range(lo + 1, hi):
            px, py = points[i]
            if span:
                t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / span**2))
                d = math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))
            else:
                d = math.hypot(px - ax, py - ay)
            if d > far:
                worst, far = i, d
        if worst > 0:
            keep.add(worst)
            todo += [(lo, worst), (worst, hi)]
    return [points[i] for i in sorted(keep)]


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    @F.udf(COORDS, useArrow=True)
    def run(coords):
        return [{"x": x, "y": y} for x, y in simplify_points([(p["x"], p["y"]) for p in coords], tolerance)]

    return lines.withColumn("coords", run("coords"))


def thin_points(points: DataFrame, spacing: float, group: str, priority: str) -> DataFrame:
    """points: id, x, y, group, priority. Greedy by priority (the smallest first, then id): a point stays unless it is
    strictly nearer than spacing to one that stays. Groups are the labels of one name."""
    if spacing <= 0:
        return points

    def run(pdf):
        pdf = pdf.sort_values([priority, "id"], kind="stable")
        kept, cells = [], {}
        for i, (x, y) in enumerate(zip(pdf.x, pdf.y, strict=True)):
            cx, cy = math.floor(x / spacing), math.floor(y / spacing)
            near = (q for dx in (-1, 0, 1) for dy in (-1, 0, 1) for q in cells.get((cx + dx, cy + dy), ()))
            if all(math.hypot(x - a, y - b) >= spacing for a, b in near):
                kept.append(i)
                cells.setdefault((cx, cy), []).append((x, y))
        return pdf.iloc[kept]

    return points.groupBy(group).applyInPandas(run, points.schema)
