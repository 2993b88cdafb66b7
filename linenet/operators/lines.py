"""Joins and measures of lines. Spatial joins go by grid cell: both sides are dealt to the cells they touch and meet by
equality, so no join compares everything with everything; the exact predicate follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linenet.functions import geometry as G
from linenet.tables import settled

HAIR = 1e-6  # metres by which rounding may put a point beside its segment
FINER = 4  # cells of joins of segments, to the cell asked for


def collect_lines(vertices: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """vertices: keys, seq, x, y. One line per key, repeated neighbours dropped, lines of one vertex left out."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("seq"), "x", "y")))
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    lines = vertices.groupBy(*keys).agg(ordered.alias("all"))
    kept = F.filter(F.col("all"), lambda p, i: (i == 0) | ~same(p, F.element_at(F.col("all"), F.greatest(i, F.lit(1)))))
    return lines.withColumn("coords", F.transform(kept, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).drop("all").where(F.size("coords") > 1)


def segments(lines: DataFrame, keep: list[str]) -> DataFrame:
    """keep, seg (from 0), x1, y1, x2, y2, len and m0, the distance along the line at its start."""
    pairs = F.arrays_zip(F.slice("coords", 1, F.size("coords") - 1).alias("a"), F.slice("coords", 2, F.size("coords") - 1).alias("b"), F.slice(G.walked(F.col("coords")), 1, F.size("coords") - 1).alias("m0"))
    only = F.array(F.struct(F.element_at("coords", 1).alias("a"), F.element_at("coords", 2).alias("b"), F.lit(0.0).alias("m0")))
    pairs = F.when(F.size("coords") == 2, only).otherwise(pairs)  # as most are: these need no walk
    rows = lines.select(*keep, F.posexplode(pairs).alias("seg", "p"))
    a, b = F.col("p.a"), F.col("p.b")
    return rows.select(*keep, "seg", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), G.distance(a["x"], a["y"], b["x"], b["y"]).alias("len"), F.col("p.m0").alias("m0"))


def cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float, reach: float = 0.0) -> Column:
    """Every grid cell that the box around the segment, widened by reach, touches."""
    lo = lambda a, b: F.floor((F.least(a, b) - reach) / size)
    hi = lambda a, b: F.floor((F.greatest(a, b) + reach) / size)
    return F.flatten(F.transform(F.sequence(lo(x1, x2), hi(x1, x2)), lambda i: F.transform(F.sequence(lo(y1, y2), hi(y1, y2)), lambda j: F.struct(i.alias("ix"), j.alias("iy")))))


def point_to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    square = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.when(square > 0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / square).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return G.distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def attach_nearest(points: DataFrame, others: DataFrame, most: float, fields: list[str]) -> DataFrame:
    """points: id, x, y; others: rid, x, y, fields. Left join with the nearest within `most`; of ties the first rid; else nulls."""
    right = others.select("rid", F.col("x").alias("rx"), F.col("y").alias("ry"), *fields, F.floor(F.col("x") / most).alias("ix"), F.floor(F.col("y") / most).alias("iy"))
    around = F.explode(cells(F.col("x"), F.col("y"), F.col("x"), F.col("y"), most, most)).alias("c")
    left = points.select("id", "x", "y", around).select("id", "x", "y", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy"))
    found = left.join(right, ["ix", "iy"]).withColumn("distance", G.distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))).where(F.col("distance") <= most)
    best = found.groupBy("id").agg(F.min(F.struct("distance", "rid", *fields)).alias("best"))
    return points.join(best, "id", "left").select("id", F.col("best.rid").alias("rid"), F.col("best.distance").alias("distance"), *[F.col(f"best.{f}").alias(f) for f in fields])


def names_of(points: DataFrame, named: DataFrame, name: str, most: float = 50.0) -> DataFrame:
    """points: id (from 0), x, y; named: rid, x, y and a name. id, name: that of the nearest within `most`, else "Point" and a number."""
    found = attach_nearest(points, named, most, [name])
    return found.select("id", F.coalesce(name, F.concat(F.lit("Point "), (F.col("id") + 1).cast("string"))).alias("name"))


def paths(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """Every grid cell that the segment itself runs through or comes within HAIR of, column by column."""
    dx = x2 - x1
    run = F.when(dx != 0, dx)
    least, most = F.least(x1, x2), F.greatest(x1, x2)

    def column(i):
        a, b = (i * size - HAIR - x1) / run, ((i + 1) * size + HAIR - x1) / run
        lo, hi = F.greatest(F.lit(0.0), F.coalesce(F.least(a, b), F.lit(0.0))), F.least(F.lit(1.0), F.coalesce(F.greatest(a, b), F.lit(1.0)))
        ya, yb = y1 + lo * (y2 - y1), y1 + hi * (y2 - y1)
        return F.transform(F.sequence(F.floor((F.least(ya, yb) - HAIR) / size), F.floor((F.greatest(ya, yb) + HAIR) / size)), lambda j: F.struct(i.alias("ix"), j.alias("iy")))

    return F.flatten(F.transform(F.sequence(F.floor((least - HAIR) / size), F.floor((most + HAIR) / size)), column))


def dealt(segs: DataFrame, keep: list[str], size: float) -> tuple[DataFrame, DataFrame]:
    """Sides a and b of a join of segments by the cells of their paths: a_ and b_ with keep, ix, iy. Pairs are many more than
    rows, so the number of parts is fixed and not left to the size of the rows."""
    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = segs.select(*keep, F.explode(paths(*[F.col(k) for k in ("x1", "y1", "x2", "y2")], size)).alias("c")).select(*keep, "c.ix", "c.iy").repartition(parts, "ix", "iy")
    return tuple(spread.select(*[F.col(k).alias(f"{side}_{k}") for k in keep], "ix", "iy") for side in "ab")


def crossing_points(segs: DataFrame, cell: float) -> DataFrame:
    """segs: line_id, seg, x1 .. y2. Proper crossings of segments of different lines: a, b, x, y (each cell pair once).
    Segments are dealt to cells a fraction of `cell` wide, as few pairs of a large cell cross."""
    size = cell / FINER
    left, right = dealt(segs, ["line_id", "seg", "x1", "y1", "x2", "y2"], size)
    ux, uy = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")
    vx, vy = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    wx, wy = F.col("b_x1") - F.col("a_x1"), F.col("b_y1") - F.col("a_y1")
    det = ux * vy - uy * vx
    safe = F.when(det == 0, F.lit(None)).otherwise(det)
    t, u = (wx * vy - wy * vx) / safe, (wx * uy - wy * ux) / safe
    met = left.join(right, ["ix", "iy"]).where(F.col("a_line_id") < F.col("b_line_id")).withColumn("t", t).withColumn("u", u).where("t > 0 AND t < 1 AND u > 0 AND u < 1")
    met = met.withColumn("x", F.col("a_x1") + F.col("t") * ux).withColumn("y", F.col("a_y1") + F.col("t") * uy)
    found = met.where((F.col("ix") == F.floor(F.col("x") / size)) & (F.col("iy") == F.floor(F.col("y") / size)))
    return found.select(F.col("a_line_id").alias("a"), F.col("b_line_id").alias("b"), F.col("a_seg"), F.col("b_seg"), "x", "y", "t", "u")


def meeting_segments(segs: DataFrame, cell: float) -> DataFrame:
    """segs: line_id, seg, x1 .. y2, and others. Where segments meet, a <= b: a, b, a_seg, b_seg, x, y, t, u (shares of the two
    segments), and the others as a_ and b_. A row for each pair of segments and point; segments of one line meet too.

    Crossings, touches (ends and vertices on the other line), both ends of each stretch that two segments share; a line's
    own vertices and the closing of a ring are no meeting. Sides are told by one formula for each vertex and segment, so
    that a vertex on a segment is one to both its neighbours."""
    c = F.col
    own = Window.partitionBy("line_id")
    more = [k for k in segs.columns if k not in ("line_id", "seg", "x1", "y1", "x2", "y2")]
    ended = segs.withColumn("ends", (c("seg") == F.min("seg").over(own)).cast("int") - (c("seg") == F.max("seg").over(own)).cast("int"))
    size = cell / FINER
    left, right = dealt(ended, ["line_id", "seg", "ends", "x1", "y1", "x2", "y2", *more], size)
    same = c("a_line_id") == c("b_line_id")
    met = left.join(right, ["ix", "iy"]).where((c("a_line_id") < c("b_line_id")) | same & (c("a_seg") < c("b_seg")))

    def side(of, px, py):
        return (c(f"{of}_x2") - c(f"{of}_x1")) * (py - c(f"{of}_y1")) - (c(f"{of}_y2") - c(f"{of}_y1")) * (px - c(f"{of}_x1"))

    met = met.withColumns({f"{s}{k}": side("b" if s == "a" else "a", c(f"{s}_x{k}"), c(f"{s}_y{k}")) for s in "ab" for k in (1, 2)})
    met = met.where((F.signum("a1") * F.signum("a2") <= 0) & (F.signum("b1") * F.signum("b2") <= 0))
    line = (c("a1") == 0) & (c("a2") == 0) & (c("b1") == 0) & (c("b2") == 0)

    def share(s, x, y):  # of a point on a segment, by its longer axis
        dx, dy = c(f"{s}_x2") - c(f"{s}_x1"), c(f"{s}_y2") - c(f"{s}_y1")
        return F.when((F.abs(dx) >= F.abs(dy)) & (dx != 0), (x - c(f"{s}_x1")) / F.when(dx != 0, dx)).when(dy != 0, (y - c(f"{s}_y1")) / F.when(dy != 0, dy)).otherwise(0.0) + 0.0

    def place(x, y, t, u):
        return F.struct(x.alias("x"), y.alias("y"), t.alias("t"), u.alias("u"))

    def within(s, k, o):
        x, y, at = c(f"{s}_x{k}"), c(f"{s}_y{k}"), F.lit(float(k - 1))
        found = place(x, y, *((at, share("b", x, y)) if s == "a" else (share("a", x, y), at)))
        return F.when(x.between(F.least(f"{o}_x1", f"{o}_x2"), F.greatest(f"{o}_x1", f"{o}_x2")) & y.between(F.least(f"{o}_y1", f"{o}_y2"), F.greatest(f"{o}_y1", f"{o}_y2")), found)

    t, u = c("a1") / F.when(c("a1") != c("a2"), c("a1") - c("a2")), c("b1") / F.when(c("b1") != c("b2"), c("b1") - c("b2"))
    x, y = (F.coalesce(*[F.when(c(f"{s}{k}") == 0, c(f"{s}_{axis}{k}")) for s in "ab" for k in (1, 2)], c(f"a_{axis}1") + t * (c(f"a_{axis}2") - c(f"a_{axis}1"))) for axis in "xy")
    shared = F.array_distinct(F.array_compact(F.array(*[within(s, k, o) for s, o in ("ab", "ba") for k in (1, 2)])))
    found = F.when(line, shared).otherwise(F.array(place(x, y, t, u)))
    following = same & (c("b_seg") == c("a_seg") + 1) & (c("a_x2") == c("b_x1")) & (c("a_y2") == c("b_y1"))
    closing = same & (c("a_ends") == 1) & (c("b_ends") == -1) & (c("a_x1") == c("b_x2")) & (c("a_y1") == c("b_y2"))
    joined = following | closing
    met = met.withColumn("points", found).withColumn("joined", joined)
    first = F.get("points", F.lit(0))
    # Neighbours meet in their vertex at least; more than that is a line that turns back on itself.
    met = met.where((c("ix") == F.floor(first["x"] / size)) & (c("iy") == F.floor(first["y"] / size)) & (~c("joined") | (F.size("points") > 1)))
    others = [f"{s}_{k}" for s in "ab" for k in more]
    return met.select(c("a_line_id").alias("a"), c("b_line_id").alias("b"), "a_seg", "b_seg", *others, F.explode("points").alias("p")).select("a", "b", "a_seg", "b_seg", *others, "p.*")


def intersection_points(segs: DataFrame, cell: float) -> DataFrame:
    """segs: line_id, seg, x1 .. y2. Where lines meet, a <= b, each point of a pair once: a, b, x, y, a_seg, b_seg (the first).
    Two pairs of segments tell one point to the last digits only, so it counts once to six decimals, and is given to these."""
    six = lambda k: G.rounded(F.col(k), 6).alias(k)
    met = meeting_segments(segs.select("line_id", "seg", "x1", "y1", "x2", "y2"), cell).select("a", "b", "a_seg", "b_seg", six("x"), six("y"))
    return met.groupBy("a", "b", "x", "y").agg(F.min(F.struct("a_seg", "b_seg")).alias("first")).select("a", "b", "x", "y", "first.a_seg", "first.b_seg")


def inside_boxes(segs: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """Metres of each line inside each box (area_id, x0, y0, x1, y1), where over 0, by clipping segments. Boxes are few: areas."""
    b = boxes.select("area_id", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def bounds(start, delta, lo, hi):
        enter = F.when(delta > 0, (lo - start) / delta).when(delta < 0, (hi - start) / delta).when((start >= lo) & (start <= hi), 0.0).otherwise(2.0)
        leave = F.when(delta > 0, (hi - start) / delta).when(delta < 0, (lo - start) / delta).when((start >= lo) & (start <= hi), 1.0).otherwise(-1.0)
        return enter, leave

    ex, lx = bounds(F.col("x1"), dx, F.col("bx0"), F.col("bx1"))
    ey, ly = bounds(F.col("y1"), dy, F.col("by0"), F.col("by1"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lx, ly) - F.greatest(F.lit(0.0), ex, ey))
    overlap = (F.least("x1", "x2") <= F.col("bx1")) & (F.greatest("x1", "x2") >= F.col("bx0")) & (F.least("y1", "y2") <= F.col("by1")) & (F.greatest("y1", "y2") >= F.col("by0"))
    size = 250.0
    spread = segs.select("*", F.explode(cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size)).alias("c")).select(*segs.columns, F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy"))
    there = b.select("*", F.explode(cells(F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), size)).alias("c")).select("area_id", "bx0", "by0", "bx1", "by1", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy"))
    met = spread.join(there, ["ix", "iy"]).where(overlap)
    first = (F.col("ix") == F.floor(F.greatest(F.least("x1", "x2"), F.col("bx0")) / size)) & (F.col("iy") == F.floor(F.greatest(F.least("y1", "y2"), F.col("by0")) / size))
    return met.where(first).groupBy(*key, "area_id").agg(F.sum(share * F.col("len")).alias("metres")).where("metres > 0")


def share_within(samples: DataFrame, marks: DataFrame, reach: float) -> DataFrame:
    """samples: id, k, x, y (points along lines); marks: segments x1 .. y2. Share of each line's samples within reach of any mark.

    A cell whose four corners are within reach of one mark is so as a whole (distance from a segment is convex), and its
    samples need no mark; only those of other cells are compared with the marks near them."""
    size, c = reach / 2, F.col
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # marks are few rows, their cells many
    ends = [c(k) for k in ("x1", "y1", "x2", "y2")]
    spread = marks.select("x1", "y1", "x2", "y2").distinct().repartition(parts, "x1", "y1").withColumn("c", F.explode(cells(*ends, size, reach))).select("x1", "y1", "x2", "y2", "c.ix", "c.iy")
    corners = [point_to_segment((c("ix") + i) * size, (c("iy") + j) * size, *ends) for i in (0, 1) for j in (0, 1)]
    spread = settled(spread.withColumn("whole", F.greatest(*corners) <= reach - HAIR), "marks")
    inside = settled(spread.where("whole").select("ix", "iy").distinct(), "inside")
    border = spread.where("NOT whole").join(inside, ["ix", "iy"], "left_anti").drop("whole")
    here = samples.select("id", "k", "x", "y", F.floor(c("x") / size).alias("ix"), F.floor(c("y") / size).alias("iy"))
    told = here.join(inside.withColumn("hit", F.lit(1)), ["ix", "iy"], "left")
    asked = settled(told.where("hit IS NULL").drop("hit"), "asked")
    near = asked.join(border, ["ix", "iy"]).where(point_to_segment(c("x"), c("y"), *ends) <= reach).select("id", "k").distinct().withColumn("hit", F.lit(1))
    rows = told.where("hit = 1").select("id", "hit").unionByName(asked.join(near, ["id", "k"], "left").select("id", "hit"))
    return rows.groupBy("id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("share"))


def pieces_by_cell(segs: DataFrame, keep: list[str], size: float) -> DataFrame:
    """Segments cut at the lines of the grid: keep, x1 .. y2 of the whole segment, t0, t1 (shares of it) and the cell ix, iy."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def cuts(start, end, delta):
        lo, hi = F.floor(F.least(start, end) / size) + 1, F.ceil(F.greatest(start, end) / size) - 1
        return F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda i: (i * size - start) / delta)).otherwise(F.array().cast("array<double>"))

    at = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts(F.col("x1"), F.col("x2"), dx), cuts(F.col("y1"), F.col("y2"), dy)))
    spans = F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("t0"), F.slice("at", F.lit(2), F.size("at") - 1).alias("t1"))
    cut = segs.withColumn("at", at).select(*keep, "x1", "y1", "x2", "y2", F.explode(spans).alias("p")).select(*keep, "x1", "y1", "x2", "y2", "p.t0", "p.t1").where("t0 < t1")
    middle = (F.col("t0") + F.col("t1")) / 2
    return cut.withColumn("ix", F.floor((F.col("x1") + middle * dx) / size)).withColumn("iy", F.floor((F.col("y1") + middle * dy) / size))


def dealt_marks(spread: DataFrame, size: float, reach: float) -> tuple[DataFrame, DataFrame]:
    """spread: segments x1 .. y2 by cell ix, iy. The cells as told by their marks: ix, iy, whole (all of it within reach of one
    mark, as its corners are and distance from a segment is convex); and the marks within reach of each cell that isn't."""
    c, ends = F.col, [F.col(k) for k in ("x1", "y1", "x2", "y2")]
    corners = [point_to_segment((c("ix") + i) * size, (c("iy") + j) * size, *ends) for i in (0, 1) for j in (0, 1)]
    middle = point_to_segment((c("ix") + 0.5) * size, (c("iy") + 0.5) * size, *ends)
    spread = settled(spread.where(middle <= reach + size * 0.75).withColumn("whole", F.greatest(*corners) <= reach - HAIR), "marks")
    told = settled(spread.groupBy("ix", "iy").agg(F.max("whole").alias("whole")), "cells")
    return told, settled(spread.where("NOT whole").drop("whole").join(told.where("whole"), ["ix", "iy"], "left_anti"), "border")


def length_share_within(segs: DataFrame, marks: DataFrame, reach: float) -> DataFrame:
    """segs: id, x1 .. y2, len, m0 (read several times); marks: segments x1 .. y2. Share of each line's length within reach of
    any mark: id, share.

    Ground that marks cover as a whole is told by cells, wide ones, then small, then fine, and pieces of lines there need no
    mark; only what lies in other fine cells is compared with the marks near them. What lies within reach of one mark is one
    interval of a segment (a capsule is convex); the intervals of a piece are merged, so that ground near several marks counts
    once. Round ends are true arcs. A line of no length has share 0."""
    c = F.col
    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # marks and border pieces are few rows, their cells and pairs many
    wide, small, fine = reach * 4, reach / 2, reach / 8
    ends = ["x1", "y1", "x2", "y2"]
    spread = marks.select(*ends).distinct().repartition(parts, "x1", "y1").withColumn("c", F.explode(cells(*map(c, ends), small, reach)))
    told, border = dealt_marks(spread.select(*ends, "c.ix", "c.iy"), small, reach)
    several, inner = int(wide / small), int(small / fine)
    broad = settled(told.groupBy(F.floor(c("ix") / several).alias("ix"), F.floor(c("iy") / several).alias("iy")).agg((F.sum(c("whole").cast("int")) == several * several).alias("whole")), "cells")
    children = F.explode(F.array(*[F.struct((c("ix") * inner + i).alias("ix"), (c("iy") * inner + j).alias("iy")) for i in range(inner) for j in range(inner)]))
    told_fine, there = dealt_marks(border.repartition(parts, "ix", "iy").withColumn("c", children).select(*ends, "c.ix", "c.iy"), fine, reach)

    place = ["id", "m0", "ox", "oy", "ux", "uy"]  # a segment's begin and direction; d0, d1: where along it
    rest = segs.where("len > 0").select("id", "m0", c("x1").alias("ox"), c("y1").alias("oy"), ((c("x2") - c("x1")) / c("len")).alias("ux"), ((c("y2") - c("y1")) / c("len")).alias("uy"), F.lit(0.0).alias("d0"), c("len").alias("d1"))
    gains = []
    for size, cells_told in ((wide, broad), (small, told), (fine, told_fine)):
        at = rest.withColumns({f"{k}{n}": c(f"o{k}") + c(f"d{n - 1}") * c(f"u{k}") for k in "xy" for n in (1, 2)})
        span = c("d1") - c("d0")
        cut = pieces_by_cell(at, [*place, "d0", "d1"], size).select(*place, (c("d0") + c("t0") * span).alias("d0"), (c("d0") + c("t1") * span).alias("d1"), "ix", "iy")
        met = cut.join(cells_told, ["ix", "iy"])
        gains.append(met.where("whole").select("id", (c("d1") - c("d0")).alias("gained")))
        rest = settled(met.where("NOT whole").select(*place, "d0", "d1", "ix", "iy").repartition(parts), "pieces")
    met = rest.select(c("ox").alias("x1"), c("oy").alias("y1"), "id", "m0", "ux", "uy", "d0", "d1", "ix", "iy").repartition(parts, "ix", "iy")
    span = G.distance(c("x1"), c("y1"), c("x2"), c("y2"))
    unit = lambda d, n: F.when(n > 0, d / n).otherwise(0.0)
    there = there.withColumn("span", span).withColumn("vx", unit(c("x2") - c("x1"), c("span"))).withColumn("vy", unit(c("y2") - c("y1"), c("span")))
    there = there.select(c("x1").alias("ax"), c("y1").alias("ay"), c("x2").alias("bx"), c("y2").alias("by"), "vx", "vy", "span", "ix", "iy")
    met = met.join(there, ["ix", "iy"])
    # In metres along the segment: fa, fb are the feet of the mark's ends, ga, gb their distances; p and q run along and across the mark.
    met = met.withColumns({"ax": c("ax") - c("x1"), "ay": c("ay") - c("y1"), "bx": c("bx") - c("x1"), "by": c("by") - c("y1")})
    met = met.withColumns({
        "fa": c("ax") * c("ux") + c("ay") * c("uy"), "ga": c("ax") * c("uy") - c("ay") * c("ux"), "fb": c("bx") * c("ux") + c("by") * c("uy"), "gb": c("bx") * c("uy") - c("by") * c("ux"),
        "p": -(c("ax") * c("vx") + c("ay") * c("vy")), "dp": c("ux") * c("vx") + c("uy") * c("vy"), "q": c("ay") * c("vx") - c("ax") * c("vy"), "dq": c("ux") * c("vy") - c("uy") * c("vx"),
    })
    part = lambda d, by: F.when(by != 0, d / by)
    half = lambda g: F.when(F.abs(g) <= reach, F.sqrt(reach * reach - g * g))
    met = met.withColumns({
        "ha": half(c("ga")), "hb": half(c("gb")), "p0": part(-c("p"), c("dp")), "p1": part(c("span") - c("p"), c("dp")), "q0": part(-reach - c("q"), c("dq")), "q1": part(reach - c("q"), c("dq")),
        "over": (c("span") > 0) & ((c("dp") != 0) | c("p").between(0, c("span"))) & ((c("dq") != 0) | (F.abs(c("q")) <= reach)),
    })
    met = met.withColumns({"enter": F.greatest(F.least("p0", "p1"), F.least("q0", "q1")), "leave": F.least(F.greatest("p0", "p1"), F.greatest("q0", "q1"))})  # nulls are skipped
    strip = c("over") & (c("enter") <= c("leave"))
    met = met.withColumns({"lo": F.least(c("fa") - c("ha"), c("fb") - c("hb"), F.when(strip, c("enter"))), "hi": F.greatest(c("fa") + c("ha"), c("fb") + c("hb"), F.when(strip, c("leave")))})
    span_of = F.struct(F.when(c("lo").isNotNull(), F.greatest("d0", "lo")).alias("lo"), F.when(c("hi").isNotNull(), F.least("d1", "hi")).alias("hi"))
    found = met.select("id", "m0", "d0", F.explode(F.array(span_of)).alias("s")).where("s.lo < s.hi")  # exploded, so that the filter isn't pushed into the join with all of the above
    found = found.select("id", "m0", "d0", "s.lo", "s.hi")
    before = F.max("hi").over(Window.partitionBy("id", "m0", "d0").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    gained = F.greatest(F.lit(0.0), F.col("hi") - F.greatest("lo", before))
    covered = found.select("id", gained.alias("gained"))
    for more in gains:
        covered = covered.unionByName(more)
    covered = covered.groupBy("id").agg(F.sum("gained").alias("covered"))
    whole = segs.groupBy("id").agg(F.sum("len").alias("whole"))
    share = F.when(F.col("whole") > 0, F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0)) / F.col("whole"))).otherwise(0.0)
    return whole.join(covered, "id", "left").select("id", share.alias("share"))


def waymarked(segs: DataFrame, marked: DataFrame, unmarked: DataFrame, reach: float, least: float = 0.5) -> DataFrame:
    """segs: as for length_share_within, and walked. Marked where `least` of the length is within reach of the marked mask,
    failing that unmarked by the other mask, failing both unknown; null where not walked (ferries, bridges of gaps)."""
    segs = settled(segs.select("id", "x1", "y1", "x2", "y2", "len", "m0", "walked"), "segments")
    asked = segs.where("walked")
    on, off = length_share_within(asked, marked, reach).withColumnRenamed("share", "marked_share"), length_share_within(asked, unmarked, reach).withColumnRenamed("share", "unmarked_share")
    found = segs.select("id").distinct().join(on, "id", "left").join(off, "id", "left")
    return found.withColumn("waymarked", F.when(F.col("marked_share") >= least, "marked").when(F.col("unmarked_share") >= least, "unmarked").when(F.col("marked_share").isNotNull(), "unknown"))


def nearest_on_lines(points: DataFrame, segs: DataFrame, most: float) -> DataFrame:
    """points: id, x, y; segs: line_id, seg ... The nearest segment within `most`: id, line_id, seg, distance."""
    spread = segs.select("*", F.explode(cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), most * 2, most)).alias("c")).select(*segs.columns, F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy"))
    here = points.select("id", "x", "y", F.floor(F.col("x") / (most * 2)).alias("ix"), F.floor(F.col("y") / (most * 2)).alias("iy"))
    d = point_to_segment(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    found = here.join(spread, ["ix", "iy"]).withColumn("distance", d).where(F.col("distance") <= most)
    best = found.groupBy("id").agg(F.min(F.struct("distance", "line_id", "seg")).alias("b"))
    return best.select("id", F.col("b.line_id").alias("line_id"), F.col("b.seg").alias("seg"), F.col("b.distance").alias("distance"))


def chain_id(source: Column, x: Column, y: Column, metres: Column) -> Column:
    """tag-x-y-length, numbers rounded half to even."""
    tag = F.regexp_replace(F.regexp_replace(F.lower(source), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    whole = lambda c: F.rint(c).cast("long").cast("string")
    return F.concat_ws("-", tag, whole(x), whole(y), whole(metres))


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn = 1").drop("rn")
