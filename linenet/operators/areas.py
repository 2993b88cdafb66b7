"""Lines and areas. An area is a flat list of rings under the even-odd rule, so holes and several parts need no more.

Areas are dealt to grid cells: each cell knows whether its centre is inside, and which edges of rings touch it. A piece of
a line within a cell is cut at those edges alone, and each part is inside if the way from the centre crosses them oddly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linenet.functions import geometry as G
from linenet.operators import lines as L
from linenet.operators import noding
from linenet.tables import settled

TOUCHED = 100.0  # metres from which on an area counts as touched


def box_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def ring_edges(areas: DataFrame) -> DataFrame:
    """area_id, x1 .. y2 of every edge, rings closed."""
    rings = areas.select("area_id", F.explode("rings").alias("ring"))
    following = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = rings.select("area_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), following.alias("b"))).alias("e"))
    return edges.select("area_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("x1 <> x2 OR y1 <> y2")


def area_cells(areas: DataFrame, size: float) -> DataFrame:
    """area_id, ix, iy, cx, cy (the cell's centre), inside (whether it is), edges: cells that hold any of an area."""
    edges = ring_edges(areas)
    bounds = edges.groupBy("area_id").agg(*[f([F.least, F.greatest][k](f"{a}1", f"{a}2")).alias(f"{a}{k}") for a in "xy" for k, f in enumerate((F.min, F.max))])
    span = lambda a: F.sequence(F.floor(F.col(f"{a}0") / size), F.floor(F.col(f"{a}1") / size))
    every = bounds.select("area_id", F.explode(span("x")).alias("ix"), span("y").alias("ys")).select("area_id", "ix", F.explode("ys").alias("iy"))
    every = every.withColumn("cx", (F.col("ix") + 0.5) * size).withColumn("cy", (F.col("iy") + 0.5) * size)
    every = every.join(areas.select("area_id", "rings"), "area_id").withColumn("inside", G.inside_rings(F.col("cx"), F.col("cy"), F.col("rings"))).drop("rings")
    near = edges.withColumn("c", F.explode(L.cells(*[F.col(k) for k in ("x1", "y1", "x2", "y2")], size)))
    near = near.groupBy("area_id", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy")).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return every.join(near, ["area_id", "ix", "iy"], "left").withColumn("edges", F.coalesce("edges", none)).where("inside OR size(edges) > 0")


def _side(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _oddly(edges: Column, ax, ay, bx, by) -> Column:
    """Whether the way from a to b crosses an odd number of edges; a vertex on the way belongs to one side."""
    crossed = lambda e: ((_side(ax, ay, bx, by, e["x1"], e["y1"]) > 0) != (_side(ax, ay, bx, by, e["x2"], e["y2"]) > 0)) & ((_side(e["x1"], e["y1"], e["x2"], e["y2"], ax, ay) > 0) != (_side(e["x1"], e["y1"], e["x2"], e["y2"], bx, by) > 0))
    return F.size(F.filter(edges, crossed)) % 2 == 1


def inside_spans(segs: DataFrame, areas: DataFrame, key: list[str], size: float = 250.0) -> DataFrame:
    """segs: key, x1 .. y2, len; areas: area_id, rings. The parts of each segment inside each area: key, area_id, and their
    ends ax, ay, bx, by with their length metres, and where along the line they are (start, stop), if segs have m0."""
    c = F.col
    segs = segs.where("len > 0").withColumn("seg_len", c("len")).withColumn("seg_m0", c("m0") if "m0" in segs.columns else F.lit(None).cast("double"))
    cut = L.pieces_by_cell(segs, [*key, "seg_len", "seg_m0"], size)
    met = cut.join(area_cells(areas, size), ["ix", "iy"])
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")

    def crossing(e):
        det = dx * (e["y2"] - e["y1"]) - dy * (e["x2"] - e["x1"])
        return ((e["x1"] - c("x1")) * (e["y2"] - e["y1"]) - (e["y1"] - c("y1")) * (e["x2"] - e["x1"])) / F.when(det != 0, det)

    cuts = F.filter(F.transform("edges", crossing), lambda t: t.isNotNull() & (t > c("t0")) & (t < c("t1")))
    met = met.withColumn("at", F.array_sort(F.array_distinct(F.concat(F.array("t0", "t1"), cuts))))
    spans = F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("lo"), F.slice("at", F.lit(2), F.size("at") - 1).alias("hi"))

    def within(s):
        t = (s["lo"] + s["hi"]) / 2
        return c("inside") != _oddly(c("edges"), c("cx"), c("cy"), c("x1") + t * dx, c("y1") + t * dy)

    found = met.select(*key, "area_id", "x1", "y1", "x2", "y2", "seg_len", "seg_m0", F.explode(F.filter(spans, within)).alias("s"))
    at = lambda t: ((c("x1") + t * dx), (c("y1") + t * dy))
    (ax, ay), (bx, by) = at(c("s.lo")), at(c("s.hi"))
    return found.select(*key, "area_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), ((c("s.hi") - c("s.lo")) * c("seg_len")).alias("metres"), (c("seg_m0") + c("s.lo") * c("seg_len")).alias("start"), (c("seg_m0") + c("s.hi") * c("seg_len")).alias("stop"))


def clip_lines(lines: DataFrame, mask: DataFrame, size: float = 250.0) -> DataFrame:
    """lines: line_id, coords and others; mask: areas. A row for each stretch inside the mask: line_id, part, start, stop,
    coords and the others. A line wholly inside keeps its own vertices, so that clipping nodes nothing."""
    spans = inside_spans(L.segments(lines, ["line_id"]), mask, ["line_id"], size)
    along = Window.partitionBy("line_id").orderBy("start", "stop")
    before = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("opens", (before.isNull() | (F.col("start") > before + 1e-6)).cast("int")).withColumn("part", F.sum("opens").over(along) - 1)
    runs = runs.groupBy("line_id", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).where("stop - start > 1e-6")
    both = lines.join(runs, "line_id").withColumn("along", G.walked(F.col("coords")))
    whole = (F.col("start") <= 1e-6) & (F.col("stop") >= F.element_at("along", -1) - 1e-6)
    cut = noding.substring(F.col("coords"), F.col("along"), F.col("start"), F.col("stop"))
    return both.withColumn("coords", F.when(whole, F.col("coords")).otherwise(cut)).drop("along")


def one_area_each(areas: DataFrame) -> DataFrame:
    """areas, checked: an identifier that stands twice is an error."""
    twice = areas.groupBy("area_id").count().where("count > 1").select("area_id").limit(5).collect()
    if twice:
        raise ValueError(f"areas with the same identifier: {[r.area_id for r in twice]}")
    return areas


def metres_inside(segs: DataFrame, areas: DataFrame, key: list[str], size: float = 250.0) -> DataFrame:
    """key, area_id, metres of each line inside each area, where over 0."""
    return inside_spans(segs, one_area_each(areas), key, size).groupBy(*key, "area_id").agg(F.sum("metres").alias("metres")).where("metres > 0")


def protected_within(edges: DataFrame, segs: DataFrame, areas: DataFrame, key: str = "edge_id") -> DataFrame:
    """edges: key, kind. Adds `protected`: (id, m) of each area that the edge runs in, the longest first; an empty list where
    it runs in none, null for ferries, which are not asked."""
    found = metres_inside(segs, areas, [key])
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("metres")).alias("d"), F.col("area_id").alias("id")))).alias("l"))
    own = F.transform("l", lambda s: F.struct(s["id"].alias("id"), (-s["d"]).alias("m")))
    none = F.transform(F.array().cast("array<bigint>"), lambda i: F.struct(i.alias("id"), F.lit(0.0).alias("m")))
    return edges.join(listed, key, "left").withColumn("protected", F.when(F.col("kind") != "ferry", F.coalesce(own, none))).drop("l")


def protected_metres(edges: DataFrame) -> DataFrame:
    """edges with `protected`. area_id, metres over all edges, the longest first."""
    each = edges.select(F.explode("protected").alias("p")).select(F.col("p.id").alias("area_id"), F.col("p.m").alias("m"))
    return each.groupBy("area_id").agg(F.sum("m").alias("metres")).orderBy(F.col("metres").desc(), "area_id")


def touched(metres: DataFrame, least: float = TOUCHED) -> DataFrame:
    return metres.where(F.col("metres") >= least)


def share_inside(segs: DataFrame, areas: DataFrame, key: list[str]) -> DataFrame:
    """key, share of each line's length inside the areas, which must not overlap; 0 for lines outside of all."""
    inside = metres_inside(segs, areas, key).groupBy(*key).agg(F.sum("metres").alias("metres"))
    whole = segs.groupBy(*key).agg(F.sum("len").alias("whole"))
    share = F.when(F.col("whole") > 0, F.coalesce("metres", F.lit(0.0)) / F.col("whole")).otherwise(0.0)
    return whole.join(inside, key, "left").select(*key, share.alias("share"))


def reach_across(segs: DataFrame, areas: DataFrame, key: list[str]) -> DataFrame:
    """key, reach: how far north to south what lies inside the areas extends; 0 where nothing does."""
    inside = inside_spans(segs, areas, key).groupBy(*key).agg((F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("reach"))
    return segs.select(*key).distinct().join(inside, key, "left").select(*key, F.coalesce("reach", F.lit(0.0)).alias("reach"))


def intersecting(areas: DataFrame, zone: DataFrame, size: float = 250.0) -> DataFrame:
    """The areas that share any ground with the zone (area_id, rings, as areas are), whole, by identifier."""
    cells = lambda a, p: area_cells(a, size).select(F.col("area_id").alias(f"{p}_id"), "ix", "iy", F.col("inside").alias(f"{p}_inside"), F.col("edges").alias(f"{p}_edges"))
    met = cells(areas, "a").join(cells(zone, "z"), ["ix", "iy"])
    crossed = F.exists("a_edges", lambda a: F.exists("z_edges", lambda z: (_side(a["x1"], a["y1"], a["x2"], a["y2"], z["x1"], z["y1"]) * _side(a["x1"], a["y1"], a["x2"], a["y2"], z["x2"], z["y2"]) <= 0) & (_side(z["x1"], z["y1"], z["x2"], z["y2"], a["x1"], a["y1"]) * _side(z["x1"], z["y1"], z["x2"], z["y2"], a["x2"], a["y2"]) <= 0)))
    sure = met.where((F.col("a_inside") & F.col("z_inside")) | crossed).select(F.col("a_id").alias("area_id"))
    first = lambda a, p: a.select(F.col("area_id").alias(f"{p}_id"), F.col("rings").alias(f"{p}_rings"), F.element_at(F.element_at("rings", 1), 1).alias(f"{p}_first"))
    near = met.select("a_id", "z_id").distinct().join(first(areas, "a"), "a_id").join(first(zone, "z"), "z_id")  # one wholly in the other
    whole = near.where(G.inside_rings(F.col("a_first.x"), F.col("a_first.y"), F.col("z_rings")) | G.inside_rings(F.col("z_first.x"), F.col("z_first.y"), F.col("a_rings")))
    return areas.join(sure.unionByName(whole.select(F.col("a_id").alias("area_id"))).distinct(), "area_id", "left_semi")


def points_inside(points: DataFrame, areas: DataFrame, size: float = 250.0) -> DataFrame:
    """points: id, x, y. id, area_id of each area that a point is in."""
    here = points.withColumn("ix", F.floor(F.col("x") / size)).withColumn("iy", F.floor(F.col("y") / size))
    met = here.join(area_cells(areas, size), ["ix", "iy"])
    return met.where(F.col("inside") != _oddly(F.col("edges"), F.col("cx"), F.col("cy"), F.col("x"), F.col("y"))).select("id", "area_id")


def crossings_of(samples: DataFrame, key: str, order: str) -> DataFrame:
    """samples: key, order, x, y, areas (array). Entries to and exits from areas between neighbouring samples: key, order (of
    the later sample), area_id, event, and x, y midway."""
    w = Window.partitionBy(key).orderBy(order)
    rows = samples.withColumn("was", F.lag("areas").over(w)).withColumn("mx", (F.col("x") + F.lag("x").over(w)) / 2).withColumn("my", (F.col("y") + F.lag("y").over(w)) / 2).where("was IS NOT NULL")
    events = F.concat(
        F.transform(F.array_except("areas", "was"), lambda a: F.struct(a.alias("area_id"), F.lit("enters").alias("event"))),
        F.transform(F.array_except("was", "areas"), lambda a: F.struct(a.alias("area_id"), F.lit("leaves").alias("event"))),
    )
    return rows.select(key, order, F.explode(events).alias("e"), "mx", "my").select(key, order, "e.area_id", "e.event", F.col("mx").alias("x"), F.col("my").alias("y"))


def no_path_recorded(segs: DataFrame, recorded: DataFrame, reach: float = 25.0, least: float = 0.5) -> DataFrame:
    """segs: id, walked and the rest of a segment. Whether less than `least` of a line's length is near the recorded mask;
    null where not walked."""
    segs = settled(segs.select("id", "x1", "y1", "x2", "y2", "len", "m0", "walked"), "segments")
    on = L.length_share_within(segs.where("walked"), recorded, reach)
    return segs.select("id").distinct().join(on, "id", "left").select("id", "share", (F.col("share") < least).alias("no_path_recorded"))


def masks(lines: DataFrame, rules: dict[str, dict[str, list[str] | None]], known: dict[str, list[str]], source: str = "source", code: str = "code") -> DataFrame:
    """lines with `mask`: each mask takes whole sources (None) or those of their lines with one of the codes named. A code
    that `known` doesn't list for a source is an error, as a mask would silently lose its lines."""
    for name, codes in known.items():
        odd = lines.where((F.col(source) == name) & F.col(code).isNotNull() & ~F.col(code).isin(codes)).select(code).distinct().limit(5).collect()
        if odd:
            raise ValueError(f"{name}: unknown codes {[r[0] for r in odd]}")
    out = None
    for mask, takes in rules.items():
        for name, codes in takes.items():
            rows = lines.where(F.col(source) == name)
            rows = (rows if codes is None else rows.where(F.col(code).isin(codes))).withColumn("mask", F.lit(mask))
            out = rows if out is None else out.unionByName(rows)
    return out


def in_one_crs(*tables: DataFrame, srid: str = "srid") -> None:
    """Fails unless all rows of all tables that state a reference system state the same one."""
    found = set()
    for table in tables:
        found |= {r[0] for r in table.select(srid).distinct().limit(3).collect()} - {None}
    if len(found) > 1:
        raise ValueError(f"tables in several reference systems: {sorted(found)}")


def tallies(edges: DataFrame) -> DataFrame:
    """edges: kind, source, waymarked, no_path_recorded, length_m, protected. Metres of a route by source, marking class,
    without a drawn way (bridges), without a recorded path, and by area; ferries count for their source alone."""
    walked = edges.where("kind <> 'ferry'")
    drawn = walked.where("kind <> 'bridge'")
    pick = lambda df, kind, name, metres="length_m": df.select(F.lit(kind).alias("tally"), F.col(name).cast("string").alias("name") if name else F.lit(None).cast("string").alias("name"), F.col(metres).alias("metres"))
    areas = walked.select(F.explode("protected").alias("p")).select(F.col("p.id").alias("id"), F.col("p.m").alias("m"))
    every = [pick(edges.where("kind <> 'bridge'"), "source", "source"), pick(drawn, "marking", "waymarked"), pick(walked.where("kind = 'bridge'"), "undrawn", None), pick(drawn.where("no_path_recorded"), "unrecorded", None), pick(areas, "area", "id", "m")]
    out = every[0]
    for part in every[1:]:
        out = out.unionByName(part)
    return out.groupBy("tally", "name").agg(F.sum("metres").alias("metres"))


def reported_areas(tally: DataFrame, least: float = TOUCHED) -> DataFrame:
    """Of a route's tallies the areas touched, the longest first."""
    return tally.where((F.col("tally") == "area") & (F.col("metres") >= least)).select(F.col("name").alias("area_id"), "metres").orderBy(F.col("metres").desc(), "area_id")
