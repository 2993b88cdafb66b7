"""Queries on noding, network, chains, areas and tracks, with SQL that goes over all pairs by brute force."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linenet.functions import geometry as G
from linenet.operators import areas as A
from linenet.operators import build as B
from linenet.operators import chains as C
from linenet.operators import lines as L
from linenet.operators import noding
from linenet.operators import series as S
from linenet.plans.catalogue import NEAR, SERIES, _series, query
from linenet.plans.tables import ED, SU, V


def bars(t):
    """A straight line from each customer's place: line_id, coords."""
    x, y = ((F.col("c_custkey") * 37) % 1009).cast("double"), ((F.col("c_custkey") * 101) % 997).cast("double")
    h = (F.col("c_custkey") % 61 - 30).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return t.customer.select(F.col("c_custkey").alias("line_id"), F.array(point(x, y), point(x + 40, y + h)).alias("coords"))


def bar_chains(t):
    return bars(t).select("line_id", F.concat(F.lit("c"), "line_id").alias("chain_id"), F.lit("bars").alias("source"), F.when(F.col("line_id") % 11 == 0, "ferry").otherwise("path").alias("kind"), F.lit(1.2).alias("factor"), "coords")


# Every bar against every other: where along itself (in metres) each is met.
BARS = """c0 AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1009)::DOUBLE AS x, ((c_custkey * 101) % 997)::DOUBLE AS y, (c_custkey % 61 - 30)::DOUBLE AS h FROM customer),
  b AS (SELECT id, x AS x1, y AS y1, x + 40 AS x2, y + h AS y2, sqrt(1600 + h * h) AS len FROM c0),
  pr AS (SELECT a.id, a.len, a.x1, a.y1, a.x2, a.y2, o.x1 AS x3, o.y1 AS y3, o.x2 AS x4, o.y2 AS y4, (a.x2 - a.x1) * (o.y2 - o.y1) - (a.y2 - a.y1) * (o.x2 - o.x1) AS det, (a.x2 - a.x1) * (o.y1 - a.y1) - (a.y2 - a.y1) * (o.x1 - a.x1) AS off
    FROM b a JOIN b o ON a.id <> o.id AND a.x1 <= o.x2 AND o.x1 <= a.x2),
  tu AS (SELECT id, len, ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / det AS t, ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / det AS u FROM pr WHERE det <> 0),
  ov AS (SELECT id, len, (x3 - x1) / (x2 - x1) AS t3, (x4 - x1) / (x2 - x1) AS t4 FROM pr WHERE det = 0 AND off = 0),
  mt AS (SELECT id, len, t * len AS m FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1
    UNION ALL SELECT id, len, unnest([greatest(0, least(t3, t4)), least(1, greatest(t3, t4))]) * len FROM ov WHERE greatest(0, least(t3, t4)) <= least(1, greatest(t3, t4))),
  ps AS (SELECT id, m, m - coalesce(lag(m) OVER (PARTITION BY id ORDER BY m), 0) AS gap FROM (SELECT id, m FROM mt WHERE m > 0.01 AND m < len - 0.01)),
  cu AS (SELECT id, 0::DOUBLE AS m FROM b UNION ALL SELECT id, m FROM ps WHERE gap > 0.01 UNION ALL SELECT id, len FROM b),
  pc AS (SELECT cu.id, row_number() OVER w - 1 AS piece, m AS m0, lead(m) OVER w AS m1, x1, y1, x2, y2, len FROM cu JOIN b ON b.id = cu.id WINDOW w AS (PARTITION BY cu.id ORDER BY m)),
  pe AS (SELECT id, piece, m0, m1, len, x1 + m0 / len * (x2 - x1) AS ax, y1 + m0 / len * (y2 - y1) AS ay, x1 + m1 / len * (x2 - x1) AS bx, y1 + m1 / len * (y2 - y1) AS b2 FROM pc WHERE m1 IS NOT NULL)"""


@query("c03_node_lines", f"WITH {BARS} SELECT id AS line_id, piece, round(m0, 4) AS m0, round(m1, 4) AS m1, round(bx, 4) AS x, round(b2, 4) AS y FROM pe")
def _(t):
    p = noding.node_lines(bars(t), 50.0)
    end = F.element_at("coords", -1)
    return p.select("line_id", F.col("piece").cast("long").alias("piece"), G.rounded(F.col("m0"), 4).alias("m0"), G.rounded(F.col("m1"), 4).alias("m1"), G.rounded(end["x"], 4).alias("x"), G.rounded(end["y"], 4).alias("y"))


# Ends of pieces on one node have the same place; each counts once a piece.
EDGES = f"""{BARS}, en AS (SELECT id, piece, 0 AS e, ax AS x, ay AS y, piece = 0 AS stops FROM pe UNION ALL SELECT id, piece, 1, bx, b2, m1 = len FROM pe),
  nd AS (SELECT round(x, 3) AS x, round(y, 3) AS y, count(*) AS degree, bool_and(stops) AS stopped FROM en GROUP BY 1, 2)"""


@query("c10_edges", f"WITH {EDGES} SELECT id AS line_id, round(m0, 3) AS m0, round(m1 - m0, 3) AS length_m, round(CASE WHEN id % 11 = 0 THEN 5000 * (m1 - m0) / len ELSE 1.2::DOUBLE * (m1 - m0) END, 3) AS cost, a.degree AS from_degree, z.degree AS to_degree FROM pe JOIN nd a ON a.x = round(ax, 3) AND a.y = round(ay, 3) JOIN nd z ON z.x = round(bx, 3) AND z.y = round(b2, 3)")
def _(t):
    edges, _ = B.cut_into_edges(bar_chains(t), 50.0)
    degrees = edges.select(F.col("from_node").alias("node")).unionByName(edges.select(F.col("to_node").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    of = lambda end: degrees.select(F.col("node").alias(f"{end}_node"), F.col("degree").alias(f"{end}_degree"))
    rows = edges.join(of("from"), "from_node").join(of("to"), "to_node")
    return rows.select(F.substring("chain_id", 2, 20).cast("long").alias("line_id"), *[G.rounded(F.col(c), 3).alias(c) for c in ("m0", "length_m", "cost")], "from_degree", "to_degree")


@query("a09_nodes", f"WITH {EDGES} SELECT x, y, stopped FROM nd")
def _(t):
    return B.cut_into_edges(bar_chains(t), 50.0)[1].select(G.rounded(F.col("x"), 3).alias("x"), G.rounded(F.col("y"), 3).alias("y"), "stopped")


# Each node where all lines stop against each piece that doesn't touch it.
REACHED = f"""{EDGES}, lo AS (SELECT x, y FROM nd WHERE stopped),
  ds AS (SELECT lo.x, lo.y, greatest(0, least(1, ((lo.x - ax) * (bx - ax) + (lo.y - ay) * (b2 - ay)) / ((m1 - m0) * (m1 - m0)))) AS t, ax, ay, bx, b2 FROM lo JOIN pe ON lo.x BETWEEN least(ax, bx) - 25 AND greatest(ax, bx) + 25 AND lo.y BETWEEN least(ay, b2) - 25 AND greatest(ay, b2) + 25
    WHERE (round(ax, 3) <> lo.x OR round(ay, 3) <> lo.y) AND (round(bx, 3) <> lo.x OR round(b2, 3) <> lo.y)),
  nr AS (SELECT x, y, min(sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (b2 - ay), 2))) AS off FROM ds GROUP BY 1, 2)"""


@query("j08_nearest_edges", f"WITH {REACHED} SELECT x, y, round(off, 3) AS off FROM nr WHERE off <= 25")
def _(t):
    edges, nodes = B.cut_into_edges(bar_chains(t), 50.0)
    found = B.nearest_edges(nodes.where("stopped"), edges, 25.0)
    return found.join(nodes, "node").select(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("off", 3).alias("off"))


@query("c09_network")
def _(t):
    edges, nodes = B.build_network(bar_chains(t), 50.0)
    return edges.groupBy("component", "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("length_m"), 3).alias("metres"))


@query("c18_adjacency", f"WITH {EDGES} SELECT count(*) * 2 AS arcs, round(sum(m1 - m0) * 2, 2) AS metres FROM pe")
def _(t):
    edges, _ = B.cut_into_edges(bar_chains(t), 50.0)
    arcs = B.adjacency(edges).join(edges.select("edge_id", "length_m"), "edge_id")
    return arcs.agg(F.count(F.lit(1)).alias("arcs"), F.round(F.sum("length_m"), 2).alias("metres"))


@query("w10_chain_order", f"WITH {BARS} SELECT id AS line_id, round(m0, 3) AS m0, piece AS chain_seq, piece = 0 AS run_start FROM pe")
def _(t):
    edges, _ = B.cut_into_edges(bar_chains(t), 50.0)
    order = C.chain_order(edges).join(edges.select("edge_id", "m0"), "edge_id")
    return order.select(F.substring("chain_id", 2, 20).cast("long").alias("line_id"), G.rounded(F.col("m0"), 3).alias("m0"), F.col("chain_seq").cast("long").alias("chain_seq"), "run_start")


ARMS = f"{ED}, ar AS (SELECT a AS node, edge_id * 2 AS arm, edge_id, source, status FROM ed UNION ALL SELECT b, edge_id * 2 + 1, edge_id, source, status FROM ed)"


def _arms(t, identities):
    e = t.edges()
    both = F.array(F.struct(F.col("a").alias("node"), (F.col("edge_id") * 2).alias("arm")), F.struct(F.col("b").alias("node"), (F.col("edge_id") * 2 + 1).alias("arm")))
    return e.select(F.explode(both).alias("s"), identities.alias("identities"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy")).select("s.node", "s.arm", "identities", "dx", "dy")


@query("c04_pair_at_junctions", f"WITH {ARMS}, k AS (SELECT node, count(*) AS k, min(arm) AS lo, max(arm) AS hi FROM ar GROUP BY 1) SELECT ar.node, arm, CASE WHEN k = 2 THEN CASE arm WHEN lo THEN hi ELSE lo END END AS partner FROM ar JOIN k ON k.node = ar.node")
def _(t):
    return C.pair_arms(_arms(t, F.array().cast("array<string>")), strokes=False)


IDENTITY = f"""{ARMS}, i AS (SELECT node, arm, unnest(CASE WHEN edge_id % 3 = 0 THEN [source, (edge_id % 40)::VARCHAR] ELSE [(edge_id % 40)::VARCHAR] END) AS part, count(*) OVER (PARTITION BY node) AS k FROM (SELECT *, row_number() OVER () AS q FROM ar)),
  kk AS (SELECT node, count(*) AS k, min(arm) AS lo, max(arm) AS hi FROM ar GROUP BY 1),
  sm AS (SELECT DISTINCT x.node, x.arm, y.arm AS other FROM i x JOIN i y ON x.node = y.node AND x.part = y.part AND x.arm <> y.arm JOIN kk ON kk.node = x.node AND kk.k > 2),
  n AS (SELECT node, arm, count(*) AS n, min(other) AS other FROM sm GROUP BY 1, 2),
  mu AS (SELECT n.node, n.arm, n.other FROM n JOIN n o ON o.node = n.node AND o.arm = n.other WHERE n.n = 1 AND o.n = 1)"""


@query("c05_pair_by_identity", f"WITH {IDENTITY} SELECT ar.node, ar.arm, CASE WHEN k = 2 THEN CASE ar.arm WHEN lo THEN hi ELSE lo END ELSE mu.other END AS partner FROM ar JOIN kk ON kk.node = ar.node LEFT JOIN mu ON mu.node = ar.node AND mu.arm = ar.arm")
def _(t):
    own = (F.col("edge_id") % 40).cast("string")
    return C.pair_arms(_arms(t, F.when(F.col("edge_id") % 3 == 0, F.array("source", own)).otherwise(F.array(own))))


@query("c08_chains")
def _(t):
    pieces = noding.node_lines(bars(t), 50.0).select((F.col("line_id") * 1000 + F.col("piece")).alias("piece"), F.lit("Bars & more").alias("source"), F.lit("path").alias("kind"), "coords", F.concat(F.lit("w"), F.col("line_id").cast("string")).alias("identity"))
    return C.build_chains(pieces).select("chain_id", "identity", F.round("length_m", 3).alias("length_m"), "n_pieces")


RING = "list_transform(range(0, len(r)), lambda i: list_concat(r[i + 1:], r[:i]))"


@query("g14_canonical", f"WITH {V}, p AS (SELECT line_id, list({{'x': x, 'y': y}} ORDER BY rn) AS c FROM l GROUP BY 1), q AS (SELECT line_id, c, CASE WHEN len(c) > 3 AND sqrt(power(c[1].x - c[-1].x, 2) + power(c[1].y - c[-1].y, 2)) <= 0.01 THEN c[:-2] END AS r FROM p), o AS (SELECT line_id, CASE WHEN r IS NULL THEN CASE WHEN c[1] <= c[-1] THEN c ELSE list_reverse(c) END ELSE list_min(list_concat({RING}, {RING.replace('r[', 'list_reverse(r)[')})) END AS c, r IS NOT NULL AS ring FROM q), z AS (SELECT line_id, CASE WHEN ring THEN list_append(c, c[1]) ELSE c END AS c FROM o) SELECT line_id, left(sha256(list_aggregate(list_transform(c, lambda v: printf('%.2f,%.2f', v.x, v.y)), 'string_agg', ';')), 8) AS digest FROM z")
def _(t):
    return t.lines().select("line_id", C.shape_digest(C.canonical(F.col("coords"))).alias("digest"))


IDS = f"{V}, p AS (SELECT line_id % 40 AS grp, line_id, list({{'x': x, 'y': y}} ORDER BY rn) AS c, sum(coalesce(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), 0)) AS m FROM l GROUP BY line_id UNION ALL SELECT 0, line_id + 10000000, [{{'x': 1.2, 'y': 2.5}}, {{'x': line_id % 3 + 4.0::DOUBLE, 'y': 2.5}}], line_id % 3 + 2.8::DOUBLE FROM l WHERE rn = 1 AND line_id % 100 = 0)"


@query("w02_chain_ids_whole", f"WITH {IDS}, n AS (SELECT line_id, c, 'way--' || grp || '-' || round_even(c[1].x, 0)::BIGINT || '-' || round_even(c[1].y, 0)::BIGINT || '-' || round_even(m, 0)::BIGINT AS name FROM p), d AS (SELECT line_id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '-' || left(sha256(list_aggregate(list_transform(c, lambda v: printf('%.2f,%.2f', v.x, v.y)), 'string_agg', ';')), 8) ELSE name END AS name FROM n), r AS (SELECT line_id, name, row_number() OVER (PARTITION BY name ORDER BY line_id) AS k FROM d) SELECT line_id, CASE WHEN k > 1 THEN name || '-' || k ELSE name END AS chain_id FROM r")
def _(t):
    own = t.lines().select("line_id", (F.col("line_id") % 40).alias("grp"), "coords")
    point = lambda x: F.struct(x.cast("double").alias("x"), F.lit(2.5).alias("y"))
    more = own.where("line_id % 100 = 0").select((F.col("line_id") + 10000000).alias("line_id"), F.lit(0).cast("long").alias("grp"), F.array(point(F.lit(1.2)), point(F.col("line_id") % 3 + 4)).alias("coords"))
    rows = own.unionByName(more).withColumn("source", F.concat(F.lit("Way ("), F.col("grp").cast("string"), F.lit(")")))
    return C.chain_ids(rows).select("line_id", "chain_id")


@query("g09_cut_lines", f"WITH {V}, q AS (SELECT line_id, seg, x1, y1, x2, y2, len, sum(len) OVER (PARTITION BY line_id ORDER BY seg) - len AS m0 FROM s), cu AS (SELECT line_id, m0 + len / 2 AS m, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM q UNION ALL SELECT line_id, 0, x1, y1 FROM q WHERE seg = 0 UNION ALL SELECT line_id, max(m0 + len), NULL, NULL FROM q GROUP BY 1), p AS (SELECT line_id, row_number() OVER w - 1 AS piece, lead(m) OVER w - m AS metres, x, y FROM cu WINDOW w AS (PARTITION BY line_id ORDER BY m)) SELECT line_id, piece, round(metres, 3) AS metres, round(x, 3) AS x, round(y, 3) AS y FROM p WHERE metres IS NOT NULL")
def _(t):
    cuts = t.segments().select("line_id", (F.col("m0") + F.col("len") / 2).alias("m"))
    first = F.element_at("coords", 1)
    return noding.cut_lines(t.lines(), cuts).select("line_id", F.col("piece").cast("long").alias("piece"), F.round(G.length(F.col("coords")), 3).alias("metres"), F.round(first["x"], 3).alias("x"), F.round(first["y"], 3).alias("y"))


FEET = f"{V}, q AS (SELECT line_id, seg, x1, y1, x2, y2, len, sum(len) OVER (PARTITION BY line_id ORDER BY seg) - len AS m0 FROM s), pt AS (SELECT line_id, rn AS seq, x + 3 AS x, y + 4 AS y FROM l), d AS (SELECT pt.line_id, seq, m0, len, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (len * len))) AS t FROM pt JOIN q ON q.line_id = pt.line_id), f AS (SELECT line_id, seq, arg_min(m0 + t * len, {{'d': round(sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2)), 9), 'm': m0 + t * len}}) AS m FROM d GROUP BY 1, 2)"


@query("g10_project_in_order", f"WITH {FEET}, g AS (SELECT line_id, seq, max(m) OVER (PARTITION BY line_id ORDER BY seq) AS m, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS a, row_number() OVER (PARTITION BY line_id ORDER BY seq DESC) AS b FROM f) SELECT g.line_id, seq, round(CASE WHEN b = 1 THEN whole WHEN a = 1 THEN 0 ELSE m END, 3) AS m FROM g JOIN (SELECT line_id, sum(len) AS whole FROM s GROUP BY 1) w ON w.line_id = g.line_id")
def _(t):
    points = t.lines().select("line_id", F.posexplode("coords").alias("k", "p")).select("line_id", (F.col("k") + 1).cast("long").alias("seq"), (F.col("p.x") + 3).alias("x"), (F.col("p.y") + 4).alias("y"))
    return noding.project_in_order(points, t.segments()).select("line_id", "seq", F.round("m", 3).alias("m"))


# Areas: an L (a square less a corner), a frame (a box with a hole), and a plain box; no vertex of a line lies on a border.
BOXES = "bx AS (SELECT * FROM (VALUES (1, 1, 0.25, 0.25, 600.25, 600.25), (1, -1, 300.25, 300.25, 600.25, 600.25), (2, 1, 500.35, 100.35, 900.35, 500.35), (2, -1, 600.35, 200.35, 700.35, 300.35), (3, 1, 100.45, 100.45, 800.45, 400.45)) AS v(area_id, sign, ax, ay, bx, b2))"
CLIP = f"""{V}, {BOXES}, q AS (SELECT line_id, area_id, sign, len, x1, y1, x2, y2,
  greatest(0, CASE WHEN x2 > x1 THEN (ax - x1) / (x2 - x1) WHEN x2 < x1 THEN (bx - x1) / (x2 - x1) WHEN x1 BETWEEN ax AND bx THEN 0 ELSE 2 END, CASE WHEN y2 > y1 THEN (ay - y1) / (y2 - y1) WHEN y2 < y1 THEN (b2 - y1) / (y2 - y1) WHEN y1 BETWEEN ay AND b2 THEN 0 ELSE 2 END) AS lo,
  least(1, CASE WHEN x2 > x1 THEN (bx - x1) / (x2 - x1) WHEN x2 < x1 THEN (ax - x1) / (x2 - x1) WHEN x1 BETWEEN ax AND bx THEN 1 ELSE -1 END, CASE WHEN y2 > y1 THEN (b2 - y1) / (y2 - y1) WHEN y2 < y1 THEN (ay - y1) / (y2 - y1) WHEN y1 BETWEEN ay AND b2 THEN 1 ELSE -1 END) AS hi FROM s, bx),
  mi AS (SELECT line_id, area_id, sum(sign * greatest(0, hi - lo) * len) AS metres FROM q GROUP BY 1, 2)"""


def shapes_of(t):
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [
        (1, [ring((0.25, 0.25), (600.25, 0.25), (600.25, 300.25), (300.25, 300.25), (300.25, 600.25), (0.25, 600.25))]),
        (2, [ring((500.35, 100.35), (900.35, 100.35), (900.35, 500.35), (500.35, 500.35)), ring((600.35, 200.35), (700.35, 200.35), (700.35, 300.35), (600.35, 300.35))]),
        (3, [ring((100.45, 100.45), (800.45, 100.45), (800.45, 400.45), (100.45, 400.45))]),
    ]
    return t.spark.createDataFrame(rows, "area_id long, rings array<array<struct<x:double,y:double>>>")


@query("j07_metres_in_polygons", f"WITH {CLIP} SELECT line_id, area_id, round(metres, 3) AS metres FROM mi WHERE metres > 0.0005")
def _(t):
    return A.metres_inside(t.segments(), shapes_of(t), ["line_id"]).where("metres > 0.0005").select("line_id", "area_id", F.round("metres", 3).alias("metres"))


def _protected(t):
    edges = t.lines().select("line_id", F.when(F.col("line_id") % 9 == 0, "ferry").when(F.col("line_id") % 9 == 1, "bridge").otherwise("path").alias("kind"))
    return A.protected_within(edges, t.segments(), shapes_of(t), "line_id")


@query("d03_protected_within", f"WITH {CLIP} SELECT l2.line_id, CASE WHEN l2.line_id % 9 = 0 THEN -1 ELSE count(area_id) END AS areas, round(CASE WHEN l2.line_id % 9 <> 0 THEN coalesce(sum(metres), 0) END, 2) AS metres FROM (SELECT DISTINCT line_id FROM s) l2 LEFT JOIN mi ON mi.line_id = l2.line_id AND metres > 0.0005 GROUP BY l2.line_id")
def _(t):
    sizes = F.filter("protected", lambda p: p["m"] > 0.0005)
    return _protected(t).select("line_id", F.coalesce(F.size(sizes), F.lit(-1)).cast("long").alias("areas"), F.round(F.aggregate(sizes, F.lit(0.0), lambda a, p: a + p["m"]), 2).alias("metres"))


@query("a07_areas_touched", f"WITH {CLIP}, a AS (SELECT area_id, sum(metres) AS metres FROM mi WHERE line_id % 9 <> 0 AND metres > 0 GROUP BY 1) SELECT area_id, round(metres, 1) AS metres FROM a WHERE metres >= 100")
def _(t):
    return A.touched(A.protected_metres(_protected(t))).select("area_id", F.round("metres", 1).alias("metres"))


@query("j11_share_inside", f"WITH {CLIP} SELECT w.line_id, round(coalesce(metres, 0) / whole, 6) AS share FROM (SELECT line_id, sum(len) AS whole FROM s GROUP BY 1) w JOIN mi ON mi.line_id = w.line_id AND area_id = 2")
def _(t):
    return A.share_inside(t.segments(), shapes_of(t).where("area_id = 2"), ["line_id"]).select("line_id", F.round("share", 6).alias("share"))


@query("g05_clip_lines", f"WITH {CLIP}, m AS (SELECT line_id, seg, sum(len) OVER (PARTITION BY line_id ORDER BY seg) - len AS m0 FROM s), q0 AS (SELECT *, row_number() OVER (PARTITION BY line_id, area_id, x1, y1, x2, y2, lo, hi) AS again FROM q WHERE area_id = 3), sg AS (SELECT s.line_id, m0, s.len, s.x1, s.y1, s.x2, s.y2 FROM s JOIN m ON m.line_id = s.line_id AND m.seg = s.seg), iv AS (SELECT DISTINCT sg.line_id, m0 + lo * sg.len AS a, m0 + hi * sg.len AS b FROM sg JOIN q0 ON q0.line_id = sg.line_id AND q0.x1 = sg.x1 AND q0.y1 = sg.y1 AND q0.x2 = sg.x2 AND q0.y2 = sg.y2 WHERE lo < hi), f AS (SELECT *, CASE WHEN a > lag(b) OVER (PARTITION BY line_id ORDER BY a) + 1e-6 THEN 1 ELSE 0 END AS opens FROM iv), r AS (SELECT line_id, sum(opens) OVER (PARTITION BY line_id ORDER BY a) AS part, a, b FROM f) SELECT line_id, part::BIGINT AS part, round(max(b) - min(a), 3) AS metres FROM r GROUP BY 1, 2 HAVING max(b) - min(a) > 1e-6")
def _(t):
    found = A.clip_lines(t.lines(), shapes_of(t).where("area_id = 3"))
    return found.select("line_id", "part", F.round(G.length(F.col("coords")), 3).alias("metres"))


@query("j12_reach_across", f"WITH {CLIP} SELECT line_id, round(coalesce(max(greatest(y1 + lo * (y2 - y1), y1 + hi * (y2 - y1))) FILTER (lo < hi) - min(least(y1 + lo * (y2 - y1), y1 + hi * (y2 - y1))) FILTER (lo < hi), 0) + 1e-7, 4) AS reach FROM q WHERE area_id = 3 GROUP BY 1")
def _(t):
    return A.reach_across(t.segments(), shapes_of(t).where("area_id = 3"), ["line_id"]).select("line_id", F.round(F.col("reach") + 1e-7, 4).alias("reach"))


@query("j10_areas_in_zone", "WITH c AS (SELECT c_custkey AS area_id, ((c_custkey * 37) % 1009)::DOUBLE + 0.1 AS x, ((c_custkey * 101) % 997)::DOUBLE + 0.1 AS y FROM customer) SELECT area_id FROM c WHERE x <= 600.25 AND x + 7 >= 0.25 AND y <= 300.25 AND y + 5 >= 0.25 OR x <= 300.25 AND x + 7 >= 0.25 AND y <= 600.25 AND y + 5 >= 0.25")
def _(t):
    x, y = ((F.col("c_custkey") * 37) % 1009).cast("double") + 0.1, ((F.col("c_custkey") * 101) % 997).cast("double") + 0.1
    return A.intersecting(t.customer.select(F.col("c_custkey").alias("area_id"), A.box_rings(x, y, x + 7, y + 5).alias("rings")), shapes_of(t).where("area_id = 1")).select("area_id")


WITHIN = f"{V}, {BOXES}, ia AS (SELECT line_id, rn, area_id FROM l, bx WHERE x BETWEEN ax AND bx AND y BETWEEN ay AND b2 GROUP BY 1, 2, 3 HAVING sum(sign) = 1)"


@query("g20_points_in_polygons", f"WITH {WITHIN} SELECT line_id * 1000 + rn AS id, area_id FROM ia")
def _(t):
    return A.points_inside(_vertices(t), shapes_of(t))


def _vertices(t):
    p = t.lines().select("line_id", F.posexplode("coords").alias("k", "p"))
    return p.select((F.col("line_id") * 1000 + F.col("k") + 1).alias("id"), "line_id", (F.col("k") + 1).cast("long").alias("rn"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("j16_area_events", f"WITH {WITHIN}, e AS (SELECT l.line_id, l.rn, b.area_id, x, y, ia.area_id IS NOT NULL AS now FROM l CROSS JOIN (SELECT DISTINCT area_id FROM bx) b LEFT JOIN ia ON ia.line_id = l.line_id AND ia.rn = l.rn AND ia.area_id = b.area_id), f AS (SELECT *, lag(now) OVER w AS was, lag(x) OVER w AS px, lag(y) OVER w AS py FROM e WINDOW w AS (PARTITION BY line_id, area_id ORDER BY rn)) SELECT line_id, row_number() OVER (PARTITION BY line_id, area_id ORDER BY rn) AS k, area_id, CASE WHEN now THEN 'enters' ELSE 'leaves' END AS event, round((x + px) / 2, 4) AS x, round((y + py) / 2, 4) AS y FROM f WHERE was IS NOT NULL AND was <> now")
def _(t):
    points = _vertices(t)
    held = A.points_inside(points.select("id", "x", "y"), shapes_of(t)).groupBy("id").agg(F.collect_set("area_id").alias("areas"))
    rows = points.join(held, "id", "left").withColumn("areas", F.coalesce("areas", F.array().cast("array<bigint>")))
    found = A.crossings_of(rows, "line_id", "rn")
    return found.select("line_id", F.row_number().over(Window.partitionBy("line_id", "area_id").orderBy("rn")).cast("long").alias("k"), "area_id", "event", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("d02_no_path_recorded", f"{NEAR} SELECT line_id, round(marked_share, 6) AS share, marked_share < 0.5 AS no_path_recorded FROM sh")
def _(t):
    s = t.suppliers()
    recorded = s.select(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 300).alias("x2"), F.col("y").alias("y2"))
    segs = t.segments().withColumnRenamed("line_id", "id").withColumn("walked", F.col("id") % 7 != 0)
    return A.no_path_recorded(segs, recorded, 25.0).select(F.col("id").alias("line_id"), F.round("share", 6).alias("share"), "no_path_recorded")


@query("d04_masks", "SELECT mask, count(*) AS n, sum(l_quantity) AS metres FROM (SELECT 'marked' AS mask, l_quantity FROM lineitem WHERE l_returnflag = 'A' OR l_returnflag = 'N' AND l_linestatus = 'O' UNION ALL SELECT 'recorded', l_quantity FROM lineitem WHERE l_returnflag IN ('N', 'R')) GROUP BY 1")
def _(t):
    rules = {"marked": {"A": None, "N": ["O"]}, "recorded": {"N": None, "R": None}}
    found = A.masks(t.lineitem, rules, {"N": ["O", "F"]}, "l_returnflag", "l_linestatus")
    return found.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("metres"))


KINDS = f"{ED}, k AS (SELECT edge_id, source, length_m, CASE status WHEN 'F' THEN 'ferry' WHEN 'P' THEN 'bridge' ELSE 'path' END AS kind, CASE WHEN a % 2 = 0 THEN 'marked' ELSE 'unknown' END AS waymarked, b % 3 = 0 AS alone FROM ed)"


def _kinds(t):
    kind = F.when(F.col("status") == "F", "ferry").when(F.col("status") == "P", "bridge").otherwise("path")
    return t.edges().withColumn("kind", kind).withColumn("waymarked", F.when(F.col("a") % 2 == 0, "marked").otherwise("unknown")).withColumn("no_path_recorded", F.col("b") % 3 == 0).withColumn("protected", F.when(F.col("b") % 5 == 0, F.array(F.struct((F.col("a") % 4).alias("id"), (F.col("length_m") / 2).alias("m")))).otherwise(F.array().cast("array<struct<id:bigint,m:double>>")))


TALLY = f"{KINDS}, y AS (SELECT 'source' AS tally, source AS name, length_m AS m FROM k WHERE kind <> 'bridge' UNION ALL SELECT 'marking', waymarked, length_m FROM k WHERE kind = 'path' UNION ALL SELECT 'undrawn', NULL, length_m FROM k WHERE kind = 'bridge' UNION ALL SELECT 'unrecorded', NULL, length_m FROM k WHERE kind = 'path' AND alone UNION ALL SELECT 'area', (a % 4)::VARCHAR, k.length_m / 2 FROM k JOIN ed ON ed.edge_id = k.edge_id WHERE kind <> 'ferry' AND b % 5 = 0)"


@query("a20_tallies", f"WITH {TALLY} SELECT tally, name, round(sum(m), 1) AS metres FROM y GROUP BY 1, 2")
def _(t):
    return A.tallies(_kinds(t)).select("tally", "name", F.round("metres", 1).alias("metres"))


@query("a21_reported_areas", f"WITH {TALLY} SELECT name AS area_id, round(sum(m), 1) AS metres FROM y WHERE tally = 'area' GROUP BY 1 HAVING sum(m) >= 3000000")
def _(t):
    return A.reported_areas(A.tallies(_kinds(t)), 3_000_000.0).select("area_id", F.round("metres", 1).alias("metres"))


@query("c20_routed_parts", f"WITH {KINDS}, r AS (SELECT edge_id % 50 AS route_id, edge_id AS seq, kind = 'ferry' AS ferry, length_m FROM k), g AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) - row_number() OVER (PARTITION BY route_id, ferry ORDER BY seq) AS run FROM r), p AS (SELECT route_id, ferry, run, min(seq) AS first, sum(length_m) AS metres, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY first) AS part, ferry, round(metres, 2) AS metres, n FROM p")
def _(t):
    route = _kinds(t).select((F.col("edge_id") % 50).alias("route_id"), F.col("edge_id").alias("seq"), "kind", "length_m")
    return B.routed_parts(route).select("route_id", "part", "ferry", F.round("metres", 2).alias("metres"), "n")


# --- tracks and heights ----------------------------------------------------------------------------------------------

SAMPLES = f"{V}, q AS (SELECT line_id, seg, x1, y1, x2, y2, len, sum(len) OVER (PARTITION BY line_id ORDER BY seg) - len AS m0 FROM s), wh AS (SELECT line_id, sum(len) AS whole FROM s GROUP BY 1), n AS (SELECT line_id, whole, greatest(2, floor(whole / 200)::INT + 1) AS n FROM wh), sm AS (SELECT line_id, n, whole, unnest(range(n)) AS k FROM n), tt AS (SELECT sm.line_id, k, n, whole * k / (n - 1) AS m FROM sm), po AS (SELECT tt.line_id, k, arg_max(x1 + (m - m0) / len * (x2 - x1), seg) AS x, arg_max(y1 + (m - m0) / len * (y2 - y1), seg) AS y FROM tt JOIN q ON q.line_id = tt.line_id AND (m >= m0 OR seg = 0) GROUP BY 1, 2)"


@query("m01_sample_along", f"WITH {SAMPLES} SELECT line_id, k, round(x, 3) AS x, round(y, 3) AS y FROM po")
def _(t):
    p = t.lines().withColumn("along", G.walked(F.col("coords"))).select("line_id", F.posexplode(S.sample_along(F.col("coords"), F.col("along"), 200.0)).alias("k", "p"))
    return p.select("line_id", F.col("k").cast("long").alias("k"), F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def _heights(t):
    """Heights by arithmetic at the samples of lines: some without reading."""
    p = t.lines().withColumn("along", G.walked(F.col("coords"))).select(F.explode(S.sample_along(F.col("coords"), F.col("along"), 200.0)).alias("p"))
    e, n = F.rint(F.col("p.x") * 100).cast("long"), F.rint(F.col("p.y") * 100).cast("long")
    h = p.select(e.alias("e"), n.alias("n")).distinct()
    return h.withColumn("z", F.when((F.col("e") + F.col("n")) % 13 != 0, ((F.col("e") * 7 + F.col("n") * 3) % 400).cast("double") / 4))


@query("m05_with_elevation", f"WITH {SAMPLES}, ce AS (SELECT line_id, k, round_even(x * 100, 0)::BIGINT AS e, round_even(y * 100, 0)::BIGINT AS n FROM po), z AS (SELECT line_id, k, CASE WHEN (e + n) % 13 <> 0 THEN ((e * 7 + n * 3) % 400)::DOUBLE / 4 END AS z FROM ce) SELECT line_id, CASE WHEN line_id % 9 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN line_id % 9 <> 0 THEN count(z) ELSE 0 END AS n_read, round(CASE WHEN line_id % 9 <> 0 THEN sum(z) END, 2) AS total, line_id % 9 <> 0 AND count(z) > 0 AS has_ascent FROM z GROUP BY line_id")
def _(t):
    edges = t.lines().select(F.col("line_id").alias("edge_id"), F.when(F.col("line_id") % 9 == 0, "ferry").otherwise("path").alias("kind"), "coords")
    found = S.with_elevation(edges, _heights(t), 200.0)
    read = F.filter("elevations", lambda z: z.isNotNull())
    return found.select(F.col("edge_id").alias("line_id"), F.size("elevations").cast("long").alias("n"), F.size(read).cast("long").alias("n_read"), F.round(F.when(F.size(read) > 0, F.aggregate(read, F.lit(0.0), lambda a, z: a + z)), 2).alias("total"), F.col("ascent").isNotNull().alias("has_ascent"))


@query("m06_chain_profiles", f"WITH {SERIES}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id AS chain_id, max(z) AS high, min(z) AS low, max(n) + (CASE WHEN max(n) > 12 THEN 1 ELSE 0 END) AS n FROM o GROUP BY 1")
def _(t):
    rows = _series(t).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("at")) - 1)
    # Edges of up to six samples; neighbours share one, but for the third edge, which begins a run of its own.
    edge = F.when(F.col("r") < 12, F.floor(F.col("r") / 6)).otherwise(2)
    shared = rows.withColumn("edge", edge).withColumn("ks", F.when((F.col("r") == 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array("edge")))
    parts = shared.select("user_id", "r", "z", F.explode("ks").alias("seq")).groupBy("user_id", "seq").agg(F.array_sort(F.collect_list(F.struct("r", "z"))).alias("s"))
    edges = parts.select((F.col("user_id") * 10 + F.col("seq")).alias("edge_id"), F.transform("s", lambda v: v["z"]).alias("elevations"))
    order = parts.select((F.col("user_id") * 10 + F.col("seq")).alias("edge_id"), F.col("user_id").alias("chain_id"), F.col("seq").alias("chain_seq"), F.lit(False).alias("flipped"), (F.col("seq") != 1).alias("run_start"))
    found = S.chain_profiles(edges, order).join(S.chain_series(edges, order), "chain_id")
    return found.select("chain_id", "high", "low", F.size("series").cast("long").alias("n"))


@query("m08_dense_measures", f"WITH {V}, q AS (SELECT line_id, seg, len, sum(len) OVER (PARTITION BY line_id ORDER BY seg) - len AS m0 FROM s), wh AS (SELECT line_id, sum(len) AS whole FROM s GROUP BY 1), kn AS (SELECT line_id, m0 AS m FROM q UNION SELECT line_id, whole * unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) FROM wh), sp AS (SELECT line_id, m, lead(m) OVER (PARTITION BY line_id ORDER BY m) - m AS step FROM kn) SELECT line_id, sum(CASE WHEN step IS NULL THEN 1 WHEN step <= 1e-6 THEN 0 ELSE greatest(1, ceil(step / 50 - 1e-9)) END)::BIGINT AS n FROM sp GROUP BY 1")
def _(t):
    m = S.dense_measures(F.col("along"), F.array(*[F.lit(float(k)) for k in range(5)]), 50.0)
    return t.lines().withColumn("along", G.walked(F.col("coords"))).select("line_id", F.size(m).cast("long").alias("n"))


@query("w09_nearest_sample", f"WITH {SERIES}, k AS (SELECT user_id, min(tm) + unnest(range(0, 5)) * 40000 + 17 AS want FROM e GROUP BY 1), d AS (SELECT k.user_id, want, arg_min(tm, {{'d': abs(tm - want), 'tm': tm}}) AS nearest FROM k JOIN e ON e.user_id = k.user_id GROUP BY 1, 2) SELECT user_id, round(want, 3) AS want, round(nearest, 3) AS nearest FROM d")
def _(t):
    rows = _series(t)
    asked = rows.groupBy("user_id").agg(F.min("at").alias("first")).select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("first") + i * 40000 + 17)).alias("want"))
    return S.nearest_sample(rows, asked, "user_id", "at").select("user_id", F.round("want", 3).alias("want"), F.round("nearest", 3).alias("nearest"))


@query("o09_sorted_union", f"WITH {V}, ls AS (SELECT line_id, list(len ORDER BY seg) AS a, list(len / 2 ORDER BY seg) AS b FROM s GROUP BY 1) SELECT line_id, len(list_distinct(list_concat(a, b)))::BIGINT AS n, round(list_min(b), 6) AS least FROM ls")
def _(t):
    lists = t.segments().groupBy("line_id").agg(F.collect_list("len").alias("a"), F.collect_list(F.col("len") / 2).alias("b"))
    union = F.array_sort(F.array_union("a", "b"))
    return lists.select("line_id", F.size(union).cast("long").alias("n"), F.round(F.element_at(union, 1), 6).alias("least"))


@query("j15_names_of_points", f"WITH {SU}, cu AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1009)::DOUBLE AS x, ((c_custkey * 101) % 997)::DOUBLE AS y FROM customer), d AS (SELECT id, arg_min(s_name, {{'d': sqrt(power(cu.x - su.x, 2) + power(cu.y - su.y, 2)), 'r': rid}}) AS name FROM cu JOIN su ON sqrt(power(cu.x - su.x, 2) + power(cu.y - su.y, 2)) <= 50 GROUP BY 1) SELECT cu.id, coalesce(name, 'Point ' || (cu.id + 1)) AS name FROM cu LEFT JOIN d ON d.id = cu.id")
def _(t):
    return L.names_of(t.customers(), t.suppliers(), "s_name", 50.0).select("id", "name")


