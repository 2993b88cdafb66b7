"""The registered queries over the shared tables, by inventory number, with the DuckDB SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linenet.functions import geometry as G
from linenet.functions import text as X
from linenet.operators import lines as L
from linenet.operators import network as N
from linenet.operators import quality as Q
from linenet.operators import series as S
from linenet.operators import shapes
from linenet.sources import files, sinks
from linenet.streaming import events
from linenet.plans.tables import BX, CU, ED, SU, V, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "g01_line_lengths"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


# --- scalar cleaning -------------------------------------------------------------------------------------------------

SEGMENTS = {"BUILDING": "house", "AUTOMOBILE": "car", "MACHINERY": "machine"}


@query("p01_standardize", "SELECT p_partkey, CASE WHEN regexp_matches(t, '^-?\\d+\\.0+$') THEN regexp_extract(t, '^(-?\\d+)', 1) ELSE t END AS code, try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS number, try_cast(p_name AS DOUBLE) AS no_number FROM (SELECT *, CAST(p_size::DOUBLE AS VARCHAR) AS t FROM part)")
def _(t):
    return t.part.select("p_partkey", X.code(F.col("p_size").cast("double")).alias("code"), F.expr("try_cast(split_part(p_brand, '#', 2) AS BIGINT) AS number"), F.expr("try_cast(p_name AS DOUBLE) AS no_number"))


@query("p03_code_labels", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'house' WHEN 'AUTOMOBILE' THEN 'car' WHEN 'MACHINERY' THEN 'machine' ELSE c_mktsegment END AS segment FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.label(F.col("c_mktsegment"), SEGMENTS).alias("segment"))


@query("p07_capture_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS captured FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("captured"))


@query("p08_parts_of", "SELECT p_partkey, list_filter(list_transform(string_split(p_brand || ' /  / ' || p_type, ' / '), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part")
def _(t):
    return t.part.select("p_partkey", X.parts_of(F.concat_ws(" /  / ", "p_brand", "p_type")).alias("parts"))


@query("p10_translate_joined", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open / ' || o_orderpriority WHEN o_orderstatus = 'F' THEN 'filled / ' || o_orderpriority ELSE o_orderstatus || ' / ' || o_orderpriority END AS said FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.translate_joined(F.concat_ws(" / ", "o_orderstatus", "o_orderpriority", "o_orderstatus"), {"O": "open", "F": "filled"}).alias("said"))


@query("p13_describe_chains", "SELECT p_partkey, p_brand || ' / ' || p_type AS identity, regexp_matches(lower(p_type), 'brass|steel') AS is_metal, p_size >= 25 AS is_large, coalesce(nullif(trim(p_name), ''), p_brand) AS name FROM part")
def _(t):
    return t.part.select("p_partkey", F.concat_ws(" / ", "p_brand", "p_type").alias("identity"), F.lower("p_type").rlike("brass|steel").alias("is_metal"), (F.col("p_size") >= 25).alias("is_large"), F.coalesce(X.said(F.col("p_name")), "p_brand").alias("name"))


@query("p14_metre_text", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT)) || ' m' AS metres FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.concat(X.thousands(F.col("o_totalprice")), F.lit(" m")).alias("metres"))


@query("p15_filled_share", "SELECT event_type, round(avg(CASE WHEN props IS NOT NULL AND trim(props) <> '' THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS props, round(avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS value FROM events GROUP BY 1")
def _(t):
    return Q.filled_share(t.events, ["props", "value"], ["event_type"])


@query("p17_search_fold", "SELECT count(*) AS hits, min(id) AS first, max(id) AS last FROM (SELECT doc_id AS id FROM documents WHERE contains(strip_accents(replace(translate(lower(text), 'øå', 'oa'), 'æ', 'ae')), 'eau'))")
def _(t):
    return t.documents.where(X.fold(F.col("text")).contains("eau")).agg(F.count(F.lit(1)).alias("hits"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("s05_filter_types", "SELECT l_shipmode, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode FROM lineitem WHERE l_returnflag IN ('R', 'A')) GROUP BY 1")
def _(t):
    return t.lineitem.where(F.col("l_returnflag").isin("R", "A")).groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count(F.lit(1)).alias("n"))


@query("s09_main_names", "SELECT s_nationkey, n_name, arg_min(s_name, s_suppkey) AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 GROUP BY 1, 2")
def _(t):
    return t.supplier.where("s_acctbal > 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_nationkey", "n_name").agg(F.min_by("s_name", "s_suppkey").alias("name"))


@query("s13_within_bounds", f"WITH {CU} SELECT id FROM cu WHERE x BETWEEN 100 AND 400 AND y BETWEEN 200 AND 600")
def _(t):
    return t.customers().where("x BETWEEN 100 AND 400 AND y BETWEEN 200 AND 600").select("id")


@query("s25_point_keys", f"WITH {V} SELECT e, n, (e << 32) | (n & 4294967295) AS key, count(*) AS asked FROM (SELECT round_even(x * 100, 0)::BIGINT AS e, round_even(y * 100, 0)::BIGINT AS n FROM v) GROUP BY 1, 2")
def _(t):
    e, n = F.rint(F.col("x") * 100).cast("long"), F.rint(F.col("y") * 100).cast("long")
    return t.vertices().select(e.alias("e"), n.alias("n")).groupBy("e", "n").agg(F.count(F.lit(1)).alias("asked")).withColumn("key", F.shiftleft("e", 32).bitwiseOR(F.col("n").bitwiseAND(F.lit(4294967295))))


# --- geometry --------------------------------------------------------------------------------------------------------


@query("g01_line_lengths", f"WITH {V} SELECT line_id, round(sum(len), 4) AS metres, count(*) + 1 AS n_vertices FROM s GROUP BY line_id")
def _(t):
    return t.lines().select("line_id", F.round(G.length(F.col("coords")), 4).alias("metres"), F.size("coords").cast("long").alias("n_vertices"))


BEARING = f"WITH {V}, e AS (SELECT line_id, arg_min(x, rn) AS ax, arg_min(y, rn) AS ay, arg_max(x, rn) AS bx, arg_max(y, rn) AS b2 FROM l GROUP BY line_id), b AS (SELECT line_id, CASE WHEN ax <> bx OR ay <> b2 THEN degrees(atan2(bx - ax, b2 - ay)) END AS d FROM e), q AS (SELECT line_id, CASE WHEN d < 0 THEN d + 360 ELSE d END AS bearing FROM b)"


@query("g02_bearings", BEARING + " SELECT line_id, round(bearing, 6) AS bearing, ['N','NE','E','SE','S','SW','W','NW'][CAST(floor(bearing / 45 + 0.5) AS BIGINT) % 8 + 1] AS compass FROM q")
def _(t):
    b = G.bearing(F.col("coords"))
    return t.lines().select("line_id", F.round(b, 6).alias("bearing"), G.compass(b).alias("compass"))


@query("g11_walked", f"WITH {V} SELECT line_id, seg, round(sum(len) OVER (PARTITION BY line_id ORDER BY seg) - len, 4) AS m0 FROM s")
def _(t):
    return t.segments().select("line_id", F.col("seg").cast("long").alias("seg"), F.round("m0", 4).alias("m0"))


@query("g07_crossings", "WITH su_ AS (SELECT c_nationkey AS line_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS seg, ((c_custkey * 37) % 1009)::DOUBLE AS x1, ((c_custkey * 101) % 997)::DOUBLE AS y1, ((c_custkey * 37) % 1009)::DOUBLE + 40 AS x2, ((c_custkey * 101) % 997)::DOUBLE + (c_custkey % 61) - 30 AS y2 FROM customer), q AS (SELECT a.line_id AS a, b.line_id AS b, a.seg AS a_seg, b.seg AS b_seg, a.x1 AS ax, a.y1 AS ay, a.x2 - a.x1 AS ux, a.y2 - a.y1 AS uy, b.x2 - b.x1 AS vx, b.y2 - b.y1 AS vy, b.x1 - a.x1 AS wx, b.y1 - a.y1 AS wy FROM su_ a JOIN su_ b ON a.line_id < b.line_id) SELECT count(*) AS n, round(sum(t), 3) AS t, a, b FROM (SELECT a, b, (wx * vy - wy * vx) / (ux * vy - uy * vx) AS t, (wx * uy - wy * ux) / (ux * vy - uy * vx) AS u FROM q WHERE ux * vy - uy * vx <> 0) WHERE t > 0 AND t < 1 AND u > 0 AND u < 1 GROUP BY a, b")
def _(t):
    key = F.col("c_custkey")
    segs = t.customer.select(F.col("c_nationkey").alias("line_id"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("seg"), ((key * 37) % 1009).cast("double").alias("x1"), ((key * 101) % 997).cast("double").alias("y1"), (key % 61).alias("k"))
    segs = segs.withColumn("x2", F.col("x1") + 40).withColumn("y2", F.col("y1") + F.col("k") - 30).drop("k")
    return L.crossing_points(segs, 50.0).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("t"), 3).alias("t"))


# g07's segments; from every tenth one a branch leaves its middle, and along every tenth one lies a part of it.
MEETING = """WITH c0 AS (SELECT c_nationkey AS line, c_custkey AS id, ((c_custkey * 37) % 1009)::DOUBLE AS x, ((c_custkey * 101) % 997)::DOUBLE AS y, (c_custkey % 61 - 30)::DOUBLE AS h FROM customer),
  sg AS (SELECT line, id, x AS x1, y AS y1, x + 40 AS x2, y + h AS y2 FROM c0 UNION ALL SELECT line + 1000, id, x + 20, y + h / 2, x + 20, y + h / 2 + 15 FROM c0 WHERE id % 10 = 0 UNION ALL SELECT line + 1000, id, x + 10, y + h / 4, x + 30, y + 3 * h / 4 FROM c0 WHERE id % 10 = 1),
  pr AS (SELECT a.line AS a, b.line AS b, a.x1, a.y1, a.x2, a.y2, b.x1 AS x3, b.y1 AS y3, b.x2 AS x4, b.y2 AS y4, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS det, (a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) AS off FROM sg a JOIN sg b ON a.line < b.line OR a.line = b.line AND a.id < b.id),
  tu AS (SELECT *, ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / det AS t, ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / det AS u FROM pr WHERE det <> 0),
  ov AS (SELECT *, CASE WHEN x1 <> x2 THEN (x3 - x1) / (x2 - x1) ELSE (y3 - y1) / (y2 - y1) END AS t3, CASE WHEN x1 <> x2 THEN (x4 - x1) / (x2 - x1) ELSE (y4 - y1) / (y2 - y1) END AS t4 FROM pr WHERE det = 0 AND off = 0),
  pt AS (SELECT a, b, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1
    UNION ALL SELECT a, b, x1 + e * (x2 - x1), y1 + e * (y2 - y1) FROM (SELECT *, unnest([greatest(0, least(t3, t4)), least(1, greatest(t3, t4))]) AS e FROM ov WHERE greatest(0, least(t3, t4)) <= least(1, greatest(t3, t4))))"""


@query("g07_intersection_points", f"{MEETING} SELECT a, b, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y FROM (SELECT DISTINCT a, b, round(x, 6) AS x, round(y, 6) AS y FROM pt) GROUP BY a, b")
def _(t):
    c = F.col
    at = t.customer.select(c("c_nationkey").alias("line_id"), c("c_custkey").alias("id"), ((c("c_custkey") * 37) % 1009).cast("double").alias("x"), ((c("c_custkey") * 101) % 997).cast("double").alias("y"), (c("c_custkey") % 61 - 30).cast("double").alias("h"))
    whole = at.select("line_id", c("id").alias("seg"), c("x").alias("x1"), c("y").alias("y1"), (c("x") + 40).alias("x2"), (c("y") + c("h")).alias("y2"))
    branch = at.where("id % 10 = 0").select(c("line_id") + 1000, "id", c("x") + 20, c("y") + c("h") / 2, c("x") + 20, c("y") + c("h") / 2 + 15)
    part = at.where("id % 10 = 1").select(c("line_id") + 1000, "id", c("x") + 10, c("y") + c("h") / 4, c("x") + 30, c("y") + c("h") * 3 / 4)
    found = L.intersection_points(whole.union(branch).union(part), 50.0)
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"))


@query("g18_bounds", f"WITH {V} SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM l")
def _(t):
    p = t.lines().select(F.explode("coords").alias("p"))
    return p.agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))


METRES = "sqrt(power((lon2 - lon1) * (111412.84 * cos(phi) - 93.5 * cos(3 * phi) + 0.118 * cos(5 * phi)), 2) + power((lat2 - lat1) * (111132.92 - 559.82 * cos(2 * phi) + 1.175 * cos(4 * phi) - 0.0023 * cos(6 * phi)), 2))"


@query("g19_metres_between", f"WITH {CU}, q AS (SELECT id, 5 + x / 50 AS lon1, 58 + y / 100 AS lat1, 5 + y / 50 AS lon2, 58 + x / 100 AS lat2 FROM cu) SELECT id, round({METRES}, 3) AS metres FROM (SELECT *, radians((lat1 + lat2) / 2) AS phi FROM q)")
def _(t):
    x, y = F.col("x"), F.col("y")
    return t.customers().select("id", F.round(G.metres_between(5 + x / 50, 58 + y / 100, 5 + y / 50, 58 + x / 100), 3).alias("metres"))


@query("g20_areas_at", f"WITH {CU}, {BX} SELECT id, list(area_id ORDER BY area_id) AS areas FROM cu JOIN bx ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY id")
def _(t):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"))
    c = t.customers().withColumn("ix", F.floor(F.col("x") / 250)).withColumn("iy", F.floor(F.col("y") / 250))
    spread = t.boxes().withColumn("rings", F.array(ring)).withColumn("c", F.explode(L.cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 250.0))).select("area_id", "rings", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy"))
    return c.join(spread, ["ix", "iy"]).where(G.inside_rings(F.col("x"), F.col("y"), F.col("rings"))).groupBy("id").agg(F.array_sort(F.collect_list("area_id")).alias("areas"))


@query("g23_midpoints", f"WITH {V}, a AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY seg) AS m1, sum(len) OVER (PARTITION BY line_id) / 2 AS half FROM s), b AS (SELECT * FROM a WHERE m1 - len <= half AND (m1 > half OR m1 >= half * 2)), f AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seg DESC) AS r FROM b) SELECT line_id, round(x1 + (x2 - x1) * (half - (m1 - len)) / len, 3) AS x, round(y1 + (y2 - y1) * (half - (m1 - len)) / len, 3) AS y FROM f WHERE r = 1")
def _(t):
    m = G.point_along(F.col("coords"), 0.5)
    return t.lines().select("line_id", F.round(m["x"], 3).alias("x"), F.round(m["y"], 3).alias("y"))


@query("g24_samples", f"WITH {V}, t AS (SELECT line_id, sum(len) AS m FROM s GROUP BY 1) SELECT line_id, greatest(2, CAST(floor(m / 5) AS BIGINT) + 1) AS n, round(m / (greatest(2, CAST(floor(m / 5) AS BIGINT) + 1) - 1), 6) AS step FROM t")
def _(t):
    m = G.length(F.col("coords"))
    n = S.sample_count(m)
    return t.lines().select("line_id", n.cast("long").alias("n"), F.round(m / (n - 1), 6).alias("step"))


@query("w02_chain_ids", f"WITH {V}, t AS (SELECT line_id, arg_min(x, rn) AS x, arg_min(y, rn) AS y, sum(coalesce(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), 0)) AS m FROM l GROUP BY 1) SELECT line_id, 'order-lines-' || round_even(x, 0)::BIGINT || '-' || round_even(y, 0)::BIGINT || '-' || round_even(m, 0)::BIGINT AS chain_id FROM t")
def _(t):
    a = F.element_at("coords", 1)
    return t.lines().select("line_id", L.chain_id(F.lit("Order  Lines!"), a["x"], a["y"], G.length(F.col("coords"))).alias("chain_id"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("j01_attach_nearest", f"WITH {CU}, {SU}, d AS (SELECT id, rid, s_name, sqrt((su.x - cu.x) * (su.x - cu.x) + (su.y - cu.y) * (su.y - cu.y)) AS distance FROM cu, su), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, rid) AS r FROM d WHERE distance <= 50) SELECT cu.id, b.rid, round(b.distance, 6) AS distance, b.s_name FROM cu LEFT JOIN b ON b.id = cu.id AND r = 1")
def _(t):
    return L.attach_nearest(t.customers(), t.suppliers(), 50.0, ["s_name"]).withColumn("distance", F.round("distance", 6))


@query("j02_join_info", "SELECT o_orderkey, l_linenumber, l_partkey, o_orderstatus, l_linestatus AS status_info FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "o_orderstatus", F.col("l_linestatus").alias("status_info"))


@query("j03_joined_values", "SELECT o_orderkey, v.flags FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ' / ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1) v ON l_orderkey = o_orderkey")
def _(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(X.combine(F.collect_set("l_returnflag")).alias("flags"))
    return t.orders.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "flags")


@query("j07_protected_within", f"WITH {V}, {BX}, q AS (SELECT line_id, area_id, len, greatest(0, CASE WHEN x2 > x1 THEN (x0 - x1s) / (x2 - x1) WHEN x2 < x1 THEN (bx1 - x1s) / (x2 - x1) WHEN x1s BETWEEN x0 AND bx1 THEN 0 ELSE 2 END, CASE WHEN y2 > y1 THEN (y0 - y1s) / (y2 - y1) WHEN y2 < y1 THEN (by1 - y1s) / (y2 - y1) WHEN y1s BETWEEN y0 AND by1 THEN 0 ELSE 2 END) AS lo, least(1, CASE WHEN x2 > x1 THEN (bx1 - x1s) / (x2 - x1) WHEN x2 < x1 THEN (x0 - x1s) / (x2 - x1) WHEN x1s BETWEEN x0 AND bx1 THEN 1 ELSE -1 END, CASE WHEN y2 > y1 THEN (by1 - y1s) / (y2 - y1) WHEN y2 < y1 THEN (y0 - y1s) / (y2 - y1) WHEN y1s BETWEEN y0 AND by1 THEN 1 ELSE -1 END) AS hi FROM (SELECT s.*, s.x1 AS x1s, s.y1 AS y1s, area_id, x0, y0, bx.x1 AS bx1, bx.y1 AS by1 FROM s, bx)) SELECT line_id, area_id, round(sum(greatest(0, hi - lo) * len), 3) AS metres FROM q GROUP BY 1, 2 HAVING sum(greatest(0, hi - lo) * len) > 0")
def _(t):
    return L.inside_boxes(t.segments(), t.boxes(), ["line_id"]).withColumn("metres", F.round("metres", 3))


@query("j09_points_within", f"WITH {CU}, {SU} SELECT id, count(*) AS n FROM cu JOIN su ON sqrt((su.x - cu.x) * (su.x - cu.x) + (su.y - cu.y) * (su.y - cu.y)) <= 25 GROUP BY id")
def _(t):
    d = G.distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))
    right = t.suppliers().select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.floor(F.col("x") / 25).alias("ix"), F.floor(F.col("y") / 25).alias("iy"))
    left = t.customers().select("id", "x", "y", F.explode(L.cells(F.col("x"), F.col("y"), F.col("x"), F.col("y"), 25.0, 25.0)).alias("c")).select("id", "x", "y", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy"))
    return left.join(right, ["ix", "iy"]).where(d <= 25).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("j13_orphans", "SELECT 'customer without order' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'order without line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    a = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("customer without order").alias("kind"), "n")
    b = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("order without line").alias("kind"), "n")
    return a.unionByName(b)


@query("j14_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def _(t):
    return t.supplier.join(t.lineitem.where("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("j16_crossings_of_areas", f"WITH {V}, e AS (SELECT line_id, rn, x >= 200 AND x < 450 AND y >= 200 AND y < 450 AS inside, x, y FROM l), f AS (SELECT *, lag(inside) OVER p AS before, lag(x) OVER p AS lx, lag(y) OVER p AS ly FROM e WINDOW p AS (PARTITION BY line_id ORDER BY rn)) SELECT line_id, rn, CASE WHEN inside THEN 'in' ELSE 'out' END AS event, round((x + lx) / 2, 4) AS x, round((y + ly) / 2, 4) AS y FROM f WHERE before IS NOT NULL AND before <> inside")
def _(t):
    p = t.lines().select("line_id", F.posexplode("coords").alias("rn", "p")).select("line_id", (F.col("rn") + 1).cast("long").alias("rn"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    w = Window.partitionBy("line_id").orderBy("rn")
    p = p.withColumn("inside", F.expr("x >= 200 AND x < 450 AND y >= 200 AND y < 450"))
    p = p.withColumn("before", F.lag("inside").over(w)).withColumn("lx", F.lag("x").over(w)).withColumn("ly", F.lag("y").over(w))
    return p.where("before IS NOT NULL AND before <> inside").select("line_id", "rn", F.when(F.col("inside"), "in").otherwise("out").alias("event"), F.round((F.col("x") + F.col("lx")) / 2, 4).alias("x"), F.round((F.col("y") + F.col("ly")) / 2, 4).alias("y"))


# --- aggregations ----------------------------------------------------------------------------------------------------


@query("a01_describe_column", "WITH m AS (SELECT min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders) SELECT count(*) AS n_rows, count(o_totalprice) AS n_known, count(DISTINCT o_totalprice) AS n_unique, any_value(least) AS least, any_value(most) AS most, median(o_totalprice) AS median, round(avg(o_totalprice), 2) AS mean, count(*) FILTER (o_totalprice = least) AS n_least, count(*) FILTER (o_totalprice = most) AS n_most, round(100.0 * count(o_totalprice) / count(*), 1) AS pct, count(DISTINCT o_totalprice) = count(o_totalprice) AS is_unique FROM orders, m")
def _(t):
    return Q.describe_column(t.orders, "o_totalprice")


@query("a15_value_counts", "SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def _(t):
    return Q.value_counts(t.part, "p_size")


@query("a03_join_values", "SELECT o_custkey, string_agg(DISTINCT p, ' / ' ORDER BY p) AS said FROM (SELECT o_custkey, unnest([o_orderpriority, o_orderstatus]) AS p FROM orders) GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(X.combine(F.flatten(F.collect_list(F.array("o_orderpriority", "o_orderstatus")))).alias("said"))


@query("a04_whole_way_length", "WITH p AS (SELECT p_partkey, p_retailprice, unnest(list_distinct([p_brand, p_type])) AS part FROM part), q AS (SELECT DISTINCT a.p_partkey AS k, b.p_partkey AS o, b.p_retailprice AS m FROM p a JOIN p b ON a.part = b.part) SELECT k AS p_partkey, round(sum(m), 2) AS whole FROM q GROUP BY k")
def _(t):
    p = t.part.select("p_partkey", "p_retailprice", F.explode(F.array_distinct(F.array("p_brand", "p_type"))).alias("part"))
    # each way's total once, then the overlap of a chain's two ways taken off: linear in chains, no pairs of them
    by_part = p.groupBy("part").agg(F.sum("p_retailprice").alias("m"))
    both = t.part.groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("twice"))
    total = p.join(by_part, "part").groupBy("p_partkey").agg(F.sum("m").alias("m"))
    return t.part.join(total, "p_partkey").join(both, ["p_brand", "p_type"]).select("p_partkey", F.round(F.col("m") - F.col("twice"), 2).alias("whole"))


@query("a06_chain_coverage", "SELECT o_orderkey AS chain, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS marked, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS unmarked, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS unknown, coalesce(sum(l_quantity), 0) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    part = lambda f, n: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).alias(n)
    per = t.lineitem.groupBy("l_orderkey").agg(part("A", "marked"), part("N", "unmarked"), part("R", "unknown"), F.sum("l_quantity").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return t.orders.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("chain"), *[zero(c) for c in ("marked", "unmarked", "unknown", "total")])


@query("a08_node_degrees", f"WITH {ED} SELECT vertex, count(*) AS degree FROM (SELECT a AS vertex FROM ed UNION ALL SELECT b FROM ed) GROUP BY 1")
def _(t):
    return N.describe_nodes(t.edges())


@query("a11_summary", f"WITH {V} SELECT count(DISTINCT line_id) AS n_lines, round(sum(len) / 1000, 3) AS km, round(avg(len), 6) AS mean_segment FROM s")
def _(t):
    return t.segments().agg(F.count_distinct("line_id").alias("n_lines"), F.round(F.sum("len") / 1000, 3).alias("km"), F.round(F.avg("len"), 6).alias("mean_segment"))


@query("a12_by_source_and_class", f"WITH {ED} SELECT source, status, round(sum(length_m) / 1000, 4) AS km, round(100 * sum(length_m) / sum(sum(length_m)) OVER (PARTITION BY source), 4) AS pct FROM ed GROUP BY 1, 2")
def _(t):
    per = t.edges().groupBy("source", "status").agg(F.sum("length_m").alias("m"))
    return per.select("source", "status", F.round(F.col("m") / 1000, 4).alias("km"), F.round(100 * F.col("m") / F.sum("m").over(Window.partitionBy("source")), 4).alias("pct"))


@query("a16_crosstab", "SELECT event_type, count(*) FILTER (b = 'low') AS low, count(*) FILTER (b = 'mid') AS mid, count(*) FILTER (b = 'high') AS high FROM (SELECT event_type, CASE WHEN value < 50 THEN 'low' WHEN value < 150 THEN 'mid' ELSE 'high' END AS b FROM events) GROUP BY 1")
def _(t):
    b = F.when(F.col("value") < 50, "low").when(F.col("value") < 150, "mid").otherwise("high")
    return Q.crosstab(t.events.withColumn("b", b), "event_type", "b", ["low", "mid", "high"])


@query("a17_cardinality", "SELECT n AS n_rows, count(*) AS n_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def _(t):
    return Q.cardinality(t.lineitem, "l_orderkey")


@query("a19_patterns", "SELECT count(*) FILTER (regexp_matches(p_type, '(?i)brass')) AS brass, count(*) FILTER (contains(p_name, 'e')) AS with_e, count(*) AS n FROM part")
def _(t):
    return t.part.agg(F.count_if(F.col("p_type").rlike("(?i)brass")).alias("brass"), F.count_if(F.col("p_name").contains("e")).alias("with_e"), F.count(F.lit(1)).alias("n"))


@query("a20_tally", "SELECT l_returnflag AS source, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS open, sum(l_quantity) AS metres FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def _(t):
    return t.lineitem.where("l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("source")).agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("open"), F.sum("l_quantity").alias("metres"))


# --- ordered ---------------------------------------------------------------------------------------------------------


@query("w01_dense_ids", "SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS dense FROM orders")
def _(t):
    return Q.dense_ids(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")


SERIES = "e AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS tm, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS z FROM events)"


def _series(t):
    return t.events.select("user_id", "event_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 1000000).alias("at"), F.when(F.col("event_type") != "error", F.col("value")).alias("z"))


@query("w03_stretches", f"WITH {SERIES}, g AS (SELECT *, count(*) FILTER (z IS NULL) OVER (PARTITION BY user_id ORDER BY tm) AS run FROM e), r AS (SELECT user_id, run, min(tm) AS first, max(tm) AS last, count(*) AS n FROM g WHERE z IS NOT NULL GROUP BY 1, 2) SELECT user_id, first, last, n, row_number() OVER (PARTITION BY user_id ORDER BY first) AS stretch FROM r")
def _(t):
    return S.stretches(_series(t), "user_id", "at", "z")


@query("w04_running_max", f"WITH {SERIES} SELECT event_id, max(z) OVER (PARTITION BY user_id ORDER BY tm) AS high FROM e")
def _(t):
    return _series(t).select("event_id", F.max("z").over(Window.partitionBy("user_id").orderBy("at")).alias("high"))


@query("w05_deltas", "SELECT event_id, d, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS code, CASE WHEN CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END < 128 THEN 1 WHEN CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END < 16384 THEN 2 WHEN CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END < 2097152 THEN 3 ELSE 4 END AS bytes FROM (SELECT event_id, v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY ts), 0) AS d FROM (SELECT *, round_even(value * 100, 0)::BIGINT AS v FROM events))")
def _(t):
    v = t.events.select("event_id", "user_id", "ts", F.rint(F.col("value") * 100).cast("long").alias("v"))
    d = v.withColumn("d", F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy("user_id").orderBy("ts")), F.lit(0)))
    return d.select("event_id", "d", X.zigzag(F.col("d")).alias("code"), X.varint_bytes(X.zigzag(F.col("d"))).alias("bytes"))


CC = f"WITH RECURSIVE {ED}, arcs AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), cc(v, m) USING KEY (v) AS (SELECT a, a FROM arcs UNION (SELECT arcs.b AS v, min(cc.m) AS m FROM cc JOIN arcs ON arcs.a = cc.v JOIN recurring.cc AS u ON u.v = arcs.b WHERE cc.m < u.m GROUP BY arcs.b))"


@query("c01_components", CC + " SELECT v AS vertex, m AS component FROM cc")
def _(t):
    return N.components(t.edges())


@query("w11_label_components", CC + " SELECT m AS component, round(sum(length_m), 2) AS metres, count(*) AS n_edges, row_number() OVER (ORDER BY round(sum(length_m), 2) DESC, m) AS place FROM ed JOIN cc ON v = a GROUP BY m")
def _(t):
    return N.label_components(t.edges()).withColumn("metres", F.round("metres", 2))


NEAR = "pt AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1009)::DOUBLE AS x, ((c_custkey * 101) % 997)::DOUBLE AS y FROM customer), ed AS (SELECT p.id AS a, q.id AS b FROM pt p JOIN pt q ON p.id < q.id AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 12)"


@query("c02_cluster_points", f"WITH RECURSIVE {NEAR}, arcs AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed UNION SELECT id, id FROM pt), cc(v, m) USING KEY (v) AS (SELECT a, a FROM arcs UNION (SELECT arcs.b AS v, min(cc.m) AS m FROM cc JOIN arcs ON arcs.a = cc.v JOIN recurring.cc AS u ON u.v = arcs.b WHERE cc.m < u.m GROUP BY arcs.b)) SELECT v AS vertex, m AS component FROM cc")
def _(t):
    return N.clusters(t.customers().select("id", "x", "y"), 12.0)


@query("c11_edge_costs", f"WITH {ED}, q AS (SELECT *, sum(length_m) OVER (PARTITION BY source) AS chain_m, CASE status WHEN 'F' THEN 'ferry' WHEN 'P' THEN 'bridge' ELSE 'path' END AS kind FROM ed) SELECT edge_id, kind, round(CASE kind WHEN 'ferry' THEN 5000 * length_m / chain_m WHEN 'bridge' THEN length_m * 1.3::DOUBLE ELSE length_m * 1.1::DOUBLE END, 6) AS cost FROM q")
def _(t):
    kind = F.when(F.col("status") == "F", "ferry").when(F.col("status") == "P", "bridge").otherwise("path")
    e = t.edges()
    chains = e.groupBy("source").agg(F.sum("length_m").alias("chain_m"))
    return N.edge_costs(e.join(chains, "source").withColumn("kind", kind).withColumn("factor", F.lit(1.1))).select("edge_id", "kind", F.round("cost", 6).alias("cost"))


@query("c19_shortest_paths", f"WITH RECURSIVE {ED}, arcs AS (SELECT a, b, min(length_m) AS w FROM (SELECT a, b, length_m FROM ed UNION ALL SELECT b, a, length_m FROM ed) WHERE a <> b GROUP BY 1, 2), d(v, c) USING KEY (v) AS (SELECT 1::BIGINT, 0::DOUBLE UNION (SELECT x.v, x.c FROM (SELECT arcs.b AS v, min(d.c + w) AS c FROM d JOIN arcs ON arcs.a = d.v GROUP BY arcs.b) x LEFT JOIN recurring.d AS u ON u.v = x.v WHERE u.v IS NULL OR x.c < u.c)) SELECT v AS vertex, round(c, 4) AS cost FROM d")
def _(t):
    return N.shortest_paths(t.edges().withColumn("cost", F.col("length_m")), 1).select("vertex", F.round("cost", 4).alias("cost"))


# --- series ----------------------------------------------------------------------------------------------------------

FOLD = """list_reduce(list_prepend({'t': 0::DOUBLE, 'a': NULL::DOUBLE, 'e': NULL::DOUBLE, 'z': NULL::DOUBLE}, list_transform(%s, lambda hh: {'t': 0::DOUBLE, 'a': NULL::DOUBLE, 'e': NULL::DOUBLE, 'z': hh})), lambda s, r:
  CASE WHEN r.z IS NULL THEN {'t': s.t + CASE WHEN s.e - s.a >= 5 THEN s.e - s.a ELSE 0 END, 'a': NULL, 'e': NULL, 'z': NULL}
       WHEN s.a IS NULL THEN {'t': s.t, 'a': r.z, 'e': r.z, 'z': NULL}
       WHEN s.e >= s.a AND r.z > s.e THEN {'t': s.t, 'a': s.a, 'e': r.z, 'z': NULL}
       WHEN s.e >= s.a AND s.e - r.z >= 5 THEN {'t': s.t + s.e - s.a, 'a': s.e, 'e': r.z, 'z': NULL}
       WHEN s.e < s.a AND r.z < s.e THEN {'t': s.t, 'a': s.a, 'e': r.z, 'z': NULL}
       WHEN s.e < s.a AND r.z - s.e >= 5 THEN {'t': s.t, 'a': s.e, 'e': r.z, 'z': NULL} ELSE {'t': s.t, 'a': s.a, 'e': s.e, 'z': NULL} END)"""


@query("m04_profiles", f"WITH {SERIES}, h AS (SELECT user_id, list(z ORDER BY tm) AS z, max(z) AS high, min(z) AS low FROM e GROUP BY 1), f AS (SELECT *, {FOLD % 'z'} AS up, {FOLD % 'list_transform(z, lambda qq: -qq)'} AS down FROM h) SELECT user_id, round(CASE WHEN high IS NOT NULL THEN up.t + CASE WHEN up.e - up.a >= 5 THEN up.e - up.a ELSE 0 END END, 4) AS ascent, round(CASE WHEN high IS NOT NULL THEN down.t + CASE WHEN down.e - down.a >= 5 THEN down.e - down.a ELSE 0 END END, 4) AS descent, high, low FROM f")
def _(t):
    h = _series(t).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "z"))).alias("s"), F.max("z").alias("high"), F.min("z").alias("low"))
    z = F.transform("s", lambda p: p["z"])
    return h.select("user_id", F.round(S.ascent(z), 4).alias("ascent"), F.round(S.descent(z), 4).alias("descent"), "high", "low")


@query("m09_interpolate", f"WITH {SERIES}, g AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN tm END IGNORE NULLS) OVER b AS a0, last_value(z IGNORE NULLS) OVER b AS z0, first_value(CASE WHEN z IS NOT NULL THEN tm END IGNORE NULLS) OVER f AS a1, first_value(z IGNORE NULLS) OVER f AS z1 FROM e WINDOW b AS (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY tm ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, round(CASE WHEN a1 = a0 THEN z0 ELSE z0 + (z1 - z0) * (tm - a0) / (a1 - a0) END, 4) AS filled FROM g")
def _(t):
    return S.interpolate(_series(t), "user_id", "at", "z").select("event_id", F.round("filled", 4).alias("filled"))


@query("k08_checksum", "WITH q AS (SELECT user_id, round_even(value * 100, 0)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) SELECT user_id, ((sum(v) + 1) % 4294967296)::BIGINT AS a, ((sum(v * r) + count(*)) % 4294967296)::BIGINT AS b FROM q GROUP BY 1")
def _(t):
    from_end = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc()))
    v = t.events.select("user_id", F.rint(F.col("value") * 100).cast("long").alias("v"), from_end.alias("r"))
    m = 4294967296
    return v.groupBy("user_id").agg(((F.sum("v") + 1) % m).alias("a"), ((F.sum(F.col("v") * F.col("r")) + F.count(F.lit(1))) % m).alias("b"))


# --- order, sets, quality --------------------------------------------------------------------------------------------


@query("o02_explode_positions", f"WITH {V} SELECT line_id, count(*) AS n FROM (SELECT DISTINCT line_id, round_even(x / 50, 0) AS cx, round_even(y / 50, 0) AS cy FROM v) GROUP BY 1")
def _(t):
    return t.vertices().select("line_id", F.rint(F.col("x") / 50).alias("cx"), F.rint(F.col("y") / 50).alias("cy")).distinct().groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))


@query("o03_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return Q.top(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 20)


@query("o05_first_per_key", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return L.first_per_key(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("o06_union_all", "SELECT 'customer' AS source, c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, s_name FROM supplier")
def _(t):
    a = t.customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("o07_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT s_suppkey FROM supplier")
def _(t):
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.supplier.select("s_suppkey"))


@query("o08_intersection", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.select("c_custkey"))


@query("q01_validate", "WITH sp AS (SELECT o_orderkey AS id, o_totalprice / 500 AS x FROM orders), att AS (SELECT l_orderkey AS k FROM lineitem) SELECT * FROM (SELECT 'duplicate ids' AS rule, 'issue' AS level, count(*) AS n FROM (SELECT id FROM sp GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orphan attributes', 'issue', count(DISTINCT k) FROM att WHERE k NOT IN (SELECT id FROM sp) UNION ALL SELECT 'unreferenced geometry', 'warning', count(DISTINCT id) FROM sp WHERE id NOT IN (SELECT k FROM att) UNION ALL SELECT 'outside of bounds', 'issue', count(*) FROM sp WHERE x < 0 OR x > 1100) WHERE n > 0")
def _(t):
    spatial = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500).alias("x"), F.lit(1.0).alias("y"))
    return Q.validate(spatial, t.lineitem, "id", "l_orderkey", 1)


@query("a13_elevation_by_source", f"WITH {SERIES} SELECT user_id % 7 AS source, count(z) AS n, round(sum(z), 2) AS total, min(z) AS low, max(z) AS high FROM e GROUP BY 1")
def _(t):
    return _series(t).groupBy((F.col("user_id") % 7).alias("source")).agg(F.count("z").alias("n"), F.round(F.sum("z"), 2).alias("total"), F.min("z").alias("low"), F.max("z").alias("high"))


# --- sources, sinks, shapes, coverage, streams -----------------------------------------------------------------------


@query("k04_osm_nodes", f"WITH {V}, p AS (SELECT line_id, rn, x AS lon, y AS lat, printf('%.7f %.7f', x, y) AS key FROM l), f AS (SELECT key, min(line_id * 100000 + rn) AS first, arg_min(lon, line_id * 100000 + rn) AS lon, arg_min(lat, line_id * 100000 + rn) AS lat FROM p GROUP BY key) SELECT key, row_number() OVER (ORDER BY first) AS node_id, lon, lat FROM f")
def _(t):
    return sinks.osm_nodes(t.lines())


@query("s23_gpx_round_trip", f"WITH {V} SELECT line_id, rn - 1 AS seq, round(x, 5) AS lon, round(y, 5) AS lat FROM l")
def _(t):
    documents = sinks.tracks_xml(t.lines(), "line_id").select(F.regexp_extract("value", "<name>(.*?)</name>", 1).cast("long").alias("line_id"), F.col("value").alias("text"))
    return files.parse_gpx(documents, "line_id").select("line_id", F.col("seq").cast("long").alias("seq"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@query("d01_waymarked", f"WITH {V}, {SU}, mk AS (SELECT x AS x1, y AS y1, x + 300 AS x2, y AS y2 FROM su), q AS (SELECT line_id, rn, max(CASE WHEN sqrt(power(x - greatest(x1, least(x2, x)), 2) + power(y - y1, 2)) <= 25 THEN 1 ELSE 0 END) AS hit FROM l, mk GROUP BY 1, 2), sh AS (SELECT line_id, avg(hit::DOUBLE) AS share FROM q GROUP BY 1) SELECT line_id, round(share, 6) AS share, CASE WHEN share >= 0.5 THEN 'marked' ELSE 'unknown' END AS waymarked FROM sh")
def _(t):
    s = t.suppliers()
    marks = s.select(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 300).alias("x2"), F.col("y").alias("y2"))
    samples = t.lines().select(F.col("line_id").alias("id"), F.posexplode("coords").alias("k", "p")).select("id", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    share = L.share_within(samples, marks, 25.0)
    return share.select(F.col("id").alias("line_id"), F.round("share", 6).alias("share"), F.when(F.col("share") >= 0.5, "marked").otherwise("unknown").alias("waymarked"))


# Brute force over all pairs of segment and mark: what of a segment is near a mark's two ends and its strip, then the union.
NEAR = f"""WITH {V}, {SU}, sg AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY seg) - len AS m0 FROM s WHERE line_id % 7 <> 0),
  mk AS (SELECT 'on' AS mask, x AS a, y AS b, x + 300 AS c, y AS d FROM su UNION ALL SELECT 'off', x, y, x, y + 300 FROM su),
  pr AS (SELECT *, (x2 - x1) / len AS ux, (y2 - y1) / len AS uy, (c - a) / 300 AS vx, (d - b) / 300 AS vy FROM sg, mk),
  pt AS (SELECT *, (a - x1) * ux + (b - y1) * uy AS fa, (c - x1) * ux + (d - y1) * uy AS fc, abs((a - x1) * uy - (b - y1) * ux) AS ga, abs((c - x1) * uy - (d - y1) * ux) AS gc,
    (x1 - a) * vx + (y1 - b) * vy AS p, ux * vx + uy * vy AS dp, (x1 - a) * vy - (y1 - b) * vx AS q, ux * vy - uy * vx AS dq FROM pr),
  st AS (SELECT *, CASE WHEN dp = 0 AND (p < 0 OR p > 300) OR dq = 0 AND abs(q) > 25 THEN NULL ELSE greatest(CASE WHEN dp = 0 THEN -1e9 ELSE least(-p / dp, (300 - p) / dp) END, CASE WHEN dq = 0 THEN -1e9 ELSE least((-25 - q) / dq, (25 - q) / dq) END) END AS sl,
    least(CASE WHEN dp = 0 THEN 1e9 ELSE greatest(-p / dp, (300 - p) / dp) END, CASE WHEN dq = 0 THEN 1e9 ELSE greatest((-25 - q) / dq, (25 - q) / dq) END) AS sh FROM pt),
  part AS (SELECT mask, line_id, m0, len, fa - sqrt(625 - ga * ga) AS lo, fa + sqrt(625 - ga * ga) AS hi FROM (SELECT * FROM st WHERE ga <= 25)
    UNION ALL SELECT mask, line_id, m0, len, fc - sqrt(625 - gc * gc), fc + sqrt(625 - gc * gc) FROM (SELECT * FROM st WHERE gc <= 25)
    UNION ALL SELECT mask, line_id, m0, len, sl, sh FROM st WHERE sl <= sh),
  iv AS (SELECT mask, line_id, m0 + greatest(lo, 0) AS lo, m0 + least(hi, len) AS hi FROM part WHERE greatest(lo, 0) < least(hi, len)),
  gp AS (SELECT mask, line_id, greatest(0, hi - greatest(lo, coalesce(max(hi) OVER (PARTITION BY mask, line_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo))) AS gained FROM iv),
  cv AS (SELECT line_id, sum(gained) FILTER (mask = 'on') AS near_on, sum(gained) FILTER (mask = 'off') AS near_off FROM gp GROUP BY 1),
  sh AS (SELECT w.line_id, CASE WHEN w.line_id % 7 <> 0 THEN least(1, coalesce(near_on, 0) / whole) END AS marked_share, CASE WHEN w.line_id % 7 <> 0 THEN least(1, coalesce(near_off, 0) / whole) END AS unmarked_share FROM (SELECT line_id, sum(len) AS whole FROM s GROUP BY 1) w LEFT JOIN cv USING (line_id))"""


@query("d01_waymarked_by_length", f"{NEAR} SELECT line_id, round(marked_share, 6) AS marked_share, round(unmarked_share, 6) AS unmarked_share, CASE WHEN marked_share >= 0.5 THEN 'marked' WHEN unmarked_share >= 0.5 THEN 'unmarked' WHEN marked_share IS NOT NULL THEN 'unknown' END AS waymarked FROM sh")
def _(t):
    s = t.suppliers()
    marked = s.select(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 300).alias("x2"), F.col("y").alias("y2"))
    unmarked = s.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), (F.col("y") + 300).alias("y2"))
    segs = t.segments().withColumnRenamed("line_id", "id").withColumn("walked", F.col("id") % 7 != 0)
    found = L.waymarked(segs, marked, unmarked, 25.0)
    return found.select(F.col("id").alias("line_id"), F.round("marked_share", 6).alias("marked_share"), F.round("unmarked_share", 6).alias("unmarked_share"), "waymarked")


@query("j08_nearest_on_lines", f"WITH {CU}, {SU}, mk AS (SELECT rid AS line_id, x AS x1, y AS y1, x + 60 AS x2 FROM su), d AS (SELECT id, line_id, sqrt(power(cu.x - greatest(x1, least(x2, cu.x)), 2) + power(cu.y - y1, 2)) AS distance FROM cu, mk), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, line_id) AS r FROM d WHERE distance <= 25) SELECT id, line_id, round(distance, 6) AS distance FROM b WHERE r = 1")
def _(t):
    segs = t.suppliers().select(F.col("rid").alias("line_id"), F.lit(0).alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 60).alias("x2"), F.col("y").alias("y2"))
    return L.nearest_on_lines(t.customers(), segs, 25.0).select("id", "line_id", F.round("distance", 6).alias("distance"))


@query("g17_simplify")
def _(t):
    return shapes.simplify(t.lines(), 50.0).select("line_id", F.size("coords").alias("n_vertices"), F.round(G.length(F.col("coords")), 3).alias("metres"))


@query("o01_thin_points")
def _(t):
    points = t.customers().select("id", "x", "y", F.col("c_nationkey").alias("grp"), (-F.col("c_acctbal")).alias("rank"))
    return shapes.thin_points(points, 120.0, "grp", "rank")


@query("t01_windowed_events", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    w = events.windowed(t.events)
    return w.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("g25_to_metres")
def _(t):
    p = G.utm(5 + F.col("x") / 100, 58 + F.col("y") / 100)
    return t.customers().select("id", F.round(p["x"], 3).alias("east"), F.round(p["y"], 3).alias("north"))
