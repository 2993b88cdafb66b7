import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from linenet.functions import geometry as G
from linenet.functions import text as X
from linenet.operators import lines as L
from linenet.operators import network as N
from linenet.operators import series as S
from linenet.operators import shapes
from linenet.sources import files, sinks


@pytest.mark.parametrize(
    "heights, expected",
    [([0, 5], 5.0), ([0, 4.9], 0.0), ([0, 10, 7, 20], 20.0), ([0, 10, 4, 20], 26.0), ([10, 0, 4], 0.0), ([0, 10, None, 0, 6], 16.0), ([None, None], None), ([3], 0.0), ([], None)],
)
def test_ascent(spark, heights, expected):
    df = spark.createDataFrame([([None if h is None else float(h) for h in heights],)], "h array<double>")
    assert df.select(S.ascent(F.col("h")).alias("a")).first().a == expected


def test_descent_is_ascent_reversed(spark):
    df = spark.createDataFrame([([20.0, 4.0, 10.0, 0.0],)], "h array<double>")
    row = df.select(S.descent(F.col("h")).alias("d"), S.ascent(F.reverse("h")).alias("a")).first()
    assert row.d == row.a == 26.0


def test_text_cleaning(spark):
    df = spark.createDataFrame([(" a / b /  / a ",), ("",), (None,)], "v string")
    rows = df.select(X.parts_of(F.col("v")).alias("p"), X.combine(X.parts_of(F.col("v"))).alias("c"), X.translate_joined(F.col("v"), {"a": "z"}).alias("t")).collect()
    assert [r.p for r in rows] == [["a", "b", "a"], [], []]
    assert [r.c for r in rows] == ["a / b", None, None]
    assert [r.t for r in rows] == ["z / b", None, None]


def test_compass_halves_up(spark):
    df = spark.createDataFrame([(22.5,), (22.4,), (337.5,), (None,)], "b double")
    assert [r.c for r in df.select(G.compass(F.col("b")).alias("c")).collect()] == ["NE", "N", "N", None]


def test_utm_central_meridian(spark):
    p = spark.range(1).select(G.utm(F.lit(15.0), F.lit(60.0)).alias("p")).first().p
    assert abs(p.x - 500000) < 1e-6 and abs(p.y - 6651411.19) < 0.5


def test_even_odd_rings(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    df = spark.createDataFrame([(x, [square(0.0, 10.0), square(4.0, 6.0)]) for x in (1.0, 5.0, 11.0)], "x double, rings array<array<struct<x:double,y:double>>>")
    assert [r.i for r in df.select(G.inside_rings(F.col("x"), F.col("x"), F.col("rings")).alias("i")).collect()] == [True, False, False]


def test_shortest_paths_against_dijkstra(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60), float(random.randrange(1, 50))) for _ in range(110)]
    near: dict = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))
    best, queue = {}, [(0.0, 0)]
    while queue:
        c, v = heapq.heappop(queue)
        if v not in best:
            best[v] = c
            for w, d in near.get(v, ()):
                heapq.heappush(queue, (c + d, w))
    paths = N.shortest_paths(spark.createDataFrame(edges, "a long, b long, cost double"), 0)
    assert {r.vertex: r.cost for r in paths.collect()} == best
    goal = max(best, key=best.get)
    way = N.route(paths, goal)
    assert way[0] == 0 and way[-1] == goal and N.route(paths, 999) == []


def test_components_with_lone_vertices(spark):
    found = N.components(spark.createDataFrame([(5, 3), (3, 9), (7, 7)], "a long, b long"), spark.range(10).withColumnRenamed("id", "vertex"))
    assert {r.vertex: r.component for r in found.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6, 7: 7, 8: 8, 9: 3}


def test_shapes():
    assert shapes.simplify_points([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], 0.5) == [(0, 0), (2, 0), (3, 5), (4, 0)]


def test_thinning_keeps_equal_distance(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a", 1), (2, 5.0, 0.0, "a", 0), (3, 10.0, 0.0, "a", 2), (4, 1.0, 0.0, "b", 0)], "id long, x double, y double, grp string, rank int")
    assert sorted(r.id for r in shapes.thin_points(df, 5.0, "grp", "rank").collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in shapes.thin_points(df, 6.0, "grp", "rank").collect()) == [2, 4]


def test_payload_round_trip():
    edges = [{"a": 3, "b": 1, "coords": [(12.5, 65.25), (12.500001, 65.249999)], "heights": [1.25, None, -3.5]}, {"a": 1, "b": 9, "coords": [], "heights": []}]
    payload = sinks.encode_graph(edges)
    assert sinks.decode_graph(payload) == edges and payload == sinks.encode_graph(edges)
    for v in (0, 1, -1, 127, 128, -(2**40)):
        assert sinks.zigzag(v) >= 0


def test_gpx_and_osm(spark, tmp_path):
    lines = spark.createDataFrame([(1, "A & b", [(10.0, 60.0, 5.0), (10.1, 60.1, None)]), (2, "short", [(1.0, 2.0, 3.0)])], "line_id long, name string, coords array<struct<x:double,y:double,z:double>>")
    sinks.write_gpx(lines, str(tmp_path / "gpx"), "T & <t>", credits=(("a", "CC", "https://l.example"), ("b", "CC", "javascript:x")))
    text = spark.read.text(str(tmp_path / "gpx"), wholetext=True).where("length(value) > 0").first().value
    assert text.count("<trk>") == 1 and "A &amp; b" in text and "<name>T &amp; &lt;t&gt;</name><desc>a, b: CC</desc><link href=\"https://l.example\"/>" in text and text.count("<ele>") == 1 and "<time>" not in text
    doc = spark.createDataFrame([("d", text)], "path string, text string")
    assert [(r.lon, r.lat) for r in files.parse_gpx(doc).orderBy("seq").collect()] == [(10.0, 60.0), (10.1, 60.1)]
    tagged = spark.createDataFrame([(1, {"highway": "path", "name": None}, [(1.0, 2.0), (3.0, 4.0)]), (2, {"highway": "path"}, [(3.0, 4.0), (5.0, 6.0)])], "line_id long, tags map<string,string>, coords array<struct<x:double,y:double>>")
    nodes = sinks.osm_nodes(tagged)
    ways = sinks.osm_ways(tagged, nodes)
    assert sorted((r.way_id, r.refs) for r in ways.collect()) == [(1_000_000, [1, 2]), (1_000_001, [2, 3])]
    assert [r.value for r in sinks.osm_xml(nodes, ways).collect()][-1] == '<way id="1000001"><nd ref="2"/><nd ref="3"/><tag k="highway" v="path"/></way>'


def test_osm_json(spark):
    doc = '{"elements":[{"type":"way","id":1,"tags":{"highway":"path"},"geometry":[{"lat":1,"lon":2},{"lat":3,"lon":4}]},{"type":"way","id":2,"tags":{"highway":"path"},"geometry":[{"lat":1,"lon":2}]},{"type":"node","id":3,"lat":5,"lon":6,"tags":{"name":"Hut","amenity":"shelter"}}]}'
    elements = files.osm_elements(spark.createDataFrame([(doc,)], "text string"))
    assert [r.id for r in files.osm_paths(elements).collect()] == [1]
    assert [(r.name, r.kind, r.x) for r in files.osm_points(elements, named=True).collect()] == [("Hut", "shelter", 6.0)]
    with pytest.raises(Exception, match="no elements"):
        files.osm_elements(spark.createDataFrame([("{}",)], "text string")).collect()


def test_point_store(spark, tmp_path):
    store = files.PointStore(spark, str(tmp_path / "store"))
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 1.001, 2.0)], "id long, x double, y double")
    assert store.missing(points).count() == 2
    store.add(spark.createDataFrame([(100, 200, "DTM1", 7.0), (300, 400, "sea", -3.0)], "east long, north long, source string, z double"), 1)
    store.add(spark.createDataFrame([(100, 200, "dtm10", 9.0)], "east long, north long, source string, z double"), 2)
    assert store.missing(points).count() == 0
    assert {r.id: r.z for r in store.heights(points).collect()} == {1: 7.0, 2: None, 3: 7.0}


def test_catalogue(spark, tmp_path):
    good = '[[route]]\nid = 1\nname = "a"\ncategory = "core"\nurl = "https://x.example"\n'
    (tmp_path / "a.toml").write_text(good)
    assert files.load_catalogue(spark, str(tmp_path / "a.toml")).count() == 1
    (tmp_path / "b.toml").write_text(good + good)
    with pytest.raises(ValueError, match="unique"):
        files.load_catalogue(spark, str(tmp_path / "b.toml"))


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id int, v string")
    mark = lambda df, **p: sinks.fingerprint({"a": (df, ["id", "v"])}, p)
    assert mark(a) == mark(a.orderBy(F.desc("id")).repartition(3)) and len(mark(a)) == 16
    assert len({mark(a), mark(a.na.fill("")), mark(a.union(a)), mark(a, step=5), mark(a.where("id < 3"))}) == 5
    b = spark.createDataFrame([("a\x00b", "c"), ("-", "1:x")], "id string, v string")
    assert mark(b) != mark(spark.createDataFrame([("a", "b\x00c"), ("-", "1:x")], "id string, v string"))


def test_stream(spark, sf, tmp_path):
    from linenet.streaming import events

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windowed").count() == events.windowed(batch).count()
    assert math.isclose(spark.table("windowed").agg(F.sum("total")).first()[0], batch.agg(F.sum("value")).first()[0])


def lines_of(spark, lines):
    rows = [(k, [(float(x), float(y)) for x, y in coords]) for k, coords in lines.items()]
    return spark.createDataFrame(rows, "id long, coords array<struct<x: double, y: double>>")


def test_share_of_length_between_far_vertices(spark):
    lines = {1: [(0, 0), (1000, 0)], 2: [(0, 500), (10, 500)], 3: [(500, -200), (500, 200)], 4: [(-50, 8), (50, 8)], 5: [(350, 0), (650, 0)]}
    segs = L.segments(lines_of(spark, lines), ["id"]).withColumn("walked", F.col("id") != 5)
    mark = "x1 double, y1 double, x2 double, y2 double"
    marked = spark.createDataFrame([(200.0, 0.0, 600.0, 0.0), (400.0, 0.0, 800.0, 0.0), (400.0, 5.0, 400.0, 5.0), (0.0, 0.0, 0.0, 0.0)], mark)
    shares = {r.id: r.share for r in L.length_share_within(segs, marked, 10.0).collect()}
    assert shares == pytest.approx({1: 0.63, 2: 0.0, 3: 0.05, 4: 0.12, 5: 1.0}, abs=1e-9)  # both sides of x = 0 and overlaps once
    unmarked = spark.createDataFrame([(0.0, 505.0, 5.0, 505.0), (0.0, 0.0, 1000.0, 0.0)], mark)
    found = {r.id: r.waymarked for r in L.waymarked(segs, marked, unmarked, 10.0).collect()}
    assert found == {1: "marked", 2: "unmarked", 3: "unknown", 4: "unmarked", 5: None}


def test_crowded_marks_are_asked_only_at_their_rim(spark, monkeypatch):
    lines = {1: [(0, 0), (300, 210)], 2: [(-30, 50), (330, 50)], 3: [(150, 40), (150, 80)], 4: [(-500, -500), (-400, -500)]}
    segs = L.segments(lines_of(spark, lines), ["id"])
    marks = [(float(x), float(y), float(x) + 60, float(y)) for x in range(0, 200, 4) for y in range(20, 90, 2)]
    left, table = [], L.settled
    monkeypatch.setattr(L, "settled", lambda df, name="table": left.append((name, table(df, name))) or left[-1][1])
    shares = {r.id: r.share for r in L.length_share_within(segs, spark.createDataFrame(marks, "x1 double, y1 double, x2 double, y2 double"), 10.0).collect()}
    # The marks' union is a box of 0 to 256 by 20 to 88, widened by 10 with arcs between the marks' ends; along both ways by steps.
    steps = 20_000
    near = lambda x, y: any(math.hypot(x - min(max(x, a), c), y - b) <= 10 for a, b, c, _ in marks if abs(b - y) <= 10 and a - 10 <= x <= c + 10)
    for k, ((ax, ay), (bx, by)) in lines.items():
        told = sum(near(ax + (i + 0.5) / steps * (bx - ax), ay + (i + 0.5) / steps * (by - ay)) for i in range(steps)) / steps
        assert shares[k] == pytest.approx(told, abs=2 / steps), k
    asked = [df.count() for name, df in left if name == "pieces"][-1]  # of the pieces of lines, those that meet marks
    assert 0 < asked < 40


def test_intersection_points(spark):
    lines = {
        1: [(0, 0), (10, 0), (20, 10)], 2: [(5, 0), (5, 8)], 3: [(10, -5), (10, 5)], 4: [(2, 0), (8, 0)], 5: [(20, 10), (30, 10)],
        6: [(100, 0), (110, 10), (110, 0), (100, 10)], 7: [(200, 0), (210, 0), (205, 0)], 8: [(300, 0), (310, 0), (305, 9), (300, 0)], 9: [(400, 0), (401, 0), (402, 0)], 10: [(100.5, -10), (100.5, 99)],
    }
    found = L.intersection_points(L.segments(lines_of(spark, lines).withColumnRenamed("id", "line_id"), ["line_id"]), 7.0).collect()
    points = sorted((r.a, r.b, r.x, r.y) for r in found)
    crossing = [(6, 10, 100.5, 0.5), (6, 10, 100.5, 9.5)]
    assert points == sorted([(1, 2, 5, 0), (1, 3, 10, 0), (1, 4, 2, 0), (1, 4, 8, 0), (1, 5, 20, 10), (2, 4, 5, 0), (6, 6, 105, 5), (7, 7, 205, 0), (7, 7, 210, 0), *crossing])


def test_a_point_of_several_segments_counts_once(spark):
    ends = {(1, 0): (1, 0, 6, 5), (1, 1): (2, 3, 6, 1), (2, 0): (0, 0, 10, 7), (2, 1): (3, 0, 4, 7), (2, 2): (4, 1, 2, 5)}  # all through (10/3, 7/3)
    segs = spark.createDataFrame([(*k, *map(float, v)) for k, v in ends.items()], "line_id long, seg int, x1 double, y1 double, x2 double, y2 double")
    found = [(r.a, r.b, r.x, r.y) for r in L.intersection_points(segs, 50.0).where("a < b").collect()]
    assert found == [(1, 2, 3.333333, 2.333333)]


def test_segments_go_to_the_cells_of_their_paths(spark):
    ends = {1: (0, 0, 100, 100), 2: (100, 0, 0, 100), 3: (50, 0, 50, 100), 4: (0, 50, 100, 50)}  # all meet in a corner of four cells
    segs = spark.createDataFrame([(k, 0, *map(float, v)) for k, v in ends.items()], "line_id long, seg int, x1 double, y1 double, x2 double, y2 double")
    cells = {r.line_id: r.n for r in segs.select("line_id", F.size(L.paths(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 10.0)).alias("n")).collect()}
    assert cells[1] <= 44 and cells[3] <= 26  # their box: 121 cells
    met = L.crossing_points(segs, 40.0)
    assert sorted((r.a, r.b, r.x, r.y) for r in met.collect()) == [(a, b, 50.0, 50.0) for a in range(1, 5) for b in range(a + 1, 5)]
    assert L.dealt(segs, ["line_id"], 10.0)[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_clusters_by_small_cells(spark):
    rng, nan = random.Random(3), float("nan")
    crowd = [(rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(400)] + [(100 + rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(60)]
    points = [(i, x, y) for i, (x, y) in enumerate(crowd)] + [(1000, 6.0 + 9.9, 0.0), (1001, -80.0, 0.0), (1002, nan, nan), (1003, nan, nan), (1004, None, 1.0), (1005, None, 1.0)]
    root = {i: i for i, _, _ in points}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, ax, ay in points:
        for j, bx, by in points:
            if i < j and None not in (ax, bx) and math.hypot(ax - bx, ay - by) <= 10:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    frame = spark.createDataFrame(points, "id long, x double, y double")
    assert {r.vertex: r.component for r in N.clusters(frame, 10.0).collect()} == {i: top(i) for i in root}
    assert N._links(frame.where("id < 400").selectExpr("id", "x", "y", "0L AS label"), 10.0).count() == 0  # one cluster: no pairs


def test_wider_way_rounds_halves_up(spark):
    from linenet.operators import quality as Q

    found = spark.createDataFrame([(1, 1.0, 526384.9999999999), (2, 1.0, 526385.0000000001), (3, 1.0, 520795.0), (4, 5.0, 5.5)], "k int, m double, whole double")
    assert {r.k: r.whole_km for r in Q.wider_way(found, "m").collect()} == {1: 526.39, 2: 526.39, 3: 520.8, 4: None}


def test_share_within_many_marks(spark):
    """Every sample near every mark: 3,000 x 100,000 comparisons before; cells that a mark covers whole need none."""
    rng = random.Random(5)
    marks = [(x, y, x + 300.0, y) for x, y in ((rng.uniform(-250, -50), rng.uniform(-5, 5)) for _ in range(3000))]
    samples = spark.range(100000).select((F.col("id") % 10).alias("id"), F.col("id").alias("k"), (F.col("id") % 40).cast("double").alias("x"), F.when(F.col("id") % 10 < 5, F.col("id") % 13).otherwise(200.0).alias("y"))
    frame = spark.createDataFrame(marks, "x1 double, y1 double, x2 double, y2 double")
    plans = L.share_within(samples, frame, 25.0)
    assert {r.id: r.share for r in plans.collect()} == {i: 1.0 if i < 5 else 0.0 for i in range(10)}
    few = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 25), (0, 25.001), (10, -25), (335, 0), (-25, 0), (-18, 18)])], "id int, k int, x double, y double")
    one = spark.createDataFrame([(0.0, 0.0, 310.0, 0.0)], frame.schema)
    assert [r.share for r in L.share_within(few, one, 25.0).collect()] == [4 / 6]
