"""Queries on codes, texts, column profiles, registers and series, with SQL that states each rule by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from linenet.functions import codes, text as X
from linenet.operators import areas as A
from linenet.operators import quality as Q
from linenet.operators import series as S
from linenet.plans.catalogue import SERIES, _series, query
from linenet.plans.tables import CU, V
from linenet.sources import files, registers as R, sinks

TYPES = codes.CodeTable({"ECONOMY": {"en": ("Economy", "cheap"), "no": ("Rimelig", "billig")}, "STANDARD": {"en": ("Standard", "usual"), "no": ("Vanlig", "som oftest")}, "24": {"en": ("Economy", "another code")}})


@query("p02_process", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Rimelig' WHEN 'STANDARD' THEN 'Vanlig' ELSE p_type END AS slag, p_size::VARCHAR AS code, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT END AS number, CASE WHEN p_partkey % 3 <> 0 THEN p_size = 7 END AS flag FROM part")
def _(t):
    raw = t.part.select(F.col("p_partkey"), "p_type", F.col("p_size").cast("double").alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".7"))).otherwise("n/a").alias("number"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_size") == 7, "true").otherwise("false").alias("flag"))
    done = codes.process(raw, {"p_type": "string", "code": "code", "number": "integer", "flag": "boolean"}, {"p_type": TYPES}, {"p_type": {"no": "slag"}, "gone": {"no": "borte"}}, "no")
    return done


@query("p03_labels_and_back", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Economy' WHEN 'STANDARD' THEN 'Standard' ELSE p_type END AS label, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'STANDARD' THEN 'usual' END AS described, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_type END AS back FROM part")
def _(t):
    label = TYPES.label(F.col("p_type"), "en")
    return t.part.select("p_partkey", label.alias("label"), TYPES.description(F.col("p_type"), "en").alias("described"), TYPES.code(label, "en").alias("back"))


@query("p04_translated_names", "SELECT p_partkey AS nummer, p_name AS navn, p_size FROM part")
def _(t):
    return codes.renamed(t.part.select("p_partkey", "p_name", "p_size"), {"p_partkey": {"no": "nummer"}, "p_name": {"no": "navn"}, "p_size": {"en": "size"}}, "no")


@query("p05_importance", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 3 END AS rank FROM part")
def _(t):
    return t.part.select("p_partkey", X.rank_of(F.col("p_type"), ["PROMO", "STANDARD", "ECONOMY"]).alias("rank"))


@query("p06_label_passthrough", "SELECT s_suppkey, CASE s_nationkey WHEN 3 THEN 'three' WHEN 15 THEN 'fifteen' ELSE s_nationkey::VARCHAR END AS label FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", X.label(F.col("s_nationkey").cast("double"), {"3": "three", "15": "fifteen"}).alias("label"))


@query("p07_capture_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS captured FROM orders")
def _(t):
    said = F.when(F.col("o_orderkey") % 4 == 0, "no date").when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", X.capture_date(said).alias("captured"))


@query("p09_identities", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN [p_brand] ELSE [p_brand, p_type] END AS identities FROM part")
def _(t):
    return t.part.select("p_partkey", X.identities(F.concat_ws(" / ", "p_brand", "p_type", F.lit("Ukjent"), "p_brand"), ("Ukjent", "ECONOMY")).alias("identities"))


@query("p12_osm_tags", "SELECT p_partkey, 'kind=' || lower(p_type) || ';name=' || p_name || ';ref=' || p_brand || CASE WHEN p_name LIKE '%widget%' THEN ';surface=wide' WHEN p_name LIKE '%a%' THEN ';surface=any' ELSE '' END || ';x:source=made' AS tags FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') UNION ALL SELECT p_partkey, 'name=' || p_name || ';ref=' || p_brand || CASE WHEN p_name LIKE '%widget%' THEN ';surface=wide' WHEN p_name LIKE '%a%' THEN ';surface=any' ELSE '' END || ';x:source=made' FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD')")
def _(t):
    fields = {"name": (F.col("p_name"), None), "ref": (F.col("p_brand"), None), "kind": (F.col("p_type"), {"ECONOMY": "economy", "STANDARD": "standard"}), "note": (F.lit("  "), None)}
    tags = X.osm_tags(fields, [("surface", F.col("p_name"), "widget", "wide"), ("surface", F.col("p_name"), "a", "any"), ("name", F.col("p_name"), ".", "never")], {"x:source": "made", "ref": "never"})
    return t.part.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags"))


@query("p14_sentences", "SELECT s_suppkey, nullif(concat_ws(' · ', CASE WHEN abs(s_acctbal) >= 50 THEN format('{:,.1f}', round_even(abs(s_acctbal), 0) / 1000) || ' km marked' END, CASE WHEN s_nationkey >= 5 THEN format('{:,.1f}', s_nationkey * 20 / 1000) || ' km unmarked' END), '') AS marking, '+' || format('{:,}', floor(abs(s_acctbal) + 0.5)::BIGINT) || ' / −' || s_nationkey || ' m' || CASE WHEN s_suppkey % 2 = 0 THEN ' towards ' || s_name ELSE '' END AS climb FROM supplier")
def _(t):
    marked, off = F.rint(F.abs("s_acctbal")), (F.col("s_nationkey") * 20).cast("double")
    climb = X.climb_text(F.abs("s_acctbal"), F.col("s_nationkey").cast("double"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")))
    return t.supplier.select("s_suppkey", X.described([("marked", F.when(F.abs("s_acctbal") >= 50, F.greatest(marked, F.lit(50.0)))), ("unmarked", F.when(F.col("s_nationkey") >= 5, off))]).alias("marking"), climb.alias("climb"))


@query("p16_popups", "SELECT p_partkey, '<table><tr><th>Name</th><td>' || replace(replace(replace(p_name || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>' || CASE WHEN p_size > 20 THEN '<tr><th>Size</th><td>' || p_size || '</td></tr>' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '<tr><td colspan=\"2\"><a href=\"https://x.example/' || p_partkey || '\">More</a></td></tr>' ELSE '' END || '</table>' AS html FROM part")
def _(t):
    link = F.concat(F.when(F.col("p_partkey") % 2 == 0, "https").otherwise("javascript"), F.lit("://x.example/"), F.col("p_partkey").cast("string"))
    fields = {"Name": F.concat("p_name", F.lit(" <&>")), "Size": F.when(F.col("p_size") > 20, F.col("p_size")), "Blank": F.lit(" ")}
    return t.part.select("p_partkey", X.popup(fields, {"More": link}).alias("html"))


PROFILE = " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS name, count(*) AS n_rows, count({c}) AS n_known, round(100.0 * count({c}) / count(*), 1) AS pct, count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) = count({c}) AS is_unique, min({c})::VARCHAR AS least, count(*) FILTER ({c} = (SELECT min({c}) FROM src)) AS n_least, max({c})::VARCHAR AS most, count(*) FILTER ({c} = (SELECT max({c}) FROM src)) AS n_most, {mean} AS mean, (SELECT string_agg(v || '=' || n, ', ' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top FROM src"
    for i, (c, mean) in enumerate([("event_type", "NULL::DOUBLE"), ("user_id", "round(avg(user_id), 2)"), ("hour", "round(avg(hour), 2)")])
)


@query("a02_describe_columns", f"WITH src AS (SELECT event_type, user_id, CASE WHEN event_type <> 'error' THEN extract(hour FROM ts)::INT END AS hour FROM events) {PROFILE}")
def _(t):
    rows = t.events.select("event_type", "user_id", F.when(F.col("event_type") != "error", F.hour("ts")).alias("hour"))
    return Q.describe_columns(rows, ["event_type", "unknown", "user_id", "hour"], by_completeness=True)


WAYS = "p AS (SELECT p_partkey, p_retailprice, unnest(list_distinct([p_brand, p_type, 's' || p_size % 10])) AS part FROM part), q AS (SELECT DISTINCT a.p_partkey AS k, b.p_partkey AS o, b.p_retailprice AS m FROM p a JOIN p b ON a.part = b.part AND a.part <> 's3'), w AS (SELECT k, sum(m) AS whole FROM q GROUP BY 1)"


def _ways(t):
    rows = t.part.withColumn("identity", F.concat_ws(" / ", "p_brand", "p_type", F.concat(F.lit("s"), (F.col("p_size") % 10).cast("string")))).withColumn("source", F.lit("part"))
    return Q.whole_way(rows, "p_partkey", "source", "identity", "p_retailprice", ["s3"])


@query("a04_whole_way_of_any_parts", f"WITH {WAYS} SELECT k AS p_partkey, round(whole, 2) AS whole FROM w")
def _(t):
    return _ways(t).select("p_partkey", F.round("whole", 2).alias("whole"))


@query("a05_wider_way", f"WITH {WAYS} SELECT k AS p_partkey, CASE WHEN whole > p_retailprice + 1 THEN round(whole / 1000, 2) END AS whole_km FROM w JOIN part ON p_partkey = k")
def _(t):
    return Q.wider_way(_ways(t), "p_retailprice").select("p_partkey", "whole_km")


@query("a12_top_and_rest", "WITH m AS (SELECT o_custkey::VARCHAR AS name, sum(o_totalprice) AS metres FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY metres DESC, name) AS k FROM m) SELECT CASE WHEN k <= 8 THEN name END AS name, round(sum(metres), 1) AS metres, count(*) AS n FROM r GROUP BY 1")
def _(t):
    counts = t.orders.groupBy(F.col("o_custkey").cast("string").alias("who")).agg(F.sum("o_totalprice").alias("metres"))
    return Q.top_and_rest(counts, "who", "metres").withColumn("metres", F.round("metres", 1))


@query("a15_shares", "SELECT event_type AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM events GROUP BY 1")
def _(t):
    return Q.shares(t.events, "event_type")


@query("a17_cardinality_figures", "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS n_keys, min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, median(n)::DOUBLE AS median, CASE max(n) WHEN 1 THEN '1:1' WHEN 2 THEN '1:2' ELSE '1:N' END AS relation FROM c")
def _(t):
    return Q.cardinality_figures(t.lineitem, "l_orderkey")


@query("a18_length_statistics", f"WITH {V}, m AS (SELECT line_id, sum(len) AS m FROM s GROUP BY 1) SELECT round(sum(m), 2) AS total, round(avg(m), 4) AS mean, round(median(m), 4) AS median FROM m")
def _(t):
    from linenet.functions import geometry as G

    m = t.lines().select(G.length(F.col("coords")).alias("m"))
    return m.agg(F.round(F.sum("m"), 2).alias("total"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.median("m"), 4).alias("median"))


@query("q01_issues", f"WITH {V}, i AS (SELECT line_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l GROUP BY 1), f AS (SELECT o_orderkey + 5 AS k FROM orders) SELECT * FROM (SELECT 'orphan attributes' AS rule, 'issue' AS level, count(DISTINCT k) AS n FROM f WHERE k NOT IN (SELECT line_id FROM i) UNION ALL SELECT 'unreferenced geometry', 'warning', count(*) FROM i WHERE line_id NOT IN (SELECT k FROM f) UNION ALL SELECT 'outside of bounds', 'issue', count(*) FROM i WHERE x0 < 10 OR x1 > 1040 OR y0 < 5 OR y1 > 1005 UNION ALL SELECT 'missing columns', 'issue', 1 UNION ALL SELECT 'fewer rows', CASE WHEN d > 200 THEN 'issue' ELSE 'warning' END, CASE WHEN d > 50 THEN floor(d)::BIGINT ELSE 0 END FROM (SELECT 1000 * (1 - (SELECT count(*) FROM i) / (SELECT count(*) FROM orders)::DOUBLE) AS d)) WHERE n > 0")
def _(t):
    attributes = t.orders.select((F.col("o_orderkey") + 5).alias("fk"), "o_orderstatus")
    return Q.issues(t.lines(), attributes, "line_id", "fk", ["line_id", "o_orderstatus", "no_such"], (10.0, 5.0, 1040.0, 1005.0), t.orders.count())


# --- registers -------------------------------------------------------------------------------------------------------


@query("s01_feed_entries", "SELECT o_orderkey::VARCHAR AS id, 'Order ' || o_orderstatus AS title, o_orderdate AS updated, 'https://x.example/' || o_orderkey AS link FROM orders")
def _(t):
    entry = F.concat(F.lit("<entry><id>"), F.col("o_orderkey").cast("string"), F.lit('</id><title type="text">Order '), F.col("o_orderstatus"), F.lit("</title><updated>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('</updated><link rel="x" href="https://x.example/'), F.col("o_orderkey").cast("string"), F.lit('"/></entry>'))
    feeds = t.orders.groupBy((F.col("o_orderkey") % 50).alias("k")).agg(F.concat(F.lit("<feed><title>F</title>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>")).alias("text"))
    return R.feed_entries(feeds).withColumn("updated", F.col("updated").cast("timestamp_ntz"))


@query("s04_layers", "SELECT kommune, layer, count(*) AS n, count(s_name) AS suppliers FROM (SELECT CASE c_nationkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS kommune, 'customers' AS layer, NULL AS s_name FROM customer UNION ALL SELECT 'b', 'suppliers', s_name FROM supplier) GROUP BY 1, 2")
def _(t):
    archives = {"b": {"customers": t.customer.where("c_nationkey % 2 = 1"), "suppliers": t.supplier}, "a": {"customers": t.customer.where("c_nationkey % 2 = 0"), "other": t.part}}
    return R.load_layers(archives, ["customers", "suppliers"]).groupBy("kommune", "layer").agg(F.count(F.lit(1)).alias("n"), F.count("s_name").alias("suppliers"))


@query("s06_roads", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linestatus WHEN 'O' THEN 'open' ELSE l_linestatus END AS category, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def _(t):
    found = R.roads(t.lineitem, ["A", "R"], {"O": "open"}, "l_returnflag", "l_linestatus")
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey", "category").agg(F.count(F.lit(1)).alias("n"))


@query("s07_cabins", "SELECT p_partkey, coalesce(CASE WHEN p_size < 10 THEN 'level ' || p_size END, 'Promoted') AS kind FROM part WHERE p_size < 10 OR p_type = 'PROMO'")
def _(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") < 10, F.concat(F.lit("level "), F.col("p_size").cast("string"))).alias("service_level"), F.col("p_type").alias("building_type"))
    return R.cabins(rows, {"PROMO": "Promoted"}).select("p_partkey", "kind")


@query("g26_label_points", f"WITH {CU} SELECT id, round(x + 3, 4) AS x, round(y + 2, 2) AS y FROM cu")
def _(t):
    c = t.customers()
    p = R.label_point(A.box_rings(F.col("x"), F.col("y"), F.col("x") + 6, F.col("y") + 4))
    return c.select("id", F.round(p["x"], 4).alias("x"), F.round(p["y"], 2).alias("y"))


@query("s08_place_names", "SELECT p_partkey, p_name AS name FROM part WHERE p_type IN ('PROMO', 'ECONOMY') AND p_partkey % 5 <> 0")
def _(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(" ").alias("name"), F.col("p_type").alias("kind"))
    return R.place_names(rows, ["PROMO", "ECONOMY"]).select("p_partkey", "name")


@query("s09_main_spellings", "SELECT c_nationkey AS place_id, arg_min(o_orderpriority || '-' || o_orderkey, o_orderkey) AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY 1")
def _(t):
    spellings = t.orders.select(F.col("o_custkey").alias("name_id"), F.concat_ws("-", "o_orderpriority", "o_orderkey").alias("spelling"), F.col("o_orderkey").alias("row_id"))
    names = t.customer.select(F.col("c_custkey").alias("name_id"), F.col("c_nationkey").alias("place_id"), F.col("c_mktsegment").alias("status"))
    return R.main_names(spellings, names, ("BUILDING", "FURNITURE"))


@query("s11_ranked_places", f"WITH {V} SELECT n_nationkey AS place_id, n_name AS name, CASE n_regionkey WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS rank, x, y FROM v JOIN nation ON line_id % 25 = n_nationkey WHERE n_regionkey <> 3 AND l_returnflag = 'A'")
def _(t):
    points = t.vertices().where("l_returnflag = 'A'").groupBy((F.col("line_id") % 25).alias("place_id")).agg(F.collect_list(F.struct("x", "y")).alias("points"))
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("place_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("importance"), F.when(F.col("n_regionkey") == 3, "off").otherwise("on").alias("kind"))
    places = points.join(names.select("place_id", "importance", "kind"), "place_id")
    return R.ranked_places(places, names.select("place_id", "name"), ["2", "0"], ["on"]).select(F.col("place_id").cast("int").alias("place_id"), "name", "rank", "x", "y")


@query("s12_find", "SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), 'WIDGET') OR p_type = 'PROMO'")
def _(t):
    part = t.part.select("p_partkey", "p_name", "p_type")
    both = R.find(part, "p_name", "Widget").unionByName(R.find(part, "p_type", "PROMO", exact=True)).unionByName(R.find(part, "p_name", "%")).unionByName(R.find(part, "p_type", "PR_MO"))
    return both.select("p_partkey", "p_name").distinct()


@query("s13_lines_within", f"WITH {V}, b AS (SELECT line_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l GROUP BY 1) SELECT line_id FROM b WHERE x0 <= 300 AND x1 >= 250 AND y0 <= 120 AND y1 >= 100")
def _(t):
    return R.within(R.boxes_of(t.lines()), (250.0, 100.0, 300.0, 120.0), 10_000_000).select("line_id")


@query("s17_pages", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    pages = t.orders.groupBy(F.floor(F.col("o_orderkey") / 100).cast("long").alias("page")).agg(F.collect_list(F.struct("o_orderkey", "o_custkey")).alias("rows"))
    return R.paged(pages, t.orders.count(), 100)


@query("s20_places", "SELECT event_id AS id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS name, CASE WHEN event_id % 2 = 0 THEN 'hut' WHEN event_id % 3 = 0 THEN 'shelter' END AS kind, value AS x, user_id::DOUBLE AS y FROM events")
def _(t):
    tags = F.map_filter(F.create_map(F.lit("name"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).otherwise(""), F.lit("tourism"), F.when(F.col("event_id") % 2 == 0, "hut").otherwise(""), F.lit("amenity"), F.when(F.col("event_id") % 3 == 0, "shelter")), lambda k, v: v.isNotNull())
    element = F.struct(F.lit("node").alias("type"), F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("lat"), F.col("value").alias("lon"), tags.alias("tags"))
    documents = t.events.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("text"))
    return files.osm_points(files.osm_elements(documents))


@query("s24_routes", f"WITH {V} SELECT line_id AS id, 'r' || line_id AS name, round(sum(len) / 1000, 2) AS length_km, count(*) + 1 AS n_vertices FROM s GROUP BY 1, 2")
def _(t):
    points = t.lines().select(F.col("line_id").alias("id"), F.posexplode("coords").alias("seq", "p")).select("id", F.lit(0).alias("part"), "seq", "p.x", "p.y")
    catalogue = t.lines().select(F.col("line_id").alias("id"), F.concat(F.lit("r"), F.col("line_id").cast("string")).alias("name"))
    return R.load_routes(catalogue, points).select("id", "name", "length_km", "n_vertices")


@query("s25_batches_and_readings", f"WITH {V} SELECT DISTINCT round_even(x * 100, 0)::BIGINT AS east, round_even(y * 100, 0)::BIGINT AS north, CASE WHEN round_even(x * 100, 0) % 700 <> 0 THEN round_even(y * 100, 0) / 7 END AS z FROM v")
def _(t):
    asked = R.batches(files.PointStore.keys(t.vertices().select("x", "y")))
    given = F.transform("asked", lambda p: F.struct(F.when(p["east"] % 700 == 0, "srtm").otherwise("DTM10").alias("datakilde"), (p["north"] / 7).alias("z")))
    return R.readings(asked.withColumn("given", given))


@query("k15_area_table", f"WITH {CU} SELECT id AS area_id, round(x / 7, 6) AS x0, round(y / 7 + 6, 6) AS y1, 4 AS n FROM cu")
def _(t):
    table = R.area_table(t.customers().select(F.col("id").alias("area_id"), A.box_rings(F.col("x") / 7, F.col("y") / 7, F.col("x") / 7 + 5, F.col("y") / 7 + 6).alias("rings")))
    return table.select("area_id", F.get("bounds", F.lit(0)).alias("x0"), F.get("bounds", F.lit(3)).alias("y1"), F.size(F.get("rings", F.lit(0))).alias("n"))


@query("k16_edge_costs", "SELECT r_name AS source, CASE WHEN r_regionkey <> 2 THEN 1 + r_regionkey / 10 END AS factor, CASE WHEN r_regionkey = 2 THEN 5000.0::DOUBLE END AS flat_m FROM region UNION ALL SELECT 'bridge', 1.3, NULL")
def _(t):
    sources = t.region.select(F.col("r_name").alias("source"), F.when(F.col("r_regionkey") == 2, "ferry").otherwise("path").alias("kind"), (1 + F.col("r_regionkey") / 10).alias("factor"))
    return R.edge_costs(sources, 5_000.0, 1.3)


@query("p18_credits", "SELECT 'L' || n_regionkey AS licence, '© Region ' || n_regionkey || ': ' || string_agg(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' (' || n_nationkey || ')' ELSE '' END, ', ' ORDER BY n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' (' || n_nationkey || ')' ELSE '' END) || '. L' || n_regionkey AS line FROM nation GROUP BY n_regionkey")
def _(t):
    region = F.col("n_regionkey").cast("string")
    return R.credits(t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("L"), region).alias("licence"), F.concat(F.lit("Region "), region).alias("attribution"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(" ").alias("version")))


@query("k01_gpx_tracks", f"WITH {V} SELECT line_id, '<trk><name>A &amp; ' || line_id || '</name><desc>n: ' || count(*) || '</desc><extensions><m>' || printf('%.1f', line_id / 4) || '</m></extensions><trkseg>' || string_agg(printf('<trkpt lat=\"%.7f\" lon=\"%.7f\"></trkpt>', y, x), '' ORDER BY rn) || '</trkseg></trk>' AS xml FROM l GROUP BY line_id")
def _(t):
    rows = t.lines().select("line_id", F.concat(F.lit("A & "), F.col("line_id").cast("string")).alias("name"), F.size("coords").alias("n"), (F.col("line_id") / 4).alias("m"), F.lit(" ").alias("blank"), "coords")
    xml = sinks.tracks_xml(rows, "name", described=("n", "blank"), figures=("m",))
    return xml.select(F.regexp_extract("value", "<name>A &amp; (.*?)</name>", 1).cast("long").alias("line_id"), F.col("value").alias("xml"))


# --- series ----------------------------------------------------------------------------------------------------------


@query("w06_gradients", f"WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm) AS i FROM e), h AS (SELECT a.user_id, a.i, min(b.i) FILTER (b.tm >= a.tm - 43200) AS lo, coalesce(min(b.i) FILTER (b.tm >= a.tm + 43200), max(b.i)) AS hi FROM r a JOIN r b ON b.user_id = a.user_id WHERE a.z IS NOT NULL GROUP BY 1, 2), ab AS (SELECT h.user_id, h.i, min(r.i) FILTER (r.z IS NOT NULL AND r.i <= h.i) AS a, max(r.i) FILTER (r.z IS NOT NULL AND r.i >= h.i) AS b FROM h JOIN r ON r.user_id = h.user_id AND r.i BETWEEN h.lo AND h.hi GROUP BY 1, 2), g AS (SELECT r.event_id, CASE WHEN y.tm - x.tm >= 600 THEN 100 * (y.z - x.z) / (y.tm - x.tm) END AS slope FROM ab JOIN r ON r.user_id = ab.user_id AND r.i = ab.i JOIN r x ON x.user_id = ab.user_id AND x.i = ab.a JOIN r y ON y.user_id = ab.user_id AND y.i = ab.b) SELECT event_id, round(slope, 6) AS slope, CASE WHEN abs(coalesce(slope, 0)) * 1000 < 15 THEN 0 WHEN abs(slope) * 1000 < 25 THEN 1 WHEN abs(slope) * 1000 < 40 THEN 2 ELSE 3 END AS band FROM g")
def _(t):
    g = S.gradients(_series(t), "user_id", "at", "z", 43200, 600.0)
    return g.select("event_id", F.round("slope", 6).alias("slope"), S.band(F.col("slope") * 1000).alias("band"))


@query("w08_draw_points", f"WITH {SERIES}, r AS (SELECT user_id, tm - 1704067200 AS tm, z, count(*) OVER p AS n, max(tm - 1704067200) OVER p AS total, count(*) FILTER (z IS NULL) OVER (PARTITION BY user_id ORDER BY tm) AS missed FROM e WINDOW p AS (PARTITION BY user_id)), s AS (SELECT user_id, greatest(0, least(39, floor(tm / total * 40))) AS slot, any_value(total) AS total, min(z) AS low, max(z) AS high, arg_min(tm, {{'z': z, 't': tm}}) AS low_at, arg_min(tm, {{'z': -z, 't': tm}}) AS high_at, min(missed) AS gap, max(missed) AS after FROM r WHERE n > 40 AND z IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, gap > lag(after) OVER (PARTITION BY user_id ORDER BY slot) AS opens FROM s), d AS (SELECT user_id, (slot + 0.5) / 40 * total AS mm, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY slot) AS run, unnest(CASE WHEN low = high THEN [low] WHEN low_at <= high_at THEN [low, high] ELSE [high, low] END) AS value FROM o UNION ALL SELECT user_id, tm, dense_rank() OVER (PARTITION BY user_id ORDER BY missed) - 1, z FROM r WHERE n <= 40 AND z IS NOT NULL) SELECT user_id, round(mm, 4) AS m, run, value FROM d")
def _(t):
    rows = _series(t).withColumn("at", F.col("at") - 1704067200)
    return S.draw_points(rows, "user_id", "at", "z", 40).select("user_id", F.round("at", 4).alias("m"), "run", "value")


@query("m13_pair_keys", "SELECT least(o_custkey, o_orderkey) AS lo, greatest(o_custkey, o_orderkey) AS hi, count(*) AS n, count(*) FILTER (o_custkey > o_orderkey) AS turned FROM orders GROUP BY 1, 2")
def _(t):
    keyed = t.orders.select(S.pair_key(F.col("o_custkey"), F.col("o_orderkey")).alias("k"))
    return keyed.groupBy("k.lo", "k.hi").agg(F.count(F.lit(1)).alias("n"), F.count_if("k.turned").alias("turned"))
