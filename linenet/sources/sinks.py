"""Sinks: GPX and OSM XML as text rows, OSM tags, fingerprints, and the compact graph payload."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escaped(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fixed(value: Column, decimals: int) -> Column:
    """With as many decimals, halves to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals))


def tracks_xml(lines: DataFrame, name: str = "name", described: tuple[str, ...] = (), figures: tuple[str, ...] = ()) -> DataFrame:
    """lines: name, coords (x = longitude, y = latitude, optionally z) or parts (an array of such). One <trk> text per line, a
    segment per part; heights with two decimals where known, the fields that say something as description, and figures
    with one decimal as extensions."""
    lines = lines if "parts" in lines.columns else lines.withColumn("parts", F.array("coords"))
    has_z = "z" in [f.name for f in lines.schema["parts"].dataType.elementType.elementType.fields]

    def point(p):
        at = F.format_string('<trkpt lat="%.7f" lon="%.7f">', p["y"], p["x"])
        ele = F.when(p["z"].isNotNull() & ~F.isnan(p["z"]), F.concat(F.lit("<ele>"), fixed(p["z"], 2), F.lit("</ele>"))).otherwise("") if has_z else F.lit("")
        return F.concat(at, ele, F.lit("</trkpt>"))

    kept = F.filter("parts", lambda c: F.size(c) > 1)
    body = F.array_join(F.transform(kept, lambda c: F.concat(F.lit("<trkseg>"), F.array_join(F.transform(c, point), ""), F.lit("</trkseg>"))), "")
    said = F.concat_ws("; ", *[F.when(F.trim(F.col(d).cast("string")) != "", F.concat(F.lit(f"{d}: "), F.trim(F.col(d).cast("string")))) for d in described]) if described else F.lit("")
    desc = F.when(said != "", F.concat(F.lit("<desc>"), escaped(said), F.lit("</desc>"))).otherwise("")
    more = F.concat_ws("", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"<{f}>"), fixed(F.col(f).cast("double"), 1), F.lit(f"</{f}>"))) for f in figures]) if figures else F.lit("")
    extra = F.when(more != "", F.concat(F.lit("<extensions>"), more, F.lit("</extensions>"))).otherwise("")
    return lines.where(F.size(kept) > 0).select(F.concat(F.lit("<trk><name>"), escaped(F.col(name)), F.lit("</name>"), desc, extra, body, F.lit("</trk>")).alias("value"))


def waypoints_xml(points: DataFrame) -> DataFrame:
    """points: name, x, y. One <wpt> text each."""
    return points.select(F.concat(F.format_string('<wpt lat="%.7f" lon="%.7f"><name>', "y", "x"), escaped(F.col("name")), F.lit("</name></wpt>")).alias("value"))


def gpx_head(title: str, description: str = "", credits: tuple[tuple[str, str, str], ...] = ()) -> str:
    """credits: name, licence, address. Each licence is said once for people, and its address once for machines."""
    own = lambda v: html.escape(v, quote=True)
    said: dict[str, list[str]] = {}
    for name, licence, _ in credits:
        said.setdefault(licence, []).append(name)
    lines = [description] * bool(description) + [f"{', '.join(dict.fromkeys(names))}: {licence}" for licence, names in said.items()]
    links = "".join(f'<link href="{own(a)}"/>' for a in dict.fromkeys(address for _, _, address in credits if address.startswith(("http://", "https://"))))
    desc = f"<desc>{own('; '.join(lines))}</desc>" if lines else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="linenet" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>{own(title)}</name>{desc}{links}</metadata>'


def write_gpx(lines: DataFrame, path: str, title: str, name: str = "name", most: int | None = None, waypoints: DataFrame | None = None, **about) -> None:
    """A folder of GPX 1.1 documents, one for each partition, written by the executors; waypoints come first. most: as many
    lines, by line_id. about: description and credits of the head; described and figures of the tracks."""
    head = gpx_head(title, about.pop("description", ""), about.pop("credits", ()))
    rows = tracks_xml(lines if most is None else lines.orderBy("line_id").limit(most), name, **about).withColumn("o", F.lit(1))
    if waypoints is not None:
        rows = waypoints_xml(waypoints).withColumn("o", F.lit(0)).coalesce(1).unionByName(rows)
    part = rows.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id())
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "k", "value"))), lambda v: v["value"])
    whole = part.groupBy("part").agg(F.concat(F.lit(head), F.array_join(listed, ""), F.lit("</gpx>")).alias("value"))
    whole.select("value").write.text(path)


def osm_nodes(lines: DataFrame) -> DataFrame:
    """lines: line_id, coords. Nodes by coordinates rounded to seven decimals: key, node_id (from 1, in order of first appearance), lon, lat as first seen."""
    p = lines.select("line_id", F.posexplode("coords").alias("seq", "p")).select("line_id", "seq", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    key = F.format_string("%.7f %.7f", "lon", "lat")
    first = p.groupBy(key.alias("key")).agg(F.min(F.struct("line_id", "seq", "lon", "lat")).alias("f"))
    ordered = first.select("key", F.col("f.line_id").alias("line_id"), F.col("f.seq").alias("seq"), F.col("f.lon").alias("lon"), F.col("f.lat").alias("lat"))
    per_line = ordered.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
    before = per_line.withColumn("before", F.sum("n").over(Window.orderBy("line_id")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("line_id").orderBy("seq"))
    return ordered.withColumn("rn", within).join(before, "line_id").select("key", (F.col("before") + F.col("rn")).alias("node_id"), "lon", "lat")


def osm_ways(lines: DataFrame, nodes: DataFrame, first_id: int = 1_000_000) -> DataFrame:
    """lines: line_id, tags, coords. way_id, refs, tags (those that say something)."""
    p = lines.select("line_id", F.posexplode("coords").alias("seq", "p")).select("line_id", "seq", F.format_string("%.7f %.7f", "p.x", "p.y").alias("key"))
    refs = p.join(nodes.select("key", "node_id"), "key").groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda r: r["node_id"]).alias("refs"))
    number = F.row_number().over(Window.orderBy("line_id")) - 1 + first_id
    return lines.select("line_id", F.map_filter("tags", lambda k, v: v.isNotNull() & (F.trim(v) != "")).alias("tags")).join(refs, "line_id").select(number.alias("way_id"), "line_id", "refs", "tags")


def osm_xml(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Text rows of the document's elements, nodes first."""
    n = nodes.select(F.lit(0).alias("o"), F.col("node_id").alias("id"), F.format_string('<node id="%d" lat="%s" lon="%s"/>', "node_id", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("value"))
    refs = F.array_join(F.transform("refs", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit('<tag k="'), escaped(e["key"]), F.lit('" v="'), escaped(e["value"]), F.lit('"/>'))), "")
    w = ways.select(F.lit(1).alias("o"), F.col("way_id").alias("id"), F.concat(F.lit('<way id="'), F.col("way_id").cast("string"), F.lit('">'), refs, tags, F.lit("</way>")).alias("value"))
    return n.unionByName(w).orderBy("o", "id").select("value")


def fingerprint(tables: dict[str, tuple[DataFrame, list[str]]], params: dict | None = None) -> str:
    """16 hex digits over several tables (sources, masks, areas), whatever the order of their rows, and parameters. Values are
    told apart by their lengths, a null from any text; a row is its SHA-256, and a table the count of its rows and the sums
    of their digests' four quarters, which copies of a row change too."""
    said = [json.dumps(params or {}, sort_keys=True, default=str)]
    for name, (rows, columns) in sorted(tables.items()):
        text = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
        digest = F.sha2(F.concat_ws(",", *text), 256)
        quarter = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
        found = rows.agg(F.count(F.lit(1)), *[F.sum(q) for q in quarter]).first()
        said.append(f"{name} {columns} {[str(v) for v in found]}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:16]


def zigzag(v: int) -> int:
    return v * 2 if v >= 0 else -v * 2 - 1


def varint(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def checksum(values: list[int]) -> tuple[int, int]:
    a, b = 1, 0
    for v in values:
        a = (a + v) % (1 << 32)
        b = (b + a) % (1 << 32)
    return a, b


def encode_graph(edges: list[dict], quantum: float = 1e-6, step: float = 0.01) -> str:
    """edges: a, b, coords [(x, y)], heights [float or None]. Deltas as zig-zag varints, gaps as 0; gzip, base64.
    A payload is one region's graph for one page; it is made on the driver from rows of that region."""
    numbers: list[int] = [len(edges)]
    before = 0
    for e in edges:
        numbers += [zigzag(e["a"] - before), zigzag(e["b"] - e["a"]), len(e["coords"]), len(e["heights"])]
        before = e["b"]
        x0 = y0 = z0 = 0
        for x, y in e["coords"]:
            x, y = round(x / quantum), round(y / quantum)
            numbers += [zigzag(x - x0), zigzag(y - y0)]
            x0, y0 = x, y
        for z in e["heights"]:
            if z is None:
                numbers.append(0)
            else:
                numbers.append(zigzag(round(z / step) - z0) + 1)
                z0 = round(z / step)
    head = json.dumps({"quantum": quantum, "step": step, "check": checksum(numbers)}).encode()
    body = varint(len(head)) + head + b"".join(map(varint, numbers))
    return base64.b64encode(gzip.compress(body, 9, mtime=0)).decode()


def decode_graph(payload: str) -> list[dict]:
    """The inverse; bytes left over or a wrong checksum raise ValueError."""
    body = gzip.decompress(base64.b64decode(payload))
    at = 0

    def take() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = body[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    size = take()
    head = json.loads(body[at : at + size])
    at += size
    numbers = []
    while at < len(body):
        numbers.append(take())
    if list(checksum(numbers)) != head["check"]:
        raise ValueError("checksum")
    it = iter(numbers)
    back = lambda v: v >> 1 if v % 2 == 0 else -(v >> 1) - 1
    out, before = [], 0
    for _ in range(next(it)):
        a = before + back(next(it))
        b = before = a + back(next(it))
        n_coords, n_heights = next(it), next(it)
        coords, heights, x, y, z = [], [], 0, 0, 0
        for _ in range(n_coords):
            x, y = x + back(next(it)), y + back(next(it))
            coords.append((round(x * head["quantum"], 9), round(y * head["quantum"], 9)))
        for _ in range(n_heights):
            v = next(it)
            if v:
                z += back(v - 1)
                heights.append(round(z * head["step"], 6))
            else:
                heights.append(None)
        out.append({"a": a, "b": b, "coords": coords, "heights": heights})
    if next(it, None) is not None:
        raise ValueError("bytes left over")
    return out
