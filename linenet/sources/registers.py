"""Registers of roads, places, areas and heights as contracts over files: each takes DataFrames that a read gave (a layer
and its tables), and gives the rows that the network is built from. Live services are the caller's; their answers are files."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linenet.functions import geometry as G
from linenet.functions import text as X

def feed_entries(documents: DataFrame, text: str = "text") -> DataFrame:
    """Entries of Atom feeds: id, title, updated (a point in time), link. Documents are XML texts."""
    each = F.filter(F.split(F.col(text), r"<entry\b[^>]*>"), lambda p, i: i > 0)
    entry = documents.select(F.explode(F.transform(each, lambda e: F.split(e, "</entry>")[0])).alias("e"))
    inside = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    link = F.nullif(F.regexp_extract("e", r'<link\b[^>]*\bhref="([^"]*)"', 1), F.lit(""))
    return entry.select(inside("id").alias("id"), inside("title").alias("title"), F.try_to_timestamp(inside("updated")).alias("updated"), link.alias("link"))


def newest_entry(entries: DataFrame, pattern: str) -> DataFrame:
    """Of the entries whose title has the pattern the one updated last; none is an error, not an empty answer."""
    found = entries.where(F.col("title").rlike(pattern)).orderBy(F.col("updated").desc_nulls_last(), "id").limit(1)
    if found.isEmpty():
        raise FileNotFoundError(f"no entry like {pattern}")
    return found


def load_layers(archives: dict[str, dict[str, DataFrame]], layers: list[str]) -> DataFrame:
    """archives: partition -> layer -> rows. The layers asked for of all partitions in one table, with `kommune` and `layer`;
    columns that one lacks are null. A partition without one of them is left out of it; none at all is an error."""
    out = None
    for code, held in sorted(archives.items()):
        for layer in layers:
            if layer in held:
                rows = held[layer].withColumn("kommune", F.lit(code)).withColumn("layer", F.lit(layer))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise LookupError(f"no archive has any of {layers}")
    return out


def of_types(rows: DataFrame, column: str, types: list[str]) -> DataFrame:
    return rows.where(F.col(column).isin(types))


def roads(rows: DataFrame, types: list[str], categories: dict[str, str], kind: str = "typeveg", category: str = "vegkategori") -> DataFrame:
    """Roads of these types, with the label of their category (the code, where it has none)."""
    return of_types(rows, kind, types).withColumn("category", X.label(F.col(category), categories))


def label_point(rings: Column) -> Column:
    """A point inside an area: on the middle of its height, the middle of the widest stretch inside (even-odd)."""
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    y = (F.array_min(ys) + F.array_max(ys)) / 2 + (F.array_max(ys) - F.array_min(ys)) * 1e-7  # off the vertices

    def met(ring):
        following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.filter(F.zip_with(ring, following, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))), lambda x: x.isNotNull())

    xs = F.array_sort(F.flatten(F.transform(rings, met)))
    spans = F.filter(F.transform(xs, lambda x, i: F.when(i % 2 == 0, F.struct((F.get(xs, i + 1) - x).alias("w"), (x + (F.get(xs, i + 1) - x) / 2).alias("x")))), lambda s: s.isNotNull())
    return F.struct(F.array_max(spans)["x"].alias("x"), y.alias("y"))


def cabins(rows: DataFrame, codes: dict[str, str], level: str = "service_level", kind: str = "building_type") -> DataFrame:
    """Buildings with a service level, or of a type among the codes: kind is the level, else the type's label."""
    kept = rows.where(F.col(level).isNotNull() | F.col(kind).isin(list(codes)))
    return kept.withColumn("kind", F.coalesce(F.col(level), X.label(F.col(kind), codes)))


def place_names(rows: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Named label points: name, kind, x, y; of these kinds only, where given."""
    named = rows.withColumn("name", X.said(F.col("name"))).where("name IS NOT NULL")
    return named if kinds is None else of_types(named, "kind", kinds)


def main_names(spellings: DataFrame, names: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """spellings: name_id, spelling, row_id; names: name_id, place_id, status. place_id, name: the first spelling of the
    place's main name."""
    main = names.where(F.col("status").isin(*statuses)).select("name_id", "place_id")
    return spellings.join(main, "name_id").groupBy("place_id").agg(F.min_by("spelling", "row_id").alias("name"))


def ranked_places(positions: DataFrame, names: DataFrame, order: list[str], kinds: list[str] | None = None) -> DataFrame:
    """positions: place_id, kind, importance, points (array). A row for each point of a named place, with its rank."""
    rows = positions.join(names, "place_id").where(X.said(F.col("name")).isNotNull())
    rows = rows if kinds is None else of_types(rows, "kind", kinds)
    return rows.withColumn("rank", X.rank_of(F.col("importance"), order)).select("place_id", "name", "kind", "rank", F.explode("points").alias("p")).select("place_id", "name", "kind", "rank", "p.x", "p.y")


def find(rows: DataFrame, column: str, name: str, exact: bool = False) -> DataFrame:
    """Rows of this name, or whose name holds it in any case; % and _ and quotes are text like any other."""
    value = F.col(column)
    return rows.where(value == name if exact else F.contains(F.upper(value), F.upper(F.lit(name))))


def within(rows: DataFrame, bounds: tuple[float, float, float, float], most: int | None = None) -> DataFrame:
    """Rows whose box (x0, y0, x1, y1) meets the bounds. An answer longer than the service's page is truncated: an error."""
    x0, y0, x1, y1 = bounds
    found = rows.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: the answer would be cut off")
    return found


def boxes_of(lines: DataFrame) -> DataFrame:
    """lines with x0, y0, x1, y1."""
    of = lambda f, k: f(F.transform("coords", lambda p: p[k]))
    return lines.withColumns({"x0": of(F.array_min, "x"), "y0": of(F.array_min, "y"), "x1": of(F.array_max, "x"), "y1": of(F.array_max, "y")})


def paged(pages: DataFrame, total: int, size: int) -> DataFrame:
    """pages: page (from 0), rows (array). All rows of a paged answer, up to the first empty page or the total; a page that
    is missing in between is an error."""
    wanted = math.ceil(total / size)
    have = pages.select("page", F.size("rows").alias("n"))
    empty = have.where("n = 0").agg(F.min("page")).first()[0]
    last = wanted if empty is None else min(wanted, empty)
    held = have.where(F.col("page") < last).agg(F.count_distinct("page")).first()[0]
    if held < last:
        raise ValueError(f"{last - held} pages of {last} are missing")
    return pages.where(F.col("page") < last).select(F.explode("rows").alias("r")).select("r.*")


def load_routes(catalogue: DataFrame, points: DataFrame, ident: str = "id") -> DataFrame:
    """catalogue: id and more; points: id, part, seq, x, y (metres). Routes with parts, n_vertices and length_km (two
    decimals); a route without geometry is an error."""
    parts = points.groupBy(ident, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coords"))
    parts = parts.withColumn("m", G.length(F.col("coords"))).groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("part", "coords"))).alias("parts"), F.sum("m").alias("m"), F.sum(F.size("coords")).alias("n_vertices"))
    lost = [r[0] for r in catalogue.join(parts, ident, "left_anti").select(ident).limit(5).collect()]
    if lost:
        raise LookupError(f"routes without a track: {lost}")
    return catalogue.join(parts, ident).withColumn("length_km", F.round(F.col("m") / 1000, 2)).drop("m")


def readings(answers: DataFrame, asked: str = "asked", given: str = "given") -> DataFrame:
    """answers: asked (array of points), given (array of (datakilde, z)). One row a point with z where its source is a
    terrain model; an answer of another length than its question is an error."""
    checked = F.when(F.size(asked) != F.size(given), F.raise_error(F.lit("as many heights as points are needed"))).otherwise(F.arrays_zip(F.col(asked).alias("p"), F.col(given).alias("g")))
    rows = answers.select(F.explode(checked).alias("a"))
    return rows.select("a.p.*", F.when(F.lower("a.g.datakilde").startswith("dtm"), F.col("a.g.z")).alias("z"))


def batches(points: DataFrame, size: int = 50) -> DataFrame:
    """points: east, north, distinct. Questions of `size` points each: batch, asked. Dealt by hash, so batches are numbered
    within their part and no task sees all points."""
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64("east", "north"), F.lit(64)).cast("int")
    rn = F.row_number().over(Window.partitionBy("part").orderBy("east", "north")) - 1
    rows = points.select("east", "north").distinct().withColumn("part", part).withColumn("k", F.floor(rn / size))
    return rows.groupBy("part", "k").agg(F.array_sort(F.collect_list(F.struct("east", "north"))).alias("asked"))


def edge_costs(sources: DataFrame, ferry: float, bridge: float) -> DataFrame:
    """sources: source, kind, factor. source, factor, flat_m: what an edge of it costs; bridges have a row of their own."""
    own = sources.select("source", F.when(F.col("kind") != "ferry", F.col("factor")).alias("factor"), F.when(F.col("kind") == "ferry", F.lit(ferry)).alias("flat_m"))
    return own.unionByName(sources.sparkSession.createDataFrame([("bridge", bridge, None)], "source string, factor double, flat_m double"))


def area_table(areas: DataFrame, decimals: int = 6) -> DataFrame:
    """areas: area_id, rings. Flat ring lists with rounded coordinates, and bounds."""
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(F.round(p["x"], decimals), F.round(p["y"], decimals))))
    rows = areas.withColumn("rings", rings)
    of = lambda f, i: f(F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: F.get(p, F.lit(i))))))
    return rows.withColumn("bounds", F.array(of(F.array_min, 0), of(F.array_min, 1), of(F.array_max, 0), of(F.array_max, 1)))


def credits(sources: DataFrame) -> DataFrame:
    """sources: name, licence, attribution, version. One line for each licence, its sources in order of their names."""
    one = F.concat("name", F.coalesce(F.concat(F.lit(" ("), X.said(F.col("version")), F.lit(")")), F.lit("")))
    rows = sources.withColumn("one", one).groupBy("licence", "attribution").agg(F.array_join(F.array_sort(F.collect_set("one")), ", ").alias("names"))
    return rows.select("licence", F.concat_ws(". ", F.concat(F.lit("© "), F.col("attribution"), F.lit(": "), F.col("names")), F.col("licence")).alias("line"))


@dataclass(frozen=True)
class Params:
    """What a build is made with."""

    bridge_m: float = 25.0
    ferry_cost_m: float = 5_000.0
    bridge_factor: float = 1.3
    mark_m: float = 10.0
    record_m: float = 25.0
    step_m: float = 5.0
    threshold_m: float = 5.0

    @classmethod
    def of(cls, given: dict, **overrides) -> Params:
        """Defaults, then what was given, then overrides; unknown names and nulls are left."""
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for source in (given, overrides) for k, v in source.items() if k in known and v is not None})
