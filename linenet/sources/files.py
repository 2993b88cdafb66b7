"""File-backed sources: GPX and OSM JSON documents, route catalogues, partition discovery, and a store of point heights.

Documents come as rows of a text or binaryFile read, so a folder of any size is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_TYPES = ("path", "footway", "track", "bridleway", "steps")


def parse_gpx(documents: DataFrame, ident: str = "path", text: str = "text") -> DataFrame:
    """ident, part, seq, lon, lat: the points of each track segment with two points or more; heights and times are left."""
    xml = F.regexp_replace(F.col(text), r'xmlns="[^"]*"', "")
    parts = F.filter(F.split(xml, "<trkseg[^>]*>"), lambda p, i: i > 0)
    segment = lambda p: F.regexp_extract_all(F.split(p, "</trkseg>")[0], F.lit(r"(<trkpt\b[^>]*>)"), F.lit(1))
    lines = documents.select(ident, F.posexplode(F.transform(parts, segment)).alias("part", "points")).where(F.size("points") > 1)
    points = lines.select(ident, "part", F.posexplode("points").alias("seq", "p"))
    number = lambda name: F.regexp_extract("p", rf'\b{name}\s*=\s*["\']([^"\']*)["\']', 1).cast("double").alias(name)
    return points.select(ident, "part", "seq", number("lon"), number("lat"))


OSM = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,center:struct<lat:double,lon:double>>>>"


def osm_elements(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per element; a document without `elements` is an error, as a truncated answer must not pass for an empty one."""
    parsed = documents.select(F.from_json(text, OSM).alias("d"))
    checked = parsed.select(F.when(F.col("d.elements").isNull(), F.raise_error(F.lit("no elements in the answer"))).otherwise(F.col("d.elements")).alias("e"))
    return checked.select(F.explode("e").alias("e")).select("e.*")


def osm_paths(elements: DataFrame, types: tuple[str, ...] = PATH_TYPES) -> DataFrame:
    """Ways of these highway types with two vertices or more: id, name, highway, coords."""
    ways = elements.where((F.col("type") == "way") & F.col("tags")["highway"].isin(*types) & (F.size("geometry") > 1))
    return ways.select("id", F.col("tags")["name"].alias("name"), F.col("tags")["highway"].alias("highway"), F.transform("geometry", lambda g: F.struct(g["lon"].alias("x"), g["lat"].alias("y"))).alias("coords"))


def osm_points(elements: DataFrame, named: bool = False) -> DataFrame:
    """Nodes and the centres of ways: id, name, kind (tourism, else amenity, else building), x, y; those without a place are left out."""
    kind = F.coalesce(*[F.nullif(F.col("tags")[k], F.lit("")) for k in ("tourism", "amenity", "building")])
    x, y = F.coalesce("lon", "center.lon"), F.coalesce("lat", "center.lat")
    found = elements.select("id", F.nullif(F.col("tags")["name"], F.lit("")).alias("name"), kind.alias("kind"), x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return found.where("name IS NOT NULL") if named else found


def distinct_places(points: DataFrame) -> DataFrame:
    """First of equal names within a thousandth of a degree (rounded half to even)."""
    key = [F.col("name"), F.rint(F.col("x") * 1000), F.rint(F.col("y") * 1000)]
    return points.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(F.min(F.struct("id", "name", "kind", "x", "y")).alias("p")).select("p.*")


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A TOML catalogue of routes: id (unique), name, category (core or access), url (http). Broken rules raise ValueError."""
    import tomllib

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows, seen = [], set()
    for r in tomllib.loads(text).get("route", []):
        number, name, category, url = r.get("id"), r.get("name"), r.get("category"), r.get("url", "")
        if not isinstance(number, int) or number in seen:
            raise ValueError(f"route id {number!r} is no number, or not unique")
        if not name or category not in ("core", "access") or not str(url).startswith(("http://", "https://")):
            raise ValueError(f"route {number}: name, category and url are needed")
        seen.add(number)
        rows.append((number, name, category, url))
    return spark.createDataFrame(rows, "id long, name string, category string, url string")


def missing_partitions(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Partitions still to order."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def newest(feed: DataFrame, key: list[str], updated: str = "updated") -> DataFrame:
    """Of each key's entries the one updated last."""
    return feed.groupBy(*key).agg(F.max(F.struct(updated, *[c for c in feed.columns if c not in (*key, updated)])).alias("e")).select(*key, "e.*")


def exactly_one(found: DataFrame, what: str) -> DataFrame:
    names = [r[0] for r in found.limit(3).collect()]
    if len(names) != 1:
        raise LookupError(f"{what}: {'nothing' if not names else 'several, such as ' + ', '.join(map(str, names))}")
    return found


class PointStore:
    """Heights by point, in a Parquet table keyed by centimetres. The first answer to a point stays; a null height is an answer."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def read(self) -> DataFrame:
        try:
            return self._spark.read.parquet(self._path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self._spark.createDataFrame([], "east long, north long, z double, batch long")

    @staticmethod
    def keys(points: DataFrame) -> DataFrame:
        return points.withColumn("east", F.rint(F.col("x") * 100).cast("long")).withColumn("north", F.rint(F.col("y") * 100).cast("long"))

    def known(self) -> DataFrame:
        return self.read().groupBy("east", "north").agg(F.min_by("z", "batch").alias("z"), F.lit(True).alias("asked"))

    def missing(self, points: DataFrame) -> DataFrame:
        return self.keys(points).select("east", "north").distinct().join(self.known(), ["east", "north"], "left_anti")

    def add(self, answers: DataFrame, batch: int) -> None:
        """answers: east, north, source, z. Heights of sources other than terrain models are no readings."""
        z = F.when(F.lower("source").startswith("dtm"), F.col("z"))
        answers.select("east", "north", z.alias("z"), F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(self._path)

    def heights(self, points: DataFrame) -> DataFrame:
        return self.keys(points).join(self.known(), ["east", "north"], "left").drop("east", "north")
