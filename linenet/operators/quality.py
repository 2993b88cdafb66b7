"""Column profiles and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linenet.functions import text as X
from linenet.tables import settled


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, non-null count, percentage, distinct count, uniqueness, least and greatest with their counts, median, mean."""
    c = F.col(column)
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_known"), F.count_distinct(c).alias("n_unique"), F.min(c).alias("least"), F.max(c).alias("most"), F.median(c).alias("median"), F.round(F.avg(c), 2).alias("mean"))
    ends = df.join(F.broadcast(stats.select("least", "most"))).agg(F.sum((c == F.col("least")).cast("long")).alias("n_least"), F.sum((c == F.col("most")).cast("long")).alias("n_most"))  # one row beside
    return stats.join(F.broadcast(ends)).withColumn("pct", F.round(100.0 * F.col("n_known") / F.col("n_rows"), 1)).withColumn("is_unique", F.col("n_unique") == F.col("n_known"))


def value_counts(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """All values with counts if there are fewer than `most`, else the `most` commonest (ties by value)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(most)


def filled_share(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Share of rows that say something, by column."""
    said = lambda c: (F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).cast("double")
    return df.groupBy(*group).agg(*[F.round(F.avg(said(c)), 6).alias(c) for c in columns])


def cardinality(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_keys"))


def validate(spatial: DataFrame, attributes: DataFrame, ident: str, foreign: str, expected: int) -> DataFrame:
    """rule, level (issue or warning), n: rules that failed, with the number of rows (or the drop in per mille)."""
    ids, keys = spatial.select(F.col(ident).alias("k")), attributes.select(F.col(foreign).alias("k"))
    found = [
        ("missing geometry", "issue", spatial.where(F.col("x").isNull() | F.col("y").isNull())),
        ("duplicate ids", "issue", ids.groupBy("k").count().where("count > 1")),
        ("orphan attributes", "issue", keys.distinct().join(ids, "k", "left_anti")),
        ("unreferenced geometry", "warning", ids.distinct().join(keys, "k", "left_anti")),
        ("outside of bounds", "issue", spatial.where("x < 0 OR x > 1100 OR y < 0 OR y > 1100")),
    ]
    out = None
    for rule, level, rows in found:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), "n")
        out = one if out is None else out.unionByName(one)
    drop = spatial.agg(F.floor((1 - F.count(F.lit(1)) / F.lit(float(expected))) * 1000).cast("long").alias("n"))
    drop = drop.select(F.lit("fewer rows").alias("rule"), F.when(F.col("n") > 200, "issue").otherwise("warning").alias("level"), "n").where("n > 50")
    return out.where("n > 0").unionByName(drop)


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def top(df: DataFrame, by: list, n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """Adds `dense`, from 0 in the column's order: ranks are counted per range, then offset, so no task sees all rows. The
    ranges are written once, as their numbers are read twice."""
    values = df.select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id())
    within = settled(values.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(column))), "ranges")
    sizes = within.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.withColumn("offset", F.sum("size").over(Window.orderBy("part")) - F.col("size")).select("part", "offset")  # a row for each range
    numbered = within.join(F.broadcast(offsets), "part").select(F.col(column).alias("value"), (F.col("rn") + F.col("offset") - 1).cast("long").alias("dense"))
    return df.join(numbered, df[column].eqNullSafe(numbered["value"])).drop("value")


def row_ids(df: DataFrame, column: str, size: Column | None = None) -> DataFrame:
    """As dense_ids of a column that has no value twice, with all rows' columns: no row is looked up again. With size, a row
    takes so many numbers, of which `dense` is the first."""
    ranged = df.withColumn("size", F.lit(1) if size is None else size).repartitionByRange(column).withColumn("part", F.spark_partition_id())
    within = settled(ranged.withColumn("upto", F.sum("size").over(Window.partitionBy("part").orderBy(column))), "ranges")
    sizes = within.groupBy("part").agg(F.sum("size").alias("own"))
    offsets = sizes.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("offset"))  # a row for each range
    dense = (F.col("upto") + F.col("offset") - F.col("size")).cast("long")
    return within.join(F.broadcast(offsets), "part").withColumn("dense", dense).drop("part", "upto", "offset", "size")


def describe_columns(df: DataFrame, columns: list[str] | None = None, most: int = 5, by_completeness: bool = False) -> DataFrame:
    """A row for each column (unknown names are left out): place, name, n_rows, n_known, pct, n_unique, is_unique, least and
    most as text with their counts, and top: values with counts, all where there are fewer than `most`, else the commonest
    `most` (ties by value). One pass deals (column, value) pairs to counters, so no task gathers a column."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if dict(df.dtypes)[c] not in ("string", "date", "timestamp", "boolean", "binary") else F.lit(None).cast("double")).alias("number")) for i, c in enumerate(names)])
    seen = settled(df.select(F.explode(pairs).alias("p")).groupBy("p.place", "p.name", "p.value", "p.number").agg(F.count(F.lit(1)).alias("n")), "values")
    known = F.col("value").isNotNull()
    ends = F.struct(F.col("number"), F.col("value"), F.col("n"))
    stats = seen.groupBy("place", "name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_known"), F.count_if(known).alias("n_unique"),
        F.min(F.when(known, ends)).alias("lo"), F.max(F.when(known, ends)).alias("hi"), F.round(F.sum(F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), 2).alias("mean"),
    )
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.col("n").desc(), "value"))
    top = seen.where(known).withColumn("rank", rank).where(F.col("rank") <= most).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
    top = top.withColumn("top", F.array_join(F.transform("t", lambda v: F.concat_ws("=", v["value"], v["n"].cast("string"))), ", ")).select("place", "top")
    out = stats.join(top, "place", "left").select(
        "place", "name", "n_rows", "n_known", F.round(100.0 * F.col("n_known") / F.col("n_rows"), 1).alias("pct"), "n_unique", (F.col("n_unique") == F.col("n_known")).alias("is_unique"),
        F.col("lo.value").alias("least"), F.col("lo.n").alias("n_least"), F.col("hi.value").alias("most"), F.col("hi.n").alias("n_most"), "mean", "top",
    )
    return out.orderBy(F.col("pct").desc(), "place") if by_completeness else out.orderBy("place")


def whole_way(rows: DataFrame, ident: str, source: str, identity: str, metres: str, ignore: list[str] = ()) -> DataFrame:
    """ident, whole: the metres of all rows that share a part of the identity within the source, each once; null without
    one. Rows of one set of parts count as one from the start; a part's total then answers all sets that have it, and only
    what two sets share in several parts, which its totals hold more than once, is taken off."""
    parts = F.array_sort(F.array_except(F.array_distinct(X.parts_of(F.col(identity))), F.array(*[F.lit(i) for i in ignore]).cast("array<string>")))
    keyed = rows.select(ident, source, metres, parts.alias("parts"))
    sets = settled(keyed.where(F.size("parts") > 0).groupBy(source, "parts").agg(F.sum(metres).alias("m")), "sets")
    each = settled(sets.select(source, "parts", "m", F.explode("parts").alias("part")), "parts")
    totals = each.groupBy(source, "part").agg(F.sum("m").alias("total"))
    sums = each.join(totals, [source, "part"]).groupBy(source, "parts").agg(F.sum("total").alias("total"))
    pair = F.explode(F.flatten(F.transform("parts", lambda p, i: F.transform(F.slice("parts", i + 2, F.size("parts")), lambda q: F.struct(p.alias("p"), q.alias("q"))))))
    pairs = settled(sets.where(F.size("parts") > 1).select(source, "parts", "m", pair.alias("pair")), "pairs")
    other = pairs.select(source, "pair", F.col("parts").alias("others"), F.col("m").alias("o_m"))
    met = pairs.select(source, "pair", "parts").join(other, [source, "pair"]).select(source, "parts", "others", "o_m").distinct()
    again = F.col("o_m") * (F.size(F.array_intersect("parts", "others")) - 1)
    twice = met.groupBy(source, "parts").agg(F.sum(again).alias("twice"))
    found = sums.join(twice, [source, "parts"], "left").select(source, "parts", (F.col("total") - F.coalesce("twice", F.lit(0.0))).alias("whole"))
    return keyed.join(found, [source, "parts"], "left").select(ident, metres, "whole")


def wider_way(found: DataFrame, metres: str) -> DataFrame:
    """Adds whole_km, the whole way in kilometres, where it is more than a metre longer than the row itself."""
    return found.withColumn("whole_km", F.when(F.col("whole") > F.col(metres) + 1, F.round(F.round("whole", 6) / 1000, 2)))  # halves of a sum are not left to its last digits


def top_and_rest(counts: DataFrame, name: str, metres: str, most: int = 8) -> DataFrame:
    """The `most` longest, and one row for all the rest (name null): name, metres, n."""
    rank = F.row_number().over(Window.orderBy(F.col(metres).desc(), name))  # counts are few: one row for each name
    ranked = counts.withColumn("name", F.when(rank <= most, F.col(name)))
    return ranked.groupBy("name").agg(F.sum(metres).alias("metres"), F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """value, n, pct of all rows that have one."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def cardinality_figures(df: DataFrame, key: str) -> DataFrame:
    """One row on rows per key: n_keys, least, most, mean, median, relation (1:1, 1:2 or 1:N)."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("n_keys"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.median("n").alias("median"))
    return out.withColumn("relation", F.when(F.col("most") == 1, "1:1").when(F.col("most") == 2, "1:2").otherwise("1:N"))


def issues(spatial: DataFrame, attributes: DataFrame, ident: str, foreign: str, columns: list[str], bounds: tuple[float, float, float, float], expected: int | None = None, srid: int | None = None) -> DataFrame:
    """rule, level (issue or warning), n: the seven rule groups, those that fail. spatial: ident, coords (lines) and, where
    srid is asked for, srid; bounds: x0, y0, x1, y1, which all four extremes of a line must keep."""
    x0, y0, x1, y1 = bounds
    xs, ys = F.transform("coords", lambda p: p["x"]), F.transform("coords", lambda p: p["y"])
    ids, keys = spatial.select(F.col(ident).alias("k")), attributes.select(F.col(foreign).alias("k"))
    bad = F.col("coords").isNull() | (F.size("coords") < 2) | F.exists("coords", lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    outside = (F.array_min(xs) < x0) | (F.array_max(xs) > x1) | (F.array_min(ys) < y0) | (F.array_max(ys) > y1)
    found = [("invalid geometry", "issue", spatial.where(bad)), ("duplicate ids", "issue", ids.groupBy("k").count().where("count > 1")), ("orphan attributes", "issue", keys.where("k IS NOT NULL").distinct().join(ids, "k", "left_anti")), ("unreferenced geometry", "warning", ids.distinct().join(keys, "k", "left_anti")), ("outside of bounds", "issue", spatial.where(~bad & outside))]
    if srid is not None:
        found.append(("reference system", "issue", spatial.where(~F.col("srid").eqNullSafe(F.lit(srid)))))
    rows = [part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), "n") for rule, level, part in found]
    missing = len([c for c in columns if c not in spatial.columns and c not in attributes.columns])
    rows.append(spatial.sparkSession.createDataFrame([("missing columns", "issue", missing)], "rule string, level string, n long"))
    if expected:
        less = spatial.agg((1000 * (1 - F.count(F.lit(1)) / F.lit(float(expected)))).alias("d"))
        rows.append(less.select(F.lit("fewer rows").alias("rule"), F.when(F.col("d") > 200, "issue").otherwise("warning").alias("level"), F.when(F.col("d") > 50, F.floor("d")).otherwise(0).cast("long").alias("n")))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.where("n > 0")
