"""Exact dedup by content sort.

Normalised texts (white space deleted) are range-partitioned by splitters that Spark samples from them, sorted
externally so that equals are adjacent, and compared in full with their neighbours. The splitters are the texts' first
`HEAD` characters and a hash of the whole, so that what is sampled stays small however long texts are.

Texts that more than one in `HOT_SHARE` of all rows share are hot; there are fewer than `HOT_SHARE` of them, whatever the
input. The last part of their key is a salt, a hash of the identifier, so that they spread over `SALTS` runs; each run
yields its best row, and the runs of one text meet again by the digest, already aggregated, in a broadcast table of at
most that many rows. All other texts have one run, which decides on the spot: rows cross the network once.

Cases: a null text counts as empty, and all empty (or blank) texts are equal; a null doc_id loses every tie; of
fully repeated rows one is kept; texts may be as long as a row can be, and are compared whole; an empty table gives an
empty table; other columns are carried, never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linenet.llm.common import SPACES, materialize, quoted, unpack, whole_row

SALTS = 64
HEAD = 32
HOT_SHARE = 1000
ORDER = ["head", "mark", "salt"]


def _plain(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _normal(text: Column) -> Column:
    return F.translate(_plain(text), SPACES, "")


def _hot(docs: DataFrame, text: str) -> DataFrame:
    """mark: the hashes that more than one in HOT_SHARE of all rows have, so fewer than HOT_SHARE."""
    seen = materialize(docs.groupBy(F.xxhash64(_normal(quoted(text))).alias("mark")).agg(F.count(F.lit(1)).alias("n")), "exact-marks")
    total = seen.agg(F.sum("n")).first()[0] or 0
    return seen.where(F.col("n") * HOT_SHARE > total).select("mark", F.lit(True).alias("hot"))


def _runs(docs: DataFrame, text: str, ident: str, carry: bool) -> DataFrame:
    """Rows in content order: `norm`, the place in the run of (norm, salt), and whether the text is hot."""
    norm = _normal(quoted(text))
    rows = docs.select(
        whole_row(docs) if carry else norm.alias("norm"),
        quoted(ident).alias("doc_id"),
        F.length(_plain(quoted(text))).alias("n_points"),
        F.substring(norm, 1, HEAD).alias("head"),
        F.xxhash64(norm).alias("mark"),
    )
    rows = rows.join(F.broadcast(materialize(_hot(docs, text), "exact-hot")), "mark", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    placed = rows.repartitionByRange(*ORDER)
    if carry:  # the row holds the text, so only one of both is sent
        placed = placed.withColumn("norm", _normal(F.col("row").getField(text)))
    best_first = Window.partitionBy(*ORDER, "norm").orderBy(F.col("n_points").desc(), F.col("doc_id").asc_nulls_last())
    return placed.withColumn("place", F.row_number().over(best_first))


def _best(runs: DataFrame) -> DataFrame:
    """For each hot text (one row each, so fewer than HOT_SHARE but for clashing hashes): its rows, and which stays."""
    order = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    best = runs.where("hot").groupBy("text_sha256").agg(F.sum("run_size").alias("all_rows"), F.min(order).alias("best"))
    return best.select("text_sha256", "all_rows", F.col("best.c").alias("best_id"), (-F.col("best.a")).alias("best_points"))


def exact_groups(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    run = Window.partitionBy(*ORDER, "norm")
    best_first = run.orderBy(F.col("n_points").desc(), F.col("doc_id").asc_nulls_last())
    runs = _runs(docs, text, ident, False).withColumn("first_id", F.first("doc_id").over(best_first)).withColumn("run_size", F.count(F.lit(1)).over(run))
    runs = runs.withColumn("text_sha256", F.sha2("norm", 256))
    runs = materialize(runs.select("doc_id", "n_points", "hot", "place", "first_id", "run_size", "text_sha256"), "exact-runs")
    best = materialize(_best(runs.where("place = 1")), "exact-best")
    found = runs.join(F.broadcast(best), "text_sha256", "left")
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_points") == F.col("best_points"))
    return found.select(
        "doc_id",
        F.when(F.col("hot"), F.col("best_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("all_rows", "run_size").alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | stays)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    first = _runs(docs, text, ident, True).where("place = 1").withColumn("run_size", F.lit(1))
    first = first.withColumn("text_sha256", F.when(F.col("hot"), F.sha2("norm", 256)))
    first = materialize(first.select("row", "doc_id", "n_points", "hot", "run_size", "text_sha256"), "exact-rows")
    best = materialize(_best(first), "exact-best")
    found = first.join(F.broadcast(best), "text_sha256", "left")
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_points") == F.col("best_points"))
    return unpack(found.where(~F.col("hot") | stays), docs.columns)
