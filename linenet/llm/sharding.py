"""Sharding by minimax contiguous partition.

Rows with equal texts form one group that no cut divides. Groups are ordered by a hash of the text; runs of that
order (`UNITS` equal ranges of the hash, so their number is bounded whatever the input) are the atomic units. The
smallest feasible shard capacity is found by binary search, each try checked greedily over prefix sums, and the
order is cut there. The unit table (at most `UNITS` rows) is all that reaches the driver.

Law: `bytes`. Slots count from 0 in each shard; they come from the offsets of (unit, lane), a lane being a hash
class of identifiers within a large unit, so a text that a third of all rows share is numbered by many tasks.

Cases: a null text counts as empty (8 bytes of size); a null doc_id is numbered like any other; fully repeated
rows get slots of their own, ties going by identifier; the size of very long texts counts whole; an empty table gives an
empty table; other columns are not read, whatever their names; there may be empty shards when groups are few. Rows that
share one text and lack a doc_id stand in one lane.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linenet.llm.common import materialize, quoted

UNITS = 1 << 15
LANE_ROWS = 2_000


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """First positions of shards 1.. when each shard takes all that fits; None if `shards` don't suffice. ends: running sums."""
    cuts, taken, at = [], 0, 0
    for _ in range(shards):
        at = bisect_right(ends, taken + capacity, lo=at)
        if at == len(ends):
            return cuts
        cuts.append(at)
        taken = ends[at - 1] if at else 0
    return None


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which the ordered sizes fit into `shards` contiguous shards, and the cuts it gives."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0, []
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy_cuts(ends, low, shards)


def shard(docs: DataFrame, shards: int = 24, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`), shard_bytes, capacity."""
    spark = docs.sparkSession
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    key = F.xxhash64(F.lit("linenet"), whole)
    rows = materialize(
        docs.select(
            quoted(ident).alias("doc_id"),
            (F.octet_length(whole) + 8).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            key.alias("key"),
            F.shiftrightunsigned(key, 64 - (UNITS.bit_length() - 1)).cast("int").alias("unit"),
        ),
        "shard-rows",
    )
    units = sorted((r.unit, r.size, r.n) for r in rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect())
    capacity, cuts = minimax_cuts([size for _, size, _ in units], shards)
    table = [(unit, bisect_right(cuts, i), max(1, -(-n // LANE_ROWS))) for i, (unit, _, n) in enumerate(units)]
    plan = F.broadcast(spark.createDataFrame(table, "unit int, shard int, lanes int"))  # UNITS rows at most
    placed = rows.join(plan, "unit").withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.col("lanes")).cast("int"))
    counts = placed.groupBy("shard", "unit", "lane").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("shard").orderBy("unit", "lane")
    offsets = materialize(
        counts.select(
            "unit", "lane",
            (F.sum("n").over(before) - F.col("n")).alias("first"),
            F.sum("bytes").over(Window.partitionBy("shard")).alias("shard_bytes"),
        ),
        "shard-offsets",
    )
    within = Window.partitionBy("unit", "lane").orderBy("key", F.col("doc_id").asc_nulls_last())
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(offsets, ["unit", "lane"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "shard_bytes", F.lit(capacity).cast("long").alias("capacity"),
        )
    )
