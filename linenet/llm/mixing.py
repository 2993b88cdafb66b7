"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the budget; none gets more
than `MOST` times its own words, the excess goes to the others by weight. A source's documents fall into blocks by
hash. Whole passes over the source come first; the rest of the target takes its blocks in a permuted order, and the
block where the target is met is cut at documents. What it still lacks then is taken from the documents that fit of the
blocks after it, in the same order, until less is lacking than any document left has. Every (block, pass) is one draw. A tree splits the draws among
the output shards: at each node a keyed permutation ranks them and the left half takes its exact share of ranks, so
the counts by source are a multivariate-hypergeometric draw and no draw is taken twice. Each shard shuffles locally.

There are at most `BLOCKS` blocks plus one per source whatever the input, of about `BLOCK_DOCS` documents or more, so the tree's tables stay small.

Cases: a null text has size 0; a null source is a source of its own; sources of size 0 have target 0; fully
repeated rows share a hash (as would a tie of hashes) and are taken alike; the words of very long texts are all counted,
and one that doesn't fit what is left is passed over; an empty table gives an empty table; other columns are carried,
whatever their names. Reruns agree (hashes only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linenet.llm.common import WORD, materialize, quoted, unpack, whole_row

MOST = 3
BLOCKS = 8192
BLOCK_DOCS = 128
ROUNDS = 4
SHARDS = 16
SEED = 20240607
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: float = 1.0) -> DataFrame:
    """sizes: source, source_size. Adds source_no, weight and target: `budget` of all words shared by weight, capped, reshared."""
    ranked = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", ((F.col("source_no") - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * MOST)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("spent", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("level", (F.sum("source_size").over(whole) * budget - F.col("spent")) / F.sum("weight").over(after))
        .withColumn("level", F.max("level").over(whole))  # it rises while sources are capped, in this order, then falls
    )
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return filled.select(*sizes.columns, "source_no", "weight", target.alias("target"))


def split_tree(draws: DataFrame, keys: list[str], shards: int, seed: int) -> DataFrame:
    """Adds `shard`: recursive halving of the shard range, each side taking its exact share of the node's draws."""
    out, level = draws.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards)), 0
    while (1 << level) < shards:
        node = Window.partitionBy("lo", "hi")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        out = (
            out.withColumn("rank", F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed + level + 1), *keys), *keys)))
            .withColumn("n", F.count(F.lit(1)).over(node))
            .withColumn("left", F.col("rank") <= F.floor(F.col("n") * (middle - F.col("lo")) / (F.col("hi") - F.col("lo"))))
            .withColumn("mid", middle)
            .withColumn("single", F.col("hi") - F.col("lo") <= 1)
            .withColumn("hi2", F.when(F.col("left") & ~F.col("single"), F.col("mid")).otherwise(F.col("hi")))
            .withColumn("lo2", F.when(F.col("left") | F.col("single"), F.col("lo")).otherwise(F.col("mid")))
            .select(*draws.columns, F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
        )
        level += 1
    return out.withColumn("shard", F.col("lo")).drop("lo", "hi")


class Mix:
    """The plan of one mix: `sources` (targets), `blocks` (source_no, block, passes, cuts, homes) and, by row, what is taken."""

    def __init__(self, docs: DataFrame, shards: int = SHARDS, seed: int = SEED, budget: float = 1.0, text: str = "text", ident: str = "doc_id", source: str = "source"):
        self.docs, self.shards, self.seed = docs, shards, seed
        self._size = size_of(quoted(text).cast("string"))
        self._hash = F.xxhash64(F.lit(seed), quoted(ident), quoted(text))
        self._source = quoted(source)
        self.rows = materialize(docs.select(quoted(ident).alias("doc_id"), self._source.alias("source"), self._size.alias("size"), self._hash.alias("h")), "mix-rows")
        sizes = materialize(self.rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sizes")
        total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        self.sources = materialize(
            targets(sizes, budget)
            .withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
            .withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.ceil(F.lit(BLOCKS) * F.col("source_size") / F.greatest(total, F.lit(1))))).cast("int")),
            "mix-sources",
        )
        self.blocks = materialize(self._plan(), "mix-blocks")
        self.n_blocks = self.blocks.count()

    def _in_blocks(self, rows: DataFrame) -> DataFrame:
        """rows have source and h; adds the source's figures and the block."""
        own = self.sources.withColumnRenamed("source", "of")
        if own.count() <= BROADCAST_ROWS:
            own = F.broadcast(own)
        return rows.join(own, rows["source"].eqNullSafe(own["of"])).drop("of").withColumn("block", F.pmod(F.xxhash64(F.lit(self.seed), "h"), F.col("n_blocks")).cast("int"))

    def _plan(self) -> DataFrame:
        rows = self._in_blocks(self.rows)
        sized = rows.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
        order = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(self.seed + 101), "source_no", "block"), "block")
        upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
        ranked = sized.withColumn("upto", upto).withColumn("need", F.col("rest") - (F.col("upto") - F.col("words")))
        ranked = ranked.withColumn("place", F.row_number().over(order))
        ranked = materialize(ranked.withColumn("whole", F.col("need") >= F.col("words")).withColumn("partly", ~F.col("whole") & (F.col("need") > 0)), "mix-ranked")
        edge = ranked.where("partly").select("source_no", "block", "need")  # one block per source
        left = rows.select("source_no", "block", "h", "size").join(F.broadcast(edge) if edge.count() <= BROADCAST_ROWS else edge, ["source_no", "block"])
        plan, block = ranked, ["source_no", "block"]
        run = F.sum("size").over(Window.partitionBy(*block).orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
        for k in range(ROUNDS):  # documents in hash order up to the first that would not fit; then those that still fit; and so on
            left = materialize(left, "mix-edge")
            fits = left.where("size <= need").withColumn("run", run).where("run <= need")
            cut = fits.groupBy(*block).agg(F.max("h").alias(f"cut{k}"), F.max("run").alias("got"), F.first("need").alias(f"need{k}"))
            plan = plan.join(cut.drop("got"), block, "left")
            left = left.join(cut, block, "left").where(~F.coalesce((F.col("size") <= F.col("need")) & (F.col("h") <= F.col(f"cut{k}")), F.lit(False)))
            left = left.select(*block, "h", "size", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"))
        plan = plan.join(self._carry(rows, ranked, materialize(left, "mix-edge")), block, "left")
        plan = plan.withColumn("draws", F.col("passes") + (F.col("whole") | F.coalesce(*[F.col(f"cut{k}") for k in range(ROUNDS)]).isNotNull() | F.col("carried").isNotNull()).cast("int"))
        each = plan.where("draws > 0").select("source_no", "block", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("pass"))
        split = split_tree(each, ["source_no", "block", "pass"], self.shards, self.seed)
        homes = split.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).getField("shard").alias("homes"))
        return plan.join(homes, ["source_no", "block"], "left").select("source_no", "block", "passes", "whole", "place", "carried", *[f"{c}{k}" for c in ("cut", "need") for k in range(ROUNDS)], F.coalesce("homes", F.array().cast("array<int>")).alias("homes"))

    @staticmethod
    def _carried(step: Column) -> Column:
        """Whether a row (place, h, size) is of those that a step of _carry took."""
        at = F.struct("place", "h")
        return (at > step["start"]) & (at <= step["cut"]) & (F.col("size") <= step["need"])

    def _carry(self, rows: DataFrame, ranked: DataFrame, left: DataFrame) -> DataFrame:
        """What the edge blocks (left: their documents not taken, and need) still lack, from the documents that fit in the
        order of blocks and hashes. A step takes whole blocks and the next one up to its first document that does not fit,
        which is passed over for good; then the same after it. source_no, block, carried (the source's steps) for blocks taken from."""
        edge = ranked.where("partly").select("source_no", F.col("place").alias("edge"))
        short = materialize(left.groupBy("source_no").agg(F.first("need").alias("need")).where("need >= 1").join(edge, "source_no"), "mix-short")
        far = rows.select("source_no", "block", "h", "size").join(ranked.select("source_no", "block", "place"), ["source_no", "block"]).join(short, "source_no").where("place > edge")
        near = left.drop("need").join(short, "source_no").withColumn("place", F.col("edge"))
        columns = ["source_no", "block", "place", "h", "size", "need"]
        begin, last_hash = F.struct(F.lit(-1).alias("place"), F.lit(-(2**63)).alias("h")), F.lit(2**63 - 1)
        asked = materialize(far.select(*columns).unionByName(near.select(*columns)).where("size > 0 AND size <= need"), "mix-asked")
        todo, steps = asked.withColumn("start", begin), None
        while not todo.isEmpty():
            sized = todo.groupBy("source_no", "place").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("start").alias("start"))
            sized = sized.withColumn("upto", F.sum("words").over(Window.partitionBy("source_no").orderBy("place")))
            met = F.min(F.when(F.col("upto") > F.col("need"), F.struct("place", (F.col("upto") - F.col("words")).alias("before")))).alias("met")
            step = materialize(sized.groupBy("source_no").agg(F.first("need").alias("need"), F.first("start").alias("start"), met, F.max("place").alias("last"), F.max("upto").alias("all")), "mix-step")
            cut = todo.select("source_no", "place", "h", "size").join(step.where("met IS NOT NULL").select("source_no", "need", "met.place", "met.before"), ["source_no", "place"])
            cut = cut.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source_no", "place").orderBy("h")))
            fits = F.col("upto") <= F.col("need")
            cut = cut.groupBy("source_no").agg(F.max(F.when(fits, F.col("h"))).alias("cut_h"), F.min(F.when(~fits, F.col("h"))).alias("stop_h"), F.max(F.when(fits, F.col("upto"))).alias("got"))
            upto = F.when(F.col("met").isNull(), F.struct(F.col("last").alias("place"), last_hash.alias("h"))).when(F.col("cut_h").isNull(), F.struct((F.col("met.place") - 1).alias("place"), last_hash.alias("h"))).otherwise(F.struct(F.col("met.place").alias("place"), F.col("cut_h").alias("h")))
            stop = F.when(F.col("met").isNotNull(), F.struct(F.col("met.place").alias("place"), F.col("stop_h").alias("h")))
            done = step.join(cut, "source_no", "left").select("source_no", "need", "start", upto.alias("cut"), stop.alias("stop"), (F.col("need") - F.coalesce("got", "met.before", "all")).alias("lacks"))
            done = materialize(done, "mix-step")
            own = done.select("source_no", F.struct("start", "cut", "need").alias("step"))
            steps = own if steps is None else materialize(steps.unionByName(own), "mix-steps")
            after = done.where("stop IS NOT NULL").select("source_no", F.col("stop").alias("start"), F.col("lacks").alias("need"))
            todo = materialize(todo.drop("start", "need").join(after, "source_no").where((F.struct("place", "h") > F.col("start")) & (F.col("size") <= F.col("need"))), "mix-todo")
        if steps is None:
            point = "struct<place: int, h: bigint>"
            return ranked.select("source_no", "block", F.lit(None).cast(f"array<struct<start: {point}, cut: {point}, need: double>>").alias("carried")).limit(0)
        carried = steps.groupBy("source_no").agg(F.collect_list("step").alias("carried"))
        return asked.drop("need").join(carried, "source_no").where(F.exists("carried", self._carried)).groupBy("source_no", "block").agg(F.first("carried").alias("carried"))

    def quotas(self) -> DataFrame:
        """The tree's leaves: shard, source_no, blocks."""
        return self.blocks.select("source_no", F.explode("homes").alias("shard")).groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("blocks"))

    def _decided(self, rows: DataFrame) -> DataFrame:
        plan = F.broadcast(self.blocks) if self.n_blocks <= BROADCAST_ROWS else self.blocks
        extra = F.col("whole")
        for k in range(ROUNDS):
            extra = extra | F.coalesce((F.col("size") <= F.col(f"need{k}")) & (F.col("h") <= F.col(f"cut{k}")), F.lit(False))
        extra = extra | F.coalesce(F.exists("carried", self._carried), F.lit(False))
        copies = F.col("passes") + extra.cast("int")
        return self._in_blocks(rows).drop("passes").join(plan, ["source_no", "block"]).withColumn("copies", copies).withColumn("homes", F.slice("homes", F.lit(1), F.col("copies")))

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken, copies, shards (one for each copy)."""
        return self._decided(self.rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.col("homes").alias("shards"))

    def rows_of(self) -> DataFrame:
        """The mix itself: each document as often as it is taken, dealt to its shards and shuffled within them; docs' columns."""
        rows = self.docs.select(whole_row(self.docs), self._source.alias("source"), self._size.alias("size"), self._hash.alias("h"))
        dealt = self._decided(rows).select("row", "h", F.posexplode("homes").alias("copy", "shard"))
        key = F.xxhash64(F.lit(self.seed + 202), "h", "copy")
        return unpack(dealt.withColumn("key", key).repartitionByRange("shard", "key").sortWithinPartitions("shard", "key"), self.docs.columns)
