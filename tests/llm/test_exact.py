"""Native operators: exact dedup, sharding, mixing."""

import collections
import re
import zlib

import pytest
from oracle import same, views

from linenet.llm import exact_dedup, mixing, queries, sharding

ROWS = [(1, "a b", "s", 1), (2, "ab ", "s", 2), (3, None, None, 3), (4, " \n", "t", 4), (None, "a  b", "s", 5), (5, "c" * 50_000, "t", 6), (1, "a b", "s", 1), (7, "é x", "", 8)]
SCHEMA = "doc_id long, text string, source string, kept int"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    same(views(sf), queries.QUERIES[name](spark, sf), queries.ORACLES[name])


def test_exact_cases(rows, empty):
    found = [tuple(r) for r in exact_dedup.exact_groups(rows).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert collections.Counter(found) == collections.Counter([(1, None, 4, False), (1, None, 4, False), (2, None, 4, False), (None, None, 4, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (7, 7, 1, True)])
    kept = exact_dedup.exact_dedup(rows)
    assert kept.columns == rows.columns and kept.count() == 4
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.exact_dedup(empty).count() == 0


def test_minimax():
    assert sharding.minimax_cuts([7, 2, 5, 10, 8], 2) == (18, [3])
    assert sharding.minimax_cuts([], 3) == (0, [])
    assert sharding.minimax_cuts([5], 3) == (5, [])
    for sizes in ([3, 1, 4, 1, 5, 9, 2, 6], [1] * 24):
        for shards in (1, 2, 3, 8):
            capacity, cuts = sharding.minimax_cuts(sizes, shards)
            edges = [0, *cuts, len(sizes)]
            assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:], strict=False)) == capacity and len(cuts) < shards
            assert sharding.greedy_cuts([sum(sizes[: i + 1]) for i in range(len(sizes))], capacity - 1, shards) is None or capacity == max(sizes)


def test_shards(spark, sf, rows, empty):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op7_sharding(spark, sf).collect()
    by_text, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in found:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by_text[raw].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(found) == len(docs)
    assert sorted(r.size for r in sharding.shard(rows, 3).collect()) == sorted(len((t or "").encode()) + 8 for _, t, _, _ in ROWS)
    assert sharding.shard(empty).count() == 0


def test_lanes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LANE_ROWS", 5)
    found = sharding.shard(spark.range(200).selectExpr("id AS doc_id", "'same' AS text"), 4).collect()
    assert len({r.shard for r in found}) == 1 and sorted(r.slot for r in found) == list(range(200))


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 5), ("d", 0)], "source string, source_size long")
    found = {r.source: (r.weight, r.target) for r in mixing.targets(sizes).collect()}
    assert found["b"] == (2.0, 30.0) and found["d"] == (1.0, 0.0) and found[None] == (2.0, 15.0)
    assert abs(sum(t for _, t in found.values()) - 1515) < 1e-9 and abs(found["c"][1] / found["a"][1] - 3) < 1e-9


def test_split_tree_is_exact(spark):
    draws = spark.range(1000).selectExpr("id AS block", "id % 3 AS source_no")
    found = mixing.split_tree(draws, ["source_no", "block"], 7, 1).groupBy("shard").count().collect()
    assert len(found) == 7 and max(r["count"] for r in found) - min(r["count"] for r in found) <= 3


def test_mix(spark, sf, rows, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    mix = mixing.Mix(docs)
    found = mix.taken().collect()
    taken, target = collections.Counter(), {}
    for r in found:
        source, size = words[r.doc_id]
        assert r.size == size and r.taken == size * r.copies <= 3 * size and len(r.shards) == r.copies
        taken[source] += r.taken
        target[source] = r.target
    largest = max(s for _, s in words.values())
    assert all(abs(taken[s] - t) <= largest for s, t in target.items())
    assert collections.Counter(r.doc_id for r in mix.rows_of().collect()) == collections.Counter({r.doc_id: r.copies for r in found if r.copies})
    again = {r.doc_id: r.taken for r in mixing.Mix(docs.repartition(5)).taken().collect()}
    assert again == {r.doc_id: r.taken for r in found}
    assert mixing.Mix(rows).taken().count() == len(ROWS) and mixing.Mix(rows).rows_of().columns == rows.columns
    assert mixing.Mix(empty).taken().count() == mixing.Mix(empty).rows_of().count() == 0


def test_mix_carries_what_a_long_document_leaves(spark):
    sizes = {0: 200_000} | {i: 15 + i % 21 for i in range(1, 2001)}
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in sizes.items()], "doc_id long, text string, source string")
    small = sum(sizes.values()) - sizes[0]
    for budget in (0.6, 0.16, 0.1613):
        mix = mixing.Mix(docs, budget=budget)
        found = mix.taken().collect()
        want, taken = min(small, budget * sum(sizes.values())), sum(r.taken for r in found)
        assert want - 15 < taken <= want + 1e-6 and not any(r.copies for r in found if r.doc_id == 0)
        assert all(len(r.shards) == r.copies for r in found)
        assert collections.Counter(r.doc_id for r in mix.rows_of().collect()) == collections.Counter({r.doc_id: 1 for r in found if r.copies})
