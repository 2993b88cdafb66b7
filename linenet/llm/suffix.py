"""Suffix-array dedup: every byte covered by a `LENGTH`-byte string that also starts elsewhere is removed.

Across the corpus, equal strings are brought together by anchors: a string's anchor is the `GRAM`-byte piece of it with
the least hash, so equal strings have equal anchors at equal places, whichever documents hold them. Anchors are
shuffled by hash and compared with their neighbours in sort order. Those that occur once go; those whose whole
surroundings occur twice need no more; for the others the surroundings are suffix-sorted, in blocks of whole anchor
groups. Sorting has two stages: only suffixes smaller than their successors are sorted directly, the rest follow by
scanning buckets; then the common prefixes of neighbours show which strings of a group are equal. (All of a group share
the anchor itself, which stands in the block as a short token.) A group of more than `CROWD` different surroundings is
too large for one block: its strings are counted by hash in many tasks instead.

Cases: a null text is empty; texts shorter than `LENGTH` lose nothing; texts with copies lose everything (from `LENGTH`
bytes on); repeated rows are copies; a null doc_id is a doc_id like others; very long texts are read whole; an
empty table gives an empty table; other columns are not read, whatever their names. Strings are judged on the input, by 64-bit hashes (with text hash and length for whole texts).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linenet.llm.common import discard, lean, materialize, quoted

LENGTH, GRAM = 200, 128
SIDE = LENGTH - GRAM
TOKEN = 8
BLOCK_BYTES = 2 << 20
CROWD = 20_000
GROUP_BYTES = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C13  # odd, 3 mod 8
TABLE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n. They stay with the worker, so there are at most twice as many as were
    asked for."""
    if not _powers or len(_powers[0]) <= n:
        size = 2 * n + 1
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([[U(1)], np.full(size, U(b))]).cumprod(dtype=np.uint64) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any piece of `data` in constant time."""

    def __init__(self, data: np.ndarray):
        up, self._down = powers(len(data))
        self._sums = np.concatenate([[U(0)], np.cumsum(TABLE[data] * up[: len(data)], dtype=np.uint64)])

    def of(self, begin, end) -> np.ndarray:
        return mix((self._sums[end] - self._sums[begin]) * self._down[begin])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width] for each i, the window cut off at the end."""
    out, k = x, 1
    while k * 2 <= width:
        y = out.copy()
        y[:-k] = best(out[:-k], out[k:])
        out, k = y, k * 2
    if rest := width - k:
        y = out.copy()
        y[:-rest] = best(out[:-rest], out[rest:])
        out = y
    return out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text number, position, anchor hash and hash of the surroundings, for each anchor of texts of LENGTH bytes or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(at, at + GRAM) | U(1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    lowest = sliding(grams, SIDE + 1, np.minimum)
    valid = np.zeros(len(grams), bool)  # a string of LENGTH bytes begins here
    valid[: len(data) - LENGTH + 1] = owner[: len(data) - LENGTH + 1] == owner[LENGTH - 1 :]
    lowest[~valid] = 0
    padded = np.concatenate([np.zeros(SIDE, np.uint64), lowest])
    position = np.flatnonzero(sliding(padded, SIDE + 1, np.maximum)[: len(grams)] >= grams)
    text = owner[position]
    begin, end = np.maximum(position - SIDE, starts[text]), np.minimum(position + LENGTH, ends[text])
    around = mix(hashes.of(begin, end) + (position - begin).astype(np.uint64))
    return text, position - starts[text], grams[position].view(np.int64), around.view(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text, sorted by their first `depth` bytes at least.

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets of first bytes in
    order: the predecessor of each suffix found, if it is not smaller than its successor, is next in its own bucket.
    """
    n = len(text)
    change = np.zeros(n, np.int8)
    change[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    change[-1] = -1
    known = np.where(change != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    smaller = change[np.minimum(known, n - 1)] > 0
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))
    keys = np.ascontiguousarray(rows[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the smallest
    out = []
    for byte in range(256):
        found = induced[byte]
        k = 0
        while k < len(found):  # runs of one byte: their predecessors are in the same bucket
            before = found[k][found[k] > 0] - 1
            before = before[text[before] == byte]
            if len(before):
                found.append(before)
            k += 1
        bucket = np.concatenate([*found, direct[edges[byte] : edges[byte + 1]]]) if found else direct[edges[byte] : edges[byte + 1]]
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > byte], first[first > byte]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part, value in zip(np.split(before, cuts), first[np.concatenate([[0], cuts])].tolist(), strict=True):
                induced[value].append(part)
    return np.concatenate(out)


def common_prefix(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order after the first, whether it shares `depth` (a multiple of 8) bytes with the one before."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(text) + depth, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    equal = np.zeros(max(0, len(order) - 1), bool)
    live = np.arange(len(equal))
    for k in range(0, depth, 8):
        live = live[words[order[live] + k] == words[order[live + 1] + k]]
    equal[live] = True
    return equal


def repeated(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For surroundings (by group): (row, bytes before the anchor) of every string that another row of its group, or a
    row that stands for several, has at the same place."""
    nl, nr = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    text = np.frombuffer(b"".join(a + int(g).to_bytes(TOKEN, "big") + b for g, a, b in zip(groups.tolist(), lefts, rights, strict=True)), np.uint8)
    sizes = nl + nr + TOKEN
    starts = np.cumsum(sizes) - sizes
    order = suffix_order(text, SIDE + TOKEN)
    run = np.concatenate([[0], np.cumsum(~common_prefix(text, order, SIDE + TOKEN))])
    row = np.searchsorted(starts, order, side="right") - 1
    before = nl[row] - (order - starts[row])
    fits = (before >= 0) & (SIDE - before <= nr[row])
    run, row, before = run[fits], row[fits], before[fits]
    key = (run * (groups.max() + 1) + groups[row]) * (SIDE + 1) + before
    by = np.argsort(key, kind="stable")
    key, row, before = key[by], row[by], before[by]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    total = np.bincount(number, weights=1 + twice[row]) if len(key) else np.zeros(0)
    hit = total[number] >= 2 if len(key) else first
    return row[hit], before[hit]


def _strings(rows: DataFrame) -> DataFrame:
    """rows: did, tid, text. The anchors, with equal texts of a batch taken once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seen: dict[str, int] = {}
            dids, tids = batch.column("did").to_pylist(), batch.column("tid").to_pylist()
            first: list[int] = []
            many: list[bool] = []
            texts: list[bytes] = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                if len(t) * 4 < LENGTH:
                    continue
                if t in seen:
                    many[seen[t]] = True
                    continue
                seen[t] = len(first)
                first.append(i)
                many.append(False)
                texts.append(t.encode())
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size < GROUP_BYTES):
                    size += len(texts[end])
                    end += 1
                with np.errstate(over="ignore"):
                    text, position, gram, around = anchors(texts[begin:end])
                text = (text + begin).tolist()
                columns = [
                    pa.array(gram), pa.array(around), pa.array([dids[first[t]] for t in text], pa.int64()), pa.array([tids[first[t]] for t in text], pa.int64()),
                    pa.array([len(texts[t]) for t in text], pa.int32()), pa.array(position.astype(np.int32)), pa.array([many[t] for t in text], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "did", "tid", "n", "pos", "many"])
                begin = end

    return rows.mapInArrow(lean(run), "h long, c long, did long, tid long, n int, pos int, many boolean")


def _hits(found: DataFrame) -> DataFrame:
    """Anchors that occur more than once: `twice` if with equal surroundings; `rep` for one of each different surroundings."""
    group = Window.partitionBy("h")
    by = group.orderBy("c")
    return (
        found.withColumn("before", F.lag("c").over(by))
        .withColumn("after", F.lead("c").over(by))
        .withColumn("mixed", F.min("c").over(group) != F.max("c").over(group))
        .withColumn("new", F.col("before").isNull() | (F.col("before") != F.col("c")))
        .withColumn("twice", F.col("many") | ~F.col("new") | F.coalesce(F.col("after") == F.col("c"), F.lit(False)))
        .withColumn("crowd", F.sum(F.col("new").cast("long")).over(group))
        .where("twice OR mixed")
        .select("h", "did", "tid", "n", "pos", "twice", (F.col("mixed") & F.col("new")).alias("rep"), "crowd")
    )


def _surroundings(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """h, tid, n, pos, twice, crowd, left, right for each `rep`: the bytes beside the anchor."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for tid, text, wanted in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = text.encode()
                for w in wanted:
                    p = w["pos"]
                    out.append((w["h"], tid, len(data), p, w["twice"], w["crowd"], data[max(0, p - SIDE) : p], data[p + GRAM : p + LENGTH]))
            for begin in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[begin : begin + 20_000], strict=True), kinds(pa), strict=True)], names=names)

    names = ["h", "tid", "n", "pos", "twice", "crowd", "left", "right"]

    def kinds(pa):
        return [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]

    wanted = hits.where("rep").groupBy("did", "tid").agg(F.collect_list(F.struct("h", "pos", "twice", "crowd")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"did": "w_did", "tid": "w_tid"})
    same = (F.col("tid") == F.col("w_tid")) & F.col("did").eqNullSafe(F.col("w_did"))
    return rows.join(wanted, same).select("tid", "text", "wanted").mapInArrow(lean(run), "h long, tid long, n int, pos int, twice boolean, crowd long, left binary, right binary")


SPAN = "tid long, n int, begin int, end int"


def _sorted_spans(around: DataFrame) -> DataFrame:
    """Spans of strings that another member of their anchor group has, by suffix sorting."""

    def solve(rows, pa):
        _, groups = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        twice = np.array([r[4] for r in rows])
        row, before = repeated(groups, [r[5] for r in rows], [r[6] for r in rows], twice)
        keep = ~twice[row]
        row, before = row[keep], before[keep]
        by = np.lexsort((before, row))
        row, before = row[by], before[by]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (before[1:] != before[:-1] + 1)]) if len(row) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        lasts = np.append(begins[1:], len(row)) - 1 if len(row) else begins
        out = [(rows[r][1], rows[r][2], rows[r][3] - int(b), rows[r][3] - int(a) + LENGTH) for r, a, b in zip(row[begins].tolist(), before[begins], before[lasts], strict=True)]
        return pa.RecordBatch.from_pylist([dict(zip(("tid", "n", "begin", "end"), o, strict=True)) for o in out], schema=pa.schema([("tid", pa.int64()), ("n", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        import pyarrow as pa

        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size >= BLOCK_BYTES and r[0] != last:
                    yield solve(held, pa)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r[5]) + len(r[6]) + TOKEN, r[0]
        if held:
            yield solve(held, pa)

    rows = around.where(F.col("crowd") <= CROWD).select("h", "tid", "n", "pos", "twice", "left", "right")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(lean(run), SPAN)


def _counted_spans(around: DataFrame) -> DataFrame:
    """The same for groups over CROWD: strings are dealt out by their own hash, and counted."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for h, tid, n, pos, twice, left, right in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                ks = [k for k in range(len(left) + 1) if SIDE - k <= len(right)]
                keys = [int.from_bytes(hashlib.blake2b(left[len(left) - k :] + right[: SIDE - k], digest_size=8).digest(), "big", signed=True) for k in ks]
                m = len(ks)
                yield pa.RecordBatch.from_arrays([pa.array([h] * m, pa.int64()), pa.array(ks, pa.int32()), pa.array(keys, pa.int64()), pa.array([tid] * m, pa.int64()), pa.array([n] * m, pa.int32()), pa.array([pos] * m, pa.int32()), pa.array([twice] * m, pa.bool_())], names=["h", "k", "key", "tid", "n", "pos", "twice"])

    rows = around.where(F.col("crowd") > CROWD).select("h", "tid", "n", "pos", "twice", "left", "right")
    each = rows.mapInArrow(lean(run), "h long, k int, key long, tid long, n int, pos int, twice boolean")
    same = F.sum(F.when(F.col("twice"), 2).otherwise(1)).over(Window.partitionBy("h", "k", "key"))
    return each.withColumn("total", same).where("total >= 2 AND NOT twice").select("tid", "n", (F.col("pos") - F.col("k")).alias("begin"), (F.col("pos") - F.col("k") + LENGTH).alias("end"))


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, text: str = "text", ident: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the bytes kept."""
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(quoted(ident).cast("long").alias("did"), F.xxhash64(whole).alias("tid"), F.octet_length(whole).alias("n"), whole.alias("text"))
    hits = materialize(_hits(_strings(rows.select("did", "tid", "text"))), "suffix-hits")
    copied = materialize(rows.groupBy("tid", "n").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("tid", "n"), "suffix-copied")
    around = materialize(_surroundings(rows.select("did", "tid", "text"), hits), "suffix-around")
    spans = _sorted_spans(around)
    if not around.where(F.col("crowd") > CROWD).isEmpty():
        spans = spans.unionByName(_counted_spans(around))
    plain = hits.where("twice").select("tid", "n", F.greatest(F.col("pos") - SIDE, F.lit(0)).alias("begin"), F.least(F.col("pos") + LENGTH, F.col("n")).alias("end"))
    spans = materialize(spans.unionByName(plain), "suffix-spans")
    discard(hits)
    discard(around)
    spans = spans.join(copied, ["tid", "n"], "left_anti")
    by_text = spans.groupBy("tid", "n").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    every = copied.select("tid", "n", F.lit(None).cast("array<struct<begin:int,end:int>>").alias("spans"), F.lit(True).alias("all"))
    cuts = materialize(by_text.withColumn("all", F.lit(False)).unionByName(every), "suffix-cuts")

    def run(batches):
        import pyarrow as pa

        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if with_text else [])
        for batch in batches:
            out = []
            for did, t, own, whole_text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = t.encode()
                found = ([(0, len(data))] if len(data) >= LENGTH else []) if whole_text else union_of([(s["begin"], s["end"]) for s in own or []])
                parts, at = [], 0
                for begin, end in found:
                    parts.append(data[at:begin])
                    at = end
                kept = b"".join([*parts, data[at:]])
                out.append({"doc_id": did, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(found), "kept_sha256": hashlib.sha256(kept).hexdigest(), **({"kept": kept} if with_text else {})})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    joined = rows.join(cuts, ["tid", "n"], "left").select("did", "text", "spans", "all")
    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
