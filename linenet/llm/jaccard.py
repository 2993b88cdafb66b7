"""N-gram Jaccard join over a token-group matrix.

A document's set holds hashes of its distinct `WORDS_EACH`-word shingles; equal sets are one class from the start.
Classes that probably resemble each other (their least hashes agree) are dealt to the same group, large groups being
split. Inside a group all classes are compared. Between groups, a class opens another group only if one of its rarest
tokens (as many as a link cannot do without) stands in the group's row of tokens and if the whole group's union of
tokens could hold enough of its own (and, before any set is sent, if parities of token classes allow a link with a
member); then it is compared with the members. Classes already joined need no comparison,
so a huge cluster of near copies costs one pass, not all pairs. Links are decided exactly; components follow.

The order of rarity comes from counts of frequent tokens and of words, gathered over all documents; it is advisory (any
order that all documents share gives the same links), so its tables are bounded by `FREQUENT` and `WORDS_KNOWN` rows.

Cases: words are as the contract has them; with fewer words than a shingle the whole sequence is one shingle; a null,
empty or blank text has the empty set, no links, and its own doc_id as component; a null doc_id is never the smallest;
very long texts are read whole (a group of texts is cut after TEXT_BYTES, not a text); repeated rows and ties are
linked; an empty table gives an empty table; other columns are carried or not read, whatever their names. Token and class
hashes have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linenet.llm.common import discard, lean, materialize, quoted, sliced, unpack, whole_row
from linenet.llm.components import components
from linenet.llm.suffix import Hashes, U, mix

WORDS_EACH = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity of 0.8
KEYS = 6
GROUP_TOKENS = 1_000_000
TEXT_BYTES = 1 << 18
PIVOTS = 3
FREQUENT = 1 << 17
SEEN = 2
BATCH = 2000
WORDS_KNOWN = 1 << 16
ASKERS = 1 << 14
BROADCAST_ROWS, BITMAP_ROWS = 200_000, 4_000_000
SLICE = 50
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], rarity=None, words_seen: list | None = None) -> list:
    """The sorted distinct shingle hashes of each text. rarity (word hashes and their logarithmic counts): with each
    set how common its shingles should be, as the sum over their words. words_seen gets all word hashes."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = LOWER[np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)] if texts else np.zeros(0, np.uint8)
    if not len(data):
        return []
    blank = SPACE[data]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = mix(Hashes(data).of(begin, end) + (end - begin).astype(np.uint64))
    owner = np.searchsorted(np.cumsum(sizes), begin, side="right")
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    if words_seen is not None:
        words_seen.append(words)
    common = np.zeros(len(words))
    if rarity is not None and len(rarity[0]):
        at = np.minimum(np.searchsorted(rarity[0], words), len(rarity[0]) - 1)
        common = np.where(rarity[0][at] == words, rarity[1][at], 0.0)
    n = max(0, len(words) - WORDS_EACH + 1)
    grams = np.full(n, U(WORDS_EACH))
    for j in range(WORDS_EACH):
        grams = mix(grams * U(0x9E3779B97F4A7C15) + words[j : j + n])
    expected = sum((common[j : j + n] for j in range(WORDS_EACH)), np.zeros(n))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS_EACH:
            tokens, at = np.unique(grams[a : b - WORDS_EACH + 1], return_index=True)
            out.append(tokens if rarity is None else (tokens, expected[a + at]))
        elif b > a:
            whole = U(b - a)
            for w in words[a:b]:
                whole = mix(np.array([whole * U(0x9E3779B97F4A7C15) + w]))[0]
            out.append(np.array([whole], np.uint64) if rarity is None else (np.array([whole], np.uint64), np.zeros(1)))
        else:
            out.append(np.zeros(0, np.uint64) if rarity is None else (np.zeros(0, np.uint64), np.zeros(0)))
    return out


def sets_of(texts: list[str], rarity=None, words_seen: list | None = None):
    """Yields (first text number, sets) for groups of texts of bounded size."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        part = []
        while end < len(texts) and (end == begin or size < TEXT_BYTES):
            part.append(texts[end].encode())
            size += len(part[-1])
            end += 1
        with np.errstate(over="ignore"):
            yield begin, shingle_sets(part, rarity, words_seen)
        begin = end


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def needed(n: int) -> int:
    """Tokens that a set of n must share with any set it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def linked(n: int, others: np.ndarray, shared: np.ndarray) -> np.ndarray:
    return (DENOMINATOR * shared >= NUMERATOR * (n + others - shared)) & (shared > 0)


def group_keys(tokens: np.ndarray) -> list[int]:
    """Keys from pairs of least hashes under several orders; similar sets share some of them."""
    keys = []
    with np.errstate(over="ignore"):
        for j in range(KEYS):
            order = mix(tokens ^ U((j + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
            least = np.sort(np.partition(order, 1)[:2]) if len(order) > 1 else np.array([order[0], order[0]])
            keys.append(int(mix(np.array([least[0] * U(3) + least[1] + U(j)])).view(np.int64)[0]))
    return keys


def parities(tokens: np.ndarray) -> bytes:
    """For each of as many classes of tokens as there are tokens (a power of 2) whether the set has an odd number of them.
    Two sets differ in at most as many of these as they differ in tokens."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (rows of 64-bit words) over fewer classes: halves of the classes meet."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class Resemblance:
    """The parities of a group's members, by their number of classes."""

    def __init__(self, members: list[tuple[int, bytes]]):
        by_words: dict[int, list] = {}
        for at, (n, bits) in enumerate(members):
            by_words.setdefault(len(bits) // 8, []).append((at, n, bits))
        self._parts = []
        for of in by_words.values():
            at, n, bits = zip(*of, strict=True)
            self._parts.append((np.array(at), np.array(n), np.frombuffer(b"".join(bits), np.uint64).reshape(len(of), -1)))

    def of(self, n: int, bits: bytes) -> np.ndarray:
        """The members that may link to a set of n tokens: sets that link differ in a ninth of their tokens at most."""
        own, out = np.frombuffer(bits, np.uint64), []
        for at, sizes, theirs in self._parts:
            words = min(theirs.shape[1], len(own))
            differ = np.bitwise_count(folded(theirs, words) ^ folded(own, words)).sum(axis=1, dtype=np.int64)
            near = (NUMERATOR + DENOMINATOR) * differ <= (DENOMINATOR - NUMERATOR) * (sizes + n)
            near &= (DENOMINATOR * sizes >= NUMERATOR * n) & (DENOMINATOR * n >= NUMERATOR * sizes)
            out.append(at[near])
        return np.sort(np.concatenate(out))


class GroupRow:
    """The token-group matrix's row of one group: its union of tokens, and who has each."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self._owner = owner[order]
        self.union, self._first = np.unique(tokens[order], return_index=True)
        self._ends = np.append(self._first[1:], len(tokens))
        self.sizes, self._n = np.array([len(s) for s in sets]), len(sets)

    def shared(self, tokens: np.ndarray) -> np.ndarray | None:
        """Tokens shared with each member; None if the union bounds them below what a link needs."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < needed(len(tokens)):
            return None
        spans = self._ends[at] - self._first[at]
        offset = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
        return np.bincount(self._owner[np.repeat(self._first[at], spans) + offset], minlength=self._n)


def link_inside(sets: list[np.ndarray], first: list[int]) -> list[int]:
    """For each member the representative of its component; members in `first` represent before others do."""
    parent = list(range(len(sets)))
    rank = {m: i for i, m in enumerate(first)}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    row, parts = GroupRow(sets), len(sets)
    for i in range(len(sets)):
        if parts == 1:
            break
        shared = row.shared(sets[i])
        for j in np.flatnonzero(linked(len(sets[i]), row.sizes, shared)).tolist() if shared is not None else ():
            a, b = sorted((root(i), root(j)), key=lambda x: (rank.get(x, len(sets)), x))
            if a != b:
                parent[b] = a
                parts -= 1
    return [root(i) for i in range(len(sets))]


COUNTS = "array<struct<token:long,seen:long>>"
PROFILE = f"doc_id long, tid long, n long, class long, keys array<long>, bits binary, frequent {COUNTS}, words {COUNTS}"


def most_seen(values: np.ndarray, least: int, most: int) -> list[dict]:
    """The most frequent values with their counts."""
    found, seen = np.unique(values, return_counts=True)
    often = np.flatnonzero(seen >= least)
    often = often[np.argsort(-seen[often], kind="stable")[:most]]
    return [{"token": t, "seen": c} for t, c in zip(found[often].view(np.int64).tolist(), seen[often].tolist(), strict=True)]


def _profiles(rows: DataFrame) -> DataFrame:
    """rows: doc_id, tid, text. Size, class and group keys of each; on a batch's first row, the batch's frequent tokens and words."""

    def run(batches):
        import pyarrow as pa

        counts = pa.list_(pa.struct([("token", pa.int64()), ("seen", pa.int64())]))
        kinds = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary()), ("frequent", counts), ("words", counts)])
        for batch in sliced(batches, BATCH):
            ids, tids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, kept, known, words = [], [], {}, []
            for begin, sets in sets_of(batch.column(2).to_pylist(), None, words):
                for i, s in enumerate(sets, begin):
                    name = class_of(s)
                    if name not in known:
                        known[name] = (group_keys(s), parities(s)) if len(s) else ([], b"")
                        kept.append(s)
                    out.append({"doc_id": ids[i], "tid": tids[i], "n": len(s), "class": name, "keys": known[name][0], "bits": known[name][1], "frequent": None, "words": None})
            if kept:
                out[0]["frequent"] = most_seen(np.concatenate(kept), SEEN, FREQUENT // 2)
                out[0]["words"] = most_seen(np.concatenate(words), 2, WORDS_KNOWN // 4)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return rows.mapInArrow(lean(run), PROFILE)


def _chosen(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows joined with wanted (w_id, w_tid, ...) by identifier and text hash. Up to BROADCAST_ROWS wanted rows and
    seats are broadcast; up to BITMAP_ROWS, a bitmap of 16 bits for each (broadcast too, so of bounded size) first keeps most other
    rows from being shuffled; beyond, Spark shuffles both sides."""
    same = (F.col("tid") == F.col("w_tid")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    n = wanted.agg(F.coalesce(F.sum(F.size("seats") + 1), F.lit(0))).first()[0]
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), same)
    if n <= BITMAP_ROWS:
        bits = (16 * n - 1).bit_length()
        place = F.shiftrightunsigned("w_tid", 64 - bits)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(w_tid, {64 - bits}) & 63 as int))")
        words = wanted.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        inside = F.expr(f"bits & shiftleft(1L, cast(shiftrightunsigned(tid, {64 - bits}) & 63 as int))") != 0
        rows = rows.join(F.broadcast(words), F.shiftrightunsigned("tid", 64 - bits + 6) == F.col("word")).where(inside).drop("word", "bits")
    return rows.join(wanted, same)


SEAT = "grp long, part int, asks boolean, own boolean, pivot boolean, label long"


def _seated(rows: DataFrame, reps: DataFrame, seats: DataFrame) -> DataFrame:
    """seats: class and SEAT. Each seat with `tokens` (little-endian bytes) of its class, from the text of the class's
    representative, in the order of groups; so texts of the classes seated and their tokens travel once."""
    names = [c.split()[0] for c in SEAT.split(", ")]
    wanted = seats.groupBy("class").agg(F.collect_list(F.struct(*names)).alias("seats")).join(reps, "class")
    wanted = materialize(wanted.select("class", "seats", F.col("doc_id").alias("w_id"), F.col("tid").alias("w_tid")), "jaccard-wanted")

    def run(batches):
        import pyarrow as pa

        seat = {"grp": pa.int64(), "part": pa.int32(), "asks": pa.bool_(), "own": pa.bool_(), "pivot": pa.bool_(), "label": pa.int64()}
        kinds = pa.schema([("class", pa.int64()), *seat.items(), ("tokens", pa.binary())])
        for batch in sliced(batches, SLICE):
            classes, texts, places = (batch.column(i).to_pylist() for i in range(3))
            for begin, sets in sets_of(texts):
                out = [{"class": classes[i], **at, "tokens": s.tobytes()} for i, s in enumerate(sets, begin) for at in places[i]]
                for k in range(0, len(out), SLICE):
                    yield pa.RecordBatch.from_pylist(out[k : k + SLICE], schema=kinds)

    found = _chosen(rows, wanted).select("class", "text", "seats")
    out = found.mapInArrow(lean(run), f"class long, {SEAT}, tokens binary")
    return out.repartition("grp", "part").sortWithinPartitions("grp", "part", "asks", "class")


def _groups(classes: DataFrame) -> DataFrame:
    """class, n, grp (its group), pivot; groups of one class are named by it."""
    keyed = classes.select("class", "n", F.explode("keys").alias("key"))
    popular = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "jaccard-keys")
    best = keyed.join(popular, "key").groupBy("class").agg(F.max(F.struct("size", "key")).alias("best"), F.first("n").alias("n"))
    chosen = materialize(best.select("class", "n", F.col("best.key").alias("key")), "jaccard-chosen")
    totals = materialize(chosen.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens")).where("members > 1").withColumn("parts", F.ceil(F.col("tokens") / GROUP_TOKENS).cast("int")), "jaccard-totals")
    placed = chosen.join(totals, "key").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    own = placed.select("class", "n", "key", "part", "parts", F.xxhash64("key", "part").alias("grp"), F.lit(True).alias("own"))
    lowest = F.row_number().over(Window.partitionBy("key").orderBy("class"))
    split = placed.where("parts > 1")
    pivots = split.withColumn("place", lowest).where(F.col("place") <= PIVOTS).select("class", "n", "key", F.col("part").alias("home"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    guests = pivots.where("part <> home").select("class", "n", "key", "part", "parts", F.xxhash64("key", "part").alias("grp"), F.lit(False).alias("own"))
    first = pivots.select(F.col("class").alias("p_class"), "part", "key").distinct()
    everyone = own.unionByName(guests)
    joined = everyone.join(first.withColumnsRenamed({"part": "p_part", "key": "p_key"}), (F.col("class") == F.col("p_class")) & (F.col("key") == F.col("p_key")) & (F.col("part") == F.col("p_part")), "left")
    return joined.select("class", "n", "grp", "own", F.col("p_class").isNotNull().alias("pivot"))


def _solve_inside(members: DataFrame) -> DataFrame:
    """members: as seated. class, label (the representative of its component inside the group), own."""

    def solve(names, sets, own, pivot, pa):
        first = [i for _, i in sorted((names[i], i) for i in range(len(names)) if pivot[i])]
        labels = [names[x] for x in link_inside(sets, first)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(labels, pa.int64()), pa.array(own, pa.bool_())], names=["class", "label", "own"])

    def run(batches):
        import pyarrow as pa

        group, names, sets, own, pivot = None, [], [], [], []
        for batch in sliced(batches, SLICE):
            for r in batch.select(["grp", "class", "own", "pivot", "tokens"]).to_pylist():
                if r["grp"] != group:
                    if names:
                        yield solve(names, sets, own, pivot, pa)
                    group, names, sets, own, pivot = r["grp"], [], [], [], []
                if names and names[-1] == r["class"]:  # the representative's row stands twice in the input
                    continue
                names.append(r["class"])
                sets.append(np.frombuffer(r["tokens"], np.uint64))
                own.append(r["own"])
                pivot.append(r["pivot"])
        if names:
            yield solve(names, sets, own, pivot, pa)

    return members.mapInArrow(lean(run), "class long, label long, own boolean")


def _postings(rows: DataFrame, order) -> DataFrame:
    """token, class, rest (tokens from this one on): of each set as many of the rarest tokens as a link cannot do without."""

    def run(batches):
        import pyarrow as pa

        common, rank, words, counts = order.value
        for batch in sliced(batches):
            seen = set()
            for _, sets in sets_of(batch.column(0).to_pylist(), (words, counts)):
                tokens, names, rests = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
                for s, expected in sets:
                    if not len(s) or (name := class_of(s)) in seen:
                        continue
                    seen.add(name)
                    at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                    often = common[at] == s if len(common) else np.zeros(len(s), bool)
                    weight = np.zeros(len(s), np.int64)
                    weight[often] = rank[at[often]]
                    ordered = s[np.lexsort((s, expected, weight))]
                    part = ordered[: len(s) - needed(len(s)) + 1]
                    tokens.append(part)
                    names += [name] * len(part)
                    rests.append(len(s) - np.arange(len(part)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(names, pa.int64()), pa.array(np.concatenate(rests))], names=["token", "class", "rest"])

    return rows.select("text").mapInArrow(lean(run), "token long, class long, rest long")


def _solve_between(members: DataFrame) -> DataFrame:
    """members: as seated. Links a, b: from a class that asks to the label of each component of the group with a member
    that it links to, so as many as components, not members."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        group, last, names, sets, row = None, None, [], [], None
        for batch in sliced(batches, SLICE):
            out = []
            for r in batch.select(["grp", "part", "asks", "class", "label", "tokens"]).to_pylist():
                if (r["grp"], r["part"]) != group:
                    group, last, names, sets, row = (r["grp"], r["part"]), None, [], [], None
                if last == (r["asks"], r["class"]):  # the representative's row stands twice in the input
                    continue
                last = (r["asks"], r["class"])
                own = np.frombuffer(r["tokens"], np.uint64)
                if not r["asks"]:
                    names.append(r["label"])
                    sets.append(own)
                    continue
                row = row or GroupRow(sets)
                shared = row.shared(own)
                if shared is not None:
                    out += [{"a": r["class"], "b": b} for b in sorted({names[j] for j in np.flatnonzero(linked(len(own), row.sizes, shared)).tolist()})]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return members.mapInArrow(lean(run), "a long, b long")


def _seats_between(asked: DataFrame, homes: DataFrame, classes: DataFrame) -> DataFrame:
    """asked: class, grp. The seats (class, SEAT) that are worth tokens: parities go to the group first, and only askers
    that some member resembles, and members that some asker resembles, are seated. Questions to one group are dealt to
    parts of about ASKERS, each with the group's members."""
    parts = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("parts"))
    askers = asked.join(parts, "grp").select("grp", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"), "class", F.lit(None).cast("long").alias("label"))
    members = homes.join(parts, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "class", "label")
    both = askers.unionByName(members).join(classes.select("class", "n", "bits"), "class")

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("class", pa.int64()), ("grp", pa.int64()), ("part", pa.int32()), ("asks", pa.bool_()), ("label", pa.int64())])
        group, held, near, wanted = None, [], None, set()

        def seat(r):
            return {k: r[k] for k in ("class", "grp", "part", "asks", "label")}

        for batch in sliced(batches, 1000):
            out = []
            for r in batch.to_pylist():
                if (r["grp"], r["part"]) != group:
                    out += [seat(held[i]) for i in sorted(wanted)]
                    group, held, near, wanted = (r["grp"], r["part"]), [], None, set()
                if not r["asks"]:
                    held.append(r)
                    continue
                near = near or Resemblance([(m["n"], m["bits"]) for m in held])
                found = near.of(r["n"], r["bits"]).tolist()
                wanted.update(found)
                if found:
                    out.append(seat(r))
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
        yield pa.RecordBatch.from_pylist([seat(held[i]) for i in sorted(wanted)], schema=kinds)

    dealt = both.repartition("grp", "part").sortWithinPartitions("grp", "part", "asks", "class")
    found = dealt.mapInArrow(lean(run), "class long, grp long, part int, asks boolean, label long")
    return found.withColumn("own", ~F.col("asks")).withColumn("pivot", F.lit(False))


def _most(profiles: DataFrame, column: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the values most seen over all documents, `most` of them at most: those over the least
    bound on counts (an eighth of an octave each) that so few are over, so no task gathers more than the driver does."""
    seen = profiles.where(F.col(column).isNotNull()).select(F.explode(column).alias("f")).groupBy("f.token").agg(F.sum("f.seen").alias("seen"))
    seen = materialize(seen.withColumn("octave", F.floor(F.log2("seen") * 8).cast("int")), "jaccard-seen")
    bound, total = None, 0
    for octave, n in sorted(((r.octave, r.n) for r in seen.groupBy("octave").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):  # 512 at most
        total += n
        if total > most:
            break
        bound = octave
    found = [] if bound is None else sorted((r.token & (2**64 - 1), r.seen) for r in seen.where(F.col("octave") >= bound).collect())
    return np.array([t for t, _ in found], np.uint64), np.array([s for _, s in found], np.int64)


def _classes(profiles: DataFrame) -> DataFrame:
    """class, n, keys, bits, and doc_id, tid of its representative: the row with the smallest doc_id."""
    ordered = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("tid").alias("z"))
    classes = profiles.where("n > 0").groupBy("class").agg(F.min(ordered).alias("rep"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits"))
    return classes.select("class", "n", "keys", "bits", F.col("rep.y").alias("doc_id"), F.col("rep.z").alias("tid"))


def _homes(classes: DataFrame, groups: DataFrame, inside: DataFrame) -> DataFrame:
    """class, n, grp and label of each class (alone: itself), with the group's least and most n."""
    own = groups.where("own").select("class", "grp").join(inside.where("own").select("class", "label"), "class")
    group = Window.partitionBy(F.coalesce("grp", "class"))
    every = classes.select("class", "n").join(own, "class", "left")
    return every.select("class", F.coalesce("grp", "class").alias("grp"), F.coalesce("label", "class").alias("label"), "n", F.min("n").over(group).alias("least"), F.max("n").over(group).alias("most"))


def _asked(rows: DataFrame, homes: DataFrame, order) -> DataFrame:
    """class, grp: which classes ask which other groups, by the rarest tokens that a link cannot do without."""
    token = Window.partitionBy("token")
    by_class = token.orderBy("class")
    found = _postings(rows, order).withColumn("before", F.lag("class").over(by_class)).withColumn("several", F.min("class").over(token) != F.max("class").over(token))
    postings = materialize(found.where("several AND (before IS NULL OR before <> class)").select("token", "class", "rest"), "jaccard-postings")
    found = postings.join(homes, "class").withColumn("apart", F.min("label").over(token) != F.max("label").over(token))
    apart = materialize(found.where("apart").select("token", "class", "rest", "grp", "label", "n", "least", "most"), "jaccard-apart")
    discard(postings)
    rows_of = apart.groupBy("token", F.col("grp").alias("o_grp"), F.col("label").alias("o_label"))
    rows_of = rows_of.agg(F.max("rest").alias("o_rest"), F.min("least").alias("o_least"), F.max("most").alias("o_most"))
    sizes = f"{DENOMINATOR} * o_most >= {NUMERATOR} * n AND {NUMERATOR} * o_least <= {DENOMINATOR} * n"
    enough = f"{NUMERATOR + DENOMINATOR} * least(rest, o_rest) >= {NUMERATOR} * (n + o_least)"  # what follows the first token shared bounds the overlap
    asked = apart.join(rows_of, "token").where(f"label < o_label AND grp <> o_grp AND {sizes} AND {enough}")
    asked = materialize(asked.select("class", F.col("o_grp").alias("grp")).distinct(), "jaccard-asked")
    discard(apart)
    return asked


def _resolve(docs: DataFrame, text: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows (doc_id, tid, n, class), and root by class for classes that link to others."""
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(quoted(ident).cast("long").alias("doc_id"), F.xxhash64(whole).alias("tid"), whole.alias("text"))
    profiles = materialize(_profiles(rows), "jaccard-profiles")
    often, words = _most(profiles, "frequent", FREQUENT), _most(profiles, "words", WORDS_KNOWN)
    classes = materialize(_classes(profiles), "jaccard-classes")
    slim = materialize(profiles.select("doc_id", "tid", "n", "class"), "jaccard-slim")
    discard(profiles)
    reps = classes.select("class", "doc_id", "tid")
    groups = materialize(_groups(classes), "jaccard-groups")
    seats = groups.select("class", "grp", F.lit(0).alias("part"), F.lit(False).alias("asks"), "own", "pivot", F.lit(None).cast("long").alias("label"))
    inside = materialize(_solve_inside(_seated(rows, reps, seats)), "jaccard-inside")
    homes = materialize(_homes(classes, groups, inside), "jaccard-homes")
    shared = docs.sparkSession.sparkContext.broadcast((*often, words[0], np.log1p(words[1])))  # FREQUENT + WORDS_KNOWN rows at most
    asked = _asked(rows, homes, shared)
    seats = materialize(_seats_between(asked, homes.select("class", "grp", "label"), classes), "jaccard-seats")
    between = _solve_between(_seated(rows, reps, seats))
    links = materialize(inside.select(F.col("class").alias("a"), F.col("label").alias("b")).unionByName(between), "jaccard-links")
    for spent in (classes, groups, inside, homes, asked, seats):
        discard(spent)
    return slim, components(links)


def jaccard_components(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for each row of docs."""
    profiles, roots = _resolve(docs, text, ident)
    key = F.when(F.col("n") > 0, F.col("class"))  # rows without shingles have one class, and no links: a null key is not dealt out by it
    placed = profiles.withColumn("key", key).join(roots.withColumnRenamed("vertex", "key"), "key", "left").drop("key").withColumn("root", F.coalesce("root", "class"))
    placed = materialize(placed, "jaccard-placed")
    least = materialize(placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "jaccard-least")
    out = placed.join(least, (placed["root"] == least["root"]) & (placed["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("class").alias("class_id"))


def near_dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One document of each component stays, that with the smallest doc_id (nulls last; then by a hash of the text).
    Rows without shingles all stay; rows that repeat both doc_id and text are one document."""
    profiles, roots = _resolve(docs, text, ident)
    named = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("tid").alias("z"))
    placed = profiles.where("n > 0").join(roots.withColumnRenamed("vertex", "class"), "class", "left").select("doc_id", "tid", F.coalesce("root", "class").alias("root"))
    placed = materialize(placed, "jaccard-placed")
    stays = materialize(placed.groupBy("root").agg(F.min(named).alias("stays"), F.count(F.lit(1)).alias("k")).where("k > 1").select("root", F.col("stays.y").alias("s_id"), F.col("stays.z").alias("s_tid")), "jaccard-stays")
    gone = placed.join(stays, "root").where("NOT (doc_id <=> s_id AND tid = s_tid)").select(F.col("doc_id").alias("g_id"), F.col("tid").alias("g_tid")).distinct()
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(whole_row(docs), quoted(ident).cast("long").alias("doc_id"), F.xxhash64(whole).alias("tid"))
    return unpack(rows.join(materialize(gone, "jaccard-gone"), (F.col("tid") == F.col("g_tid")) & F.col("doc_id").eqNullSafe(F.col("g_id")), "left_anti"), docs.columns)
