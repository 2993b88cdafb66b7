"""SentencePiece encoding and decoding with sampled segmentations, without replacement.

The vocabulary comes from a public SentencePiece model file (its path is a parameter; nothing is trained). Its pieces
weigh by rank as a Zipf unigram model does, so a text has a lattice of segmentations. A perturbed A* search emits the
`k` best of all segmentations under Gumbel noise: these are draws without replacement. Its nodes are sets of
segmentations with a common beginning, its bound for a node is the node's exact greatest perturbed log-probability
(sums over the lattice give the node's mass, and the noise is drawn from the top down), and a node's best child
inherits that bound. The inclusion score of a draw is the chance that its noise would pass the best one left out.
Noise is a hash of the row's key, so reruns and other partitionings agree.

Pieces cross no line end and take blanks only at their front, so the lattice is a chain of units (blanks and what
follows them); the distinct units of a group of rows share their tables, and all rows walk them in step in numpy.

Cases: null and empty texts have the empty segmentation (score 1); a text with fewer than k segmentations gives what it
has; characters outside the vocabulary (and U+2581 itself) become byte pieces; a null key is a key; repeated rows are
segmented alike; very long texts are segmented whole, in a group of their own; draws of equal noise (a tie) come in the
order of the search; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linenet.llm.common import lean, quoted, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, SAMPLES = 11, 2
GROUP_CHARS = 1 << 17
ROWS_KEPT = 1 << 18
UNITS = re.compile(r" *[^ \n]+| +|\n")
BLANK, FALLBACK = 0x2581, 1 << 21
GOLD = np.uint64(0x9E3779B97F4A7C15)
ONE = np.zeros(1, np.int64)
FIRST_STEPS = 256


class Vocabulary:
    """Pieces as a trie over code points, held in arrays that a batch of lookups goes through at once."""

    def __init__(self, pieces: list[tuple[str, int, float]], bytes_from: int, byte_weight: float, longest: int):
        """pieces: text (a blank as U+2581), id, log weight."""
        self.longest, self.bytes_from, self.byte_weight = longest, bytes_from, byte_weight
        self.texts = {i: t for t, i, _ in pieces}
        self._spelled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        edges: dict[int, int] = {}
        ids, weights = [-1], [-np.inf]
        for text, number, weight in pieces:
            node = 0
            for c in text:
                key = (node << 21) | ord(c)
                if key not in edges:
                    edges[key] = len(ids)
                    ids.append(-1)
                    weights.append(-np.inf)
                node = edges[key]
            ids[node], weights[node] = number, weight
        self.ids, self.weights = np.array(ids, np.int32), np.array(weights)
        self._bits = max(8, (len(edges) * 4).bit_length())
        left, self._slots = np.fromiter(edges.keys(), np.int64, len(edges)), []
        to = np.fromiter(edges.values(), np.int32, len(edges))
        while len(left):  # one table for each place in a slot's chain
            keys, nodes = np.full(1 << self._bits, -1, np.int64), np.zeros(1 << self._bits, np.int32)
            slot = self._slot(left)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], nodes[slot[first]] = left[first], to[first]
            self._slots.append((keys, nodes))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, to = left[rest], to[rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * GOLD) >> np.uint64(64 - self._bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by its character, or -1."""
        keys = (nodes.astype(np.int64) << 21) | chars
        slot = self._slot(keys)
        table, to = self._slots[0]
        found = table[slot]
        out = np.where(found == keys, to[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))  # the slot is another's: along its chain
        for table, to in self._slots[1:]:
            found = table[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = to[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def spell(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the pieces, end to end. Byte pieces are their byte."""
        if self._spelled is None:
            spelled = [b""] * (max(max(self.texts, default=0), self.bytes_from + 255) + 1)
            for i, t in self.texts.items():
                spelled[i] = t.replace(chr(BLANK), " ").encode()
            for b in range(256):
                spelled[self.bytes_from + b] = bytes([b])
            sizes = np.array([len(x) for x in spelled], np.int64)
            self._spelled = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes
        whole, starts, sizes = self._spelled
        sizes = sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(starts[ids] - ends + sizes, sizes)
        at += np.arange(len(at))
        return whole[at].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text whose segmentation this is."""
        return self.spell(np.asarray(ids, np.int64)).decode("utf-8", "replace")[1:]


@lru_cache(2)
def load(model: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    n = m.get_piece_size()
    normal = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    whole = float(np.log(np.arange(1, n + 1) ** -1.0 @ np.ones(n)))
    ranked = sorted(normal, key=lambda i: -m.get_score(i))
    pieces = [(m.id_to_piece(i), i, -float(np.log(r + 1)) - whole) for r, i in enumerate(ranked)]
    first_byte = next((i for i in range(n) if m.is_byte(i)), n)
    return Vocabulary(pieces, first_byte, -float(np.log(n)) - whole, max(len(p[0]) for p in pieces))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """In the open interval (0, 1)."""
    out = (mix(x) >> np.uint64(11)).astype(np.float64)
    out += 0.5
    out /= 1 << 53
    return out


class Lattice:
    """Tables of distinct units, which grow by `add`. Each row (a character of a unit) has entries, one for each piece that
    begins there, shorter ones first: piece `ids`, `lengths`, `logs` (log of the chance), `sums` (chances so far), `rows`,
    `several` (whether other pieces begin there too)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.numbers, self.n_rows, self.n_entries = vocabulary, Numbers(), 0, 0
        self.starts = self.ends = np.zeros(0, np.int64)
        self.firsts, self.opens, self.several = np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, bool)
        self.ids, self.rows = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.lengths, self.sums, self.logs = np.zeros(0, np.int8), np.zeros(0), np.zeros(0)
        self._room: dict[str, np.ndarray] = {}

    def _append(self, **more: np.ndarray) -> None:
        """Puts more behind each array named, which is the front of one with room to grow."""
        for name, new in more.items():
            old = getattr(self, name)
            n, room = len(old) + len(new), self._room.get(name, old)
            if n > len(room):
                room = self._room[name] = np.empty(2 * n, old.dtype)
                room[: len(old)] = old
            room[len(old) : n] = new
            setattr(self, name, room[:n])

    def cut(self, most: int) -> None:
        """Keeps the first units, of `most` rows at most: the commonest words are among those seen first."""
        units = int(np.searchsorted(self.ends, most, side="right"))
        self.n_rows = int(self.ends[units - 1]) if units else 0
        self.n_entries = int(self.firsts[self.n_rows])
        self.numbers = Numbers(islice(self.numbers.items(), units))
        sizes = {"starts": units, "ends": units, "firsts": self.n_rows + 1, "opens": self.n_rows}
        for name in ("starts", "ends", "firsts", "opens", "several", "ids", "rows", "lengths", "sums", "logs"):
            setattr(self, name, getattr(self, name)[: sizes.get(name, self.n_entries)])

    def add(self, units: list[str]) -> None:
        if not units:
            return
        vocabulary = self.vocabulary
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        n = len(codes)
        literal = codes == BLANK
        codes = np.where(codes == 0x20, BLANK, codes)
        room = np.repeat(ends, sizes) - np.arange(n)
        nodes, at, matches = np.zeros(n, np.int32), np.arange(n), []
        room_for = room
        if literal.any():  # U+2581 itself ends what may be matched
            stop = np.minimum.accumulate(np.where(literal, np.arange(n), n)[::-1])[::-1]
            room_for = np.minimum(room, stop - np.arange(n))
            at = np.flatnonzero(room_for > 0)
            nodes = nodes[at]
        choices = np.ones(n, np.int64)  # each row has an entry of one character
        single, weight = np.full(n, -1, np.int32), np.zeros(n)
        for length in range(1, vocabulary.longest + 1):
            nodes = vocabulary.step(nodes, codes[at + length - 1])
            found = np.flatnonzero((nodes >= 0) & (vocabulary.ids[nodes] >= 0))  # node -1: the last, never asked for
            to, rows = nodes[found], at[found]
            if length == 1:
                single[rows], weight[rows] = vocabulary.ids[to], vocabulary.weights[to]
            else:
                matches.append((rows, choices[rows], length, vocabulary.ids[to], vocabulary.weights[to]))
                choices[rows] += 1
            live = np.flatnonzero((nodes >= 0) & (room_for[at] > length))
            if not len(live):
                break
            at, nodes = at[live], nodes[live]
        bare = np.flatnonzero(single < 0)
        c = codes[bare]
        single[bare] = FALLBACK + c
        weight[bare] = vocabulary.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        last = np.cumsum(choices)
        firsts, m = last - choices, int(last[-1])
        ids, lengths, weights = np.zeros(m, np.int32), np.ones(m, np.int8), np.zeros(m)
        ids[firsts], weights[firsts] = single, weight
        for rows, place, length, own, value in matches:
            place = firsts[rows] + place
            ids[place], lengths[place], weights[place] = own, length, value
        rows = np.repeat(np.arange(n), choices)
        mass, follows = self._mass(room, choices, firsts, rows, lengths, weights)
        logs = weights + mass[follows] - mass[rows]
        sums = np.exp(logs)
        several = np.flatnonzero(choices > 1)
        place = firsts[several] + 1
        while len(several):
            sums[place] += sums[place - 1]
            going = place + 1 < last[several]
            several, place = several[going], place[going] + 1
        sums[last - 1] = 1.0
        opens = np.zeros(n, bool)
        opens[ends - sizes] = True
        self._append(starts=ends - sizes + self.n_rows, ends=ends + self.n_rows, opens=opens, firsts=last + self.n_entries, several=(choices > 1)[rows])
        self._append(rows=rows + self.n_rows, ids=ids, lengths=lengths, logs=logs, sums=sums)
        self.n_rows, self.n_entries = self.n_rows + n, self.n_entries + m

    @staticmethod
    def _mass(room, choices, firsts, rows, lengths, weights) -> tuple[np.ndarray, np.ndarray]:
        """Log of the sum over segmentations of the rest of the unit, by row, from the units' ends; and the row after each entry (the last: none)."""
        n = len(room)
        left = room[rows] - lengths
        follows = np.where(left > 0, rows + lengths, n)
        mass = np.zeros(n + 1)
        order = np.argsort(room.astype(np.uint16) if room.max() < 1 << 16 else room, kind="stable")  # short keys sort by digits
        edges = np.append(np.flatnonzero(np.diff(room[order], prepend=-1)), n)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[lo:hi]
            first, many = firsts[own], choices[own]
            total = weights[first] + mass[follows[first]]
            j = 1
            more = np.flatnonzero(many > 1)
            while len(more):
                place = first[more] + j
                total[more] = np.logaddexp(total[more], weights[place] + mass[follows[place]])
                j += 1
                more = more[many[more] > j]
            mass[own] = total
        return mass, follows

    def entries(self, row: int) -> slice:
        return slice(int(self.firsts[row]), int(self.firsts[row + 1]))

    def walk(self, at: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples each unit from row `at` to its end. Steps of each, then the entries of all steps, unit by unit."""
        live = np.flatnonzero(at < ends)
        at, ends, seeds, found = at[live], ends[live], seeds[live], []
        steps = np.zeros(len(live) if not len(live) else int(live[-1]) + 1, np.int64)
        while len(live):
            pick = self.firsts[at]
            chance = uniform(seeds + np.uint64(len(found)) * GOLD)
            later = np.flatnonzero(self.sums[pick] < chance)
            while len(later):
                pick[later] += 1
                later = later[self.sums[pick[later]] < chance[later]]
            found.append((live, pick))
            steps[live] += 1  # each once
            at = at + self.lengths[pick]
            going = np.flatnonzero(at < ends)
            live, at, ends, seeds = live[going], at[going], ends[going], seeds[going]
        first = np.cumsum(steps) - steps
        out = np.zeros(int(steps.sum()), np.int64)
        for k, (unit, pick) in enumerate(found):
            out[first[unit] + k] = pick
        return steps, out


class Row:
    """The search state of one text."""

    def __init__(self, units: np.ndarray, seed: np.uint64):
        self.units, self.seed, self.paths, self.frontier, self.done = units, seed, [], [], []

    def noise(self, path: int, at: np.ndarray, salt: int) -> np.ndarray:
        return -np.log(uniform(self.seed + np.uint64((path + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)) + np.uint64(salt * 0xD6E8FEB86659FD93 & (2**64 - 1)) + at.astype(np.uint64) * GOLD))


def truncated(location, bound, noise):
    """A Gumbel at `location` given that it is under `bound`; noise: exponential."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(noise) - location)


def openings(lattice: Lattice, entries: np.ndarray, upto: np.ndarray, bound: float, row: Row, path: int, k: int) -> list[tuple[int, float]]:
    """The k + 1 steps whose other pieces have the greatest perturbed log-probability, with it. upto: log-probability
    before each step, which falls; noise is at most -log(2**-54), about 38, and its logarithm at least -37, so steps far
    enough below the first ones cannot count and are not looked at."""
    size = FIRST_STEPS
    while True:
        at = np.flatnonzero(lattice.several[entries[:size]])
        location = upto[at] + np.log(np.maximum(-np.expm1(lattice.logs[entries[at]]), 1e-300))
        if size >= len(upto):
            break
        if len(at) > k:
            least = np.partition(location, len(at) - k - 1)[len(at) - k - 1] - 41
            if upto[size] < least:
                break
        size *= 2
    if not len(at):
        return []
    shift = np.log(row.noise(path, at, 1)) - location
    best = np.argpartition(shift, k)[: k + 1] if len(shift) > k + 1 else np.arange(len(shift))
    return list(zip(at[best].tolist(), (-np.logaddexp(-bound, shift[best])).tolist(), strict=True))


def sample(lattice: Lattice, rows: list[Row], k: int) -> None:
    """Fills each row's `done`: (log-probability, perturbed, path), best first, and leaves the next bound in its frontier."""

    def go(jobs: list[tuple]) -> None:
        """jobs: row, bound, entries before and their logs, first unit, first lattice row."""
        if not jobs:
            return
        own = np.concatenate([row.units[unit:] for row, _, _, _, unit, _ in jobs])
        spans = np.array([len(job[0].units) - job[4] for job in jobs], np.int64)
        heads = np.cumsum(spans) - spans
        at = lattice.starts[own]
        for (*_, first), head in zip(jobs, heads.tolist(), strict=True):
            if first >= 0:
                at[head] = first
        bases = np.array([int(row.seed) + (len(row.paths) + 1) * 0xA0761D6478BD642F & (2**64 - 1) for row, *_ in jobs], np.uint64)
        number = np.arange(len(own)) + np.repeat(np.array([job[4] for job in jobs], np.int64) - heads, spans)
        steps, found = lattice.walk(at, lattice.ends[own], mix(np.repeat(bases, spans) + number.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
        sizes = np.zeros(len(jobs), np.int64)
        np.add.at(sizes, np.repeat(np.arange(len(jobs)), spans)[: len(steps)], steps)
        logs = lattice.logs[found]
        hi = 0
        for (row, bound, before, earlier, _, _), size in zip(jobs, sizes.tolist(), strict=True):
            lo, hi = hi, hi + size
            entries, log = found[lo:hi], logs[lo:hi]
            n = len(before)
            whole = np.concatenate([before, entries]) if n else entries
            whole_log = np.concatenate([earlier, log]) if n else log
            upto = np.cumsum(whole_log)
            path = len(row.paths)
            row.paths.append((whole, whole_log))
            row.done.append((float(upto[-1]) if len(upto) else 0.0, bound, path))
            for t, value in openings(lattice, entries, upto[n:] - log, bound, row, path, k):
                heapq.heappush(row.frontier, (-value, path, n + t, 1 << int(lattice.lengths[entries[t]] - 1)))

    empty = np.zeros(0, np.int64), np.zeros(0)
    go([(row, float(-np.log(row.noise(0, ONE, 2)[0])), *empty, 0, -1) for row in rows])
    for _ in range(k - 1):
        jobs = []
        for row in rows:
            if not row.frontier:
                continue
            value, path, t, mask = heapq.heappop(row.frontier)
            entries, log = row.paths[path]
            here = int(lattice.rows[entries[t]])
            choices = lattice.entries(here)
            lengths = lattice.lengths[choices].astype(np.int64)
            out = (mask >> (lengths - 1) & 1).astype(bool)
            chance = np.where(out, 0.0, np.exp(lattice.logs[choices]))
            chosen = int(np.argmax(np.log(np.maximum(chance, 1e-300)) - np.log(row.noise(len(row.paths), lengths - 1, 3)) + np.where(out, -np.inf, 0)))
            left = np.flatnonzero(~out & (np.arange(len(chance)) != chosen))
            if len(left):
                location = float(log[:t].sum() + np.log(max(chance[left].sum(), 1e-300)))
                again = float(truncated(location, -value, row.noise(len(row.paths), ONE, 4)[0]))
                heapq.heappush(row.frontier, (-again, path, t, mask | 1 << int(lengths[chosen] - 1)))
            before = np.append(entries[:t], choices.start + chosen), np.append(log[:t], np.log(max(chance[chosen], 1e-300)))
            unit = int(lattice.opens[lattice.rows[entries[: t + 1]]].sum()) - 1  # a unit begins where a step stands at its first row
            after = here + int(lengths[chosen])
            if after < lattice.ends[row.units[unit]]:
                jobs.append((row, -value, *before, unit, after))
            else:
                jobs.append((row, -value, *before, unit + 1, -1))
        go(jobs)


def ids_of(vocabulary: Vocabulary, lattice: Lattice, entries: np.ndarray) -> np.ndarray:
    """Piece ids; characters outside the vocabulary become byte pieces."""
    ids = lattice.ids[entries]
    bare = np.flatnonzero(ids >= FALLBACK)
    if not len(bare):
        return ids
    c = ids[bare] - FALLBACK
    sizes = np.ones(len(ids), np.int64)
    sizes[bare] += (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    out = np.repeat(ids, sizes)
    out[out >= FALLBACK] = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32) + vocabulary.bytes_from
    return out


class Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def segment(vocabulary: Vocabulary, texts: list[str | None], seeds: list[int], k: int = SAMPLES, lattice: Lattice | None = None) -> list[list[dict]]:
    """For each text its draws: ids, log_prob, perturbed, inclusion. A lattice given is used and grows."""
    lattice = lattice or Lattice(vocabulary)
    known, rows = len(lattice.numbers), []
    for text, seed in zip(texts, seeds, strict=True):
        found = UNITS.findall(" " + text) if text else []
        rows.append(Row(np.fromiter(map(lattice.numbers.__getitem__, found), np.int64, len(found)), np.uint64(seed & (2**64 - 1))))
    with np.errstate(over="ignore"):
        lattice.add(list(islice(lattice.numbers, known, None)))
        sample(lattice, rows, k)
    out = []
    for row in rows:
        best = -row.frontier[0][0] if row.frontier else -np.inf
        out.append([{"ids": ids_of(vocabulary, lattice, row.paths[p][0]), "log_prob": log, "perturbed": value, "inclusion": float(-np.expm1(-np.exp(min(700.0, log - best))))} for log, value, p in row.done])
    return out


def encode(docs: DataFrame, text: str = "text", ident: str = "doc_id", k: int = SAMPLES, model: str = MODEL, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """A row for each draw: doc_id, draw (from 1), n_pieces, log_prob, perturbed, inclusion, ids_crc32 (of little-endian
    32-bit ids), decoded (whether the ids give the whole text back) and, with_ids, ids."""

    def run(batches):
        import pyarrow as pa

        vocabulary = load(model)
        lattice = Lattice(vocabulary)
        kinds = {"doc_id": pa.int64(), "draw": pa.int32(), "n_pieces": pa.int64(), "log_prob": pa.float64(), "perturbed": pa.float64(), "inclusion": pa.float64(), "ids_crc32": pa.int64(), "decoded": pa.bool_()}
        for batch in sliced(batches):
            ids, texts, seeds = (batch.column(i).to_pylist() for i in range(3))
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (end == begin or chars < GROUP_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                out, pieces = [], []
                if lattice.n_rows > 2 * ROWS_KEPT:  # a long text's, whose arrays are large
                    lattice = Lattice(vocabulary)
                elif lattice.n_rows > ROWS_KEPT:
                    lattice.cut(ROWS_KEPT // 2)
                for i, draws in enumerate(segment(vocabulary, texts[begin:end], seeds[begin:end], k, lattice), begin):
                    whole = (" " + texts[i]).encode() if texts[i] else b""
                    for d, x in enumerate(draws, 1):
                        own = x.pop("ids")
                        pieces.append(own)
                        out.append({"doc_id": ids[i], "draw": d, "n_pieces": len(own), **x, "ids_crc32": zlib.crc32(own.tobytes()), "decoded": vocabulary.spell(own) == whole})
                made = pa.RecordBatch.from_pylist(out, schema=pa.schema(list(kinds.items())))
                if with_ids:  # from the arrays as they are: a list for each row would cost an object for each piece
                    ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
                    made = made.append_column("ids", pa.ListArray.from_arrays(ends, np.concatenate([*pieces, np.zeros(0, np.int32)]).astype(np.int32, copy=False)))
                yield made
                begin = end

    rows = docs.select(quoted(ident).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"), F.xxhash64(F.lit(seed), quoted(ident)).alias("seed"))
    schema = "doc_id long, draw int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, decoded boolean" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded with `text`, the text of each row's ids; null ids: null."""

    @F.udf("string", useArrow=True)
    def text(x):
        return None if x is None else load(model).decode(list(x))

    return encoded.withColumn("text", text(quoted(ids)))
