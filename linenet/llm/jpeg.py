"""Media columns: baseline JPEG, encoded and decoded in numpy.

The encoder stores bytes without loss as quantised coefficients, the format's own unit: byte b is the 8 magnitude bits
of a coefficient of size class 8, 64 of them make a block, each block is a restart interval, and the Huffman tables
have a code for that class alone. The decoder is general for baseline JPEG (one to three components, any Huffman
tables, with or without restart intervals): it parses markers and Huffman-decodes all restart intervals of a batch of
files in step, a numpy lane for each. From DC coefficients alone come luminance thumbnails, their dimensions and hashes.

Cases: a null text is empty; an empty payload is padded to 64 bytes; repeated rows get equal values; an empty table
gives an empty table; very long texts are stored whole; nothing is ranked, so there are no ties; other columns are not
read, whatever their names. Progressive, arithmetic-coded or damaged files raise ValueError.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from linenet.llm.common import lean, quoted

UNIT = 64
CLASS = 8
GROUP_BYTES = 2 << 20
COMMENT = b"linenet payload "


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def grid(blocks: int) -> tuple[int, int]:
    """Rows and columns of blocks: nearly square."""
    columns = max(1, math.isqrt(blocks - 1) + 1) if blocks > 1 else 1
    return -(-blocks // columns), columns


def headers(rows: int, columns: int, size: int) -> bytes:
    if max(rows, columns) * 8 > 65535:
        raise ValueError("payload too large for one JPEG")
    one_code = bytes([1] + [0] * 15 + [CLASS])  # one code, one bit long
    return (
        b"\xff\xd8"
        + segment(0xFE, COMMENT + str(size).encode())
        + segment(0xDB, bytes([0]) + bytes([1] * 64))
        + segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + segment(0xC4, bytes([0x00]) + one_code + bytes([0x10]) + one_code)
        + segment(0xDD, (1).to_bytes(2, "big"))
        + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (a positive multiple of 64 bytes)."""
    shapes = [grid(len(p) // UNIT) for p in payloads]
    counts = np.array([r * c for r, c in shapes])
    whole = b"".join(p + bytes(r * c * UNIT - len(p)) for p, (r, c) in zip(payloads, shapes, strict=True))
    bits = np.zeros((len(whole), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(np.frombuffer(whole, np.uint8).reshape(-1, 1), axis=1)
    packed = np.packbits(bits.reshape(-1, UNIT * 9), axis=1)  # 72 bytes a block
    stuffed = packed == 0xFF
    last = np.cumsum(counts) - 1
    number = np.arange(len(packed)) - np.repeat(last + 1 - counts, counts)
    room = packed.shape[1] + stuffed.sum(axis=1) + 2
    room[last] -= 2
    ends = np.cumsum(room)
    places = (ends - room)[:, None] + np.arange(packed.shape[1]) + np.cumsum(stuffed, axis=1) - stuffed
    out = np.zeros(int(ends[-1]), np.uint8)
    out[places] = packed
    marked = np.ones(len(packed), bool)
    marked[last] = False
    out[ends[marked] - 2] = 0xFF
    out[ends[marked] - 1] = 0xD0 + number[marked] % 8
    scan, at, files = out.tobytes(), 0, []
    for p, (r, c), end in zip(payloads, shapes, ends[last].tolist(), strict=True):
        files.append(headers(r, c, len(p)) + scan[at:end] + b"\xff\xd9")
        at = end
    return files


@dataclass
class Image:
    """What the markers say, and the scan's bytes."""

    height: int = 0
    width: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantisation table
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)  # class * 16 + number: the table's bytes
    tables: list[tuple[int, int]] = field(default_factory=list)  # DC and AC table of each component
    interval: int = 0
    size: int | None = None
    scan: bytes = b""


def parse(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at = Image(), 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.codes[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            image.interval = int.from_bytes(body, "big")
        elif marker == 0xFE and body.startswith(COMMENT):
            image.size = int(body[len(COMMENT) :])
        elif marker == 0xDA:
            of = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            if len(of) != len(image.components):
                raise ValueError("not all components are in one scan")
            image.tables = [of[c[0]] for c in image.components]
            end = data.rfind(b"\xff\xd9", at)
            image.scan = data[at : end if end >= 0 else len(data)]
            return image
    raise ValueError("no scan")


def lookup_table(code: bytes) -> np.ndarray:
    """For each 16-bit window: symbol * 32 + code length, or -1. code: 16 counts by length, then the symbols."""
    table, window, k = np.full(1 << 16, -1, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(code[length - 1]):
            span = 1 << (16 - length)
            table[window : window + span] = code[k] * 32 + length
            window += span
            k += 1
    return table


def lanes_of(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unstuffed bytes of all scans, the first byte of each restart interval, and the file it belongs to."""
    data = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    edges = np.cumsum([0] + [len(s) for s in scans])
    after = data[1:]
    escape = np.flatnonzero((data[:-1] == 0xFF) & ((after == 0) | ((after & 0xF8) == 0xD0)))
    marks = escape[after[escape] != 0]
    keep = np.ones(len(data) - 1, bool)
    keep[escape + 1] = False
    keep[marks] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    starts = np.sort(np.concatenate([edges[:-1], marks + 2]))
    return np.concatenate([data[:-1][keep], np.zeros(8, np.uint8)]), place[starts], np.searchsorted(edges, starts, side="right") - 1


class Bits:
    """A bit position for each lane."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        d = data.astype(np.uint32)
        self._words = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
        self.at = starts.astype(np.int64) * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """16 bits."""
        at = self.at[lanes]
        return ((self._words[np.minimum(at >> 3, len(self._words) - 1)] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int64)

    def symbol(self, table: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        found = table[self.peek(lanes)]
        if (found < 0).any():
            raise ValueError("no such Huffman code")
        self.at[lanes] += found & 31
        return found >> 5

    def signed(self, sizes: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The next `sizes` bits as JPEG's signed magnitudes."""
        raw = self.peek(lanes) >> (16 - sizes)
        self.at[lanes] += sizes
        return np.where((raw >> np.maximum(sizes - 1, 0)) == 0, raw - (1 << sizes) + 1, raw) * (sizes > 0)


def coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image and component: (rows, columns, 64) coefficients in scan (zigzag) order. The images share their tables."""
    first = images[0]
    alone = len(first.components) == 1
    most_h, most_v = max(c[1] for c in first.components), max(c[2] for c in first.components)
    shapes = []  # MCU rows and columns
    for image in images:
        h, v = (8, 8) if alone else (8 * most_h, 8 * most_v)
        shapes.append((-(-image.height // v), -(-image.width // h)))
    data, starts, owner = lanes_of([i.scan for i in images])
    ordinal = np.arange(len(starts)) - np.searchsorted(owner, owner, side="left")
    total = np.array([r * c for r, c in shapes])[owner]
    interval = np.array([i.interval or r * c for i, (r, c) in zip(images, shapes, strict=True)])[owner]
    counts = np.clip(total - ordinal * interval, 0, interval)  # MCUs of each lane
    bits, dc = Bits(data, starts), np.zeros((len(first.components), len(starts)), np.int64)
    tables = [(lookup_table(first.codes[a]), lookup_table(first.codes[16 + b])) for a, b in first.tables]
    per = [1 if alone else h * v for _, h, v, _ in first.components]
    out = [np.zeros((int(counts.sum()) * n, 64), np.int16) for n in per]
    base = np.cumsum(counts) - counts
    for mcu in range(int(counts.max(initial=0))):
        lanes = np.flatnonzero(counts > mcu)
        for c, n in enumerate(per):
            for b in range(n):
                row = (base[lanes] + mcu) * n + b
                dc[c, lanes] += bits.signed(bits.symbol(tables[c][0], lanes), lanes)
                out[c][row, 0] = dc[c, lanes]
                k, live = np.ones(len(lanes), np.int64), np.arange(len(lanes))
                while len(live):
                    sym = bits.symbol(tables[c][1], lanes[live])
                    run, size = sym >> 4, sym & 15
                    ends = (size == 0) & (run != 15)
                    if ends.any():
                        live, run, size = live[~ends], run[~ends], size[~ends]
                    k[live] += run
                    if len(live) and k[live].max() > 63:
                        raise ValueError("too many coefficients in a block")
                    value = bits.signed(size, lanes[live])
                    out[c][row[live], k[live]] = value
                    k[live] += 1
                    live = live[k[live] < 64]
    found, at = [], 0
    for image, (r, c) in zip(images, shapes, strict=True):
        parts = []
        for i, (_, h, v, _) in enumerate(image.components):
            n = per[i]
            x = out[i][at * n : (at + r * c) * n]
            parts.append(x.reshape(r, c, 64) if n == 1 else x.reshape(r, c, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(r * v, c * h, 64))
        at += r * c
        found.append(parts)
    return found


def decode(files: list[bytes]) -> list[tuple[Image, list[np.ndarray]]]:
    """Image and coefficients of each file; files with the same tables are decoded in step."""
    images = [parse(f) for f in files]
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        alike.setdefault((tuple(sorted(image.codes.items())), tuple(image.components), tuple(image.tables)), []).append(i)
    out: list = [None] * len(files)
    for group in alike.values():
        for i, parts in zip(group, coefficients([images[i] for i in group]), strict=True):
            out[i] = images[i], parts
    return out


def payload_of(image: Image, parts: list[np.ndarray]) -> bytes:
    """The bytes that encode() stored."""
    x = parts[0].reshape(-1)
    return np.where(x < 0, x + 255, x).astype(np.uint8).tobytes()[: image.size]


def thumbnail(image: Image, parts: list[np.ndarray]) -> np.ndarray:
    """Luminance of each 8 x 8 block, from its DC coefficient alone."""
    quantiser = image.quantisers[image.components[0][3]][0]
    return np.clip(np.rint(parts[0][:, :, 0].astype(np.int32) * quantiser / 8 + 128), 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8 x 8 evenly spaced blocks are brighter than their mean."""
    r, c = thumb.shape
    grid8 = thumb[np.ix_(np.arange(8) * r // 8, np.arange(8) * c // 8)].astype(np.float64)
    return np.packbits(grid8.ravel() > grid8.mean()).tobytes().hex()


def feature(image: Image, parts: list[np.ndarray]) -> str:
    thumb = thumbnail(image, parts)
    return f"{image.width}x{image.height}:{average_hash(thumb)}:{hashlib.sha1(thumb.tobytes()).hexdigest()[:16]}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _groups(items: list, size) -> list[list]:
    out, total = [], 0
    for item in items:
        if not out or total >= GROUP_BYTES:
            out.append([])
            total = 0
        out[-1].append(item)
        total += size(item)
    return out


def store(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media (a JPEG that holds the text's bytes, padded)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for group in _groups([padded(t) for t in batch.column("text").to_pylist()], lambda x: len(x[1])):
                media = pa.array(encode([p for _, p in group]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(group)), pa.array([n for n, _ in group], pa.int64()), media], names=["doc_id", "n_bytes", "media"])
                at += len(group)

    rows = docs.select(quoted(ident).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """media: doc_id, n_bytes, media. Decodes each file; payload figures, the file's own, dimensions and thumbnail hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, sizes = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist()
            for group in _groups(list(zip(ids, sizes, batch.column("media").to_pylist(), strict=True)), lambda x: len(x[2])):
                out = []
                for (doc_id, n, media), (image, parts) in zip(group, decode([g[2] for g in group]), strict=True):
                    payload = payload_of(image, parts)
                    out.append(
                        {
                            "doc_id": doc_id, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                            "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                            "feature": feature(image, parts), "width": image.width, "height": image.height,
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=schema_of(pa))

    def schema_of(pa):
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "width": pa.int32(), "height": pa.int32()}
        return pa.schema(list(kinds.items()))

    return media.mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int")
