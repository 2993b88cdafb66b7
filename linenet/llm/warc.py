"""WARC archives with a two-level capture index.

Writing: each task writes archives of gzip members, one record each; rows with an equal payload of at least
`least_bytes` point to the one with the smallest page_id (revisit records, identical-payload-digest profile).
Index: capture keys (reversed-host URL, then the row's number) are range-partitioned and sorted; each task writes
one index file of compressed blocks, followed by a sparse directory with the first key of each block. A table of the
index files (one row each) is the upper level. Lookups range-partition their keys alike, binary-search the upper
level, the directory and the block, and then read records by range, in archive order.

Cases: a null payload is empty; a null URL has the key `-`; a null page_id loses to any number, and among rows that
all lack one, all are responses; of repeated rows (same page_id and payload) with the smallest page_id all are
responses; very long URLs and payloads are stored whole; an empty table gives no archives and an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linenet.llm.common import fresh_path, materialize, quoted
from linenet.llm.storage import PartWriter, RangeReader

BLOCK_LINES = 512
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 4 << 20
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"


def sort_key(url: str | None) -> str:
    """The URL with its host reversed: https://www.a.example:443/x?y#z -> example,a)/x?y"""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)", url or "")
    if not m:
        return re.sub(r"\s", "%20", url or "") or "-"
    host = m[1].lower().strip(".")
    host = re.sub(r"^www\d*\.", "", host)
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    rest = re.sub(r"\s", "%20", m[3] or "/")
    return ",".join(reversed(host.split("."))) + port + ")" + (rest if rest[0] == "/" else "/" + rest)


def capture_key(url: str | None, number: int | None) -> str:
    return sort_key(url) + " " + ("~" if number is None else f"{number + (1 << 63):020d}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None, captured: str) -> tuple[bytes, str]:
    """One gzip member, and the record's type. A revisit keeps the HTTP head (with the full length) and the digest only."""
    kind, sha = "response" if refers_to is None else "revisit", digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:linenet:capture:{'' if number is None else number}:{sha}>"),
        ("WARC-Date", captured),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "%0A", url or "")),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("X-Row", "" if number is None else str(number)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:linenet:capture:{refers_to}:{sha}>"), ("X-Refers-To-Row", str(refers_to))] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush(), kind


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.partition(": ")[::2] for line in http.decode().split("\r\n")[1:]), payload


def _batches(rows: Iterator[dict], schema, size: int = 4096):
    import pyarrow as pa

    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


ENTRY = "key string, number long, archive string, offset long, length long, kind string"


def write_archives(rows: DataFrame, folder: str, captured: str = CAPTURED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """rows: number, url, payload, refers_to (null: response). Writes archives; returns their captures (ENTRY), materialized."""

    def write(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("number", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string())])
        out = None
        for batch in batches:
            entries = []
            for row in batch.to_pylist():
                if out is None or out.at >= archive_bytes:
                    if out is not None:
                        out.close()
                    out = PartWriter(folder, ".warc.gz")
                member, kind = record(row["number"], row["url"], (row["payload"] or "").encode(), row["refers_to"], captured)
                entries.append({"key": capture_key(row["url"], row["number"]), "number": row["number"], "archive": out.uri, "offset": out.write(member), "length": len(member), "kind": kind})
            yield pa.RecordBatch.from_pylist(entries, schema=schema)
        if out is not None:
            out.close()

    return materialize(rows.select("number", "url", "payload", "refers_to").mapInArrow(write, ENTRY), "warc-captures")


def mark_revisits(pages: DataFrame, ident: str, url: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """number, url, payload, refers_to for each row of pages."""
    whole = F.coalesce(quoted(payload).cast("string"), F.lit(""))
    rows = pages.select(quoted(ident).cast("long").alias("number"), quoted(url).cast("string").alias("url"), whole.alias("payload"), F.unhex(F.sha2(whole, 256)).alias("sha"), F.octet_length(whole).alias("n"))
    known = materialize(rows.where(F.col("n") >= least_bytes).select("number", "sha"), "warc-payloads")
    first = materialize(known.groupBy("sha").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "warc-first")
    others = materialize(known.join(first, "sha").where(~F.col("number").eqNullSafe(F.col("first"))).distinct(), "warc-revisits")
    others = others.select(F.col("number").alias("r_number"), F.col("sha").alias("r_sha"), F.col("first").alias("refers_to"))
    same = (F.col("sha") == F.col("r_sha")) & F.col("number").eqNullSafe(F.col("r_number"))
    return rows.join(others, same, "left").select("number", "url", "payload", "refers_to")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, str, int]]:
    """Writes the index files; returns the upper level: (first key, last key, file, captures), in key order."""

    def write(batches):
        import pyarrow as pa

        out, lines, directory, first, last, n = None, [], [], "", "", 0

        def flush():
            packed = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([lines[0].partition("\t")[0], out.write(packed), len(packed), len(lines)])
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out, first = PartWriter(folder, ".index"), row["key"]
                lines.append(f"{row['key']}\t" + json.dumps([row["number"], row["archive"], row["offset"], row["length"], row["kind"]]))
                last, n = row["key"], n + 1
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed + len(packed).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "file": out.uri, "n": n}])

    sorted_captures = captures.repartitionByRange("key").sortWithinPartitions("key", "archive", "offset")
    found = sorted_captures.mapInArrow(write, "first string, last string, file string, n long")
    return sorted((r["first"], r["last"], r.file, r.n) for r in found.collect())


class CaptureIndex:
    """Searches the two levels from one process. `top` is what build_index returned."""

    def __init__(self, top: list[tuple[str, str, str, int]], reader: RangeReader):
        self._firsts, self._top, self._reader, self._files, self._block = [t[0] for t in top], top, reader, {}, (None, [])

    def _directory(self, file: str) -> list[list]:
        if file not in self._files:
            size = self._reader.size(file)
            length = int.from_bytes(self._reader.read(file, size - 8, 8), "big")
            if len(self._files) >= 4:
                self._files.pop(next(iter(self._files)))
            self._files[file] = json.loads(zlib.decompress(self._reader.read(file, size - 8 - length, length)))
        return self._files[file]

    def _lines(self, file: str, offset: int, length: int) -> list[str]:
        if self._block[0] != (file, offset):
            self._block = (file, offset), zlib.decompress(self._reader.read(file, offset, length)).decode().split("\n")
        return self._block[1]

    def find(self, key: str, prefix: bool = False) -> Iterator[tuple]:
        """Captures (number, archive, offset, length, kind) with this key, or whose key begins with it."""
        for at in range(max(0, bisect_left(self._firsts, key) - 1), len(self._top)):
            first, last, file, _ = self._top[at]
            if last < key:
                continue
            if first > key and not (prefix and first.startswith(key)):
                return
            directory = self._directory(file)
            begin = max(0, bisect_left(directory, key, key=lambda d: d[0]) - 1)
            for head, offset, length, _ in directory[begin:]:
                if head > key and not (prefix and head.startswith(key)):
                    return
                lines = self._lines(file, offset, length)
                for line in lines[bisect_left(lines, key, key=lambda x: x.partition("\t")[0]) :]:
                    own, _, rest = line.partition("\t")
                    if own != key and not (prefix and own.startswith(key)):
                        return
                    yield tuple(json.loads(rest))


def lookup(wanted: DataFrame, top: list[tuple[str, str, str, int]]) -> DataFrame:
    """wanted: key. The captures of each distinct key: number, archive, offset, length, kind."""

    def search(batches):
        import pyarrow as pa

        reader, before = RangeReader(), None
        index = CaptureIndex(top, reader)
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                if key != before:
                    out += [dict(zip(("number", "archive", "offset", "length", "kind"), x, strict=True)) for x in index.find(key)]
                before = key
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("number", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))
        reader.close()

    return wanted.select("key").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(search, "number long, archive string, offset long, length long, kind string")


def read_records(captures: DataFrame) -> DataFrame:
    """Range-reads the captures' records, neighbours in one request. A response's length and digest are those of its bytes."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        reader = RangeReader()

        def runs(rows):
            run: list = []
            for row in rows:
                if run and (row["archive"] != run[0]["archive"] or row["offset"] != run[-1]["offset"] + run[-1]["length"] or row["offset"] + row["length"] - run[0]["offset"] > READ_BYTES):
                    yield run
                    run = []
                run.append(row)
            if run:
                yield run

        for batch in batches:
            out = []
            for run in runs(batch.to_pylist()):
                begin = run[0]["offset"]
                data = reader.read(run[0]["archive"], begin, run[-1]["offset"] + run[-1]["length"] - begin)
                for row in run:
                    fields, http, payload = parse(data[row["offset"] - begin : row["offset"] - begin + row["length"]])
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (digest(payload) != sha or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"damaged record at {row['archive']}:{row['offset']}")
                    number, refers = fields["X-Row"], fields.get("X-Refers-To-Row")
                    out.append({"page_id": int(number) if number else None, "url": fields["WARC-Target-URI"], "payload_bytes": int(http["Content-Length"]), "payload_digest": sha, "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        reader.close()

    ordered = captures.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archives every row of pages, indexes the archives, looks every row up and reads its record back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    captures = write_archives(mark_revisits(pages, ident, url, payload, least_bytes), f"{folder}/archives")
    top = build_index(captures, f"{folder}/index")
    key = F.udf(capture_key, "string", useArrow=True)
    wanted = pages.select(key(quoted(url).cast("string"), quoted(ident).cast("long")).alias("key"))
    found = materialize(lookup(wanted, top), "warc-found")
    return read_records(found)
