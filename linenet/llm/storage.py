"""Byte access to the shared folder from executors, for local and remote stores alike (pyarrow file systems)."""

from __future__ import annotations

import uuid


def open_store(uri: str):
    """(file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


class PartWriter:
    """Appends to one new file. Its name is unique to the attempt, so a retried task never meets what a lost one left."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        store, path = open_store(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self._out, self.at = store.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Returns where the data begin."""
        begin = self.at
        self._out.write(data)
        self.at += len(data)
        return begin

    def close(self) -> None:
        self._out.close()


class RangeReader:
    """Range reads; keeps a few files open."""

    def __init__(self, keep: int = 16):
        self._keep, self._open = keep, {}

    def file(self, uri: str):
        if uri not in self._open:
            if len(self._open) >= self._keep:
                self._open.pop(next(iter(self._open))).close()
            store, path = open_store(uri)
            self._open[uri] = store.open_input_file(path)
        return self._open[uri]

    def read(self, uri: str, offset: int, length: int) -> bytes:
        return self.file(uri).read_at(length, offset)

    def size(self, uri: str) -> int:
        return self.file(uri).size()

    def close(self) -> None:
        for f in self._open.values():
            f.close()
