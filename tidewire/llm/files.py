"""Files in the shared folder from Python workers, whatever store holds it."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyarrow import fs


def release_memory() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task shares its machine with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it. A bare path and ``file:`` mean a mounted folder; other schemes are pyarrow's."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class WholeFile:
    """A file that appears under its name only once it is whole: a task that dies leaves just a temporary name."""

    def __init__(self, uri: str):
        self._store, self.path = open_store(uri)
        folder = self.path.rpartition("/")[0]
        self._store.create_dir(folder, recursive=True)
        self._part = f"{folder}/.{uuid.uuid4().hex}.part"
        self._out = self._store.open_output_stream(self._part)
        self.at = 0

    def write(self, data) -> int:
        """Appends and tells where the data begin."""
        at = self.at
        self._out.write(data)
        self.at += memoryview(data).nbytes
        return at

    def close(self) -> None:
        self._out.close()
        self._store.move(self._part, self.path)

    def discard(self) -> None:
        self._out.close()
        self._store.delete_file(self._part)
