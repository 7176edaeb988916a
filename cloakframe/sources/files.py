"""Small files on whatever storage Spark reaches: whole reads, atomic replacement, exclusive locks.

Everything goes through Hadoop's file systems, so paths may be local, hdfs:// or an object store's.  The
caller is the driver; tables are read and written by Spark itself.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import SparkSession

LOCK_WAIT = 60.0
#: A lock file that old was left by a writer that died.
LOCK_STALE = 900.0

_guards: dict[str, threading.RLock] = {}
_guards_guard = threading.Lock()
_held = threading.local()


class Busy(TimeoutError):
    """Another writer held the lock for too long."""


class Files:
    def __init__(self, spark: SparkSession):
        self._gateway = spark.sparkContext._gateway
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._bytes = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._hadoop.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        files, at = self._at(path)
        return files.exists(at)

    def names(self, folder: str) -> list[str]:
        files, at = self._at(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def make(self, folder: str) -> None:
        """A folder that only its owner may enter."""
        files, at = self._at(folder)
        if not files.exists(at):
            files.mkdirs(at, self._hadoop.permission.FsPermission("700"))

    def delete(self, path: str) -> None:
        files, at = self._at(path)
        files.delete(at, True)

    def read(self, path: str) -> bytes:
        files, at = self._at(path)
        if not files.exists(at):
            raise FileNotFoundError(path)
        stream = files.open(at)
        try:
            return bytes(self._bytes.toByteArray(stream))
        finally:
            stream.close()

    def replace(self, path: str, data: bytes) -> None:
        """Put data at path: readers see the old file or the new one, never a part."""
        files, part = self._at(f"{path}.{uuid.uuid4().hex}.part")
        out = files.create(part, True)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        files.setPermission(part, self._hadoop.permission.FsPermission("600"))
        kind = getattr(self._hadoop, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        where = files.makeQualified(part).toUri()
        self._hadoop.FileContext.getFileContext(where, self._conf).rename(files.makeQualified(part), files.makeQualified(self._hadoop.Path(path)), how)

    def _take(self, path: str) -> bool:
        """Make the lock file, unless it is there."""
        if urlparse(path).scheme in ("", "file"):
            try:
                os.close(os.open(urlparse(path).path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600))
                return True
            except FileExistsError:
                return False
        files, at = self._at(path)
        try:
            files.create(at, False).close()
            return True
        except Exception:  # noqa: BLE001 - whatever the store raises for a file that exists
            if files.exists(at):
                return False
            raise

    def _age(self, path: str) -> float:
        files, at = self._at(path)
        try:
            return time.time() - files.getFileStatus(at).getModificationTime() / 1000
        except Exception:  # noqa: BLE001 - released meanwhile
            return 0.0

    @contextmanager
    def locked(self, path: str, wait: float = LOCK_WAIT, stale: float = LOCK_STALE) -> Iterator[None]:
        """One writer at a time, of all threads and processes that lock this path; a thread may nest it."""
        with _guards_guard:
            guard = _guards.setdefault(path, threading.RLock())
        if not guard.acquire(timeout=wait):
            raise Busy(path)
        depth = _held.__dict__.setdefault("depth", {})
        try:
            depth[path] = depth.get(path, 0) + 1
            if depth[path] == 1:
                until = time.monotonic() + wait
                while not self._take(path):
                    if self._age(path) > stale:
                        self.delete(path)
                    elif time.monotonic() > until:
                        depth[path] -= 1
                        raise Busy(path)
                    else:
                        time.sleep(0.05)
            try:
                yield
            finally:
                depth[path] -= 1
                if not depth[path]:
                    self.delete(path)
        finally:
            guard.release()
