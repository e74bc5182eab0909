"""Objects by key in any file system that Spark reaches: uploads are staged, then promoted by a rename, and empty folders go with their last object."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

STAGED = "staged-uploads"


def safe(part: str) -> str:
    return re.sub(r"[^a-zA-Z0-9._-]+", "-", part).strip("-") or "file"


def object_key(prefix: str, name: str) -> str:
    """prefix/uuid/name, of safe characters; the extension in lower case."""
    stem, dot = posixpath.splitext(posixpath.basename(name.replace("\\", "/")))
    return "/".join([*(safe(p) for p in prefix.replace("\\", "/").split("/")), str(uuid.uuid4()), safe(stem) + re.sub("[^a-zA-Z0-9.]", "", dot).lower()])


def checked(key: str) -> str:
    """The key without leading slashes; an error if it is empty, or has an empty part or one that leads upwards."""
    out = key.replace("\\", "/").lstrip("/")
    if out.startswith("..") or any(p in ("", "..") for p in out.split("/")):
        raise ValueError(f"invalid object key: {key}")
    return out


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, checked(key))

    def stage(self, name: str, data: bytes, most: int | None = None) -> str:
        """Put an upload aside; nothing is left of one beyond the limit."""
        if most is not None and len(data) > most:
            raise ValueError("upload is too large")
        return self.write(object_key(STAGED, name), data)

    def write(self, key: str, data: bytes) -> str:
        at = self.path(key)
        try:
            out = self._fs.create(at, True)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
        except Exception:
            self.delete(key)
            raise
        return key

    def read(self, key: str) -> bytes:
        stream = self._fs.open(self.path(key))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        return self._fs.exists(self.path(key))

    def delete(self, key: str) -> None:
        """The object, if there is one, and the folders that it leaves empty."""
        at = self.path(key)
        self._fs.delete(at, False)
        self._prune(at.getParent())

    def promote(self, staged: str, final: str) -> str:
        if not checked(staged).startswith(STAGED + "/"):
            raise ValueError(f"cannot promote non-staged object key: {staged}")
        old, new = self.path(staged), self.path(final)
        self._fs.mkdirs(new.getParent())
        if not self._fs.rename(old, new):
            raise OSError(f"cannot promote {staged}")
        self._prune(old.getParent())
        return final

    def _prune(self, folder) -> None:
        root = self._fs.makeQualified(self._root).toString().rstrip("/")
        folder = self._fs.makeQualified(folder)
        while folder.toString().startswith(root + "/") and (not self._fs.exists(folder) or not self._fs.listStatus(folder)):
            self._fs.delete(folder, False)
            folder = folder.getParent()


def finalise(store: ObjectStore, staged: str, final: str, record: Callable[[str], None], enqueue: Callable[[str], None], forget: Callable[[str], None]) -> str:
    """Promote an upload, record its batch, and queue it; whatever fails, the objects and records made before go again and the failure is raised."""
    undo: list[Callable[[], None]] = [lambda: store.delete(staged)]
    try:
        store.promote(staged, final)
        undo.append(lambda: store.delete(final))
        record(final)
        undo.append(lambda: forget(final))
        enqueue(final)
    except Exception:
        for step in reversed(undo):
            step()
        raise
    return final
