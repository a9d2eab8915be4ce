"""Object stores for dumped partitions: a small protocol, and stores over Hadoop file systems and memory.

``HadoopStore`` reaches whatever Spark does (``s3a://``, ``hdfs://``, local folders)
on the driver; tasks write through Spark's own writer.
"""

from __future__ import annotations

import posixpath
import uuid
from typing import Protocol

from pyspark.sql import SparkSession


class NoSuchObject(KeyError):
    """The store has no object by that name."""


class Store(Protocol):
    def with_prefix(self, path: str) -> str: ...
    def list(self, prefix: str) -> list[str]: ...
    def value(self, name: str) -> str: ...
    def download(self, name: str, path: str) -> None: ...
    def exists(self, name: str) -> bool: ...
    def store(self, name: str, data: str) -> None: ...


def joined(prefix: str | None, path: str) -> str:
    return posixpath.join(prefix, path) if prefix else path


class MemoryStore:
    """Objects in the driver's memory, for tests."""

    def __init__(self, prefix: str | None = None):
        self.prefix = prefix
        self.objects: dict[str, str] = {}

    def with_prefix(self, path: str) -> str:
        return joined(self.prefix, path)

    def list(self, prefix: str = "") -> list[str]:
        return sorted(name for name in self.objects if name.startswith(prefix))

    def value(self, name: str) -> str:
        if name not in self.objects:
            raise NoSuchObject(name)
        return self.objects[name]

    def download(self, name: str, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.value(name))

    def exists(self, name: str) -> bool:
        return name in self.objects

    def store(self, name: str, data: str) -> None:
        self.objects[name] = data

    def flush(self) -> None:
        self.objects.clear()


class HadoopStore:
    """Files of any file system that Spark knows, seen from the driver."""

    def __init__(self, spark: SparkSession, prefix: str | None = None):
        self.spark, self.prefix = spark, prefix

    def with_prefix(self, path: str) -> str:
        return joined(self.prefix, path)

    def _system(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def list(self, prefix: str) -> list[str]:
        system, path = self._system(prefix)
        if not system.exists(path):
            return []
        found, files = [], system.listFiles(path, True)
        while files.hasNext():
            found.append(files.next().getPath().toString())
        return sorted(found)

    def exists(self, name: str) -> bool:
        system, path = self._system(name)
        return system.exists(path)

    def download(self, name: str, path: str) -> None:
        """An object as a file of the driver's."""
        system, source = self._system(name)
        if not system.exists(source):
            raise NoSuchObject(name)
        system.copyToLocalFile(False, source, self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def value(self, name: str) -> str:
        system, path = self._system(name)
        if not system.exists(path):
            raise NoSuchObject(name)
        stream = system.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def store(self, name: str, data: str) -> None:
        system, path = self._system(name)
        stream = system.create(path, True)
        try:
            stream.write(bytearray(data.encode()))
        finally:
            stream.close()

    def folders(self, prefix: str) -> list[str]:
        system, path = self._system(prefix)
        return sorted(s.getPath().toString() for s in system.listStatus(path) if s.isDirectory()) if system.exists(path) else []

    def rename(self, old: str, new: str) -> None:
        """What has the new name goes aside first, and comes back if the old one can't take its place."""
        system, path = self._system(old)
        target, aside = self._system(new)[1], self._system(f"{new}.{uuid.uuid4().hex}")[1]
        system.mkdirs(target.getParent())
        before = system.exists(target) and system.rename(target, aside)
        if not system.rename(path, target):
            if before:
                system.rename(aside, target)
            raise OSError(f"can't rename {old} to {new}")
        if before:
            system.delete(aside, True)

    def delete(self, name: str) -> None:
        system, path = self._system(name)
        system.delete(path, True)
