"""Exclusive claims on names below a shared folder, through the file system that holds it.

A claim is a file that is created only where there is none, which file systems decide atomically. It
says who holds it, so that a claim whose holder died can be taken over once its lease is over: of
several that try, the one whose rename of the old claim succeeds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

LEASE_SECONDS = 900.0


class Busy(TimeoutError):
    """Somebody else holds a name, and did not let go in time."""


class SharedFolder:
    """The few file operations that publishing needs, run by the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.root = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *names: str):
        out = self.root
        for name in names:
            out = self._jvm.org.apache.hadoop.fs.Path(out, name)
        return out

    def create(self, path, text: str) -> bool:
        """Creates a file, unless there is one already."""
        self._fs.mkdirs(path.getParent())
        try:
            if self._fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
                if not self._jvm.java.io.File(path.toUri().getPath()).createNewFile():
                    return False
                out = self._fs.create(path, True)
            else:
                out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def age(self, path) -> float | None:
        """Seconds since a file was written; None if it is gone."""
        try:
            return time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000
        except Py4JJavaError as e:
            if "FileNotFound" in e.java_exception.getClass().getName():
                return None
            raise

    def exists(self, path) -> bool:
        return self._fs.exists(path)

    def move(self, source, target) -> bool:
        self._fs.mkdirs(target.getParent())
        try:
            return self._fs.rename(source, target)
        except Py4JJavaError as e:
            if "FileNotFound" in e.java_exception.getClass().getName():
                return False
            raise

    def remove(self, path) -> None:
        self._fs.delete(path, True)

    def folders(self, path) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(path) if s.isDirectory()] if self.exists(path) else []

    def files(self, path, below: str = "") -> list[str]:
        """Names of all files below a folder, relative to it."""
        out = []
        for status in self._fs.listStatus(path):
            name = f"{below}{status.getPath().getName()}"
            out += self.files(status.getPath(), f"{name}/") if status.isDirectory() else [name]
        return out


def claim(folder: SharedFolder, names: Iterable[str], holder: str, clean: Callable[[str, str], None],
          wait_seconds: float = 600.0, lease_seconds: float = LEASE_SECONDS) -> list[str]:
    """Claims all names, always in the same order, or none. ``clean(holder, name)`` removes what a holder
    that died has left of a name."""
    until, held = time.monotonic() + wait_seconds, []
    try:
        for name in sorted(names):
            path = folder.path("_claims", name)
            while not folder.create(path, holder):
                age = folder.age(path)
                if age is not None and age > lease_seconds:
                    old = folder.path("_claims", f".{holder}-{name}")
                    if folder.move(path, old):
                        clean(folder.text(old), name)
                        folder.remove(old)
                        continue
                if time.monotonic() > until:
                    raise Busy(f"{name} is held by {folder.text(path) if age is not None else 'another'}")
                time.sleep(0.05)
            held.append(name)
    except BaseException:
        release(folder, held)
        raise
    return held


def release(folder: SharedFolder, names: Iterable[str]) -> None:
    for name in names:
        folder.remove(folder.path("_claims", name))
