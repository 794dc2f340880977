"""Small files beside tables, in any store that Spark reads: read, replaced, or made once."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession


def local_path(place: str | Path) -> Path | None:
    """The path of a place on a mounted disk; None for other stores."""
    text = str(place)
    if "://" not in text and not text.startswith("file:"):
        return Path(text)
    return Path("/" + text.removeprefix("file:").lstrip("/")) if text.startswith("file:") else None


class Files:
    """Files below a place: a path, or the address of a store that the session knows."""

    def __init__(self, spark: SparkSession, place: str | Path):
        self.spark, self.local = spark, local_path(place)
        self.place = f"file://{self.local.resolve()}" if self.local is not None else str(place).rstrip("/")

    def address(self, name: str) -> str:
        return f"{self.place}/{name}"

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.address(name))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def read(self, name: str) -> str | None:
        if self.local is not None:
            try:
                return (self.local / name).read_text()
            except FileNotFoundError:
                return None
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _temporary(self, name: str, text: str) -> str:
        target = self.local / name
        target.parent.mkdir(parents=True, exist_ok=True)
        handle, made = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}")
        with os.fdopen(handle, "w") as f:
            f.write(text)
        return made

    def replace(self, name: str, text: str) -> None:
        """The file holds the text from now on; readers see the old or the new one."""
        if self.local is not None:
            os.replace(self._temporary(name, text), self.local / name)
            return
        self._write(name, text, True)

    def create(self, name: str, text: str) -> bool:
        """Makes the file, whole, unless it is there: of several that try, one does."""
        if self.local is not None:
            made = self._temporary(name, text)
            try:
                os.link(made, self.local / name)
            except FileExistsError:
                return False
            finally:
                os.unlink(made)
            return True
        try:
            self._write(name, text, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def _write(self, name: str, text: str, over: bool) -> None:
        fs, path = self._at(name)
        stream = fs.create(path, over)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self, folder: str) -> list[tuple[str, int, float]]:
        """(name, bytes, seconds since 1970) of what lies in a folder; nothing if it isn't there."""
        if self.local is not None:
            try:
                found = [(p.name, p.stat()) for p in (self.local / folder).iterdir()]
            except FileNotFoundError:
                return []
            return sorted((n, s.st_size, s.st_mtime) for n, s in found)
        fs, path = self._at(folder)
        if not fs.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000) for s in fs.listStatus(path))

    def delete(self, name: str) -> None:
        if self.local is None:
            fs, path = self._at(name)
            fs.delete(path, True)
            return
        at = self.local / name
        if at.is_dir():
            shutil.rmtree(at, ignore_errors=True)
        else:
            with contextlib.suppress(FileNotFoundError):
                at.unlink()

    @staticmethod
    def age(seconds: float) -> float:
        return time.time() - seconds
