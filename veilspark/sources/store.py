"""Small files on whatever file system Spark writes to: logs, manifests, released tables. Tables of any size are
Spark's own to read and write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        # a local file system otherwise puts a file of checksums beside each file
        return at, fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def is_folder(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isDirectory()

    def names(self, folder: str) -> list[str]:
        """In order, without those that begin with a dot."""
        at, fs = self._at(folder)
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in found if not n.startswith("."))

    def read(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, data: str | bytes) -> str:
        at, fs = self._at(path)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(data.encode() if isinstance(data, str) else data))
        finally:
            stream.close()
        return path

    def move(self, source: str, to: str) -> str:
        """A file or folder, in place of what is there."""
        (a, fs), (b, _) = self._at(source), self._at(to)
        fs.mkdirs(b.getParent())
        fs.delete(b, True)
        if not fs.rename(a, b):
            raise OSError(f"can't move {source} to {to}")
        return to

    def make(self, folder: str) -> None:
        at, fs = self._at(folder)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *parts[1:]])
