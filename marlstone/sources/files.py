"""Files by the file system that Spark reads them with: local, HDFS, object stores."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """A thin view of Hadoop's FileSystem for the paths of one session."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.conf)
        return (fs.getRaw() if fs.getUri().getScheme() == "file" else fs), p  # without checksum files

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def move(self, source: str, target: str) -> None:
        """Never over an existing target, and never into it."""
        fs, p = self._at(source)
        q = self._at(target)[1]
        if fs.exists(q) or not fs.rename(p, q):
            raise OSError(f"{source} can't be moved to {target}")

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def state(self, path: str) -> str:
        """Bytes, files, folders and time of change, in a fixed number of calls whatever the number of files."""
        fs, p = self._at(path)
        all_ = fs.getContentSummary(p)
        return f"{all_.getLength()}:{all_.getFileCount()}:{all_.getDirectoryCount()}:{fs.getFileStatus(p).getModificationTime()}"

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def parent(self, path: str) -> str:
        parent = self.jvm.org.apache.hadoop.fs.Path(path).getParent()
        return parent.toString() if parent else path

    def write_text(self, path: str, text: str) -> None:
        """Replaces what is there."""
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
