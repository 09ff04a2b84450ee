"""Small files and folders on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Text files below a root folder, which is a path or URI."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _at(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(*parts))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, *parts: str) -> bool:
        fs, path = self._at(*parts)
        return fs.exists(path)

    def read(self, *parts: str) -> str | None:
        """Content of a text file, None if there is none."""
        fs, path = self._at(*parts)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        """Replace a text file as a whole: readers see the old or the new one."""
        fs, path = self._at(*parts)
        _, new = self._at(*parts[:-1], f".{parts[-1]}.new")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(path), options)

    def delete(self, *parts: str) -> None:
        fs, path = self._at(*parts)
        fs.delete(path, True)

    def size(self, *parts: str) -> int:
        """Bytes of a folder and all in it."""
        fs, path = self._at(*parts)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0
