"""Files and tables by Spark's own file systems, so that any store works that Spark reads."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str  # relative to the listed folder
    uri: str
    size: int
    modified_ms: int


class Store:
    """A folder or file and what lies in it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._conf = spark._jsc.hadoopConfiguration()
        path = self._path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toUri().toString().rstrip("/")

    def _path(self, x: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(x)

    def _at(self, relative: str):
        return self._path(f"{self.root}/{relative}" if relative else self.root)

    @property
    def name(self) -> str:
        return self._path(self.root).getName()

    def exists(self, relative: str = "") -> bool:
        return self._fs.exists(self._at(relative))

    def is_file(self, relative: str = "") -> bool:
        return self.exists(relative) and self._fs.getFileStatus(self._at(relative)).isFile()

    def is_dir(self, relative: str = "") -> bool:
        return self.exists(relative) and self._fs.getFileStatus(self._at(relative)).isDirectory()

    def read(self, relative: str = "", most: int | None = None) -> bytes:
        size = self._fs.getFileStatus(self._at(relative)).getLen()
        size = size if most is None else min(size, most)
        stream = self._fs.open(self._at(relative))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
        finally:
            stream.close()

    def files(self, below: str = "", suffix: str = "") -> list[FileInfo]:
        """All files below a folder, by path; none where there is no such folder."""
        if not self.is_dir(below):
            return []
        out, found = [], self._fs.listFiles(self._at(below), True)
        while found.hasNext():
            f = found.next()
            uri = f.getPath().toUri().toString()
            path = f.getPath().toUri().getPath()
            root = self._path(self.root).toUri().getPath().rstrip("/")
            if uri.endswith(suffix):
                out.append(FileInfo(path[len(root) + 1 :], uri, f.getLen(), f.getModificationTime()))
        return sorted(out, key=lambda f: f.path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the folder of ``spark.checkpoint.dir``."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="kinespark-ckpt-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
