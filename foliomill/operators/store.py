"""Collections of points: Parquet tables that only grow by batches; what a batch replaces or removes is said beside it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.text import header
from foliomill.operators import points
from foliomill.session import lookup_side


class Collections:
    """Named collections below one root folder of any Hadoop file system.

    A write appends its rows under a new batch number, then the files that it replaces or removes, and last a line that
    makes the batch valid; nothing is ever renamed or overwritten, so a write that dies in between changes nothing and a
    reader sees all of a batch or none of it.  Of each file the rows since its last replacement count.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _there(self, name: str, part: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}/{part}"))

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if self.exists(s.getPath().getName()))

    def exists(self, name: str) -> bool:
        """Whether the collection has a valid batch."""
        return self._there(name, "valid") and not self.spark.read.schema("batch long, whole boolean").parquet(f"{self.root}/{name}/valid").isEmpty()

    def _valid(self, name: str) -> DataFrame:
        """Numbers of the batches that count: valid ones since the last that replaced everything."""
        valid = self.spark.read.schema("batch long, whole boolean").parquet(f"{self.root}/{name}/valid")
        first = valid.where("whole").agg(F.coalesce(F.max("batch"), F.lit(0)).alias("first"))
        return valid.crossJoin(F.broadcast(first)).where("batch >= first").select("batch")  # one row beside one row a batch

    def read(self, name: str) -> DataFrame:
        """All points of the collection; an unknown one is an error."""
        if not self.exists(name):
            raise ValueError(f"no collection {name!r}")
        valid = F.broadcast(self._valid(name))
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}/rows").join(valid, "batch", "left_semi")
        if not self._there(name, "replaced"):
            return rows.drop("batch")
        cut = self.spark.read.parquet(f"{self.root}/{name}/replaced").join(valid, "batch", "left_semi").groupBy("file_path").agg(F.max("batch").alias("_cut"))
        return rows.join(lookup_side(cut), "file_path", "left").where("_cut IS NULL OR batch >= _cut").select(*[c for c in rows.columns if c != "batch"])

    def _append(self, name: str, rows: DataFrame | None, paths: DataFrame | None, whole: bool = False) -> None:
        batch = F.lit(time.time_ns()).cast("long").alias("batch")
        if rows is not None:
            rows.select("*", batch).write.mode("append").parquet(f"{self.root}/{name}/rows")
        if paths is not None:
            paths.select("file_path", batch).distinct().write.mode("append").parquet(f"{self.root}/{name}/replaced")
        self.spark.range(1).select(batch, F.lit(whole).alias("whole")).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/valid")

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace the whole collection by ``rows`` (which may be read from it); earlier batches no longer count."""
        self._append(name, rows, None, whole=True)

    def add(self, name: str, rows: DataFrame) -> None:
        """Add points, whatever their files hold already."""
        self._append(name, rows, None)

    def remove(self, name: str, paths: DataFrame) -> None:
        """Remove the points of the files in ``paths``; files without points are no error."""
        self._append(name, None, paths)

    def replace(self, name: str, rows: DataFrame, paths: DataFrame | None = None) -> None:
        """The points of the files in ``rows`` (and in ``paths``) go and those of ``rows`` come, in one step; only ``rows`` are written."""
        gone = rows.select("file_path") if paths is None else rows.select("file_path").unionByName(paths.select("file_path"))
        self._append(name, rows, gone)

    def catalogue(self) -> DataFrame:
        """``name, chunks, files`` of all collections."""
        found = [self.stats(n).select(F.lit(n).alias("name"), "chunks", "files") for n in self.names()]
        out = self.spark.createDataFrame([], "name string, chunks long, files long")
        for f in found:
            out = out.unionByName(f)
        return out

    def stats(self, name: str) -> DataFrame:
        return points.stats(self.read(name))

    def chunks_of(self, name: str, path: str, most: int = 10_000) -> DataFrame:
        """All chunks of one file in order; an unknown file has none."""
        return self.read(name).where(F.col("file_path") == path).orderBy("chunk_index").limit(most)

    def chunk_headers(self, name: str, path: str) -> DataFrame:
        """``chunk_index, header`` of one file in order."""
        return self.chunks_of(name, path).select("chunk_index", header("chunk_text").alias("header"))
