"""Operators on stored points (payload rows): validation, revisions, neighbours, maintenance, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import refs, text


def checked(points: DataFrame) -> DataFrame:
    """Payload rules: empty ranges become null; ``fault`` names the first broken rule, null if the row is valid."""
    page, line = F.when(F.size("page_range") > 0, F.col("page_range")), F.when(F.size("line_range") > 0, F.col("line_range"))
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in ("file_path", "file_mtime", "chunk_index", "chunks_total", "chunk_text")]
    fault = F.coalesce(*missing, F.when(page.isNotNull() & line.isNotNull(), F.lit("both ranges")))
    return points.withColumns({"page_range": page, "line_range": line, "fault": fault})


def newest(points: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Of several points of one (file_path, chunk_index) the one committed last (ties: the greatest point_id); rows without key stay out."""
    key = key or ["file_path", "chunk_index"]
    order = Window.partitionBy(*key).orderBy(F.col("committed_at").desc_nulls_last(), F.col("point_id").desc())
    known = points.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    return known.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Ordered de-duplication: of the rows of a key the first in ``order`` stays."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def neighbours(hits: DataFrame, points: DataFrame, radius: int = 1) -> DataFrame:
    """Each hit (``hit, file_path, chunk_index``) with the points of the same file within ``radius`` chunks.

    Equi-join on (file_path, chunk_index) of the wanted places, so a file of any size stays spread over the tasks.
    Output: ``hit, file_path, chunk_index, distance, point_id``; wanted chunks that aren't stored don't appear.
    """
    wanted = wanted_chunks(hits, radius)
    return wanted.join(points.select("file_path", "chunk_index", "point_id"), ["file_path", "chunk_index"])


def wanted_chunks(hits: DataFrame, radius: int) -> DataFrame:
    """The places around each hit, from ``max(0, i - radius)`` to ``min(total - 1, i + radius)``, the hit itself included."""
    low = F.greatest(F.lit(0), F.col("chunk_index") - radius)
    high = F.greatest(F.col("chunk_index"), F.least(F.col("chunks_total") - 1, F.col("chunk_index") + radius))
    return hits.select("hit", "file_path", F.col("chunk_index").alias("_at"), F.explode(F.sequence(low, high)).alias("chunk_index")).select(
        "hit", "file_path", "chunk_index", (F.col("chunk_index") - F.col("_at")).alias("distance")
    )


def missing_neighbours(hits: DataFrame, points: DataFrame, radius: int = 1) -> DataFrame:
    """Wanted neighbours that aren't stored: ``hit, file_path, chunk_index``."""
    return wanted_chunks(hits, radius).join(points.select("file_path", "chunk_index"), ["file_path", "chunk_index"], "left_anti").select("hit", "file_path", "chunk_index")


def rename_prefix(points: DataFrame, old: str, new: str) -> DataFrame:
    """Paths that begin with ``old`` begin with ``new``; all others stay."""
    path = F.when(F.col("file_path").startswith(old), F.concat(F.lit(new), F.substring("file_path", len(old) + 1, 2**31 - 1))).otherwise(F.col("file_path"))
    return points.withColumn("file_path", path)


def version_below(version: Column, limit: tuple[int, int, int]) -> Column:
    """Semantic version comparison; null counts as 0.0.0."""
    return text.version_triple(version) < F.struct(*[F.lit(v) for v in limit])


def strip_file_header(points: DataFrame, limit: tuple[int, int, int] = (11, 0, 0)) -> DataFrame:
    """Remove a first line ``# file://...`` (any case) from the texts of versions below ``limit``."""
    lines = F.split("chunk_text", "\n", -1)
    has = F.lower(text.strip(F.get(lines, F.lit(0)))).startswith("# file://")
    old = version_below(F.col("version"), limit)
    cut = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return points.withColumn("chunk_text", F.when(has & old, cut).otherwise(F.col("chunk_text")))


def delete_files(points: DataFrame, paths: DataFrame) -> DataFrame:
    """Points of all files but those in ``paths`` (column file_path)."""
    return points.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def replace_files(points: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace: the points of the files in ``fresh`` go, those of ``fresh`` come, in one step."""
    return delete_files(points, fresh).unionByName(fresh)


def stats(points: DataFrame) -> DataFrame:
    """``chunks, files`` of a collection."""
    return points.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_path").alias("files"))


def described(points: DataFrame) -> DataFrame:
    """Identity and labels of each point: ``point_id, hash, label, uri, modified, reference``."""
    c = F.col
    return points.select(
        "point_id", refs.point_hash(c("chunk_index"), c("chunks_total"), c("file_path"), c("file_mtime"), c("line_range"), c("page_range")).alias("hash"),
        refs.label(c("page_range"), c("line_range")).alias("label"), refs.file_uri(c("file_path")).alias("uri"), refs.utc_time(c("file_mtime")).alias("modified"),
        refs.reference(c("file_path"), c("page_range"), c("line_range"), c("chunk_index"), c("chunks_total")).alias("reference"),
    )
