"""Queries of the operators for training data and, where SQL can express them, their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm import leakage, near_dup, packing, scans, subjects, vectors
from foliomill.session import table


def _payload_texts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "payloads").select(F.col("point_id").alias("id"), F.col("chunk_text").alias("text"))


def _scans(spark, sf_dir: str) -> DataFrame:
    """All records of PDF files (only they can be scans), repaired with the vocabulary of all other payloads."""
    pdf = F.lower("file_path").endswith(".pdf")
    points, answers = table(spark, sf_dir, "payloads"), table(spark, sf_dir, "vision_answers")
    columns = lambda src, i, text, lost, place: [F.lit(src).alias("src"), F.col(i).alias("rec_id"), "file_path", F.col(text).alias("text"), F.lit(lost).alias("lost_ends"), F.col(place).alias("place")]
    records = points.where(pdf).select(*columns("payload", "point_id", "chunk_text", False, "chunk_index")).unionByName(
        answers.where(pdf).select(*columns("vision", "vision_id", "answer", True, "page_no"))
    )
    clean = points.where(F.coalesce(~pdf, F.lit(True)) & F.col("chunk_text").isNotNull()).select(F.col("chunk_text").alias("text"))
    return scans.repair_scans(records, clean)


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Broken and misread words, running headers and page numbers of all records of PDF files."""
    return scans.repairs(_scans(spark, sf_dir))


def p1_text(spark, sf_dir: str) -> DataFrame:
    """The readable text of every record of a PDF file."""
    return _scans(spark, sf_dir).select("src", "rec_id", "text")


def _vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ai_results").where("op = 'embed'").select("result_id", "embedding")


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of results of which one is among the other's five most similar, with a cosine of at least 0.70."""
    return vectors.similar_pairs(_vectors(spark, sf_dir), 5, 0.7).toDF("result_a", "result_b")


def p2_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five most similar others of every usable result."""
    return vectors.similar_vectors(_vectors(spark, sf_dir), 5).withColumnRenamed("id", "result_id")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of points with at least 0.7 of their three-word shingles in common."""
    return near_dup.similar_points(_payload_texts(spark, sf_dir), 3, 0.7).toDF("point_a", "point_b")


def p5_groups(spark, sf_dir: str) -> DataFrame:
    """One row per point: the group of its text, the copies of its text and the number of links."""
    return near_dup.Similar(_payload_texts(spark, sf_dir), 3, 0.7).groups().withColumnRenamed("id", "point_id")


def p6_packed(spark, sf_dir: str) -> DataFrame:
    """Which document or piece lies in which container, for each capacity."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p6_fill(spark, sf_dir: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return packing.fill(p6_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Documents with twelve or more consecutive words of an evaluation item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_passages(spark, sf_dir: str) -> DataFrame:
    """The longest verbatim passages with their places."""
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean(spark, sf_dir: str) -> DataFrame:
    """The documents without any passage of an evaluation item."""
    return leakage.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "eval_items")).select("doc_id", "source")


def p8_found(spark, sf_dir: str) -> DataFrame:
    """The subjects of each document."""
    found = subjects.document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    return found.select("doc_id", "subject")


def p8_composition(spark, sf_dir: str) -> DataFrame:
    """Documents by source and subject."""
    return subjects.composition(p8_found(spark, sf_dir), table(spark, sf_dir, "documents"))


_P7 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
ig AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

_SQL = {
    "p5_found": r"""
WITH t AS (SELECT DISTINCT point_id, chunk_text FROM payloads WHERE point_id IS NOT NULL AND chunk_text IS NOT NULL),
w AS (SELECT point_id, chunk_text, regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+') AS w FROM t),
g AS (SELECT DISTINCT point_id, chunk_text, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT point_id, chunk_text, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT point_id, chunk_text, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT a.point_id AS pa, a.chunk_text AS ta, b.point_id AS pb, b.chunk_text AS tb, count(*) AS shared
      FROM g a JOIN g b ON a.g = b.g AND a.point_id < b.point_id GROUP BY ALL)
SELECT DISTINCT s.pa AS point_a, s.pb AS point_b
FROM s JOIN n x ON x.point_id = s.pa AND x.chunk_text = s.ta JOIN n y ON y.point_id = s.pb AND y.chunk_text = s.tb
WHERE s.shared >= 0.7 * (x.n + y.n - s.shared) - 1e-9
""",
    "p5_groups": r"""
WITH RECURSIVE t AS (SELECT DISTINCT point_id, chunk_text FROM payloads WHERE point_id IS NOT NULL AND chunk_text IS NOT NULL),
w AS (SELECT point_id, regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+') AS w FROM t),
s AS (SELECT point_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS g FROM w WHERE len(w) >= 3),
m AS (SELECT DISTINCT point_id, md5(array_to_string(g, '|')) AS c, g FROM s),
c AS (SELECT c, any_value(g) AS g, count(DISTINCT point_id) AS copies, min(point_id) AS least FROM m GROUP BY c),
x AS (SELECT c, len(g) AS n, unnest(g) AS k FROM c),
p AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.k = b.k AND a.c <> b.c GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE shared >= 0.7 * (na + nb - shared) - 1e-9),
r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT r.a AS c, min(y.least) AS group_id FROM r JOIN c y ON y.c = r.b GROUP BY r.a),
l AS (SELECT a AS c, count(*) AS links FROM e GROUP BY a)
SELECT point_id, min(group_id) AS group_id, max(copies) AS copies, max(coalesce(links, 0)) AS links FROM m JOIN g USING (c) JOIN c USING (c) LEFT JOIN l USING (c) GROUP BY point_id""",
    "p7_found": _P7 + "SELECT doc_id, item_id FROM hit",
    "p7_passages": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT doc_id, i - 1 AS d, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
ig AS (SELECT item_id, i - 1 AS e, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
met AS (SELECT doc_id, item_id, d, e, d - row_number() OVER (PARTITION BY doc_id, item_id, d - e ORDER BY d) AS island FROM dg JOIN ig USING (g))
SELECT doc_id, item_id, min(d) AS doc_word, min(e) AS item_word, count(*) + 11 AS words FROM met GROUP BY doc_id, item_id, d - e, island""",
    "p7_clean": _P7 + "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = d.doc_id)",
}


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (p1_found, p1_text, p2_found, p2_neighbours, p5_found, p5_groups, p6_packed, p6_fill, p7_found, p7_passages, p7_clean, p8_found, p8_composition)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
