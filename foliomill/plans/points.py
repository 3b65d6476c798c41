"""Queries on stored points."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import refs, text
from foliomill.operators import points, progress, retrieve, snapshots
from foliomill.plans.changes import SQL as _CHANGES
from foliomill.session import table


CHANGES = _CHANGES["p3_found"]


def _points(s, d):
    return table(s, d, "payloads")


def _newest(s, d):
    return points.newest(_points(s, d))


def _hits(stored):
    """The stated query set: every point whose id is divisible by 100."""
    return stored.where("point_id % 100 = 0").select(F.col("point_id").alias("hit"), "file_path", "chunk_index", "chunks_total")


def payload_faults(s, d):
    """Stored rows by the first broken payload rule."""
    return points.checked(_points(s, d)).groupBy(F.coalesce("fault", F.lit("valid")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def newest_points(s, d):
    return _newest(s, d).select("file_path", "chunk_index", "point_id")


def point_labels(s, d):
    return _points(s, d).select("point_id", refs.label(F.col("page_range"), F.col("line_range")).alias("label"), text.header("chunk_text").alias("header"), text.short_name("file_path", 30).alias("name"))


def point_uris(s, d):
    return _points(s, d).select("point_id", refs.file_uri(F.col("file_path")).alias("uri"), refs.utc_time(F.col("file_mtime")).alias("modified"))


def point_hashes(s, d):
    return points.described(_points(s, d)).select("point_id", "hash")


def point_references(s, d):
    return points.described(_points(s, d)).select("point_id", "reference")


def neighbour_expand(s, d):
    stored = _newest(s, d)
    return points.neighbours(_hits(stored), stored, 1).select("hit", "point_id", "distance")


def expanded_once(s, d):
    """Expanded points in order of hit and distance, each kept at its first place."""
    stored = _newest(s, d)
    rows = points.neighbours(_hits(stored), stored, 2)
    return points.first_of(rows, ["file_path", "chunk_index"], [F.col("hit"), F.col("distance")]).select("file_path", "chunk_index", "hit", "distance")


def missing_neighbours(s, d):
    stored = _newest(s, d)
    return points.missing_neighbours(_hits(stored), stored, 1)


def collection_stats(s, d):
    return points.stats(_points(s, d))


def chunks_by_file(s, d):
    return _points(s, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunks_total").alias("total"))


def repeated_chunks(s, d):
    """Chunk numbers that a file holds several times."""
    n = _points(s, d).where("chunk_index IS NOT NULL").groupBy("file_path", "chunk_index").agg(F.countDistinct("point_id").alias("points"))
    return n.where("points > 1")


def renamed_paths(s, d):
    return points.rename_prefix(_points(s, d), "/home/", "/srv/users/").select("point_id", "file_path")


def old_versions(s, d):
    return _points(s, d).select("point_id", points.version_below(F.col("version"), (11, 0, 0)).alias("old"))


def stripped_headers(s, d):
    return points.strip_file_header(_points(s, d)).select("point_id", F.sha2("chunk_text", 256).alias("digest"))


def removed_files(s, d):
    """The collection without the files that a snapshot reports as removed."""
    gone = snapshots.snapshot_changes(table(s, d, "file_snapshots")).where("diff = 'removed'")
    return points.delete_files(_points(s, d), gone).select("point_id", "committed_at")


def file_coverage(s, d):
    """How much of each file is stored, weighted by its length in characters."""
    rows = _newest(s, d).select("file_path", F.length(F.coalesce("chunk_text", F.lit(""))).cast("double").alias("w"), F.when(F.length("chunk_text") > 0, 1.0).otherwise(0.5).alias("r"))
    return progress.rollup(rows.withColumn("w", F.col("w") + 1), "file_path", "w", "r")


def hit_contexts(s, d):
    """The context of each hit with its neighbours, as given to a model (digest)."""
    stored = _newest(s, d)
    named = stored.select("point_id", "chunk_text").join(points.described(stored).select("point_id", "hash"), "point_id")
    rows = points.neighbours(_hits(stored), stored, 1).select("hit", "distance", "point_id").join(named, "point_id")
    return retrieve.context(rows).select("hit", F.sha2("context", 256).alias("digest"))


def resolved_references(s, d):
    """References to each hit, one in capitals, one with two damaged digits, one too short, against the hashes of its context."""
    stored = _newest(s, d)
    named = points.described(stored).select("point_id", "hash")
    around = points.neighbours(_hits(stored), stored, 1).join(named, "point_id")
    known = around.select(F.col("hit").alias("answer"), (F.col("distance") + 1).alias("place"), "hash")
    broken = F.concat(F.substring("hash", 1, 4), F.lit("x"), F.substring("hash", 6, 4), F.lit("x"), F.substring("hash", 11, 6))
    asked = around.where("distance = 0").select(F.col("hit").alias("answer"), F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.concat(F.lit("<<< "), F.upper("hash"), F.lit(" >>>")).alias("ref")), F.struct(F.lit(1).alias("pos"), broken.alias("ref")),
        F.struct(F.lit(2).alias("pos"), F.lit("0123").alias("ref")),
    )).alias("x")).select("answer", "x.pos", "x.ref")
    return retrieve.resolve_references(asked, known)


def reference_numbers(s, d):
    """Numbers of the versions around each hit, in the order in which they first appear."""
    stored = _newest(s, d)
    rows = points.neighbours(_hits(stored), stored, 2).join(stored.select("point_id", F.coalesce("version", F.lit("")).alias("ref")), "point_id")
    return retrieve.number_references(rows.select(F.col("hit").alias("answer"), F.col("distance").alias("pos"), "ref"))


def file_extents(s, d):
    """Last page and last line that the chunks of each file name."""
    return _points(s, d).groupBy("file_path").agg(F.max(F.array_max("page_range")).alias("pages"), F.max(F.array_max("line_range")).alias("lines"))


def path_preview(s, d):
    """The first ten paths of the collection."""
    return _points(s, d).select("file_path").distinct().orderBy("file_path").limit(10)


def linked_uris(s, d):
    """A sentence with each point's address as Markdown link."""
    return _points(s, d).select("point_id", refs.markdown_links(F.concat(F.lit("see "), refs.file_uri(F.col("file_path")), F.lit(" (there)"))).alias("linked"))


QUERIES = {f.__name__: f for f in (
    payload_faults, newest_points, point_labels, point_uris, point_hashes, point_references, neighbour_expand, expanded_once, missing_neighbours, collection_stats, chunks_by_file,
    repeated_chunks, renamed_paths, old_versions, stripped_headers, removed_files, file_coverage, hit_contexts, resolved_references, reference_numbers, file_extents, path_preview, linked_uris,
)}

_NEW = """
WITH stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, chunk_index ORDER BY committed_at DESC NULLS LAST, point_id DESC) AS n
  FROM payloads WHERE file_path IS NOT NULL AND chunk_index IS NOT NULL) WHERE n = 1),
hits AS (SELECT point_id AS hit, file_path, chunk_index AS spot, chunks_total FROM stored WHERE point_id % 100 = 0)
"""


def _wanted(radius: int) -> str:
    return f""", wanted AS (SELECT hit, file_path, CAST(i AS INT) AS chunk_index, CAST(i - spot AS INT) AS distance FROM (SELECT *, unnest(range(greatest(0, spot - {radius}),
  greatest(spot, least(chunks_total - 1, spot + {radius})) + 1)) AS i FROM hits))"""


_LABEL = """coalesce(CASE WHEN len(page_range) = 1 THEN 'page ' || page_range[1] WHEN len(page_range) > 1 THEN 'pages ' || page_range[1] || '–' || page_range[len(page_range)] END,
CASE WHEN len(line_range) = 1 THEN 'line ' || line_range[1] WHEN len(line_range) > 1 THEN 'lines ' || line_range[1] || '–' || line_range[len(line_range)] END)"""
_URI = "'file://' || replace(replace(url_encode(file_path), '%2F', '/'), '+', '%20')"
_RANGE = "coalesce(CASE WHEN len({0}) > 0 THEN '[' || array_to_string({0}, ', ') || ']' END, '')"
_HASH = (
    "substr(sha1(coalesce(CAST(chunk_index AS VARCHAR), '') || coalesce(CAST(chunks_total AS VARCHAR), '') || coalesce(file_path, '') || coalesce(CAST(file_mtime AS VARCHAR), '') || "
    + _RANGE.format("line_range") + " || " + _RANGE.format("page_range") + "), 1, 16)"
)
_PART = "coalesce(try_cast(string_split_regex(regexp_replace(coalesce(version, ''), '^[vV]', ''), '[.\\-+]')[{}] AS INT), 0)"
_OLD = f"({_PART.format(1)} < 11)"

SQL = {
    "payload_faults": """SELECT CASE WHEN file_path IS NULL THEN 'file_path missing' WHEN file_mtime IS NULL THEN 'file_mtime missing' WHEN chunk_index IS NULL THEN 'chunk_index missing'
WHEN chunks_total IS NULL THEN 'chunks_total missing' WHEN chunk_text IS NULL THEN 'chunk_text missing' WHEN len(page_range) > 0 AND len(line_range) > 0 THEN 'both ranges' ELSE 'valid' END AS fault, count(*) AS n FROM payloads GROUP BY fault""",
    "newest_points": _NEW + "SELECT file_path, chunk_index, point_id FROM stored",
    "point_labels": f"""SELECT point_id, {_LABEL} AS label, regexp_extract(coalesce(chunk_text, ''), '^# ([^\\n]*)', 1) AS header,
CASE WHEN length(f) <= 30 THEN f ELSE f[1:13] || '...' || right(f, 14) END AS name FROM (SELECT *, string_split(file_path, '/')[-1] AS f FROM payloads)""",
    "point_uris": f"SELECT point_id, {_URI} AS uri, strftime(make_timestamp(CAST(floor(file_mtime) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS modified FROM payloads",
    "point_hashes": f"SELECT point_id, {_HASH} AS hash FROM payloads",
    "point_references": f"SELECT point_id, concat_ws(' · ', {_URI}, coalesce({_LABEL}, 'chunk ' || (chunk_index + 1) || '/' || chunks_total)) AS reference FROM payloads",
    "neighbour_expand": _NEW + _wanted(1) + "SELECT hit, point_id, distance FROM wanted JOIN stored USING (file_path, chunk_index)",
    "expanded_once": _NEW + _wanted(2) + """SELECT file_path, chunk_index, hit, distance FROM (SELECT w.*, row_number() OVER (PARTITION BY file_path, chunk_index ORDER BY hit, distance) AS k
FROM wanted w JOIN stored USING (file_path, chunk_index)) WHERE k = 1""",
    "missing_neighbours": _NEW + _wanted(1) + "SELECT hit, file_path, chunk_index FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.file_path = w.file_path AND s.chunk_index = w.chunk_index)",
    "collection_stats": "SELECT count(*) AS chunks, count(DISTINCT file_path) AS files FROM payloads",
    "chunks_by_file": "SELECT file_path, count(*) AS chunks, max(chunks_total) AS total FROM payloads GROUP BY file_path",
    "repeated_chunks": "SELECT file_path, chunk_index, count(DISTINCT point_id) AS points FROM payloads WHERE chunk_index IS NOT NULL GROUP BY ALL HAVING count(DISTINCT point_id) > 1",
    "renamed_paths": "SELECT point_id, CASE WHEN starts_with(file_path, '/home/') THEN '/srv/users/' || substr(file_path, 7) ELSE file_path END AS file_path FROM payloads",
    "old_versions": f"SELECT point_id, {_OLD} AS old FROM payloads",
    "stripped_headers": f"""SELECT point_id, sha256(CASE WHEN {_OLD} AND starts_with(lower(trim(string_split(chunk_text, chr(10))[1])), '# file://')
THEN array_to_string(string_split(chunk_text, chr(10))[2:], chr(10)) ELSE chunk_text END) AS digest FROM payloads""",
    "file_coverage": _NEW + """SELECT file_path, CAST(coalesce(round(100 * sum((length(coalesce(chunk_text, '')) + 1) * CASE WHEN length(chunk_text) > 0 THEN 1.0 ELSE 0.5 END::DOUBLE) / sum(length(coalesce(chunk_text, '')) + 1)), 0) AS INT) AS percent
FROM stored GROUP BY file_path""",
    "hit_contexts": _NEW + _wanted(1) + f""", named AS (SELECT file_path, chunk_index, chunk_text, {_HASH} AS hash FROM stored)
SELECT hit, sha256(string_agg('<<< ' || hash || ' >>>' || chr(10) || chr(10) || coalesce(chunk_text, '') || chr(10), repeat(chr(10), 4) ORDER BY distance)) AS digest
FROM wanted JOIN named USING (file_path, chunk_index) GROUP BY hit""",
    "reference_numbers": _NEW + _wanted(2) + """, r AS (SELECT w.hit AS answer, w.distance AS pos, coalesce(s.version, '') AS ref FROM wanted w JOIN stored s USING (file_path, chunk_index))
SELECT answer, pos, ref, CAST(dense_rank() OVER (PARTITION BY answer ORDER BY f) AS INT) AS number FROM (SELECT *, min(pos) OVER (PARTITION BY answer, ref) AS f FROM r)""",
    "file_extents": "SELECT file_path, max(list_max(page_range)) AS pages, max(list_max(line_range)) AS lines FROM payloads GROUP BY file_path",
    "path_preview": "SELECT DISTINCT file_path FROM payloads ORDER BY file_path NULLS FIRST LIMIT 10",
    "linked_uris": f"SELECT point_id, 'see [file://' || file_path || '](' || {_URI} || ') (there)' AS linked FROM payloads",
    "resolved_references": _NEW + _wanted(1) + f""", known AS (SELECT w.hit AS answer, w.distance + 1 AS place, {_HASH} AS hash, w.distance FROM wanted w JOIN stored USING (file_path, chunk_index)),
asked AS (SELECT answer, pos, ref, lower(trim(replace(replace(ref, '<<<', ''), '>>>', ''))) AS token FROM (
  SELECT answer, unnest([0, 1, 2]) AS pos, unnest(['<<< ' || upper(hash) || ' >>>', substr(hash, 1, 4) || 'x' || substr(hash, 6, 4) || 'x' || substr(hash, 11, 6), '0123']) AS ref FROM known WHERE distance = 0)),
met AS (SELECT a.answer, a.pos, a.ref, k.hash, k.place, CASE WHEN length(a.token) = 16 THEN hamming(a.token, k.hash) END AS distance FROM asked a JOIN known k USING (answer)),
placed AS (SELECT *, row_number() OVER (PARTITION BY answer, pos ORDER BY distance, place) AS n FROM met WHERE distance <= 2)
SELECT answer, CAST(pos AS INT) AS pos, ref, hash, CAST(distance AS INT) AS distance FROM placed WHERE n = 1""",
    "removed_files": f"""WITH changes AS ({CHANGES}) SELECT point_id, committed_at FROM payloads p
WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.diff = 'removed' AND c.file_path = p.file_path)""",
}
