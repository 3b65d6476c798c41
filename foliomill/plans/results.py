"""Queries on vectors, cached results, vision answers, tracked files and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text
from foliomill.operators import progress, retrieve, snapshots, usage, vision, watch
from foliomill.plans.changes import SQL as _CHANGES
from foliomill.session import table

CHANGES = _CHANGES["p3_found"]

INCLUDE = ["/home/*/archive/**/*.pdf", "/home/*/archive/**/*.md", "/home/*/archive/**/*.txt"]
EXCLUDE = ["/home/*/archive/**/done/*"]


def knn_topk(s, d):
    """Top 30 of every query vector (id divisible by 100) in the whole collection."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return retrieve.top_k(v, v.where("vec_id % 100 = 0"), 30, 0.1)


def retrieve_expanded(s, d):
    """Top-k hits with their neighbours (ids beside the hit, of the same label, which stands for the file), each point kept at its best place."""
    labels = table(s, d, "embeddings").select("vec_id", "label")
    ranked = knn_topk(s, d).join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id")
    around = ranked.select("query_id", "rank", "score", F.explode(F.array(*[F.col("id") + i for i in (-1, 0, 1)])).alias("vec_id"), "id", "own")
    known = around.join(labels, "vec_id").where("label = own").withColumn("near", F.col("vec_id") - F.col("id"))
    from foliomill.operators.points import first_of

    return first_of(known, ["query_id", "vec_id"], [F.col("rank"), F.col("near")]).select("query_id", "vec_id", "label", "rank", "near", "score")


def knn_labels(s, d):
    """Per query and label: hits, the score of the last ranked and the best score."""
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return knn_topk(s, d).join(labels, "id").groupBy("query_id", "label").agg(
        F.count(F.lit(1)).alias("hits"), F.max_by("score", "rank").alias("last_score"), F.max("score").alias("best_score")
    )


def knee_cutoffs(s, d):
    return retrieve.knee_cutoff(knn_topk(s, d))


def score_floor(s, d):
    return retrieve.drop_cutoff(knn_topk(s, d), 0.3)


def reranked(s, d):
    """Ranked rows gathered by a permutation that names every second rank backwards, one twice and one unknown; 8 stay."""
    ranked = knn_topk(s, d)
    order = ranked.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n")).select(
        "query_id", F.concat(F.reverse(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda x: x % 2 == 0)), F.array(F.lit(0), F.lit(999))).alias("perm")
    )
    return retrieve.rerank(ranked, order, 8)


def token_usage(s, d):
    return usage.token_usage(table(s, d, "ai_results"))


def cache_entries(s, d):
    return usage.cache_entries(table(s, d, "ai_results"))


def cache_hits(s, d):
    """Results that an earlier one would have answered, by operation."""
    asked = usage.answered_before(table(s, d, "ai_results"))
    return asked.groupBy("op").agg(F.count(F.lit(1)).alias("asked"), F.count_if("hit").alias("hits"))


def cache_keys(s, d):
    """Content-addressed keys of all results."""
    return table(s, d, "ai_results").select("result_id", usage.cache_key(F.col("op"), F.col("output_text"), F.lit("model")).alias("key")).distinct()


def clean_json(s, d):
    """Answers without control characters (digest)."""
    return table(s, d, "ai_results").select("result_id", F.sha2(text.json_clean("parsed_schema"), 256).alias("digest")).distinct()


def _answers(s, d):
    return vision.latest(table(s, d, "vision_answers"))


def vision_relations(s, d):
    return vision.relations(_answers(s, d))


def vision_unrelated(s, d):
    return vision.unrelated(_answers(s, d))


def vision_first_mentions(s, d):
    return vision.first_mentions(_answers(s, d))


def vision_sentences(s, d):
    return vision.sentences(_answers(s, d))


def vision_pages(s, d):
    """Last page with an answer so far in each file (carried forward), and the greatest image number so far."""
    rows = _answers(s, d).select("file_path", "vision_id", "image_index", F.when(F.length("answer") > 0, F.col("page_no")).alias("page"))
    kept = progress.running_max(progress.carry_forward(rows, "file_path", ["vision_id"], "page"), "file_path", ["vision_id"], "image_index")
    return kept.select("vision_id", F.col("carried").alias("page"), F.col("peak").alias("image"))


def tracked_selected(s, d):
    """Tracked paths that the include patterns select and the exclude patterns don't."""
    return watch.selected(table(s, d, "file_snapshots"), INCLUDE, EXCLUDE)


def watch_diff(s, d):
    """All states, unchanged ones too, of the profiles' files in each snapshot against the one before (newest delivery of each)."""
    from foliomill.operators.points import first_of

    known = table(s, d, "file_snapshots").where("profile IS NOT NULL AND snapshot_no IS NOT NULL AND file_path IS NOT NULL")
    newest = [F.col("delivered_at").desc_nulls_last(), F.col("size").desc_nulls_last(), F.col("mtime").desc_nulls_last(), F.coalesce("diff", F.lit("")) == "removed"]
    return snapshots.consecutive_diffs(first_of(known, ["profile", "snapshot_no", "file_path"], newest).where("diff IS NULL OR diff <> 'removed'"))


def watch_ignored(s, d):
    """How many files the include patterns name and how many of them the exclude patterns leave out."""
    paths = table(s, d, "file_snapshots")
    named = watch.selected(paths, INCLUDE, []).join(watch.selected(paths, INCLUDE, EXCLUDE).withColumn("kept", F.lit(True)), "file_path", "left")
    return named.agg(F.count(F.lit(1)).alias("included"), F.count_if(F.col("kept").isNull()).alias("ignored"))


def permutation_checks(s, d):
    """What is wrong with the permutations of ``reranked``."""
    n = knn_topk(s, d).groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    return n.select("query_id", retrieve.permutation_check(F.concat(F.reverse(F.filter(places, lambda x: x % 2 == 0)), F.array(F.lit(0), F.lit(999))), places).alias("faults"))


def watch_counts(s, d):
    return snapshots.diff_counts(watch_diff(s, d))


def change_counts(s, d):
    """Changes per profile and snapshot."""
    found = snapshots.snapshot_changes(table(s, d, "file_snapshots"))
    return found.groupBy("profile", "snapshot_no", "diff").agg(F.count(F.lit(1)).alias("n"))


def event_peaks(s, d):
    """Events with the user's greatest value so far (monotone progress)."""
    return progress.running_max(table(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "peak")


def event_rollup(s, d):
    """Weighted completion of each user: ratio 1 for purchases, one half else, weighted by value."""
    rows = table(s, d, "events").select("user_id", "value", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.5).alias("ratio"))
    return progress.rollup(rows, "user_id", "value", "ratio")


QUERIES = {f.__name__: f for f in (
    knn_topk, retrieve_expanded, knn_labels, knee_cutoffs, score_floor, reranked, permutation_checks, token_usage, cache_entries, cache_hits, cache_keys, clean_json, vision_relations, vision_unrelated, vision_first_mentions,
    vision_sentences, vision_pages, tracked_selected, watch_diff, watch_counts, watch_ignored, change_counts, event_peaks, event_rollup,
)}

_KNN = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, round(list_cosine_similarity(q.e, x.e), 6) AS score FROM v q JOIN v x ON q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1) WHERE rank <= 30)
"""
_ANS = """
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vision_id ORDER BY asked_at DESC NULLS LAST, length(answer) DESC NULLS LAST, answer NULLS FIRST) AS n FROM vision_answers WHERE vision_id IS NOT NULL) WHERE n = 1),
e AS (SELECT vision_id, i AS pos, entities[i].name AS name FROM (SELECT vision_id, entities, unnest(range(1, len(entities) + 1)) AS i FROM a) WHERE entities[i].name IS NOT NULL),
names AS (SELECT DISTINCT vision_id, name FROM e),
r AS (SELECT vision_id, CAST(i - 1 AS INT) AS pos, relations[i].subject AS subject, relations[i].predicate AS predicate, relations[i].object AS object
  FROM (SELECT vision_id, relations, unnest(range(1, len(relations) + 1)) AS i FROM a)),
kept AS (SELECT r.* FROM r JOIN names s ON s.vision_id = r.vision_id AND s.name = r.subject JOIN names o ON o.vision_id = r.vision_id AND o.name = r.object),
ends AS (SELECT vision_id, pos, subject AS name FROM kept UNION ALL SELECT vision_id, pos, object FROM kept),
firsts AS (SELECT vision_id, name, min(pos) AS f FROM ends GROUP BY ALL)
"""
_W = """
WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile, snapshot_no, file_path ORDER BY delivered_at DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST, coalesce(diff, '') = 'removed') AS n
  FROM file_snapshots WHERE profile IS NOT NULL AND snapshot_no IS NOT NULL AND file_path IS NOT NULL) WHERE n = 1 AND coalesce(diff, '') <> 'removed'),
calendar AS (SELECT profile, snapshot_no, lag(snapshot_no) OVER (PARTITION BY profile ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT profile, snapshot_no FROM newest)),
o AS (SELECT c.profile, c.snapshot_no, r.file_path, r.size, r.mtime FROM calendar c JOIN newest r ON r.profile = c.profile AND r.snapshot_no = c.before),
c AS (SELECT r.profile, r.snapshot_no, r.file_path, r.size, r.mtime FROM newest r JOIN calendar c ON c.profile = r.profile AND c.snapshot_no = r.snapshot_no AND c.before IS NOT NULL),
diffs AS (SELECT coalesce(c.profile, o.profile) AS profile, coalesce(c.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(c.file_path, o.file_path) AS file_path,
  CASE WHEN o.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'removed' WHEN c.size IS NOT DISTINCT FROM o.size AND c.mtime IS NOT DISTINCT FROM o.mtime THEN 'None' ELSE 'changed' END AS diff
  FROM o FULL OUTER JOIN c ON o.profile = c.profile AND o.snapshot_no = c.snapshot_no AND o.file_path = c.file_path)
"""

SQL = {
    "knn_topk": _KNN + "SELECT * FROM ranked",
    "retrieve_expanded": _KNN + """, around AS (SELECT query_id, rank, score, id, unnest([id - 1, id, id + 1]) AS vec_id FROM ranked),
known AS (SELECT a.*, v.label, a.vec_id - a.id AS near FROM around a JOIN v USING (vec_id) JOIN v w ON w.vec_id = a.id AND w.label = v.label)
SELECT query_id, vec_id, label, rank, near, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY rank, near) AS k FROM known) WHERE k = 1""",
    "knn_labels": _KNN + "SELECT query_id, label, count(*) AS hits, arg_max(score, rank) AS last_score, max(score) AS best_score FROM ranked JOIN v ON v.vec_id = ranked.id GROUP BY query_id, label",
    "score_floor": _KNN + """SELECT query_id, rank, id, score FROM (SELECT *, min(CASE WHEN score < 0.3 THEN rank END) OVER (PARTITION BY query_id) AS f FROM ranked)
WHERE f IS NULL OR f = 1 OR rank < f""",
    "reranked": _KNN + """, n AS (SELECT query_id, count(*) AS n FROM ranked GROUP BY query_id),
p AS (SELECT r.query_id, r.id, r.score, n.n, row_number() OVER (PARTITION BY r.query_id ORDER BY (r.rank - 1) % 2, CASE WHEN (r.rank - 1) % 2 = 0 THEN -r.rank ELSE r.rank END) AS k
  FROM ranked r JOIN n USING (query_id))
SELECT query_id, CAST(k AS INT) AS rank, id, score FROM p WHERE k <= 8 OR n = 1""",
    "token_usage": "SELECT op, count(*) AS results, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE t = 0) AS cached FROM (SELECT result_id, op, max(total_tokens) AS t FROM ai_results GROUP BY ALL) GROUP BY op",
    "cache_entries": """WITH o AS (SELECT DISTINCT cache_key, op, result_id, created_at FROM ai_results WHERE cache_key IS NOT NULL)
SELECT cache_key, op, result_id AS first_id, uses FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at, result_id) AS n FROM o)
JOIN (SELECT cache_key, count(DISTINCT result_id) AS uses FROM o GROUP BY cache_key) USING (cache_key) WHERE n = 1""",
    "cache_hits": """WITH r AS (SELECT DISTINCT result_id, cache_key, op, created_at FROM ai_results),
f AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at NULLS FIRST, result_id) AS n FROM r)
SELECT op, count(*) AS asked, count(*) FILTER (WHERE n > 1 AND cache_key IS NOT NULL) AS hits FROM f GROUP BY op""",
    "vision_relations": _ANS + "SELECT vision_id, pos, subject, predicate, object FROM kept",
    "vision_unrelated": _ANS + "SELECT vision_id, name FROM names n WHERE NOT EXISTS (SELECT 1 FROM ends x WHERE x.vision_id = n.vision_id AND x.name = n.name)",
    "vision_first_mentions": _ANS + """SELECT k.vision_id, k.pos, k.subject, k.predicate, k.object, k.pos = s.f AS subject_first, k.pos = o.f AS object_first
FROM kept k JOIN firsts s ON s.vision_id = k.vision_id AND s.name = k.subject JOIN firsts o ON o.vision_id = k.vision_id AND o.name = k.object""",
    "vision_pages": _ANS + """SELECT vision_id, last_value(page IGNORE NULLS) OVER w AS page, max(image_index) OVER w AS image FROM (SELECT *, CASE WHEN length(answer) > 0 THEN page_no END AS page FROM a)
WINDOW w AS (PARTITION BY file_path ORDER BY vision_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "tracked_selected": r"""SELECT DISTINCT file_path FROM file_snapshots WHERE regexp_matches(file_path, '^/home/[^./][^/]*/archive/([^./][^/]*/)*[^./][^/]*\.(pdf|md|txt)$')
AND NOT regexp_matches(file_path, '^/home/[^./][^/]*/archive/([^./][^/]*/)*done/[^./][^/]*$')""",
    "watch_diff": _W + "SELECT profile, snapshot_no, file_path, diff FROM diffs",
    "watch_ignored": r"""SELECT count(*) AS included, count(*) FILTER (WHERE regexp_matches(file_path, '^/home/[^./][^/]*/archive/([^./][^/]*/)*done/[^./][^/]*$')) AS ignored
FROM (SELECT DISTINCT file_path FROM file_snapshots) WHERE regexp_matches(file_path, '^/home/[^./][^/]*/archive/([^./][^/]*/)*[^./][^/]*\.(pdf|md|txt)$')""",
    "permutation_checks": _KNN + """SELECT query_id, CASE WHEN (n + 1) // 2 + 2 <> n THEN 'length,' ELSE '' END || CASE WHEN n > 1 THEN 'missing,' ELSE '' END || 'unknown,repeated' AS faults
FROM (SELECT query_id, count(*) AS n FROM ranked GROUP BY query_id)""",
    "cache_keys": "SELECT DISTINCT result_id, sha256(concat_ws(':', op, output_text, sha256('model'))) AS key FROM ai_results",
    "clean_json": r"SELECT DISTINCT result_id, sha256(regexp_replace(parsed_schema, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS digest FROM ai_results",
    "watch_counts": _W + "SELECT diff, count(*) AS n FROM diffs GROUP BY diff",
    "change_counts": f"WITH changes AS ({CHANGES}) SELECT profile, snapshot_no, diff, count(*) AS n FROM changes GROUP BY ALL",
    "event_peaks": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events",
    "event_rollup": "SELECT user_id, CAST(coalesce(round(100 * sum(value * CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.5 END::DOUBLE) / sum(value)), 0) AS INT) AS percent FROM events GROUP BY user_id",
}
