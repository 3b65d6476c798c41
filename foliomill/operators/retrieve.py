"""Retrieval: exact top-k of a stated query set, adaptive cutoff, reranking, references, answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to the tasks at once.
QUERY_BLOCK = 2_000


def _unit(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows with ``dim`` finite values that aren't all zero."""
    ids, col = batch.column(0), batch.column(1)
    ok = np.asarray(ids.is_valid()) & np.asarray(col.is_valid())
    if len(col):
        ok &= np.diff(col.offsets.to_numpy()) == dim
    ids, col = ids.filter(pa.array(ok)), col.filter(pa.array(ok))
    x = np.array(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good]
    return ids[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 30, least: float = 0.1, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` rows of ``vectors`` (id, vector) most similar to each of ``queries`` (id, vector).

    The stated query set runs against all rows in blocks; each task keeps its own ``k`` best of every query, so only
    those are shuffled.  Cosine, rounded to 6 decimals, ties to the smaller id; below ``least`` nothing is returned.
    Null, empty and all-zero vectors and those of another length than the query's never match.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vectors.columns[0]).cast("long").alias("id"), F.col(vectors.columns[1]).cast("array<double>").alias("vector"))
    asked = queries.select(F.col(queries.columns[0]).cast("long").alias("id"), F.col(queries.columns[1]).cast("array<double>").alias("vector"))
    asked = asked.where("id IS NOT NULL AND size(vector) > 0")

    def search(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        best_id, best = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
        for b in batches:
            ids, x = _unit(b, q.shape[1])
            for at in range(0, len(ids), 4096):
                s = np.round(q @ x[at : at + 4096].T, 6)
                near = np.broadcast_to(ids[at : at + 4096], s.shape)
                # only rows that could still be among the k best are sorted; at equal scores all of them are
                if best.shape[1] == k:
                    can = (s >= best[:, -1:]).any(axis=0)
                    s, near = s[:, can], near[:, can]
                elif s.shape[1] > k:
                    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    can = (s >= edge[:, None]).any(axis=0)
                    s, near = s[:, can], near[:, can]
                if not s.shape[1]:
                    continue
                every_id, every = np.concatenate([best_id, near], axis=1), np.concatenate([best, s], axis=1)
                order = np.lexsort((every_id, -every), axis=1)[:, :k]
                best_id, best = np.take_along_axis(every_id, order, 1), np.take_along_axis(every, order, 1)
        r, c = np.nonzero(best >= least)
        yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best_id[r, c]), pa.array(best[r, c])], names=["query_id", "id", "score"])

    found: DataFrame | None = None
    part: list = []

    def run(part: list) -> DataFrame:
        q = np.array([r["vector"] for r in part], dtype=np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in part], dtype=np.int64), q / np.where(norm == 0, 1, norm)))
        return base.mapInArrow(lambda b: search(b, sent), "query_id long, id long, score double")

    for row in asked.toLocalIterator():
        if part and len(row["vector"]) != len(part[0]["vector"]):
            raise ValueError("query vectors must have the same length")
        part.append(row)
        if len(part) == block:
            found, part = run(part) if found is None else found.unionByName(run(part)), []
    if part or found is None:
        empty = spark.createDataFrame([], "query_id long, id long, score double")
        found = (run(part) if part else empty) if found is None else found.unionByName(run(part))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def knee(scores: list[float], sensitivity: float = 1.0) -> int | None:
    """Index of the knee of falling convex scores (Kneedle: Satopää et al., 2011); None if there is none or below 3 points.

    First the curve is smoothed by a polynomial (degree 7, less for few points); if that has no knee, the scores themselves are taken.
    """
    n = len(scores)
    if n < 3 or max(scores) - min(scores) < 1e-12:
        return None
    x, y = np.linspace(0, 1, n), np.array(scores, dtype=float)
    smooth = np.polynomial.Polynomial.fit(x, y, min(7, n - 1))(x)
    found = _knee(smooth, sensitivity)
    return _knee(y, sensitivity) if found is None else found


def _knee(y: np.ndarray, sensitivity: float) -> int | None:
    n = len(y)
    x = np.linspace(0, 1, n)
    if y.max() - y.min() < 1e-12:
        return None
    y = (y - y.min()) / (y.max() - y.min())
    d = (1 - y) - x  # a falling convex curve is mirrored to a rising concave one
    step = sensitivity / (n - 1)
    for i in range(1, n - 1):
        if d[i] > d[i - 1] + 1e-12 and d[i] >= d[i + 1] - 1e-12 and d[i] > 1e-9:
            limit = d[i] - step
            for j in range(i + 1, n):
                if d[j] > d[i] + 1e-12:
                    break
                if d[j] < limit:
                    return i
    return None


def cut_hits(scores: list[float], floor: float = 0.0, sensitivity: float = 1.0, least: int = 1) -> int:
    """How many of the falling scores stay: up to the knee and, within that, before the first below ``floor`` (all if that is the first)."""
    n, at = len(scores), knee(scores, sensitivity)
    cutoff = n if at is None else min(n, max(least, at + 1))
    if n < 2 or cutoff == n:
        return n
    low = next((i for i, s in enumerate(scores[:cutoff]) if s < floor), cutoff)
    return low if low else n


def knee_cutoff(ranked: DataFrame, sensitivity: float = 1.0, least: int = 1, floor: float = 0.0) -> DataFrame:
    """``query_id, n, cutoff``: how many of a query's ranked rows (query_id, rank, score) stay; all where there is no knee."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "n": [len(rows)], "cutoff": [cut_hits(rows["score"].tolist(), floor, sensitivity, least)]})

    return ranked.groupBy("query_id").applyInPandas(cut, "query_id long, n int, cutoff int")


def drop_cutoff(ranked: DataFrame, floor: float) -> DataFrame:
    """Rows before the query's first score under ``floor``; where that is the first row, nothing is cut."""
    first = F.min(F.when(F.col("score") < floor, F.col("rank"))).over(Window.partitionBy("query_id"))
    return ranked.withColumn("_f", first).where((F.col("_f").isNull()) | (F.col("_f") == 1) | (F.col("rank") < F.col("_f"))).drop("_f")


def permutation_faults(given: list[int], n: int) -> list[str]:
    """What keeps a list from being a permutation of 0 to n - 1: wrong length, missing, unknown or repeated entries."""
    want, have = set(range(n)), set(given)
    faults = [] if len(given) == n else ["length"]
    faults += ["missing"] if want - have else []
    faults += ["unknown"] if have - want else []
    return faults + (["repeated"] if len(have) < len(given) else [])


def repaired(given: list[int], n: int) -> list[int]:
    """:func:`repair_permutation` of plain lists."""
    valid = list(dict.fromkeys(i for i in given if 0 <= i < n))
    return valid + [i for i in range(n) if i not in set(valid)]


def permutation_check(given: Column, original: Column) -> Column:
    """Faults of a permutation column as text (empty: none), in the order length, missing, unknown, repeated."""
    return F.concat_ws(
        ",", F.when(F.size(given) != F.size(original), "length"), F.when(F.size(F.array_except(original, given)) > 0, "missing"),
        F.when(F.size(F.array_except(given, original)) > 0, "unknown"), F.when(F.size(F.array_distinct(given)) < F.size(given), "repeated"),
    )


def resolved(asked: list[str], known: list[str], most: int = 2) -> list[str]:
    """The known hashes that an answer's references mean (see :func:`resolve_references`), those that mean none left out."""
    out = []
    for ref in asked:
        token = ref.replace("<<<", "").replace(">>>", "").strip().lower()
        near = [(sum(a != b for a, b in zip(token, h, strict=True)), i) for i, h in enumerate(known) if len(token) == 16 == len(h)]
        best = min(near, default=(most + 1, 0))
        if best[0] <= most:
            out.append(known[best[1]])
    return out


def repair_permutation(given: Column, original: Column) -> Column:
    """First occurrences of valid entries in the given order, then what is missing in the original order."""
    return F.concat(F.array_distinct(F.filter(given, lambda x: F.array_contains(original, x))), F.array_except(original, given))


def rerank(ranked: DataFrame, order: DataFrame, keep: int = 8) -> DataFrame:
    """Gather by a permutation (``query_id, perm`` of positions from 0), then keep ``keep`` rows.

    The permutation is repaired to a full one; queries with one row are left alone.
    """
    n = ranked.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    full = n.join(order, "query_id", "left").withColumn(
        "perm", repair_permutation(F.coalesce("perm", F.array().cast("array<int>")), F.sequence(F.lit(0), F.col("n") - 1))
    )
    placed = full.select("query_id", "n", F.posexplode("perm").alias("pos", "at")).where((F.col("pos") < keep) | (F.col("n") == 1))
    return placed.join(ranked, (placed["query_id"] == ranked["query_id"]) & (placed["at"] + 1 == ranked["rank"])).select(
        placed["query_id"], (F.col("pos") + 1).alias("rank"), "id", "score"
    )


def overlap_order(question: str, chunks: list[str]) -> list[int]:
    """Offline reranker: shared words falling, position rising."""
    ask = set(question.lower().split())
    return sorted(range(len(chunks)), key=lambda i: (-len(ask & set(chunks[i].lower().split())), i))


def resolve_references(asked: DataFrame, known: DataFrame, within: str = "answer", most: int = 2) -> DataFrame:
    """``answer, pos, ref, hash, distance``: references of an answer to the hashes of its context.

    ``asked``: answer, pos, ref; ``known``: answer, place, hash.  Exact matches (case and ``<<< >>>`` ignored) first; other
    16-character tokens go to the hash with the smallest Hamming distance up to ``most``, ties to the first place.
    """
    from foliomill.functions import refs

    token = F.lower(F.trim(F.replace(F.replace("ref", F.lit("<<<"), F.lit("")), F.lit(">>>"), F.lit(""))))
    pairs = asked.withColumn("token", token).join(known, within).withColumn("distance", F.when(F.col("token") == F.col("hash"), 0).otherwise(
        F.when(F.length("token") == 16, refs.hamming(F.col("token"), F.col("hash")))))
    w = Window.partitionBy(within, "pos").orderBy("distance", "place")
    return pairs.where(F.col("distance") <= most).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(within, "pos", "ref", "hash", "distance")


def number_references(rows: DataFrame) -> DataFrame:
    """First-appearance numbers of references over an answer set: ``answer, pos, ref, number`` (from 1)."""
    first = F.min("pos").over(Window.partitionBy("answer", "ref"))
    return rows.withColumn("_f", first).withColumn("number", F.dense_rank().over(Window.partitionBy("answer").orderBy("_f"))).drop("_f")


# The answer's headings and the marks around the hashes of a context, as its readers expect them.
HEADINGS = ("### Question", "### Answers", "### Conclusion", "### References", "### Follow-Up Questions")
MARKS = ("<<< ", " >>>")


def render_answer(question: str, answers: list[tuple[str, list[str]]], conclusion: str, follow_ups: list[str], rejected: bool = False) -> str:
    """One answer as Markdown: question, numbered answers, conclusion, references, follow-ups; empty if rejected."""
    if rejected:
        return ""
    number: dict[str, int] = {}
    for _, used in answers:
        for ref in used:
            number.setdefault(ref, len(number) + 1)
    bullets = ["- " + a + "".join(f" **[{n}]**" for n in sorted({number[r] for r in used})) for a, used in answers]
    parts = [HEADINGS[0], f"**{question}**", HEADINGS[1], "\n".join(bullets), HEADINGS[2], f"**{conclusion}**"]
    if number:
        parts += [HEADINGS[3], "\n".join(f"- **[{n}]** {ref}" for ref, n in number.items())]
    parts += [HEADINGS[4], "\n".join(f"- {f}" for f in follow_ups)]
    return "\n\n".join(p for p in parts if p)


def context(rows: DataFrame, group: str = "hit") -> DataFrame:
    """Context of each group (``group, distance, hash, chunk_text``): hashes and texts in order, four line ends apart."""
    piece = F.concat(F.lit(MARKS[0]), F.col("hash"), F.lit(MARKS[1] + "\n\n"), F.coalesce("chunk_text", F.lit("")), F.lit("\n"))
    listed = F.sort_array(F.collect_list(F.struct("distance", piece.alias("piece"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["piece"]), "\n\n\n\n").alias("context"))
