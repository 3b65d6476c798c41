"""The engine's user-facing operations: watch, track, commit, search, query."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill import providers
from foliomill.functions import refs, text
from foliomill.operators import points, retrieve, segment, snapshots, usage, watch
from foliomill.operators.store import Collections
from foliomill.session import materialize
from foliomill.sources import files

_TRACKED = "file_path string, size long, mtime double, diff string"
#: Paths that one read names.
PATHS_AT_ONCE = 10_000


class Engine:
    """One profile: its patterns, the tracked snapshot, its collection and the result cache below ``home``."""

    def __init__(self, spark: SparkSession, home: str, profile: str = "default", provider: providers.Provider | None = None) -> None:
        self.spark, self.profile, self.provider = spark, profile, provider or providers.Offline()
        self.store = Collections(spark, f"{home}/collections")
        self.state = Collections(spark, f"{home}/state")
        self.kept = Collections(spark, f"{home}/patterns")
        self.cache = Collections(spark, f"{home}/cache")
        self.name = collection_name(profile)

    @property
    def patterns(self) -> dict[str, str]:
        """Patterns with their kind (include, exclude), in order; they survive a restart."""
        return {r["pattern"]: r["kind"] for r in self.kept.read(self.name).orderBy("pattern").collect()} if self.kept.exists(self.name) else {}

    def _move(self, pattern: str, kind: str | None) -> None:
        found = watch.move_pattern(self.patterns, pattern, kind)
        self.kept.write(self.name, self.spark.createDataFrame(list(found.items()), "pattern string, kind string"))

    def include(self, pattern: str) -> None:
        self._move(watch.checked_pattern(pattern), "include")

    def exclude(self, pattern: str) -> None:
        self._move(watch.checked_pattern(pattern), "exclude")

    def remove(self, pattern: str) -> None:
        self._move(watch.checked_pattern(pattern), None)

    def tracked(self) -> DataFrame:
        return self.state.read(self.name) if self.state.exists(self.name) else self.spark.createDataFrame([], _TRACKED)

    def track(self, root: str) -> DataFrame:
        """Compare the selected files with the last snapshot and keep the result; unresolved additions stay additions."""
        patterns = self.patterns
        kind = lambda k: [p for p, v in patterns.items() if v == k]
        now = files.list_files(self.spark, root)
        now = now.join(watch.selected(now, kind("include"), kind("exclude")), "file_path", "left_semi")
        old = self.tracked()
        before = old.where("diff <> 'removed'").select("file_path", "size", "mtime", F.col("diff").alias("was"))
        diff = snapshots.snapshot_diff(before, now).join(before.select("file_path", "was"), "file_path", "left")
        state = F.when(F.col("was").isin("added", "changed") & F.col("diff").isin("None", "changed"), F.col("was")).otherwise(F.col("diff"))
        kept = diff.select("file_path", "size", "mtime", state.alias("diff"))
        still = old.where("diff = 'removed'").select("file_path", "size", "mtime", "diff").join(kept, "file_path", "left_anti")
        self.state.write(self.name, materialize(kept.unionByName(still), "tracked"))
        return self.diff()

    def diff(self) -> DataFrame:
        return self.tracked().where("diff <> 'None'").orderBy("file_path")

    def listed(self) -> DataFrame:
        """The tracked files, sorted."""
        return self.tracked().orderBy("file_path")

    def _read(self, wanted: DataFrame) -> DataFrame:
        """Decoded lines of the wanted files; no other file is read."""
        escape = lambda p: re.sub(r"([\[\]{}*?\\])", r"\\\1", p)
        paths = (escape(r["file_path"]) for r in wanted.select("file_path").toLocalIterator())
        found = self.spark.createDataFrame([], "file_path string, kind string, ref_kind string, lines array<struct<text string, ref int>>")
        while block := list(itertools.islice(paths, PATHS_AT_ONCE)):
            found = found.unionByName(files.decode(self.spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(block)))
        return found

    def _embedded(self, rows: DataFrame, use_cache: bool) -> DataFrame:
        """Rows with ``vector``: from the cache where it knows their text (``use_cache`` False: it isn't read, only written)."""
        key = usage.cache_key(F.lit("embed"), F.col("chunk_text"), F.lit(self.provider.models()))
        keyed = rows.withColumn("cache_key", key)
        known = self.cache.read("embed") if self.cache.exists("embed") else self.spark.createDataFrame([], "cache_key string, vector array<float>")
        met = usage.with_cache(keyed, known, bypass=not use_cache)
        fresh = materialize(providers.embed(met.where("NOT hit").select("cache_key", "chunk_text").dropDuplicates(["cache_key"]), self.provider).where("vector IS NOT NULL").select("cache_key", "vector"), "embedded")
        new = fresh.join(known, "cache_key", "left_anti")
        if not new.isEmpty():
            self.cache.add("embed", new)
        vectors = fresh if not use_cache else fresh.unionByName(known.join(fresh, "cache_key", "left_anti").select("cache_key", "vector"))
        # a chunk whose embedding failed is left out, the others keep their numbers
        return keyed.join(vectors, "cache_key").drop("cache_key")

    def commit(self, root: str | None = None, use_cache: bool = True) -> dict[str, int]:
        """Apply the open changes to the collection in one step and mark them resolved; returns what was done.

        A changed file that can't be decoded keeps its old points and stays open.  ``root`` isn't needed any more.
        """
        changes = materialize(self.diff(), "changes")
        wanted = changes.where("diff IN ('added', 'changed')").select("file_path", "mtime")
        decoded = materialize(self._read(wanted).where("lines IS NOT NULL"), "decoded")
        docs = decoded.select(F.xxhash64("file_path").alias("doc_id"), "file_path", "ref_kind", F.array_join("lines.text", "\n").alias("text"))
        cut = segment.chunk_documents(docs.select("doc_id", "text"), 100, self.provider.chunk)
        paths = docs.select("doc_id", "file_path", "ref_kind").join(wanted, "file_path")
        span = F.when(F.col("ref_min") == F.col("ref_max"), F.array("ref_min")).otherwise(F.array("ref_min", "ref_max"))
        fresh = cut.join(paths, "doc_id").select(
            F.sha2(F.concat_ws("|", "file_path", "chunk_index", "chunk_text"), 256).alias("id"), "file_path", F.col("mtime").alias("file_mtime"), "chunk_index", "chunks_total", "chunk_text",
            F.lit("v0.2.0").alias("version"), F.when(F.col("ref_kind") == "page", span).alias("page_range"), F.when(F.col("ref_kind") == "line", span).alias("line_range"),
        )
        fresh = materialize(self._embedded(materialize(fresh, "chunks"), use_cache), "points")
        done = materialize(paths.select("file_path").unionByName(changes.where("diff = 'removed'").select("file_path")), "done")
        self.store.replace(self.name, fresh, done)
        counts = {r["diff"]: r["n"] for r in snapshots.diff_counts(changes.join(done, "file_path", "left_semi")).collect()}
        self.state.write(self.name, materialize(snapshots.resolve_diff(self.tracked(), done), "state"))
        return counts

    def update(self, root: str, use_cache: bool = True) -> dict[str, int]:
        self.track(root)
        return self.commit(root, use_cache)

    def search(self, question: str, k: int = 30, least: float = 0.1) -> DataFrame:
        """Ranked chunks of the collection: ``rank, score`` and the payload."""
        rows = self.store.read(self.name).withColumn("pid", F.xxhash64("id"))
        asked = self.spark.createDataFrame([(0, [float(x) for x in providers.retry(lambda: self.provider.embed([question]))[0]])], "id long, vector array<double>")
        ranked = retrieve.top_k(rows.select("pid", "vector"), asked, k, least)
        return ranked.join(F.broadcast(ranked.select("id")), "id", "left_semi").join(rows.drop("id", "vector"), ranked["id"] == rows["pid"]).drop("pid", "query_id", "id").orderBy("rank")

    def files_found(self, question: str, k: int = 30) -> DataFrame:
        """``file_path, score, rank``: the files of a search, with the score of the last chunk ranked, in order of first appearance."""
        found = self.search(question, k)
        return found.groupBy("file_path").agg(F.max_by("score", "rank").alias("score"), F.min("rank").alias("rank")).orderBy("rank")

    def ask(self, question: str, keep: int = 8, radius: int = 1, least: float = 0.1, sensitivity: float = 1.0) -> dict:
        """Answer with its references: search, knee cutoff (which alone knows the floor), rerank, neighbours, de-duplication, hashes.

        Gives the structured answer and, under ``answer_text``, its Markdown (empty if rejected).
        """
        hits = self.search(question, least=least).collect()  # at most 30 rows
        hits = hits[: retrieve.cut_hits([h["score"] for h in hits], least, sensitivity)]
        if len(hits) > 1:
            given = providers.retry(lambda: self.provider.rerank(question, [h["chunk_text"] for h in hits]))
            problems = retrieve.permutation_faults(given, len(hits))
            order = given if not problems else retrieve.repaired(given, len(hits))
            hits = [hits[i] for i in order][:keep]
        named = self.spark.createDataFrame([(i, h["file_path"], h["chunk_index"], h["chunks_total"]) for i, h in enumerate(hits)], "hit int, file_path string, chunk_index int, chunks_total int")
        stored = self.store.read(self.name).withColumn("point_id", F.xxhash64("id"))
        near = points.neighbours(named, stored, radius) if radius else named.withColumn("distance", F.lit(0)).join(stored.select("file_path", "chunk_index", "point_id"), ["file_path", "chunk_index"])
        first = points.first_of(near.select("hit", "distance", "file_path", "chunk_index", "point_id"), ["file_path", "chunk_index"], [F.col("hit"), F.col("distance")])
        told = first.select("hit", "distance", "point_id").join(stored, "point_id")
        c = F.col
        told = told.select(
            "hit", "distance", "chunk_text", refs.point_hash(c("chunk_index"), c("chunks_total"), c("file_path"), c("file_mtime"), c("line_range"), c("page_range")).alias("hash"),
            refs.reference(c("file_path"), c("page_range"), c("line_range"), c("chunk_index"), c("chunks_total")).alias("reference"),
        )
        context = told.orderBy("hit", "distance").collect() if hits else []
        reply = providers.retry(lambda: self.provider.answer(question, [(r["hash"], r["chunk_text"]) for r in context]))
        names = {r["hash"]: r["reference"] for r in context}
        answers = [(x["answer"], [names[h] for h in retrieve.resolved(x["chunk_ref_list"], [r["hash"] for r in context])]) for x in reply["answer_list"]]
        shown = retrieve.render_answer(reply["question_rephrased"], answers, reply["answer_conclusion"], reply["follow_up_questions_list"], reply["is_rejected"])
        return {"question": question, "query_result": reply, "answer_text": shown}

    def query(self, question: str, keep: int = 8, radius: int = 1) -> str:
        """The answer as Markdown; empty if it was rejected."""
        return self.ask(question, keep, radius)["answer_text"]

    def query_to_files(self, question: str, folder: str) -> str:
        """Write the answer as JSON and, beside it, as Markdown; gives the path of the JSON file, named after the question."""
        found = self.ask(question)
        name = self.spark.range(1).select(text.json_name(F.lit(question))).first()[0]
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        for target, body in ((path, json.dumps(found, ensure_ascii=False, indent=2)), (path.removesuffix(".json") + ".md", found["answer_text"])):
            with open(target, "w", encoding="utf-8") as out:
                out.write(body)
        return path


def collection_name(profile: str, base: str = "foliomill") -> str:
    """Base, profile with ``-`` for spaces, and the first 8 digits of the profile's SHA-1."""
    return f"{base}-{profile.replace(' ', '-')}-{hashlib.sha1(profile.encode()).hexdigest()[:8]}"
