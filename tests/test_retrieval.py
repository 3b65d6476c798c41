import random

import numpy as np
import pytest

from foliomill.operators import points, retrieve, usage, vision, watch


def test_top_k_brute_force_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(float)
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(300, None, ""), (301, [], ""), (302, [0.0] * 8, ""), (303, [1.0], ""), (304, x[0].tolist(), "")]
    v = spark.createDataFrame(rows, "id long, vector array<double>, score string").repartition(5)
    got = retrieve.top_k(v.select("id", "vector"), v.where("id < 20").select("id", "vector"), 5, 0.0, block=7).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = np.vstack([n, n[0]])
    ids = list(range(300)) + [304]
    for q in range(20):
        s = np.round(n @ n[q], 6)
        want = sorted(((-a, i) for a, i in zip(s, ids) if a >= 0))[:5]
        assert [(r.id, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, k) for k, (_, i) in enumerate(want, 1)]
    assert retrieve.top_k(v.select("id", "vector").limit(0), v.where("id < 2").select("id", "vector")).count() == 0
    assert retrieve.top_k(v.select("id", "vector"), v.limit(0).select("id", "vector")).count() == 0


def test_knee():
    at = retrieve.knee([0.95, 0.94, 0.93, 0.10, 0.09, 0.08])
    assert at is not None and at + 1 < 6
    assert retrieve.knee([0.90, 0.85, 0.80, 0.75, 0.70, 0.65]) is None
    assert retrieve.knee([1.0, 0.5]) is None and retrieve.knee([0.5] * 6) is None


def test_permutation_repair_is_always_valid(spark):
    rnd = random.Random(2)
    cases = [(list(range(n)), [rnd.randint(-1, 6) for _ in range(rnd.randint(0, 8))]) for n in range(6) for _ in range(6)]
    df = spark.createDataFrame(cases, "o array<int>, g array<int>")
    for r in df.select("o", "g", retrieve.repair_permutation(df["g"], df["o"]).alias("p")).collect():
        valid = list(dict.fromkeys(x for x in r.g if x in r.o))
        assert r.p == valid + [x for x in r.o if x not in valid]


def test_rerank_and_single(spark):
    ranked = spark.createDataFrame([(1, k, 10 + k, 1.0 / k) for k in range(1, 11)] + [(2, 1, 99, 0.5)], "query_id long, rank int, id long, score double")
    order = spark.createDataFrame([(1, [3, 3, 77, 0])], "query_id long, perm array<int>")
    got = {q: [r.id for r in retrieve.rerank(ranked, order, 4).orderBy("rank").collect() if r.query_id == q] for q in (1, 2)}
    assert got == {1: [14, 11, 12, 13], 2: [99]}
    cut = retrieve.drop_cutoff(ranked, 0.25)
    assert sorted(r.id for r in cut.collect()) == [11, 12, 13, 14, 99]


def test_references(spark):
    known = spark.createDataFrame([("q", 0, "0123456789abcdef"), ("q", 1, "0123456789abcdee"), ("q", 2, "ffffffffffffffff")], "answer string, place int, hash string")
    asked = spark.createDataFrame([("q", 0, "<<< 0123456789ABCDEE >>>"), ("q", 1, "xx23456789abcdef"[:16]), ("q", 2, "short"), ("q", 3, "x123456789abcdxf")], "answer string, pos int, ref string")
    got = {r.pos: (r.hash, r.distance) for r in retrieve.resolve_references(asked, known).collect()}
    assert got[0] == ("0123456789abcdee", 0) and got[3] == ("0123456789abcdef", 2) and 2 not in got
    numbers = retrieve.number_references(spark.createDataFrame([("a", 0, "r"), ("a", 1, "s"), ("a", 2, "r")], "answer string, pos int, ref string"))
    assert [(r.pos, r.number) for r in numbers.orderBy("pos").collect()] == [(0, 1), (1, 2), (2, 1)]


def test_render():
    text = retrieve.render_answer("Q", [("one", ["b", "a", "b"]), ("two", [])], "C", ["F"])
    assert "- one **[1]** **[2]**\n- two" in text and "### References\n\n- **[1]** b\n- **[2]** a" in text
    assert retrieve.render_answer("Q", [], "C", [], rejected=True) == "" and "### References" not in retrieve.render_answer("Q", [("x", [])], "C", [])


def test_points(spark):
    rows = [(i, "/f", i, 4, f"# file://x\nt{i}", v, None) for i, v in ((0, "v10.9.9"), (1, "v11.0.0"), (3, None))] + [(9, "/g", 0, 1, None, "x", None)]
    p = spark.createDataFrame(rows, "point_id long, file_path string, chunk_index int, chunks_total int, chunk_text string, version string, hit string")
    hits = p.where("point_id = 1").select(p["point_id"].alias("hit"), "file_path", "chunk_index", "chunks_total")
    assert sorted((r.chunk_index, r.distance) for r in points.neighbours(hits, p, 1).collect()) == [(0, -1), (1, 0)]
    assert [r.chunk_index for r in points.missing_neighbours(hits, p, 1).collect()] == [2]
    text = {r.point_id: r.chunk_text for r in points.strip_file_header(p).collect()}
    assert text == {0: "t0", 1: "# file://x\nt1", 3: "t3", 9: None}
    assert {r.file_path for r in points.rename_prefix(p, "/f", "/new").collect()} == {"/new", "/g"}
    assert {r.file_path for r in points.replace_files(p, p.where("file_path = '/g'")).collect()} == {"/f", "/g"}


def test_vision(spark):
    schema = "vision_id long, asked_at timestamp, is_rejected boolean, answer string, entities array<struct<name string, description string>>, relations array<struct<subject string, predicate string, object string>>"
    rows = [
        (1, None, False, "x", [("Cat", "old"), ("Cat", "small animal"), ("Mat", "rug"), ("Sun", "Star")], [("Cat", "on", "Mat"), ("Mat", "left_of", "Cat"), ("Cat", "sees", "Ghost")]),
        (2, None, False, "", [], None), (3, None, True, None, None, None), (4, None, False, "y", [("Dogs", "d")], [("Dogs", "chases", "Dogs")]),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.vision_id: r.sentence for r in vision.sentences(vision.latest(df)).collect()}
    assert got == {
        1: "The cat (small animal) is on the mat (rug), and the Mat is positioned to the left of the Cat, and the Sun (Star).",
        2: vision.NOTHING, 4: "The dogs (d) chase the dogs (d).",
    }


def test_watch_and_cache(spark):
    paths = spark.createDataFrame([(x,) for x in ("/a/b.txt", "/a/.h.txt", "/a/c/d.txt", "/a/c/.x/e.txt", "/a/b.md", "/a/b.txt")], "file_path string")
    assert sorted(r.file_path for r in watch.selected(paths, ["/a/**/*.txt"], []).collect()) == ["/a/b.txt", "/a/c/d.txt"]
    assert [r.file_path for r in watch.selected(paths, ["/a/**", "/a/*.txt"], ["/a/c/*", "/a/*.md"]).collect()] == ["/a/b.txt"]
    assert watch.selected(paths, [], []).count() == 0
    with pytest.raises(ValueError):
        watch.selected(paths, ["/a"], ["/a"])
    with pytest.raises(ValueError):
        watch.glob_regex("a/*")
    r = spark.createDataFrame([(1, "k", "embed", 5, "2024-01-01"), (1, "k", "embed", 5, "2024-01-01"), (2, "k", "embed", 0, "2024-01-02"), (3, None, "chunk", None, None)], "result_id long, cache_key string, op string, total_tokens long, created_at string")
    assert {x.op: (x.results, x.tokens, x.cached) for x in usage.token_usage(r).collect()} == {"embed": (2, 5, 1), "chunk": (1, 0, 0)}
    assert [(x.first_id, x.uses) for x in usage.cache_entries(r).collect()] == [(1, 2)]
    assert [x.hit for x in usage.with_cache(r, r.where("result_id = 1"), bypass=True).collect()] == [False] * 4
