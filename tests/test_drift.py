import json

from foliomill.operators import drift

SCHEMA = "feed string, file_no int, line_no int, received_at timestamp, raw string, v string, field string"


def feed(spark, files, name="f"):
    rows = []
    for no, records in files.items():
        rows += [(name, no, i, None, r if isinstance(r, str) or r is None else json.dumps(r), "x", "y") for i, r in enumerate(records, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def point(i, **more):
    return {"file_path": f"/p{i}", "chunk_index": i, **more}


def report(df):
    return {(r.file_no, r.change, r.field, r.detail) for r in drift.schema_changes(df).collect()}


def test_all_kinds_of_change(spark):
    files = {
        1: [point(i, version=f"v{i}.0.0", total="7", gone=1) for i in range(10)] + ["{broken", None, "", "[1]", '"s"'],
        2: [point(i, writer=f"v{i}.0.0", total=7, extra=[1]) for i in range(10)],
        3: [point(i, writer=None, total=7.5, extra=["a"]) for i in range(10)],
        5: [point(i, writer={"major": i}, total=7.5, extra=[]) for i in range(10)],
    }
    assert report(feed(spark, files)) == {
        (2, "renamed", "version", "writer"), (2, "removed", "gone", ""), (2, "added", "extra", ""), (2, "retyped", "total", "integer"),
        (3, "retyped", "total", "number"), (3, "retyped", "extra", "array<string>"), (5, "retyped", "writer", "object"),
    }


def test_presence_needs_a_fifth_and_repeats_count_once(spark):
    files = {1: [point(i) for i in range(10)], 2: [point(i, rare=1) if i == 0 else point(i) for i in range(10)] + [json.dumps(point(0, rare=1))] * 5, 3: [point(i, rare=i) if i < 2 else point(i) for i in range(10)]}
    assert report(feed(spark, files)) == {(3, "added", "rare", "")}


def test_empty_and_single(spark):
    assert drift.schema_changes(feed(spark, {})).count() == 0
    assert drift.schema_changes(feed(spark, {1: [point(1)]})).count() == 0
    assert drift.unified_points(feed(spark, {})).count() == 0


def test_unified_values(spark):
    files = {
        1: [point(i, version="v1.2.3", file_mtime=1.5, chunks_total=4, page_range=[1, 2], line_range=None) for i in range(5)],
        2: [point(i + 2, writer="v1.2.3", file_mtime="1970-01-01T00:00:02.500000", chunks_total="4", page_range={"from": 1, "to": 2}, line_range="3-9", own=i) for i in range(5)] + [point(9, version="late")],
    }
    rows = {(r.file_no, r.line_no): r for r in drift.unified_points(feed(spark, files)).collect()}
    assert len(rows) == 11
    a, b, late = rows[(1, 1)], rows[(2, 1)], rows[(2, 6)]
    assert (a.version, a.file_mtime, a.chunks_total, a.page_range, a.line_range) == ("v1.2.3", 1.5, 4, [1, 2], None)
    assert (b.version, b.file_mtime, b.chunks_total, b.page_range, b.line_range, b.extra) == ("v1.2.3", 2.5, 4, [1, 2], [3, 9], '{"own":0}')
    assert late.version == "late" and late.chunks_total is None


def test_fingerprints_equal_for_equal_layouts(spark):
    files = {1: [point(i, a=1) for i in range(3)], 2: [point(i, a=2) for i in range(3)], 3: [point(i, a="x") for i in range(3)]}
    f = {r.file_no: r.fingerprint for r in drift.fingerprints(feed(spark, files)).collect()}
    assert f[1] == f[2] != f[3]


def test_white_space_around_objects_and_bad_ranges(spark):
    one = lambda i, **more: json.dumps(point(i, **more))
    files = {
        1: [one(0) + "\r", "\t" + one(1), "\ufeff\u00a0" + one(2), one(3)[:-1], " \n "],
        2: [one(0, page_range="12345678901-2", line_range={"from": "a", "to": "b"}), one(1, page_range={"from": "7", "to": "x"}, line_range=["5", "99999999999"])],
    }
    rows = {(r.file_no, r.line_no): (r.page_range, r.line_range) for r in drift.unified_points(feed(spark, files)).collect()}
    assert rows == {(1, 1): (None, None), (1, 2): (None, None), (1, 3): (None, None), (2, 1): ([2], None), (2, 2): ([7], [5])}
