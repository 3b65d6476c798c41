import random
from datetime import datetime, timedelta

from foliomill.operators import snapshots

T0 = datetime(2024, 1, 1)
SCHEMA = "profile string, snapshot_no int, taken_at timestamp, delivered_at timestamp, file_path string, size long, mtime double, diff string, _g int, _k string"


def brute(rows):
    newest = {}
    for p, n, _, at, f, size, mtime, diff, *_ in rows:
        if p is None or n is None or f is None:
            continue
        rank = (at is not None, at, size is not None, size or 0, mtime is not None, mtime or 0, diff != "removed")
        if (p, n, f) not in newest or rank > newest[(p, n, f)][0]:
            newest[(p, n, f)] = (rank, size, mtime, diff)
    numbers = {}
    for p, n, _ in newest:
        numbers.setdefault(p, set()).add(n)
    out = set()
    for p, ns in numbers.items():
        ns = sorted(ns)
        for a, b in zip(ns, ns[1:]):
            old = {f: v[1:3] for (q, n, f), v in newest.items() if q == p and n == a and v[3] != "removed"}
            new = {f: v[1:3] for (q, n, f), v in newest.items() if q == p and n == b and v[3] != "removed"}
            out |= {(p, b, f, "added") for f in new.keys() - old.keys()} | {(p, b, f, "removed") for f in old.keys() - new.keys()}
            out |= {(p, b, f, "changed") for f in new.keys() & old.keys() if new[f] != old[f]}
    return out


def test_against_brute_force_with_dirty_rows(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(1500):
        rows.append((
            rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([1, 2, 4, 5, None]), T0, rnd.choice([None, T0 + timedelta(days=rnd.randint(0, 3))]),
            rnd.choice([None] + [f"/f{i}" for i in range(40)]), rnd.choice([None, 1, 2**60, 2**60 + 1]), rnd.choice([None, 0.5, 1.5]), rnd.choice([None, "None", "added", "removed"]), 1, "x",
        ))
    rows += rows[:100]
    got = {tuple(r) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows) and got


def test_empty_single_and_gap(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert snapshots.snapshot_changes(empty).count() == 0
    row = ("a", 1, T0, T0, "/x", 1, 1.0, None, 1, "")
    assert snapshots.snapshot_changes(spark.createDataFrame([row], SCHEMA)).count() == 0
    later = ("a", 3, T0, T0, "/y", 1, 1.0, "added", 1, "")
    got = {(r.snapshot_no, r.file_path, r["diff"]) for r in snapshots.snapshot_changes(spark.createDataFrame([row, later], SCHEMA)).collect()}
    assert got == {(3, "/x", "removed"), (3, "/y", "added")}


def test_key_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("a", n, T0, T0 + timedelta(seconds=k), f"/f{i}", n, 1.0, None, 1, "") for n in (1, 2, 3) for i in range(9) for k in range(3)]
        got = snapshots.snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == 18 and {r["diff"] for r in got} == {"changed"}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_watch_diff_and_resolve(spark):
    old = spark.createDataFrame([("/a", 1, 1.0), ("/b", 1, 1.0), ("/c", None, 1.0)], "file_path string, size long, mtime double")
    new = spark.createDataFrame([("/b", 2, 1.0), ("/c", None, 1.0), ("/d", 1, 1.0)], "file_path string, size long, mtime double")
    d = snapshots.snapshot_diff(old, new)
    assert {r.file_path: r["diff"] for r in d.collect()} == {"/a": "removed", "/b": "changed", "/c": "None", "/d": "added"}
    done = snapshots.resolve_diff(d, spark.createDataFrame([("/a",), ("/b",)], "file_path string"))
    assert {r.file_path: r["diff"] for r in done.collect()} == {"/b": "None", "/c": "None", "/d": "added"}


def test_negative_numbers_and_signed_zero(spark):
    rows = [("a", n, T0, T0, f, 1, z, None, 1, "") for n, z in ((-3, 0.0), (-1, -0.0)) for f in ("/x", "/y") if (n, f) != (-1, "/y")] + [("a", -1, T0, T0, "/z", 1, 1.0, None, 1, "")]
    assert {(r.snapshot_no, r.file_path, r["diff"]) for r in snapshots.snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()} == {(-1, "/y", "removed"), (-1, "/z", "added")}
