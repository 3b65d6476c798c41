import random
import re

import pytest

from foliomill.llm import near_dup


def sets_of(text, width):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, t):
    out = set()
    for a, x in rows:
        for b, y in rows:
            if a is not None and b is not None and a < b:
                s, q = sets_of(x, width), sets_of(y, width)
                if s and q and len(s & q) / len(s | q) >= t - 1e-12:
                    out.add((a, b))
    return out


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "one two"), (None, rows[0][1]), rows[3], (rows[3][0], rows[9][1]), (503, "W1, w2; w3"), (504, "w1 w2 w3")]


@pytest.mark.parametrize("width, t", [(3, 0.7), (5, 0.8), (1, 0.5)])
def test_against_brute_force(spark, width, t):
    rows = corpus(width)
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "id long, text string, sig int, token string").repartition(3)
    got = {tuple(r) for r in near_dup.similar_points(df, width, t).collect()}
    assert got == brute(rows, width, t) and got


def test_hot_shingles_take_the_grid(spark):
    rows = corpus(9, 90)
    df = spark.createDataFrame(rows, "id long, text string")
    s = near_dup.Similar(df, 3, 0.7, hot_rows=3)
    assert {tuple(r) for r in s.point_pairs().collect()} == brute(rows, 3, 0.7)


def test_groups_are_components(spark):
    rows = corpus(4, 80)
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = brute(rows, 3, 0.7)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    # one id stands in two classes here, so only ids with one text are compared
    twice = {i for i, _ in rows if i is not None and len({t for j, t in rows if j == i}) > 1}
    got = {r.id: r.group_id for r in near_dup.Similar(df, 3, 0.7).groups().collect()}
    if not twice & {x for p in pairs for x in p}:
        assert all(got[i] == find(i) for i in got)
    assert set(got) == {i for i, t in rows if i is not None and sets_of(t, 3)}


def test_connect_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    label = {r.sig: r.label for r in near_dup.connect(chain).collect()}
    assert {label.get(i, 0) for i in range(1, 41)} == {0} and label[101] == 100
    assert near_dup.connect(chain.limit(0)).count() == 0


def test_empty_table_and_long_text(spark):
    empty = near_dup.Similar(spark.createDataFrame([], "id long, text string"))
    assert empty.point_pairs().count() == 0 and empty.groups().count() == 0
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    got = near_dup.similar_points(spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text of five words")], "id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 2)]


def test_worn_out_counters_and_tiny_groups_change_nothing(spark):
    rows = corpus(12, 200)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    # every counter is shared by many tokens, so word frequencies order them
    assert near_dup.frequency_sketch(df.where("text is not null").select("id", "text"), 3, bits=8).noise > 9
    for width, t, words in ((3, 0.7, 1000), (5, 0.8, 5)):
        s = near_dup.Similar(df, width, t, bits=8, words=words, group_classes=3, group_tokens=90)
        assert {tuple(r) for r in s.point_pairs().collect()} == brute(rows, width, t)


def test_class_with_many_copies_is_dealt(spark):
    rows = [(i, "one two three four five six seven eight nine ten") for i in range(60)] + [(100 + i, "one two three four five six seven eight nine ten eleven") for i in range(40)]
    s = near_dup.Similar(spark.createDataFrame(rows, "id long, text string"), 3, 0.7, hot_rows=7)
    assert {tuple(r) for r in s.point_pairs().collect()} == brute(rows, 3, 0.7)
    assert {(r.group_id, r.copies, r.links) for r in s.groups().collect()} == {(0, 60, 1), (0, 40, 1)}


def test_connect_hub_and_too_few_rounds(spark):
    star = spark.createDataFrame([(i, 1000) for i in range(50)] + [(1000, 2000), (2000, 2001)], "a long, b long")
    assert {r.label for r in near_dup.connect(star, hot_rows=6).collect()} == {0}
    with pytest.raises(RuntimeError):
        near_dup.connect(spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long"), rounds=1)


def recorded(monkeypatch):
    """The rows of each materialized step."""
    real, rows = near_dup.materialize, {}

    def count(df, name="step"):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near_dup, "materialize", count)
    return rows


def test_texts_that_only_share_a_token_do_not_meet(spark, monkeypatch):
    # 64 worn-out counters order nothing, so a phrase of four texts leads as often as any other; sizes and places allow all its pairs
    rows = [(i, " ".join([f"phrase{i % 100} of files"] + [f"w{i}x{j}" for j in range(37)])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 50, 5)]
    steps = recorded(monkeypatch)
    s = near_dup.Similar(spark.createDataFrame(rows, "id long, text string"), 3, 0.7, bits=6, words=1)
    assert {tuple(r) for r in s.point_pairs().collect()} == {(i, 1000 + i) for i in range(0, 50, 5)}
    assert 0 < steps["met"] <= 15 and steps["candidates"] <= 15  # 75 before bitmaps decided about meetings


def test_steps_that_are_read_no_more_are_removed(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from foliomill.session import shared_dir

    kept = lambda: {p.name.split("-")[1] for p in Path(urlparse(shared_dir(spark)).path).glob("foliomill-*") if p not in before}
    before = set(Path(urlparse(shared_dir(spark)).path).glob("foliomill-*"))
    s = near_dup.Similar(spark.createDataFrame(corpus(2, 60), "id long, text string"), 3, 0.7)
    assert not kept() & {"counts", "heads", "groups", "met", "opened", "candidates", "sets"} and {"members", "similar"} <= kept()
    assert s.point_pairs().count() and s.groups().count()
