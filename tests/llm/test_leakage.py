import random
import re

import numpy as np
import pytest

from foliomill.llm import leakage


def brute(docs, items, least):
    out = set()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, t in items:
        w = words(t)
        grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        for d, x in docs:
            v = words(x)
            if i is not None and d is not None and any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def make(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(0, 30))) for i in range(12)] + [(90, None), (None, text(20))]
    docs = [(i, text(rnd.randint(0, 80))) for i in range(60)] + [(70, items[3][1]), (71, "X " + (items[4][1] or "")), (72, None), (73, ""), (None, items[3][1]), (70, items[3][1])]
    return docs, items


def test_against_brute_force_in_small_shards_and_blocks(spark):
    for seed, least in ((1, 6), (2, 12), (3, 1)):
        docs, items = make(seed)
        d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, item_id string")
        e = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
        got = leakage.leaked_passages(d, e, least, shard_words=150, block_words=40)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items, least)


def test_longest_passages_and_places(spark):
    d = spark.createDataFrame([(1, "a b c d e f. Then A, B c D e f g h"), (2, "z " + "q " * 50_000 + "c d e f g h")], "doc_id long, text string")
    e = spark.createDataFrame([(7, "a b c d e f g h"), (8, "zz")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_word, r.item_word, r.words) for r in leakage.leaked_passages(d, e, 5).collect())
    assert got == [(1, 7, 0, 0, 6), (1, 7, 7, 0, 8), (2, 7, 50_001, 2, 6)]
    assert [r.doc_id for r in leakage.without_leaks(d, e, 7).collect()] == [2]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    e = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert leakage.leaks(d, e).count() == 0 and leakage.leaks(some, e).count() == 0
    assert leakage.without_leaks(some, e).count() == 1


@pytest.mark.parametrize("seed", range(8))
def test_suffixes_are_in_full_order(seed):
    rnd = random.Random(seed)
    texts = [[rnd.randint(1, 2 if seed % 2 else 9) for _ in range(rnd.randint(1, 60))] for _ in range(rnd.randint(1, 30))]
    texts += texts[:4]  # whole texts repeated
    tokens = np.array([t for x in texts for t in [*x, 0]], dtype=np.int64)
    ends = np.flatnonzero(tokens == 0)
    suffix = lambda i: tokens[i : ends[np.searchsorted(ends, i)]].tolist()
    want = sorted((i for i in range(len(tokens)) if tokens[i]), key=lambda i: (suffix(i), i))
    assert leakage.suffix_array(tokens).tolist() == want
    assert leakage._unpack(leakage._pack(tokens), len(tokens)).tolist() == tokens.tolist()


def test_one_index_serves_several_test_sets(spark):
    docs, items = make(11)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = leakage.suffix_index(d, shard_words=200)
    for part in (items[:6], items[6:]):
        got = {(r.doc_id, r.item_id) for r in leakage.search_index(index, spark.createDataFrame(part, "item_id long, text string"), 6).collect()}
        assert got == brute(docs, part, 6)


def test_hits_come_in_blocks():
    tests = leakage.Tests([(1, "a b c d"), (2, "b c")], 2)
    words, _ = leakage.Hasher()(["a b c d"] * 30)
    vocabulary, at = np.unique(words, return_inverse=True)
    tokens = np.insert(at + 1, np.arange(4, 121, 4), 0)
    whole = [np.concatenate(v).tolist() for v in zip(*leakage.passages(tokens, leakage.suffix_array(tokens), vocabulary, tests))]
    parts = [np.concatenate(v).tolist() for v in zip(*leakage.passages(tokens, leakage.suffix_array(tokens), vocabulary, tests, 7))]
    assert whole == parts and len(whole[0]) == 60
