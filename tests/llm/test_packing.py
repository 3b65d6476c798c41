import random

import numpy as np
import pytest

from foliomill.llm import packing


def plain_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= s
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tree_is_first_fit(seed):
    rnd = random.Random(seed)
    sizes = sorted((rnd.choice([0, 1, rnd.randint(0, 50), 50]) for _ in range(rnd.randint(0, 400))), reverse=True)
    assert packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 50).tolist() == plain_first_fit(sizes, 50)


def test_pack_whole_items_once(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.choice([0, None, 3, rnd.randint(1, 300), 100, 250]), "c") for i in range(700)] + [(5, 40, "c")]
    packs = spark.createDataFrame([(1, "a", 100), (2, "b", 64), (3, "bad", 0), (None, "n", 5), (4, "none", None), (1, "a", 100)], "pack_id int, pack_name string, capacity_tokens int")
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long, grp string"), packs, group_items=200).collect()
    for pack, capacity in ((1, 100), (2, 64)):
        mine = [r for r in rows if r.pack_id == pack]
        load, seen = {}, {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            seen.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
        assert max(load.values()) <= capacity
        for i, n, _ in sizes[:700]:
            if i != 5:
                got, at = sorted(seen[i]), 0
                for k, (piece, first, size) in enumerate(got):
                    assert (piece, first) == (k, at) and (size == capacity or k == len(got) - 1)
                    at += size
                assert at == (n or 0) and (len(got) == 1 or n > capacity)
        total = sum(n or 0 for _, n, _ in sizes)
        assert sum(load.values()) == total and len(load) <= 1.12 * total / capacity + 4
    assert {r.pack_id for r in rows} == {1, 2}


def test_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (4, "word " * 30_000, 9), (None, "lost", 9), (1, "Hello world", 9)], "doc_id long, text string, size int")
    counts = sorted(tuple(r) for r in packing.token_counts(docs).collect())
    assert counts[:4] == [(1, 2), (1, 2), (2, 0), (3, 0)] and counts[4][1] >= 30_000 and len(counts) == 5
    packs = spark.createDataFrame([(1, 512)], "pack_id int, capacity_tokens int")
    p = packing.pack_documents(docs, packs)
    assert p.where("doc_id = 4").count() == -(-counts[4][1] // 512)
    assert packing.fill(p, packs).first().tokens == sum(n for _, n in counts)
    assert packing.pack_documents(docs.limit(0), packs).count() == 0 and packing.pack(packing.token_counts(docs), packs.limit(0)).count() == 0


def test_few_very_long_documents_make_many_groups(spark):
    sizes = spark.createDataFrame([(i, 5_000 * 10 + i % 10) for i in range(20)] + [(100 + i, 3) for i in range(900)], "doc_id long, n_tokens long")
    packs = spark.createDataFrame([(1, 10), (2, 10**6)], "pack_id int, capacity_tokens int")
    rows = packing.pack(sizes, packs, group_items=100)
    full = rows.where("pack_id = 1 AND n_tokens = 10")
    assert full.count() == 20 * 5_000 and full.where("container_id >= 0").count() == 0 and full.select("container_id").distinct().count() == 100_000
    rest = rows.where("pack_id = 1 AND n_tokens < 10")
    assert rest.selectExpr("container_id >> 32 AS g").distinct().count() == 10  # 918 pieces in groups of about 100
    assert rest.groupBy("container_id").sum("n_tokens").where("`sum(n_tokens)` > 10").count() == 0
    assert rows.where("pack_id = 2").count() == 920
