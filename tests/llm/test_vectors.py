import numpy as np
import pandas as pd

from foliomill.llm import vectors


def brute(rows, k, least):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a in range(0, len(x), 500):
        s = np.round(x[a : a + 500] @ x.T, 6)
        for r in range(len(s)):
            s[r, a + r] = -9
            order = np.lexsort((ids, -s[r]))[:k]
            out[ids[a + r]] = [(ids[j], s[r, j]) for j in order if s[r, j] >= least]
    return out


def clustered(n, seed, dim=96):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(2, n // 60), dim))
    x = centre[rng.integers(0, len(centre), n)] + 0.6 * rng.normal(size=(n, dim))
    return [(i, (v * rng.uniform(0.01, 100)).astype(np.float32).tolist()) for i, v in enumerate(x, 1)]


def test_recall_over_several_shards(spark):
    rows = clustered(4500, 3)
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(4)
    want = brute(rows, 5, 0.0)
    got = {}
    for r in vectors.similar_vectors(df, 5, 0.0).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    hit = sum(len({o for o, _ in want[i]} & {o for _, o in got.get(i, [])}) for i in want)
    assert hit / sum(len(v) for v in want.values()) >= 0.9
    assert all(sorted(k for k, _ in v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in got.values())


def test_split_shards_lose_nothing(spark):
    rows = clustered(1200, 5)
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    want = brute(rows, 5, 0.0)
    got = {(r.id, r.other) for r in vectors.similar_vectors(df, 5, 0.0, most_shard=300).collect()}
    true = {(i, o) for i, v in want.items() for o, _ in v}
    assert len(got & true) / len(true) >= 0.9 and len(got & true) / len(got) >= 0.9


def test_crowded_cells_are_divided_again(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 250)
    monkeypatch.setattr(vectors, "ROUTED_ROWS", 700)
    rows = clustered(6000, 13)
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(4)
    plan, divided = vectors._refined, []
    monkeypatch.setattr(vectors, "_refined", lambda *a: divided.append(plan(*a)) or divided[-1])
    got = {(r.id, r.other) for r in vectors.similar_vectors(df, 5, 0.0, most_shard=1000, most_cells=4).collect()}
    true = {(i, o) for i, v in brute(rows, 5, 0.0).items() for o, _ in v}
    assert len(got & true) / len(true) >= 0.9
    inner = [r["count"] for r in divided[0][0].where("cell >= 0").groupBy("cell").count().collect()]
    assert len(inner) >= 8 and divided[0][0].select("id").distinct().count() == 6000  # more shards than centroids, no row lost


def test_dense_topic_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 200)
    rng = np.random.default_rng(4)
    x = rng.normal(size=96) + 0.3 * rng.normal(size=(5000, 96))  # a third of the rows, mean cosine 0.92
    rest = rng.normal(size=(160, 96))[rng.integers(0, 160, 10000)] + 0.6 * rng.normal(size=(10000, 96))
    rows = pd.DataFrame({"id": range(1, 15001), "vector": list(np.concatenate([x, rest]).astype(np.float32))})
    got = {(r.id, r.other) for r in vectors.similar_vectors(spark.createDataFrame(rows).repartition(8), 5, most_shard=3000).where("id <= 5000").collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(i + 1, int(o) + 1) for i, near in enumerate(np.argpartition(-s, 5, axis=1)[:, :5]) for o in near}
    assert len(got & want) / len(want) >= 0.95


def test_one_crowded_shard_among_many_is_split(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centre = np.eye(20, 96, dtype=np.float32)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 50)
    monkeypatch.setattr(vectors, "LOST_SHARE", 1e9)  # no dense regions
    monkeypatch.setattr(vectors, "_fit", lambda sample, cells: centre)
    x = centre[np.where(rng.random(1000) < 0.6, 0, rng.integers(0, 20, 1000))] + 0.05 * rng.normal(size=(1000, 96))
    rows = pd.DataFrame({"id": range(1, 1001), "vector": list(x.astype(np.float32))})
    plan = vectors.similar_vectors(spark.createDataFrame(rows), 5, most_shard=420)._jdf.queryExecution().toString()
    assert "explode(sequence(" in plan  # dealt to parts


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=96), rng.normal(size=96)
    rows = [(i, (a * s).tolist(), "x") for i, s in zip(range(1, 31), np.linspace(0.5, 3, 30))]
    rows += [(50, (a + 0.01 * b).tolist(), ""), (51, b.tolist(), ""), (1, a.tolist(), ""), (60, None, ""), (61, [], ""), (62, [0.0] * 96, ""), (63, [1.0] * 95, ""), (64, [float("nan")] * 96, ""), (65, [None] * 96, ""), (None, b.tolist(), "")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, cell string").select("id", "vector")
    near = {}
    for r in vectors.similar_vectors(df, 5, 0.7).orderBy("id", "rank").collect():
        near.setdefault(r.id, []).append(r.other)
    assert near[1] == [2, 3, 4, 5, 6] and near[30] == [1, 2, 3, 4, 5] and near[3] == [1, 2, 4, 5, 6]
    assert near[50] == [1, 2, 3, 4, 5] and 51 not in near and not {60, 61, 62, 63, 64, 65} & set(near)
    pairs = {tuple(r) for r in vectors.similar_pairs(df, 5, 0.7).collect()}
    assert all(x < y for x, y in pairs) and (1, 30) in pairs


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "id long, vector array<float>")
    assert vectors.similar_vectors(df).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 96)], "id long, vector array<float>")
    assert vectors.similar_vectors(one).count() == 0


def test_few_probes_of_an_outlying_cell_make_no_region():
    rng = np.random.default_rng(2)
    centre = np.vstack([np.eye(96)[0] + 0.04 * rng.normal(size=(20, 96)), np.eye(96)[1]]).astype(np.float32)
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    a = np.repeat(np.arange(21), 60)
    b, lost = a.copy(), np.zeros(len(a), dtype=bool)
    b[-7:], lost[-7:] = 0, True  # 7 of the 60 pairs of the outlier
    assert (vectors._regions(centre, a, b, lost) == np.arange(21)).all()
    dense = np.flatnonzero((np.arange(len(a)) % 3 == 0) & (a < 20))
    b[dense], lost[dense] = (a[dense] + 1 + dense % 19) % 20, True  # a third of the pairs of the others
    region = vectors._regions(centre, a, b, lost)
    assert len(set(region[:20])) == 1 and region[0] < 0 and region[20] == 20


def test_beam_computes_no_cosine_twice(monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 96))[rng.integers(0, 40, 1500)] + 0.6 * rng.normal(size=(1500, 96))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph, plain, computed = vectors.Graph(x), vectors.Graph._cosines, []
    monkeypatch.setattr(vectors.Graph, "_cosines", lambda self, q, own, nodes: computed.append((own, nodes)) or plain(self, q, own, nodes))
    own = np.arange(300)
    found, sims = graph.search(x[own], own)
    pairs = [p for a, b in computed for p in zip(a.tolist(), b.tolist(), strict=True)]
    known = {(i, j) for i in own.tolist() for j in [i, *graph.near[i].tolist()]}
    assert pairs and len(set(pairs)) == len(pairs) and not known & set(pairs)  # nor those that the graph holds
    assert np.allclose(sims, (x[found] * x[own][:, None]).sum(axis=2), atol=1e-5)
    s = x[own] @ x.T
    best = np.argsort(-s, axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(best.tolist(), found[:, :6].tolist(), strict=True)]) > 0.95


def test_pairs_below_the_least_cosine_leave_no_shard():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(20, 96))[np.arange(400) % 20] + 0.6 * rng.normal(size=(400, 96))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = pd.DataFrame({"cell": 1, "id": range(400), "vec": [v.tobytes() for v in x], "member": True, "asks": np.arange(400) < 300})
    whole, above = vectors._shard(rows, 5), vectors._shard(rows, 5, 0.75)
    assert 0 < len(above) < len(whole) and above["cosine"].min() >= 0.75 - 1e-6
    want = whole[whole["cosine"] >= 0.75 - 1e-6].reset_index(drop=True)
    assert above.equals(want)
