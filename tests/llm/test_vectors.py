import numpy as np
import pytest

from lorekeep.llm.clusters import components, connected, described, similarity_clusters, split_loose
from lorekeep.llm.neighbours import estimates, most_similar

SCHEMA = "id string, v array<float>, cosine double, label int"
DIM = 32


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    rows = []
    for g in range(40):
        c = rng.standard_normal(DIM)
        for m in range(rng.integers(1, 9)):
            rows.append((f"g{g}_{m}", c + 0.15 * rng.standard_normal(DIM)))
    chain = [rng.standard_normal(DIM)]
    for _ in range(5):
        step = rng.standard_normal(DIM)
        a = chain[-1] / np.linalg.norm(chain[-1])
        step -= step @ a * a
        chain.append(0.86 * a + np.sqrt(1 - 0.86**2) * step / np.linalg.norm(step))
    rows += [(f"chain{i}", v) for i, v in enumerate(chain)]
    dense = rng.standard_normal(DIM)
    rows += [(f"d{i:03d}", dense + 0.08 * rng.standard_normal(DIM)) for i in range(300)]
    rows += [(f"copy{i}", np.ones(DIM)) for i in range(9)] + [("scaled", 7 * np.ones(DIM))]
    out = [(k, [float(x) for x in np.float32(v)], 1.0, 1) for k, v in rows]
    return out + [out[0], out[0], ("null", None, 1.0, 1), ("zero", [0.0] * DIM, 1.0, 1), ("short", [1.0] * 5, 1.0, 1), ("nan", [float("nan")] * DIM, 1.0, 1), (None, [1.0] * DIM, 1.0, 1)]


def usable(rows):
    seen = {r[0]: np.array(r[1], np.float64) for r in rows if r[0] and r[1] and len(r[1]) == DIM and np.isfinite(r[1]).all() and any(r[1])}
    ids = sorted(seen)
    x = np.stack([seen[i] / np.linalg.norm(seen[i]) for i in ids])
    return ids, x @ x.T


def test_most_similar_against_brute_force(spark, vectors):
    ids, sims = usable(vectors)
    np.fill_diagonal(sims, -2)
    want = {}
    for i, a in enumerate(ids):
        order = sorted(np.flatnonzero(np.round(sims[i], 9) >= 0.9), key=lambda j: (-np.round(sims[i, j], 9), ids[j]))[:5]
        want[a] = [round(sims[i, j], 6) for j in order]
    got = {}
    for r in most_similar(spark.createDataFrame(vectors, SCHEMA).repartition(3), "id", "v", DIM, 5, 0.9).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(round(r["cosine"], 6))
    found = sum(len(set(got.get(a, [])) & set(w)) for a, w in want.items())
    assert found >= 0.97 * sum(len(set(w)) for w in want.values())
    assert all(len(w) <= 5 for w in got.values()) and got["copy3"] == [1.0] * 5


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(1)
    d = 128
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x, q = rng.standard_normal((400, d)), rng.standard_normal((50, d))
    x, q, c = x / np.linalg.norm(x, axis=1)[:, None], q / np.linalg.norm(q, axis=1)[:, None], 0.3 * np.ones(d) / np.sqrt(d)
    r = (x - c) @ turn
    length = np.linalg.norm(r, axis=1)
    scalars = np.stack([length, np.abs(r).sum(1) / length / np.sqrt(d), x @ c], 1)
    e, bound = estimates(np.where(r > 0, 1.0, -1.0), scalars, q @ turn, q @ c, c @ turn, float(c @ c))
    off = np.abs(e - q @ x.T)
    assert (off <= bound).mean() > 0.93 and abs((e - q @ x.T).mean()) < 0.01


def test_clusters_against_brute_force(spark, vectors):
    ids, sims = usable(vectors)
    label = components(len(ids), *np.nonzero(sims >= 0.75))
    want = {(min(ids[j] for j in np.flatnonzero(label == k)), ids[i]) for k in set(label) if (label == k).sum() >= 3 for i in np.flatnonzero(label == k)}
    df = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    got = [(r["cluster_id"], r["id"]) for r in similarity_clusters(df, "id", "v", DIM, 0.75).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) ^ want) <= 0.02 * len(want)


def test_described_and_split(spark, vectors):
    ids, sims = usable(vectors)
    df = spark.createDataFrame(vectors, SCHEMA)
    clusters = similarity_clusters(df, "id", "v", DIM, 0.75).cache()
    by = {}
    for r in clusters.collect():
        by.setdefault(r["cluster_id"], []).append(ids.index(r["id"]))
    for r in described(df, clusters, "id", "v", DIM, "id").collect():
        m = by[r["cluster_id"]]
        degree = {ids[i]: round(sims[i, m].mean(), 6) for i in m}
        assert r["size"] == len(m) and r["cohesion"] == pytest.approx(np.sqrt(sims[np.ix_(m, m)].mean()), abs=1e-5)
        assert [degree[i] for i in r["typical_ids"]] == pytest.approx(sorted(degree.values(), reverse=True)[:3], abs=1e-5)
    parts = split_loose(df, clusters, "id", "v", DIM, 0.75).collect()
    chain = [r for r in parts if r["id"].startswith("chain")]
    assert len(chain) == len({r["id"] for r in chain}) == 6 and len({r["medoid"] for r in chain}) >= 2
    assert all(r["id"] == r["medoid"] or sims[ids.index(r["id"]), ids.index(r["medoid"])] >= 0.749 for r in parts)
    assert split_loose(df, clusters.where("false"), "id", "v", DIM, 0.75).count() == 0


def test_empty_and_tiny(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA)
    for some in (df.where("false"), df.where("id IN ('null', 'zero')")):
        assert most_similar(some, "id", "v", DIM, 5).count() == 0 and similarity_clusters(some, "id", "v", DIM, 0.75).count() == 0
    two = df.where("id IN ('copy1', 'copy2')")
    assert most_similar(two, "id", "v", DIM, 5).count() == 2 and similarity_clusters(two, "id", "v", DIM, 0.75, 2).count() == 2


def test_connected(spark):
    rng = np.random.default_rng(2)
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)]
    loose = [(int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2))]
    edges = path + star + loose + [(7, 7), (100, 101)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = components(400, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == {n: int(label[n]) for n in nodes}
