"""Links that the candidates of problem 5 must not lose, and parts that hold no more than they should."""

import numpy as np
import pandas as pd

from lorekeep.llm import clusters


def test_a_dense_group_keeps_a_record_that_only_one_member_links(monkeypatch):
    monkeypatch.setattr(clusters, "INNER", 1)
    monkeypatch.setattr(clusters, "SIZES", (1, 2, 3))
    dim, n = 64, 62
    x = np.full((n, dim), 0.001)
    x[:, 0] = 1
    x[-2, :2] = np.cos(0.6), np.sin(0.6)  # linked to all
    x[-1, :2] = np.cos(1.2), np.sin(1.2)  # linked to that one only
    x += np.random.default_rng(0).normal(0, 0.001, x.shape)
    x /= np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(x).max(1) / 127
    rank = np.arange(1000, dtype=np.int64)
    key = rank[np.argsort(rank.view(np.uint64) * clusters._MIX)][:n]  # the two are never first
    scheme = clusters.Scheme(dim)
    monkeypatch.setattr(scheme, "values", lambda tokens, band: np.ones((clusters.VALUES, len(tokens)), np.uint8))
    blob = clusters._pack([key, scale, np.round(x / scale[:, None]), np.ones(n)])
    out = clusters._meet(scheme, dim, 0.75, 0.1)(pd.DataFrame({"band": [0], "blob": [blob]}))
    assert out["sure"].sum() == n - 1


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 4000, 128))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.75 * a + np.sqrt(1 - 0.75**2) * b / np.linalg.norm(b, axis=1)[:, None]
    scheme = clusters.Scheme(128)
    x, y = scheme.tokens(a.astype(np.float32)), scheme.tokens(b.astype(np.float32))
    same = scheme.bands(x) == scheme.bands(y)
    values = [(scheme.values(x, t) == scheme.values(y, t)).T for t in range(clusters.BANDS)]
    for rows in (1000, 200_000, 2_000_000):  # the recall stays where the inner bands widen
        met = np.any([same[:, t] & values[t][:, scheme.inner(rows)].all(2).any(1) for t in range(clusters.BANDS)], axis=0)
        assert met.mean() >= 0.975
    common = np.bitwise_count(scheme.bitmaps(x) & scheme.bitmaps(y)).sum(1)
    assert (common / (2 * scheme.size - common) >= clusters.LEAST_JACCARD).mean() >= 0.999


def test_every_two_records_of_a_bucket_share_a_part_and_parts_are_bounded():
    rng = np.random.default_rng(3)
    n, limit = 5000, 300
    key, bands = rng.integers(0, 2**63, n), np.minimum(rng.geometric(0.2, (n, 3)) - 1, 19)  # the largest bucket holds a fifth
    counts = np.stack([np.bincount(bands[:, t], minlength=20) for t in range(3)])
    layout = clusters.Layout(counts, limit, limit)
    record, band, part = layout.parts_of(bands, key)
    assert part.max() + 1 == layout.parts and np.bincount(part).max() <= 2.3 * limit
    held: dict = {}
    for r, t, p in zip(record.tolist(), band.tolist(), part.tolist()):
        held.setdefault((t, r), set()).add(p)
    for t in range(3):
        some = np.flatnonzero(bands[:, t] == 0)[:60].tolist()
        assert all(held[t, a] & held[t, b] for a in some for b in some)


def test_parts_change_no_result(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 32))
    rows = [(f"r{k:04d}", [float(v) for v in centres[k % 30] + 0.4 * rng.standard_normal(32)]) for k in range(900)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    got = [sorted(map(tuple, clusters.similarity_clusters(df, "id", "v", 32, 0.75, bucket_rows=n).collect())) for n in (100_000, 50)]
    assert got[0] == got[1] and got[0]
