"""What a task of problem 5 compares, group by group, and what it holds meanwhile."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from lorekeep.llm import clusters


def records(x):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    scale = np.abs(x).max(1) / 127
    return x, scale, np.round(x / scale[:, None])


@pytest.mark.parametrize("least", [0.75, 0.05, -0.2])
def test_groups_of_every_size_are_compared_whole(monkeypatch, least):
    monkeypatch.setattr(clusters, "INNER", 1)
    rng = np.random.default_rng(6)
    dim, sizes = 64, [*range(1, 34), 47, 130, 255, 256, 257, 1500]
    group = np.repeat(np.arange(len(sizes)), sizes)
    x = rng.standard_normal((len(group), dim)) * rng.uniform(0.2, 3, dim)  # coordinates of unlike size, so scales differ
    for i in range(1, len(x)):  # near another record, which may be of another group
        if rng.random() < 0.6:
            x[i] = x[i - rng.integers(1, min(i, 3) + 1)] + 0.45 * x[i]
    x, scale, small = records(x)
    key = np.sort(rng.choice(2**60, len(x), replace=False))
    scheme = clusters.Scheme(dim)
    monkeypatch.setattr(scheme, "values", lambda tokens, band: np.ones((clusters.VALUES, len(tokens)), np.uint8))
    out = clusters._meet(scheme, dim, least, 0.0)(pd.DataFrame({"band": [0], "blob": [clusters._pack([key, scale, small, group])]}))
    a, b = np.searchsorted(key, out["a"]), np.searchsorted(key, out["b"])
    sims = x @ x.T
    kept = out["sure"].to_numpy() | (sims[a, b] >= least)
    want = clusters.components(len(x), *np.nonzero((sims >= least) & (group[:, None] == group)))
    assert (clusters.components(len(x), a[kept], b[kept]) == want).all() and len(np.unique(want)) < len(x)


def test_a_task_holds_little_beside_its_records():
    rng = np.random.default_rng(7)
    n, dim = 30_000, 128
    _, scale, small = records(np.repeat(rng.standard_normal((n // 10, dim)), 10, axis=0) + 0.3 * rng.standard_normal((n, dim)))
    value = np.zeros(n)
    task = clusters._meet(clusters.Scheme(dim), dim, 0.75, clusters.LEAST_JACCARD)
    pdf = pd.DataFrame({"band": [0], "blob": [clusters._pack([np.arange(n), scale, small, value])]})
    tracemalloc.start()
    task(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 8-bit vectors (twice while they are put in order), bitmaps and values are 450 bytes a record; what is worked on at once is bounded by ROWS and FLOATS
    assert peak <= 1000 * n
