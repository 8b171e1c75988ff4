"""Similarity upserts of more candidates than one block holds."""

import numpy as np

from lorekeep.operators import upsert


def test_no_number_of_candidates_is_refused(spark):
    schema = "id string, scope string, project string, embedding array<float>"
    rng = np.random.default_rng(0)
    rows = lambda name, n: [(f"{name}{i}", "project", "p" if i % 9 else None, [float(v) for v in rng.standard_normal(4)]) for i in range(n)]
    new, old = rows("n", 20_500), rows("s", 50)
    got = {r["id"]: (r["match"], r["similarity"]) for r in upsert.best_matches(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), 4).collect()}
    assert len(got) == len(new)
    for i, _, project, v in new[::500]:
        of = [(float(np.dot(np.float32(v), np.float32(w)) / np.linalg.norm(v) / np.linalg.norm(w)), s) for s, _, p, w in old if p == project]
        best = max(of)
        assert got[i][0] == best[1] and abs(got[i][1] - best[0]) < 1e-6
