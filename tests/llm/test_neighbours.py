"""The neighbour lists of the query against brute force."""

import numpy as np
from conftest import SMALL

from lorekeep.llm.neighbours import most_similar
from lorekeep.llm.queries import p2_neighbours


def test_asked_rows_have_the_neighbours_that_all_have(spark):
    e = spark.read.parquet(f"{SMALL}/episodes.parquet")
    every = {tuple(r) for r in most_similar(e, "id", "embedding", 128, 5, -1.0, 320).collect()}
    got = {tuple(r) for r in p2_neighbours(spark, SMALL).where("table_name = 'episodes'").drop("table_name").collect()}
    assert got and got < every and len(got) == 5 * len({g[0] for g in got})


def test_every_row_has_its_five_neighbours(spark):
    got = {}
    for r in most_similar(spark.read.parquet(f"{SMALL}/episodes.parquet"), "id", "embedding", 128, 5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["cosine"])
    rows = {r["id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{SMALL}/episodes.parquet").collect() if r["id"] and r["embedding"] and len(r["embedding"]) == 128 and any(r["embedding"])}
    ids = sorted(rows)
    x = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    assert sorted(got) == ids and all(len(w) == 5 for w in got.values())
    want = -np.sort(-sims, axis=1)[:, :5]
    assert np.isclose(np.array([got[i] for i in ids]), want, atol=1e-6).mean() >= 0.9
