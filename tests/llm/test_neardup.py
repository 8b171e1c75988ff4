import random

import numpy as np
import pytest
import regex

from lorekeep.llm import neardup
from lorekeep.llm.neardup import members, similar_pairs, suffix_bound

W = regex.compile(r"[\p{L}\p{N}]+")


def brute(rows, t, n, least, columns):
    def sets(text):
        w = W.findall((text or "").lower())
        return set(zip(*[w[i:] for i in range(n)])) if len(w) >= least else None

    texts = {r[0]: r for r in rows if r[0] is not None}
    ids = sorted(texts)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] for c in columns if (x := sets(texts[a][c])) and (y := sets(texts[b][c])) and len(x & y) >= t * len(x | y)}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    out = []
    for k in range(60):
        base = rnd.choices(words, k=rnd.choice([9, 10, 12, 30, 80, 200]))
        for v in range(rnd.randint(1, 4)):
            w = base[:]
            for _ in range(rnd.randint(0, max(1, len(w) // 15))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            out.append((f"e{k}_{v}", " ".join(w), ", ".join(reversed(w)) if v % 2 else None, "x", 1))
    out += [("n1", None, None, "x", 1), ("n2", "", " ", "x", 1), (None, out[0][1], None, "x", 1), out[3], out[3], ("long1", "alpha beta gamma " * 30_000, None, "x", 1), ("long2", "alpha beta gamma " * 30_001, None, "x", 1), ("rep1", "a " * 12, None, "x", 1), ("rep2", "A " * 50, None, "x", 1)]
    return out


SCHEMA = "id string, summary string, full_content string, key string, shingles int"


@pytest.mark.parametrize("num, den, shingle", [(3, 5, 3), (4, 5, 5)])
@pytest.mark.parametrize("hot", [3, 20_000])
def test_same_as_brute_force(spark, rows, num, den, shingle, hot):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in similar_pairs(df, "id", ["summary", "full_content"], num, den, shingle, 10, hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, num / den - 1e-9, shingle, 10, (1, 2))


def test_empty_and_many_copies(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert similar_pairs(df, "id", ["summary"]).count() == 0
    text = "one two three four five six seven eight nine ten eleven"
    copies = spark.createDataFrame([(f"c{n:03d}", text, None, "", 0) for n in range(120)], SCHEMA)
    got = sorted(tuple(r) for r in similar_pairs(copies, "id", ["summary"]).collect())
    assert got == [("c000", f"c{n:03d}") for n in range(1, 120)]


def test_many_copies_beside_a_near_text(spark):
    """Of a large group of copies the first stands for all in pairs with other texts; with the classes all pairs come back."""
    words = [f"w{k}" for k in range(40)]
    text, near = " ".join(words), " ".join([*words[:39], "other"])
    rows = [(f"c{n:03d}", text) for n in range(neardup.ALL_PAIRS + 20)] + [("n1", near), ("n2", near.upper())]
    df = spark.createDataFrame(rows, "id string, summary string")
    got = {tuple(r) for r in similar_pairs(df, "id", ["summary"]).collect()}
    assert got == {("c000", i) for i, t in rows[1:] if t == text} | {("c000", "n1"), ("c000", "n2"), ("n1", "n2")}
    classes = {r["id"]: r["class_id"] for r in members(df, "id", ["summary"]).collect()}
    back = {(a, b) for a, _ in rows for b, _ in rows if a < b and (classes[a] == classes[b] or (classes[a], classes[b]) in got)}
    assert back == {(a, b) for a, _ in rows for b, _ in rows if a < b}
    assert members(df.where("false"), "id", ["summary"]).count() == 0


def test_the_suffix_filter_never_exceeds_the_difference():
    rnd = random.Random(1)
    sets = [sorted(rnd.sample(range(60), rnd.randint(0, 30))) for _ in range(400)]
    x, y = sets[::2], sets[1::2]
    flat = [np.concatenate([np.array(s, np.uint64) + np.uint64(1000 * k) for k, s in enumerate(side)]) for side in (x, y)]
    ends = [np.cumsum([len(s) for s in side]) for side in (x, y)]
    starts = [e - [len(s) for s in side] for e, side in zip(ends, (x, y))]
    true = np.array([len(set(a) ^ set(b)) for a, b in zip(x, y)])
    bounds = [suffix_bound(*flat, starts[0], ends[0], starts[1], ends[1], depth) for depth in range(8)]
    assert all((b <= true).all() for b in bounds) and (bounds[7] == true).mean() > 0.9 and bounds[3].sum() > bounds[0].sum()


def test_counts_keep_their_order():
    counts = np.array([0, 1, 2, 3, 7, 300, 10**6, 2**31])
    assert (np.diff(neardup.levels_of(counts).astype(int)) > 0).all()
