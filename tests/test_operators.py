import pytest
from pyspark.sql import functions as F

from lorekeep.functions import jsonl
from lorekeep.functions.text import evergreen, jaccard, query_terms, word_set
from lorekeep.functions.vectors import cosine
from lorekeep.operators import bm25, hierarchy, retrieval, upsert, windows
from lorekeep.streaming import sessions


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_terms(spark):
    df = spark.createDataFrame([("  The cat AND the éclair-two! ",), ("near or",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(query_terms(F.col("t"))).collect()] == [["the", "cat", "the", "clair", "two"], [], [], []]
    assert [r[0] for r in df.select(query_terms(F.col("t"), True, 2)).collect()][0] == ["cat", "clair"]
    sets = spark.createDataFrame([("a_b c", "c d"), ("", "!")], "a string, b string")
    assert [r[0] for r in sets.select(jaccard(word_set(F.col("a")), word_set(F.col("b")))).collect()] == [pytest.approx(1 / 3), 1.0]
    paths = spark.createDataFrame([("/x/MEMORY.md",), ("/x/2024-01-02.md",), ("/x/notes.md",)], "p string")
    assert [r[0] for r in paths.select(evergreen(F.col("p"))).collect()] == [True, False, True]


def test_bm25_against_the_formula(spark):
    import math

    docs = {"a": "red fox red", "b": "blue fox", "c": "green bird sings here", "d": ""}
    corpus = spark.createDataFrame([(k, v.split()) for k, v in docs.items()], "doc_id string, tokens array<string>")
    q = spark.createDataFrame([("q1", ["red", "fox", "fox"]), ("q2", []), ("q3", ["none"])], "query_id string, terms array<string>")
    mean = 9 / 4
    def part(tf, dl, df):
        return max(math.log((4 - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    got = {(r["query_id"], r["doc_id"]): r["bm25"] for r in bm25.scores(q, corpus).collect()}
    assert got == {("q1", "a"): pytest.approx(-part(2, 3, 1) - 2 * part(1, 3, 2), abs=1e-8), ("q1", "b"): pytest.approx(-2 * part(1, 2, 2), abs=1e-8)}


def test_diversity_takes_the_unlike_first(spark):
    r = spark.createDataFrame([("q", "a", 0.9, 1, "one two three"), ("q", "b", 0.89, 2, "one two three"), ("q", "c", 0.7, 3, "else"), ("p", "x", 0.1, 1, "")], "query_id string, id string, score double, rank int, text string")
    got = retrieval.diversified(r, 2).orderBy("query_id", "rank")
    assert [(x["query_id"], x["id"]) for x in got.collect()] == [("p", "x"), ("q", "a"), ("q", "c")]


def test_forest_with_cycle_and_missing_parent(spark):
    p = spark.createDataFrame([("/a", "a", None), ("/a/b", "b", "/a"), ("/a/b/c", "c", "/a/b"), ("/x", "x", "/y"), ("/y", "y", "/x"), ("/o", "o", "/gone")], "full_path string, name string, parent_project string")
    assert {(r["full_path"], r["root"]) for r in hierarchy.roots(p).collect()} >= {("/a/b/c", "/a"), ("/o", "/o")}
    assert {r["name"]: r["family"] for r in hierarchy.families(p).collect()}["a"] == ["/a", "/a/b", "/a/b/c"]
    assert {(r["full_path"], r["ancestor"]) for r in hierarchy.ancestors(p).collect()} >= {("/x", "/y"), ("/y", "/x")}
    paths = spark.createDataFrame([("/a/b/f.txt",), ("/abc/f",), (None,), ("/a",)], "path string")
    assert values(hierarchy.nearest(paths, p, "path")) == [("/a", None), ("/a/b/f.txt", "/a/b"), ("/abc/f", None)]


@pytest.mark.parametrize("paths, project", [
    (["/w/s/p/a", "/w/s/p/b"], "/w/s/p"), (["/w/s/p/a"], None), (["a", "b"], None), (["/w/s/p/a", "/w/s/p/b", "/w/s/q/c"], "/w/s/p"), (["/w/s/p/a", "/w/s/q/b"], None), ([], None),
])
def test_inference(spark, paths, project):
    p = spark.createDataFrame([("/w", "w", None), ("/w/s/p", "p", "/w"), ("/w/s/q", "q", "/w")], "full_path string, name string, parent_project string")
    df = spark.createDataFrame([("g", x) for x in paths], "g string, path string")
    got = hierarchy.inferred(df, p, "g", "path").collect()
    assert [r["project"] for r in got] == ([project] if any(x.startswith("/") for x in paths) else [])


def test_log_lines(spark):
    contents = ['[{"type":"text","text":" a"},7,{"type":"text","text":""},{"type":"text","text":"b\\n"}]', '[{"type":"text"', "  plain\t", None, '[{"a":1}] x', '[{"type":"tool_use","name":"Glob","input":{"pattern":"/w/src/**/*.ts","path":"rel"}}]']
    df = spark.createDataFrame([(c,) for c in contents], "c string")
    c = F.col("c")
    assert [r[0] for r in df.select(jsonl.text(c)).collect()] == ["a\nb", None, "plain", None, "", ""]
    assert [bool(r[0]) for r in df.select(jsonl.valid_json(c)).collect()] == [True, False, False, False, False, True]
    assert df.select(jsonl.tool_paths(c)).collect()[5][0] == ["/w/src"]
    times = spark.createDataFrame([("2024-01-01T00:00:00+01:00",), ("2024-13-45T99:00:00Z",), ("2024-01-01",), (None,)], "t string")
    assert [r[0] for r in times.select(jsonl.micros(F.col("t"))).collect()] == [1704063600000000, None, None, None]


def test_budget_votes_sections(spark):
    m = spark.createDataFrame([("s", n, 10) for n in range(5)], "g string, n int, size int")
    assert sorted(r["n"] for r in windows.within_budget(m, "g", [F.col("n").desc()], F.col("size"), 25).collect()) == [2, 3, 4]
    v = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "a", 3), ("s", "b", 4), ("s", None, 5), ("t", None, 1)], "g string, v string, o int")
    assert values(windows.majority(v, "g", "v", F.col("o"))) == [("s", "b", 2)]
    s = spark.createDataFrame([(1, 0, 5), (1, 1, 30), (1, 2, 30), (2, 0, 90), (3, 0, 1), (3, 1, 99)], "d int, section int, n_lines int")
    assert values(windows.last_sections(s, "d", 40)) == [(1, 0, 5), (1, 2, 30), (2, 0, 90), (3, 0, 1), (3, 1, 99)]


def test_changes(spark):
    store = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 8)], "k string, v int")
    assert values(upsert.replaced(store, new, "k")) == [("a", 9), ("b", 3), ("c", 8)]
    old = spark.createDataFrame([("a", "old", "keep"), ("b", "x", None)], "k string, o string, p string")
    inc = spark.createDataFrame([("a", "new", "drop"), ("c", None, "z")], "k string, o string, p string")
    assert values(upsert.merged(old, inc, "k", ["o"], ["p"])) == [("a", "new", "keep"), ("b", "x", None), ("c", None, "z")]
    assert values(windows.latest(store, "k", ["v"])) == [("a", 2), ("b", 3)]


def test_similarity_upsert(spark):
    schema = "id string, scope string, project string, embedding array<float>"
    store = spark.createDataFrame([("s2", "project", "p", [1.0, 0.0]), ("s1", "project", "p", [1.0, 0.0]), ("s3", "project", "q", [0.0, 1.0]), ("s4", "global", "any", [0.0, 1.0]), ("s5", "project", "p", None)], schema)
    new = spark.createDataFrame([("n1", "project", "p", [2.0, 0.0]), ("n2", "project", "p", [0.0, 1.0]), ("n3", "global", None, [0.0, 3.0]), ("n4", "project", "p", [0.0, 0.0]), ("n5", "project", "z", None)], schema)
    got = upsert.decided(new, upsert.best_matches(new, store, 2))
    assert values(got.select("id", "action", "target")) == [("n1", "update", "s1"), ("n2", "add", None), ("n3", "update", "s4"), ("n4", "add", None), ("n5", "add", None)]
    with pytest.raises(ValueError):
        upsert.best_matches(new, store, 2, most=1)
    both = spark.createDataFrame([("a", "b", "x" * 3999, "yz"), ("a" * 400, "b" * 400, None, "n")], "o string, n string, c string, d string")
    got = both.select(*upsert.updated(F.col("o"), F.col("n"), F.col("c"), F.col("d"))).collect()
    assert got[0][0] == "a | b" and len(got[0][1]) == 4000 and got[0][1].endswith("\n---\nyz") and got[1][0] == "b" * 400 and got[1][1] == "n"


@pytest.mark.parametrize("files", [1, 4])
def test_batches_don_t_depend_on_files(spark, tmp_path, files):
    rows = [("s", n, "user" if n % 2 else "assistant") for n in range(1, 61)] + [("t", n, "user") for n in range(1, 5)]
    for k in range(files):
        part = [r for r in rows if (r[1] - 1) * files // 60 == k]
        spark.createDataFrame(part, "session_id string, line_no int, speaker string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, line_no int, speaker string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert values(sessions.drained(sessions.extraction_batches(stream))) == [("s", 1, 1, 9, 9), ("s", 2, 10, 39, 30)]


def test_stream_replaces_by_key(spark, tmp_path):
    schema, target = "path string, text string", str(tmp_path / "out")
    for part in ([("a", "1"), ("a", "2"), ("b", "3")], [("a", "4"), ("b", None)]):
        folder = tmp_path / f"in{part[0][1]}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder))
        sessions.replaced_by_key(spark.readStream.schema(schema).parquet(str(folder)), "path", target, F.col("text").isNull())
    assert values(sessions.read_version(spark, target)) == [("a", "4")]
    assert values(spark.read.parquet(f"{target}/v=0")) == [("a", "1"), ("a", "2"), ("b", "3")]


def test_batches_by_time(spark, tmp_path):
    """A user's message after a long pause fills a batch, silence does once the watermark has passed it, and later the state goes."""
    schema = "session_id string, line_no int, speaker string, minute int"
    parts = [[("s", 1, "user", 0), ("s", 2, "assistant", 5), ("s", 3, "user", 25), ("s", 4, "assistant", 26), ("t", 1, "user", 0)], [("x", 1, "assistant", 300)], [("x", 2, "assistant", 9000)], [("s", 5, "user", 9001), ("s", 6, "user", 9030)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("at", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
    got = values(sessions.drained(sessions.timed_batches(stream)))
    # a silent session's rest (line 4; t's only message) comes by the timer; after days of silence s begins anew
    assert {("s", 1, 1, 3, 3), ("s", 2, 4, 4, 1), ("t", 1, 1, 1, 1), ("s", 1, 5, 6, 2)} <= set(got)


def test_backlog_is_worked_off_before_what_follows(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "n int").repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sessions.drained(stream, then=lambda t: seen.append(t.count()))
    assert seen == [2]


def test_candidates_of_a_batch_see_each_other(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    row = lambda k, c: (f"r{k:03d}", "project", f"p{c % 2}", [float(x) for x in centres[c] + 0.12 * rng.standard_normal(16)], k)
    schema = "id string, scope string, project string, embedding array<float>, at int"
    old, new = [row(k, k % 3) for k in range(6)], [row(100 + k, int(rng.integers(0, 6))) for k in range(60)]
    new.append(("none", "project", "p0", None, 999))
    got = {r["id"]: (r["action"], r["target"]) for r in upsert.decided_in_turn(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), 16, "at").collect()}
    unit = lambda v: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    visible, want = list(old), {}
    for i, scope, project, v, _ in new:
        sims = [] if v is None else sorted((-round(float(unit(v) @ unit(w)), 9), j) for j, s, p, w, _ in visible if (s, p) == (scope, project))
        hit = sims and -sims[0][0] > 0.92
        want[i] = ("update", sims[0][1]) if hit else ("add", None)
        if not hit and v is not None:
            visible.append((i, scope, project, v, 0))
    assert got == want and sum(a == "update" and t >= "r100" for a, t in want.values()) > 5
