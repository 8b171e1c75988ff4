"""Files, lines of JSON, state, lookups, and windows over hot groups, on small fixtures with dirt."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import jsonl
from lorekeep.operators import retrieval, windows
from lorekeep.session import shared_dir
from lorekeep.sources import files
from lorekeep.sources.tables import looked_up


def test_directory(spark, tmp_path):
    for name, text in {"a.md": "# a\n", "sub/b.md": "b", ".hidden/c.md": "c", "sub/node_modules/d.md": "d", "blank.md": " \n\t", "e.txt": "e"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.directory(spark, str(tmp_path)).collect()
    assert sorted((r["folder"], r["path"], r["text"]) for r in got) == [("", "a.md", "# a\n"), ("sub", "sub/b.md", "b")]


def test_log_lines(spark):
    lines = ['{"entry_id": 1, "type": "user", "message": {"role": "user", "content": "hi"}}', '{"entry_id": 2, "mess', "", "  ", "[1, 2]", '{"entry_id": 3, "message": {"content": [{"type": "text", "text": "x"}]}, "extra": 1}', None]
    got = files.log_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["entry_id"], r["type"], r["role"]) for r in got] == [(1, "user", "user"), (3, None, None)]
    assert got[1]["content"].startswith("[{")


def test_state(spark):
    rows = [('{"byteOffset": 5, "rollingSummary": "s"}', None), ('{"byteOffset": "5", "messagesSinceExtraction": 3}', "{}"), ('{"byteOff', '{"byteOffset": 7}'), (None, None), ("{}", '{"byteOffset": 7}')]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in files.state(F.col("a"), F.col("b")).items()]).collect()]
    assert got == [(5, 0, 0, "s"), (0, 0, 3, ""), (7, 0, 0, ""), (0, 0, 0, ""), (0, 0, 0, "")]


def test_line_paths(spark):
    snapshot = '{"snapshot": {"trackedFileBackups": {"/w/a.py": "x", "rel/b.py": "y"}}}'
    call = '[{"type": "tool_use", "input": {"file_path": "/w/c.py"}}, {"type": "text", "text": "/work/no.py"}]'
    told = 'ran "path": "/w/d.py" and /work/e.py.'
    df = spark.createDataFrame([("file-history-snapshot", 1, snapshot), ("file-history-snapshot", 2, snapshot), ("user", 1, call), ("user", 3, told), ("user", 4, None)], "kind string, n int, content string")
    got = [r[0] for r in df.select(jsonl.line_paths(F.col("kind"), F.col("n"), F.col("content"))).collect()]
    assert got == [["/w/a.py"], [], ["/w/c.py"], ["/w/d.py", "/work/e.py"], []]


@pytest.mark.parametrize("most", [1, 1000])
def test_looked_up(spark, monkeypatch, most):
    monkeypatch.setattr("lorekeep.sources.tables.LOOKED_UP", most)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "id string, v int")
    ids = spark.createDataFrame([("b",), ("x",), ("b",), ("a",)], "id string")
    assert sorted(r["v"] for r in looked_up(df, ids).collect()) == [1, 2, 3]
    assert looked_up(df, ids.where("false")).count() == 0


def test_windows_over_blocks(spark):
    rnd = random.Random(3)
    rows = [("hot" if n % 3 else f"g{n % 7}", rnd.randrange(500), f"i{n:04d}", rnd.randrange(1, 9)) for n in range(1500)]
    df = spark.createDataFrame(rows, "g string, t int, id string, size int").repartition(5)
    got = {r["id"]: r["before"] for r in windows.with_previous(df, "g", F.floor(F.col("t") / 10), ["t", "id"], "size", "before").collect()}
    kept = {r["id"] for r in windows.within_budget(df, "g", [F.col("t").desc(), F.col("id")], F.col("size"), 40).collect()}
    want, stay = {}, set()
    for g in {r[0] for r in rows}:
        own = sorted((t, i, s) for x, t, i, s in rows if x == g)
        want |= {i: own[k - 1][2] if k else None for k, (_, i, _) in enumerate(own)}
        total = 0
        for t, i, s in sorted(own, key=lambda r: (-r[0], r[1])):
            if total >= 40:
                break
            stay.add(i)
            total += s
    assert got == want and kept == stay
    assert windows.with_previous(df.where("false"), "g", F.col("t"), ["t", "id"], "size", "before").count() == 0


def test_limits_and_shared_folder(spark):
    assert [retrieval.clamped(n) for n in (-3, 0, 7, 50, 1000)] == [1, 1, 7, 50, 50]
    assert shared_dir(spark)

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError):
        shared_dir(Cluster)
