import pytest

from lorekeep.llm.conversations import conversations, topological_order

SCHEMA = "session_id string, line_no int, entry_id long, uuid string, type string, role string, content string, msg_timestamp string, turn int"


def at(minute):
    return f"2024-01-01T00:{minute:02d}:00Z"


def session(name, lines):
    return [(name, n + 1, hash((name, n)) % 10**9, u, t, r, c, s, 9) for n, (u, t, r, c, s) in enumerate(lines)]


USER, REPLY = ("user", None), (None, "assistant")


@pytest.fixture(scope="module")
def data(spark):
    ok = [("u1", *USER, "hi", at(1)), ("a1", *REPLY, "yo", "NaN"), (None, "summary", "user", "no message", None), ("u2", *USER, "more", at(3)), ("u2", *USER, "sent again", at(4)), (None, *REPLY, " x ", at(5)), (None, *REPLY, "x", at(5)), ("b", *REPLY, " \n", at(6))]
    rows = session("ok", ok)
    rows += session("late", [("a", *REPLY, "second", at(9)), ("u", *USER, "first", at(2))])
    rows += session("tie", [("u", *USER, "q", at(1)), ("a", *REPLY, "r", at(1))])
    rows += session("untimed", [("u", *USER, "q", None), ("a", *REPLY, "r", "unknown")])
    rows += session("lone", [("u", *USER, "q", at(1))]) + session("empty", [("u", *USER, "", at(1)), ("a", *REPLY, None, at(2))])
    rows += session("twice", [("u", *USER, "q", at(1)), ("v", *USER, "q2", at(2)), ("a", *REPLY, "r", at(3))])
    rows += session("begins", [("a", *REPLY, "r", at(1)), ("u", *USER, "q", at(2)), ("b", *REPLY, "s", at(3))])
    rows += session("ends", [("u", *USER, "q", at(1)), ("a", *REPLY, "r", at(2)), ("v", *USER, "q", at(3))])
    rows += session("cut", [("u", *USER, "q", at(1)), ("a", *REPLY, '[{"type":"text","te', at(2)), ("b", *REPLY, "r", at(3))])
    rows += session("blocks", [("u", *USER, '[{"type":"text","text":"a"},{"type":"tool_use"},{"type":"text","text":"b"}]', at(1)), ("a", *REPLY, "r" * 100_000, at(2))])
    gap = session("gap", [("u", *USER, "q", at(1)), ("a", *REPLY, "r", at(2)), ("b", *REPLY, "r2", at(3))])
    rows += [gap[0], gap[2]] + [(None, *gap[0][1:]), ("nul", None, 5, "u", *gap[0][4:])]
    rows += session("long", [(f"{k}", *(REPLY if k % 2 else USER), f"m{k}", f"2024-01-02T{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}Z") for k in range(9000)])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_sessions(data):
    got = conversations(data, with_text=True).orderBy("session_id", "turn").collect()
    by = {}
    for r in got:
        by.setdefault(r["session_id"], []).append((r["turn"], r["speaker"], r["text"]))
    assert set(by) == {"ok", "late", "tie", "untimed", "blocks", "long"}
    assert by["ok"] == [(1, "user", "hi"), (2, "assistant", "yo"), (3, "user", "more"), (4, "assistant", "x")]
    assert [t for _, _, t in by["late"]] == ["first", "second"] and [t for _, _, t in by["tie"]] == ["q", "r"] and [t for _, _, t in by["untimed"]] == ["q", "r"]
    assert by["blocks"][0][2] == "a\nb"
    assert [(n, t) for n, _, t in by["long"]] == [(k + 1, f"m{k}") for k in range(9000)]


def test_empty(data):
    assert conversations(data.where("false")).count() == 0


def test_kahn():
    keys = [(n,) for n in range(6)]
    assert topological_order([-1, 0, -1, 2, -1, 1], keys) == ([0, 1, 2, 3, 4, 5], [])
    assert topological_order([3, 0, -1, 1], [(5,), (1,), (9,), (0,)]) == ([2], [0, 1, 3])
    assert topological_order([-1, 2, -1], [(3,), (0,), (2,)]) == ([2, 1, 0], [])


def test_given_replies(spark):
    """Answers come after what they answer even where their times say otherwise, in Kahn's order, and a cycle drops its session."""
    schema = "session_id string, line_no int, entry_id long, uuid string, type string, role string, content string, msg_timestamp string, answers string"
    ring = [("u", "user", 1, "b"), ("a", "assistant", 2, "u"), ("v", "user", 3, None), ("b", "assistant", 4, "a")]
    late = [("u", "user", 5, None), ("a", "assistant", 1, "u"), ("v", "user", 6, "a"), ("b", "assistant", 2, "v"), ("c", "assistant", 3, "b")]
    long = [(f"m{k}", "assistant" if k % 2 else "user", 50 - k, f"m{k - 1}" if k else "gone") for k in range(50)]
    rows = [(n, k + 1, h * 100 + k, u, t, None, u, at(m), p) for h, (n, r) in enumerate({"ring": ring, "late": late, "long": long}.items()) for k, (u, t, m, p) in enumerate(r)]
    got = conversations(spark.createDataFrame(rows, schema).repartition(3), with_text=True, parent_col="answers").orderBy("session_id", "turn").collect()
    by = {}
    for r in got:
        by.setdefault(r["session_id"], []).append(r["text"])
    assert by == {"late": ["u", "a", "v", "b", "c"], "long": [f"m{k}" for k in range(50)]}


def test_kahn_by_blockers_is_kahn(spark):
    import random

    rnd = random.Random(2)
    schema = "session_id string, line_no int, entry_id long, uuid string, type string, role string, content string, msg_timestamp string, answers string"
    rows, want = [], {}
    for s in range(12):
        n = 60
        # the first is the user's and the earliest, and all others answer in the end what it says
        minutes = [0] + rnd.sample(range(1, 60), n - 1)
        parents = [-1] + [rnd.randrange(k) for k in range(1, n)]
        rows += [(f"s{s}", k + 1, s * 1000 + k, f"u{k}", "assistant" if k else "user", None, f"t{k}", at(minutes[k]), f"u{parents[k]}") for k in range(n)]
        want[f"s{s}"] = [f"t{k}" for k in topological_order(parents, [(m, k) for k, m in enumerate(minutes)])[0]]
    got = {}
    for r in conversations(spark.createDataFrame(rows, schema).repartition(4), with_text=True, parent_col="answers").orderBy("session_id", "turn").collect():
        got.setdefault(r["session_id"], []).append(r["text"])
    assert got == want
