"""Problem 3: conversations from the lines of session logs.

A session's messages form a reply graph. Kahn's algorithm puts it into order, taking of the messages that are ready the
earliest by time, then line; messages that it leaves over lie on a cycle, or behind one, and break their session. The session is
complete if it begins with a user's message, every user's message is answered before the next, and no line is lost or cut off.

Kahn's order is found without bringing a session together, as a session may hold a third of all lines. A message must wait for
the latest, by time and line, of those that it answers directly or indirectly: its *blocker*. Blockers are found by doubling, each round
following twice as many replies, so rounds grow with the logarithm of the longest way; who still has a way to go after as many rounds as
the largest session allows lies on a cycle or behind one. Sorted by blocker, messages that wait for nothing are in Kahn's order already; those
with one blocker come right after it, and among them the algorithm runs as it stands. Messages are sorted by range over all
sessions, and each stretch of a session that lies in one partition is numbered on its own, with the number of messages in the
stretches before it added later. Times are filled in blocks of ``BLOCK`` lines.

Where the log names no replies, an assistant's message answers the user's message before it; no message then waits for a later one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.jsonl import SPEAKERS, is_array, micros, text, valid_json
from lorekeep.session import written

BLOCK = 4096


def topological_order(parents: list[int], keys: list[tuple]) -> tuple[list[int], list[int]]:
    """(order, left over) of nodes where ``parents[i]`` (-1: none) must precede i; of those ready, the smallest key comes first. Nodes left over lie on a cycle or behind one."""
    children: dict[int, list[int]] = {}
    ready = []
    for i, p in enumerate(parents):
        if p < 0:
            ready.append((keys[i], i))
        else:
            children.setdefault(p, []).append(i)
    heapq.heapify(ready)
    order = []
    while ready:
        _, i = heapq.heappop(ready)
        order.append(i)
        for c in children.get(i, ()):
            heapq.heappush(ready, (keys[c], c))
    seen = set(order)
    return order, [i for i in range(len(parents)) if i not in seen]


def _lines(df: DataFrame, parent_col: str | None) -> DataFrame:
    speaker = F.coalesce("type", "role")
    spoken = speaker.isin(SPEAKERS)
    content = F.col("content")
    parent = F.col(parent_col).cast("string") if parent_col else F.lit(None).cast("string")
    return df.where(F.col("session_id").isNotNull()).select(
        "session_id", "line_no", "entry_id", "uuid", parent.alias("parent"), F.when(spoken, speaker).alias("speaker"), micros(F.col("msg_timestamp")).alias("time"),
        F.coalesce(spoken & is_array(content) & ~valid_json(content), F.lit(False)).alias("cut_off"), F.when(spoken, text(content)).alias("text"),
    )


def _filled(lines: DataFrame) -> DataFrame:
    """Lines with ``at``: their time, or that of the nearest earlier line that has one; found within blocks, then across them."""
    block = F.floor(F.col("line_no") / BLOCK)
    rows = lines.withColumn("block", block)
    before = W.partitionBy("session_id", "block").orderBy("line_no", "entry_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.last("time", ignorenulls=True).over(before))
    last = lines.where(F.col("time").isNotNull()).groupBy("session_id", block.alias("block")).agg(F.max(F.struct("line_no", "entry_id", "time")).alias("last"))
    every = lines.groupBy("session_id", block.alias("block")).agg(F.count(F.lit(1)).alias("n")).join(last, ["session_id", "block"], "left")
    earlier = W.partitionBy("session_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    every = every.select("session_id", "block", F.last(F.col("last.time"), ignorenulls=True).over(earlier).alias("carried"))
    return rows.join(every, ["session_id", "block"], "left").withColumn("at", F.coalesce("at", "carried")).drop("block", "carried")


#: A message's place by time and line, and its blocker's.
KEY, BLOCKER = ["at", "line_no", "entry_id"], ["b_at", "b_line", "b_entry"]


def _blockers(messages: DataFrame) -> DataFrame:
    """Messages with the place of their blocker and the entry that they answer, without sessions that have a cycle. Replies to what is no message of the session count for nothing."""
    named = messages.where("uuid IS NOT NULL").groupBy("session_id", "uuid").agg(F.min(F.struct(*KEY)).alias("k")).select("session_id", F.col("uuid").alias("parent"), F.col("k.entry_id").alias("up"))
    linked = written(messages.join(named, ["session_id", "parent"], "left"))
    state = linked.select("session_id", F.col("entry_id").alias("node"), "up", F.struct(*KEY).alias("top"))
    most = linked.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        further = state.select("session_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("top").alias("above"))
        step = state.where("up IS NOT NULL").join(further, ["session_id", "up"])
        step = step.select("session_id", "node", F.col("next").alias("up"), F.greatest("top", "above").alias("top"))
        state = written(state.where("up IS NULL").unionByName(step))
        if not state.where("up IS NOT NULL").limit(1).count():
            break
    cyclic = state.where("up IS NOT NULL").select("session_id").distinct()
    tops = state.select("session_id", F.col("node").alias("entry_id"), *[F.col(f"top.{k}").alias(b) for k, b in zip(KEY, BLOCKER)])
    return linked.join(cyclic, "session_id", "left_anti").join(tops, ["session_id", "entry_id"]).withColumnRenamed("up", "answers")


def _kahn(rows: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
    """Rows with each group of one blocker (``new`` marks their first rows) in Kahn's order."""
    begin = np.append(np.flatnonzero(new), len(rows))
    order = np.arange(len(rows))
    for i in np.flatnonzero(np.diff(begin) > 1).tolist():
        a, b = int(begin[i]), int(begin[i + 1])
        part = rows.iloc[a:b]
        at = {e: k for k, e in enumerate(part["entry_id"].tolist())}
        parents = [at.get(p, -1) for p in part["answers"].tolist()]
        order[a:b] = a + np.array(topological_order(parents, list(zip(*[part[k].tolist() for k in KEY])))[0])
    return rows.iloc[order]


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Orders the stretch of each session in this partition; ``place`` counts from 1 within it, ``twice`` marks a user's message right after another."""
    part = TaskContext.get().partitionId()
    session, count, user, held = None, 0, False, None
    for pdf in chain(batches, [None]):
        rows = held if pdf is None else pd.concat([held, pdf]) if held is not None else pdf
        if rows is None or not len(rows):
            continue
        group = rows[["session_id", *BLOCKER]]
        new = (group != group.shift()).any(axis=1).to_numpy()
        # the last group may go on in the next batch
        stop = len(rows) if pdf is None else int(np.flatnonzero(new)[-1])
        rows, new, held = rows.iloc[:stop], new[:stop], rows.iloc[stop:]
        if not stop:
            continue
        rows = _kahn(rows, new)
        name = rows["session_id"].to_numpy()
        index = np.arange(stop)
        begins = np.append(name[0] != session, name[1:] != name[:-1])
        since = np.maximum.accumulate(np.where(begins, index, -1))
        place = np.where(since < 0, count + index + 1, index - since + 1)
        is_user = (rows["speaker"] == "user").to_numpy()
        before = np.append(user, is_user[:-1]) & ~begins
        session, count, user = name[-1], int(place[-1]), bool(is_user[-1])
        yield pd.DataFrame({"session_id": name, "at": rows["at"].to_numpy(), "entry_id": rows["entry_id"].to_numpy(), "speaker": rows["speaker"].to_numpy(), "part": np.int32(part), "place": place, "twice": is_user & before})


def conversations(df: DataFrame, with_text: bool = False, parent_col: str | None = None) -> DataFrame:
    """(session_id, turn, entry_id, speaker, at_us) and perhaps ``text``: the messages of every complete session, in order.

    Rules (``at_us`` is in microseconds): a line's speaker is ``type``, or ``role`` where that is null; only ``user`` and
    ``assistant`` lines with text are messages; a line without a time takes that of the nearest earlier line that has one
    (null, and first, if there is none); of messages that share a uuid, or without one share speaker, text and time, the
    one of smallest line number stays. A session is dropped if its line numbers are not exactly 1 to n (null or repeated
    ones included), if a user's or assistant's array is not valid JSON, if it has fewer than two messages, if it begins
    with the assistant or ends with the user, or if two user messages follow each other. Lines without a session are
    dropped. Of columns that aren't named here none is read.

    ``parent_col`` names a column with the uuid of the line that a line answers. Then no message comes before what it answers, and a
    session with a cycle of answers is dropped; a uuid that no message of the session has counts as none.
    """
    lines = written(_filled(_lines(df, parent_col)))
    whole = lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("line_no").alias("numbered"), F.min("line_no").alias("low"), F.max("line_no").alias("high"), F.max("cut_off").alias("cut_off")
    )
    distinct = lines.groupBy("session_id", "line_no").agg(F.count(F.lit(1)).alias("k")).groupBy("session_id").agg(F.max("k").alias("most"))
    good = whole.join(distinct, "session_id").where("numbered = n AND low = 1 AND high = n AND most = 1 AND NOT cut_off").select("session_id")
    said = lines.where("speaker IS NOT NULL AND text <> ''")
    same = F.when(F.col("uuid").isNull(), F.struct("speaker", F.sha2("text", 256).alias("hash"), "at"))
    first = F.min(F.struct("line_no", "entry_id", "at", "speaker", "parent")).alias("m")
    messages = said.groupBy("session_id", "uuid", same.alias("same")).agg(first).select("session_id", "uuid", "m.parent", "m.at", "m.line_no", "m.entry_id", "m.speaker")
    messages = messages.withColumn("at", F.coalesce("at", F.lit(-(2**62)))).withColumn("line_no", F.coalesce("line_no", F.lit(0))).withColumn("entry_id", F.coalesce("entry_id", F.lit(0).cast("bigint")))
    if parent_col:
        messages = _blockers(messages)
    else:
        messages = messages.select("*", F.lit(-1).cast("bigint").alias("answers"), *[F.col(k).alias(b) for k, b in zip(KEY, BLOCKER)])
    messages = messages.select("session_id", *BLOCKER, *KEY, "speaker", "answers").repartitionByRange("session_id", *BLOCKER).sortWithinPartitions("session_id", *BLOCKER, *KEY)
    numbered = written(messages.mapInPandas(_number, "session_id string, at bigint, entry_id bigint, speaker string, part int, place bigint, twice boolean"))
    stretches = numbered.groupBy("session_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"),
        F.min_by("speaker", "place").alias("first"), F.max_by("speaker", "place").alias("last"),
    )
    by_part = W.partitionBy("session_id").orderBy("part")
    stretches = stretches.withColumns({
        "offset": F.coalesce(F.sum("n").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "broken": F.col("twice")
        | F.when(F.lag("last").over(by_part).isNull(), F.col("first") != "user").otherwise((F.lag("last").over(by_part) == "user") & (F.col("first") == "user"))
        | (F.lead("first").over(by_part).isNull() & (F.col("last") != "assistant")),
    })
    session = W.partitionBy("session_id")
    stretches = stretches.withColumns({"broken": F.max("broken").over(session), "total": F.sum("n").over(session)}).where("NOT broken AND total >= 2")
    kept = stretches.join(good, "session_id", "left_semi").select("session_id", "part", "offset")
    out = numbered.join(kept, ["session_id", "part"]).select(
        "session_id", (F.col("offset") + F.col("place")).cast("int").alias("turn"), "entry_id", "speaker", F.when(F.col("at") > -(2**62), F.col("at")).alias("at_us")
    )
    return out.join(lines.select("entry_id", "text"), "entry_id").select("session_id", "turn", "entry_id", "speaker", "at_us", "text") if with_text else out
