"""Streams: batches of a session's messages for extraction, topic changes, counts of events by time, and tables kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.operators.upsert import replaced
from lorekeep.session import shared_dir

#: User messages that make the first batch of a session full, and those after it.
FIRST, LATER = 5, 15
#: Messages that a session holds back at most; the oldest leave first.
HELD = 100
#: Milliseconds after which a user's message makes any batch full, and after which a silent session is forgotten.
IDLE_MS, FORGOTTEN_MS = 20 * 60_000, 3 * 86_400_000
_BATCH = "session_id string, batch int, first_line int, last_line int, n_messages int"


def _sorted(pdfs: Iterator[pd.DataFrame], *cols: str) -> list[np.ndarray]:
    """The columns of a group's rows in order of line_no; only these narrow columns are held."""
    held = [[pdf[c].to_numpy() for c in ("line_no", *cols)] for pdf in pdfs]
    lines, *rest = (np.concatenate(x) for x in zip(*held)) if held else [np.zeros(0, np.int64)] * (1 + len(cols))
    order = np.argsort(lines, kind="stable")
    return [x[order] for x in (lines, *rest)]


def extraction_batches(messages: DataFrame, first: int = FIRST, later: int = LATER, held: int = HELD) -> DataFrame:
    """(session_id, batch, first_line, last_line, n_messages) of every full batch of a stream of (session_id, line_no, speaker).

    A batch is full with its ``first``-th user message, from a session's second batch on with its ``later``-th; it holds the
    messages since the batch before, at most ``held``, the newest. The state of a session is three numbers and the held line
    numbers, so it doesn't grow with the session. Within a micro-batch messages count in order of line_no; bound what a
    micro-batch brings by the source's ``maxFilesPerTrigger``.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, users, kept = state.get if state.exists else (0, 0, [])
        lines, is_user = _sorted((pdf[["line_no"]].assign(is_user=pdf["speaker"] == "user") for pdf in pdfs), "is_user")
        lines, at = np.append(np.array(kept, np.int64), lines), len(kept) + np.flatnonzero(is_user)
        # the user messages that make batches full: one for the first, then every ``later``-th
        start = (first if batch == 0 else later) - users - 1
        full = at[start::later] if start >= 0 else at[:0]
        begin = np.append(0, full[:-1] + 1) if len(full) else full
        out = [(key[0], batch + k + 1, int(lines[max(a, b - held + 1)]), int(lines[b]), int(min(held, b - a + 1))) for k, (a, b) in enumerate(zip(begin.tolist(), full.tolist()))]
        rest = int(full[-1]) + 1 if len(full) else 0
        users = int((at >= rest).sum()) + (0 if len(full) else users)
        # what is held back must leave room for the message that fills the batch
        state.update((batch + len(full), users, lines[rest:][-held:].tolist()))
        yield pd.DataFrame(out, columns=["session_id", "batch", "first_line", "last_line", "n_messages"])

    return messages.select("session_id", "line_no", "speaker").groupBy("session_id").applyInPandasWithState(step, _BATCH, "batch int, users int, lines array<int>", "append", GroupStateTimeout.NoTimeout)


def timed_batches(messages: DataFrame, late: str = "1 hour", first: int = FIRST, later: int = LATER, held: int = HELD, idle_ms: int = IDLE_MS, forgotten_ms: int = FORGOTTEN_MS) -> DataFrame:
    """Like :func:`extraction_batches` for a stream of (session_id, line_no, speaker, at), ``at`` being a timestamp, with time.

    A batch is full as well with a user's message ``idle_ms`` or more after the batch before (or after the session's first message); when the watermark,
    ``late`` behind the newest message, has passed a session's last message by ``idle_ms``, what it holds is a batch, and by
    ``forgotten_ms``, its state goes. A session that speaks again begins anew with batch 1.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, users, kept, since, seen = state.get if state.exists else (0, 0, [], -1, -1)
        kept, out, now = list(kept), [], state.getCurrentWatermarkMs()
        # a timer that is due counts before what has come, whether or not Spark has called it
        if kept and now >= seen + idle_ms:
            batch, since = batch + 1, seen
            out.append((key[0], batch, kept[0], kept[-1], len(kept)))
            users, kept = 0, []
        if state.exists and not kept and now >= seen + forgotten_ms:
            batch, users, since, seen = 0, 0, -1, -1
            if state.hasTimedOut:
                state.remove()
        if not state.hasTimedOut:
            narrow = (pdf[["line_no"]].assign(is_user=pdf["speaker"] == "user", ms=pdf["at"].astype("datetime64[ms]").astype("int64")) for pdf in pdfs)
            for line, is_user, ms in zip(*[x.tolist() for x in _sorted(narrow, "is_user", "ms")]):
                since = ms if since < 0 else since
                kept = [*kept[-(held - 1) :], line] if held > 1 else [line]
                users, seen = users + is_user, max(seen, ms)
                if is_user and (users >= (first if batch == 0 else later) or ms - since >= idle_ms):
                    batch, since = batch + 1, ms
                    out.append((key[0], batch, kept[0], line, len(kept)))
                    users, kept = 0, []
        if seen >= 0:
            state.update((batch, users, kept, since, seen))
            state.setTimeoutTimestamp(max(seen + (idle_ms if kept else forgotten_ms), now + 1))
        yield pd.DataFrame(out, columns=["session_id", "batch", "first_line", "last_line", "n_messages"])

    rows = messages.select("session_id", "line_no", "speaker", "at").withWatermark("at", late)
    return rows.groupBy("session_id").applyInPandasWithState(step, _BATCH, "batch int, users int, lines array<int>, since bigint, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


def same_topic(rows: DataFrame, dim: int, above: float = 0.85) -> DataFrame:
    """(session_id, id) of a stream of (session_id, id, created_at, embedding): rows whose vector has a cosine above ``above`` to the one before it in their session.

    The state of a session is one vector. Within a micro-batch rows count in order of (created_at, id); a row that is sent again counts once
    there. Vectors that are null are passed over; those of another width, or all zero, are like none.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = np.array(state.get[0]) if state.exists else None
        out = []
        for pdf in [pd.concat(list(pdfs)).drop_duplicates("id").sort_values(["created_at", "id"])]:
            for i, v in zip(pdf["id"], pdf["embedding"]):
                v = np.asarray(v, np.float64)
                if before is not None and len(v) == len(before):
                    norms = np.linalg.norm(v) * np.linalg.norm(before)
                    if norms > 0 and round(float(v @ before / norms), 9) > above:
                        out.append((key[0], i))
                before = v
        if before is not None:
            state.update((before.tolist(),))
        yield pd.DataFrame(out, columns=["session_id", "id"])

    rows = rows.where("embedding IS NOT NULL AND id IS NOT NULL AND session_id IS NOT NULL").select("session_id", "id", "created_at", "embedding")
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, id string", "vector array<double>", "append", GroupStateTimeout.NoTimeout)


def counted(events: DataFrame, at: Column, window: str, late: str, *by: str) -> DataFrame:
    """(start, ``by``..., n, total) of a stream in tumbling windows; events later than ``late`` behind the newest are dropped. ``at`` must be a timestamp with zone (a watermark takes no other)."""
    e = events.withColumn("__at", at).withWatermark("__at", late)
    return e.groupBy(F.window("__at", window), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def drained(stream: DataFrame, mode: str = "append", then: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """What a stream gives for all input that is there now, as a table in the shared folder.

    ``then`` is called once with that table when the backlog is worked off, and not before: what a live stream does for each
    change is left out while it catches up.
    """
    if mode not in ("append", "complete"):
        raise ValueError("only append and complete leave a table that holds all rows")
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{path}/out")
    if then is not None:
        then(out)
    return out


def newest_version(spark: SparkSession, target: str) -> int | None:
    """The number of the newest complete version of a table that :func:`replaced_by_key` keeps; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [f.getPath() for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max((int(p.getName().split("=")[1]) for p in done), default=None)


def read_version(spark: SparkSession, target: str) -> DataFrame:
    """The newest complete version of the table."""
    return spark.read.parquet(f"{target}/v={newest_version(spark, target)}")


def replaced_by_key(stream: DataFrame, key: str, target: str, gone: Column | None = None) -> None:
    """Run a stream of changed rows into ``target``: each micro-batch replaces all rows of its keys, and rows for which ``gone`` holds only take theirs away.

    Every micro-batch writes a version of its own, named by the batch's number, from the newest complete one before it; a version counts
    once it is complete. A crash so leaves the last version as it was, and a micro-batch that comes again gives the same version.
    """
    spark = stream.sparkSession
    log = f"{shared_dir(spark)}/replace-{uuid.uuid4().hex}"
    base = newest_version(spark, target)
    base = -1 if base is None else base

    def apply(df: DataFrame, n: int) -> None:
        new = df if gone is None else df.where(~gone)
        if base + n >= 0:
            new = replaced(spark.read.parquet(f"{target}/v={base + n}"), df, key, new)
        new.write.mode("overwrite").parquet(f"{target}/v={base + n + 1}")

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
