"""Files: directories of Markdown, session logs as lines of JSON, and state kept as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import shared_dir

#: Directories that are passed over, besides those whose names begin with a dot.
SKIPPED = ["node_modules"]
_LINE = "entry_id bigint, session_id string, line_no int, uuid string, type string, message struct<role: string, content: string>, timestamp string, cwd string, corrupt string"
_STATE = "byteOffset bigint, lastExtractedAt bigint, messagesSinceExtraction int, rollingSummary string, corrupt string"


def directory(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(folder, path, text) of every file under ``root`` whose name matches, without hidden and skipped directories; blank files are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    below = F.substring_index(F.col("_metadata.file_path"), root.rsplit(":", 1)[-1].rstrip("/") + "/", -1)
    out = files.select(below.alias("path"), F.col("value").alias("text"))
    passed = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(SKIPPED))
    return out.where(~passed & F.col("text").rlike(r"\S")).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), "path", "text")


def written_files(df: DataFrame, text_col: str, folder_of: dict[str, Column]) -> str:
    """The root of a new tree in the shared folder that has each row's text as a file of its own, in the first folder whose condition holds."""
    root = f"{shared_dir(df.sparkSession)}/files-{uuid.uuid4().hex}"
    for folder, holds in folder_of.items():
        df.where(holds).select(F.col(text_col)).write.option("maxRecordsPerFile", 1).mode("append").text(f"{root}/{folder}")
    return root


def written_lines(df: DataFrame, line: Column) -> str:
    """The root of a new folder of text files with a line for each row."""
    root = f"{shared_dir(df.sparkSession)}/lines-{uuid.uuid4().hex}"
    df.select(line.alias("value")).write.text(root)
    return root


def log_lines(lines: DataFrame) -> DataFrame:
    """The entries of a batch or stream of lines (``value``) of a session log; lines that are no JSON object are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    e = lines.where(F.col("value").rlike(r"\S")).select(F.from_json("value", _LINE, options).alias("e")).where("e IS NOT NULL AND e.corrupt IS NULL")
    return e.select("e.entry_id", "e.session_id", "e.line_no", "e.uuid", "e.type", "e.message.role", "e.message.content", F.col("e.timestamp").alias("msg_timestamp"), "e.cwd")


def state(main: Column, spare: Column) -> dict[str, Column]:
    """The fields of a state kept as JSON: of ``main``, or where that is no JSON of ``spare``; a field of another type than it should have counts as missing, and missing ones as zero or empty."""
    parsed = [F.from_json(c, _STATE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}) for c in (main, spare)]
    whole = F.try_parse_json(main).isNotNull()
    used = F.when(whole, parsed[0]).otherwise(parsed[1])
    empty = {"byteOffset": 0, "lastExtractedAt": 0, "messagesSinceExtraction": 0, "rollingSummary": ""}
    return {k: F.coalesce(used[k], F.lit(v)) for k, v in empty.items()}
