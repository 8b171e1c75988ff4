"""Session-log lines: content that is plain text or a JSON array of blocks, times, file paths of tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.sources.tables import trim_blanks

#: ISO 8601 with a zone
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
SPEAKERS = ["user", "assistant"]
_BLOCK = "type string, text string, name string, input struct<file_path:string,path:string,pattern:string,notebook_path:string>"


def is_array(content: Column) -> Column:
    return content.startswith("[{")


def valid_json(c: Column) -> Column:
    """Whether a text is one JSON value: it is wrapped in an array and in an object, so that anything after it is an error in one of the two."""
    both = [F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull() for a, b in (("[", ",0]"), ('{"a":', "}"))]
    return both[0] & both[1]


def blocks(content: Column) -> Column:
    """The blocks of a JSON array, each on its own, so that one that is no object doesn't spoil the others; null if it is none."""
    return F.when(is_array(content), F.transform(F.from_json(content, "array<string>"), lambda x: F.from_json(x, _BLOCK)))


def text(content: Column) -> Column:
    """A JSON array's non-empty texts of blocks of type ``text`` joined by line feeds, else the content itself, trimmed of blanks. A text that is a number counts as its digits."""
    parts = F.transform(F.filter(blocks(content), lambda x: (x["type"] == "text") & (F.length(x["text"]) > 0)), lambda x: x["text"])
    return trim_blanks(F.when(is_array(content), F.array_join(parts, "\n")).otherwise(content))


def micros(stamp: Column) -> Column:
    """Microseconds of an ISO time with zone; null for anything else."""
    return F.when(stamp.rlike(ISO), F.unix_micros(stamp.try_cast("timestamp")))


def glob_prefix(pattern: Column) -> Column:
    """The directory of a pattern up to its first wildcard."""
    plain = F.regexp_extract(pattern, r"^([^*?\[{]*)", 1)
    return F.when(pattern.rlike(r"[*?\[{]"), F.regexp_replace(plain, r"/?[^/]*$", "")).otherwise(pattern)


def tool_paths(content: Column) -> Column:
    """Absolute paths that the tool calls of a content name: ``file_path`` or ``notebook_path``, ``path``, and a pattern's directory."""

    def named(x: Column) -> Column:
        i = x["input"]
        return F.array(i["file_path"], i["notebook_path"], i["path"], glob_prefix(i["pattern"]))

    calls = F.filter(blocks(content), lambda x: x["type"] == "tool_use")
    return F.array_distinct(F.filter(F.flatten(F.transform(calls, named)), lambda p: p.startswith("/") & (F.length(p) > 1)))


def text_paths(content: Column, root: str = "/work/") -> Column:
    """Paths under ``root`` that a text names, without closing punctuation."""
    found = F.regexp_extract_all(content, F.lit(rf"({root}[A-Za-z0-9_./-]+)"))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"[.:;]+$", "")))


def named_paths(content: Column, root: str = "/work/") -> Column:
    """Absolute paths that are values of a path's JSON keys in a text, and what :func:`text_paths` finds."""
    keyed = F.regexp_extract_all(content, F.lit(r'"(?:file_path|path|file|notebook_path)"\s*:\s*"(/[^"]+)"'))
    return F.array_union(F.transform(keyed, lambda p: F.regexp_replace(p, r"[.:;]+$", "")), text_paths(content, root))


def snapshot_paths(content: Column) -> Column:
    """Absolute paths among the keys of a file snapshot's backups."""
    kept = F.from_json(content, "snapshot struct<trackedFileBackups: map<string, string>>")["snapshot"]["trackedFileBackups"]
    return F.filter(F.map_keys(kept), lambda p: p.startswith("/"))


def line_paths(kind: Column, line_no: Column, content: Column) -> Column:
    """The paths of a log's line: a snapshot's in the first line, else those of tool calls, else those that its text names."""
    calls = F.coalesce(tool_paths(content), F.array().cast("array<string>"))
    told = F.when(F.size(calls) > 0, calls).otherwise(named_paths(content))
    return F.coalesce(F.when((line_no == 1) & (kind == "file-history-snapshot"), snapshot_paths(content)).otherwise(told), F.array().cast("array<string>"))
