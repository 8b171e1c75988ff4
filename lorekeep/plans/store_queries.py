"""Queries agg_* (counts and votes), tx_* (texts and logs), up_* (changes), co_* (consolidation) and st_* (streams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions import jsonl
from lorekeep.functions.text import DAY_MS, basename, evergreen, tokens
from lorekeep.operators import upsert, windows
from lorekeep.operators.skew import if_small
from lorekeep.plans.common import C, E, NOW, chunks, episodes
from lorekeep.sources.tables import one_per_id, table, trim_blanks
from lorekeep.streaming import sessions


# counts and votes


def agg_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, ids and vectors of episodes and chunks."""
    out = None
    for name in ("episodes", "chunks"):
        t = table(spark, sf_dir, name).agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count("embedding").alias("n_vectors"), F.count_distinct("project_path").alias("n_paths"))
        t = t.select(F.lit(name).alias("table_name"), "n_rows", "n_ids", "n_vectors", "n_paths")
        out = t if out is None else out.unionByName(t)
    return out


def agg_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by the project as it is spelled, labelled afterwards."""
    e = episodes(spark, sf_dir, "project").groupBy("project").agg(F.count("*").alias("n"))
    return e.select(F.coalesce("project", F.lit("(global)")).alias("project"), "n")


def agg_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir, "project", "scope", "importance").groupBy("project", "scope", "importance").agg(F.count("*").alias("n"))


def agg_sessions_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir, "project_path", "session_id")
    return e.groupBy("project_path").agg(F.count_distinct("session_id").alias("n_sessions"), F.count("*").alias("n_episodes"))


def agg_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest episodes."""
    e = episodes(spark, sf_dir, "project", "importance", "summary", "created_at")
    return e.orderBy(F.col("created_at").desc(), "id").limit(10).select("id", "project", "importance", F.substring("summary", 1, 80).alias("summary"), "created_at")


def _entities(c: Column) -> Column:
    return F.coalesce(F.when(jsonl.valid_json(c), F.from_json(c, "array<string>")), F.array().cast("array<string>"))


def agg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many episodes name each entity; a list that is cut off names none."""
    e = episodes(spark, sf_dir, "entities").select("id", F.explode(F.array_distinct(_entities(F.col("entities")))).alias("entity"))
    return e.groupBy("entity").agg(F.count("*").alias("n_episodes"))


def agg_session_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project that most of a session's episodes have, of equals the first; and the last path that isn't null."""
    e = episodes(spark, sf_dir, "session_id", "project", "project_path", "created_at")
    vote = windows.majority(e, "session_id", "project", F.struct("created_at", "id"))
    last = e.where("project_path IS NOT NULL").groupBy("session_id").agg(F.max_by("project_path", F.struct("created_at", "id")).alias("last_path"))
    return vote.join(last, "session_id", "left")


#: Words that place an episode in a topic, the first rule that holds wins.
RULES = [("tests", r"(?i)\btest runner\b|\btests\b"), ("search", r"(?i)\bsearch endpoint\b|\bposting list\b|\bquery planner\b"), ("memory", r"(?i)\bchunk index\b|\bsummary buffer\b|\bvector cache\b"), ("files", r"(?i)\barchive folder\b|\block file\b")]


def _topic(c: Column) -> Column:
    out = None
    for name, pattern in RULES:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise("other")


def agg_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the topic of an episode's content differs from its summary's: how often, and the three first episodes by id."""
    e = episodes(spark, sf_dir, "summary", "full_content").where("full_content IS NOT NULL")
    e = e.select("id", _topic(F.col("summary")).alias("old"), _topic(F.col("full_content")).alias("new")).where("old <> new")
    place = F.row_number().over(W.partitionBy("old", "new").orderBy("id"))
    first = e.withColumn("k", place).where("k <= 3").groupBy("old", "new").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
    return e.groupBy("old", "new").agg(F.count("*").alias("n")).join(first, ["old", "new"])


def agg_unembedded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with chunks that lack a vector, with layer and project as their path tells."""
    parts = F.split("path", "/")
    at = F.array_position(parts, ".claude").cast("int")
    c = chunks(spark, sf_dir, "path", "embedding").where("embedding IS NULL AND path IS NOT NULL").select("path").distinct()
    home = F.col("path").startswith("/home/")
    return c.select("path", F.when(home | (at < 2), "global").otherwise("project").alias("layer"), F.when(~home & (at > 1), F.get(parts, at - 2)).alias("project"))


# texts and logs


def tx_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of users and assistants that have text."""
    t = table(spark, sf_dir, "transcript_entries")
    speaker = F.coalesce("type", "role")
    m = t.where(speaker.isin(jsonl.SPEAKERS)).select("entry_id", "session_id", "line_no", speaker.alias("speaker"), jsonl.text(F.col("content")).alias("text"))
    return m.where("text <> ''")


def tx_tool_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The absolute paths that each session's tool calls name, with how many lines name them."""
    t = table(spark, sf_dir, "transcript_entries").select("session_id", F.explode(jsonl.tool_paths(F.col("content"))).alias("path"))
    return t.groupBy("session_id", "path").agg(F.count("*").alias("n"))


def tx_text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(jsonl.text_paths(F.col("text"))).alias("path"))


def tx_first_cwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first working directory among the first ten lines of each session."""
    t = table(spark, sf_dir, "transcript_entries").where("line_no <= 10 AND cwd <> ''")
    return t.groupBy("session_id").agg(F.min_by("cwd", F.struct("line_no", "entry_id")).alias("cwd"))


def tx_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pieces of each document: 400 tokens, a new one every 320 until one reaches the end; with lines and hash."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.split("text", "\n")
    token = F.flatten(F.transform(lines, lambda l, i: F.transform(F.regexp_extract_all(l, F.lit(r"(\S+)")), lambda t: F.struct((i + 1).alias("line"), t.alias("token")))))
    d = d.select("doc_id", token.alias("t")).where(F.size("t") > 0)
    last = F.greatest(F.ceil((F.size("t") - 400) / 320), F.lit(0)).cast("int")
    p = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("t", k * 320 + 1, 400))).alias("piece", "t"))
    return p.select("doc_id", "piece", F.size("t").alias("n_tokens"), F.get("t", F.lit(0))["line"].alias("start_line"), F.element_at("t", -1)["line"].alias("end_line"), F.sha2(F.array_join(F.transform("t", lambda x: x["token"]), " "), 256).alias("hash"))


def tx_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 7 of each document, at most 10,000 characters."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    part = F.array_join(F.slice(F.split("text", "\n"), 3, 5), "\n")
    return d.select("doc_id", F.substring(part, 1, 10_000).alias("text"), (F.length(part) > 10_000).alias("truncated"))


def tx_recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest daily files of each project."""
    c = chunks(spark, sf_dir, "path", "project_path").where(basename(F.col("path")).rlike(r"^\d{4}-\d{2}-\d{2}")).select("project_path", "path", basename(F.col("path")).alias("name")).distinct()
    place = F.row_number().over(W.partitionBy("project_path").orderBy(F.col("name").desc(), "path"))
    return c.withColumn("rank", place).where("rank <= 3").select("project_path", "rank", "path")


def tx_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest messages of each session up to about 6,000 characters, in order; where that is more, the newest are what is cut."""
    m = tx_messages(spark, sf_dir)
    m = windows.within_budget(m, "session_id", [F.col("line_no").desc(), F.col("entry_id").desc()], F.length("text"), 6000)
    line = F.struct("line_no", "entry_id", F.concat("speaker", F.lit(": "), "text").alias("t"))
    tail = m.groupBy("session_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(line)).alias("l"))
    return tail.select("session_id", "n", F.substring(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), 1, 6000).alias("tail"))


def tx_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits into 2,000 tokens of context for each project: its newest chunks, whole, until the budget is used up."""
    n = F.size(tokens(F.col("text")))
    c = chunks(spark, sf_dir, "project_path", "text", "updated_at").where("project_path IS NOT NULL").select("project_path", "id", "updated_at", n.alias("n_tokens"))
    c = windows.within_budget(c, "project_path", [F.col("updated_at").desc(), F.col("id")], F.col("n_tokens"), 2000)
    return c.groupBy("project_path").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.min("updated_at").alias("oldest"))


def tx_day_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown of each project's important episodes by day, one piece for each hour in order of time, so that no day is ever one row; blank summaries are left out, and a day's title stands in its own piece (hour -1)."""
    e = episodes(spark, sf_dir, "project_path", "importance", "summary", "created_at").where("importance = 'high' AND project_path IS NOT NULL").where(trim_blanks(F.col("summary")) != "")
    at = F.timestamp_millis(F.col("created_at"))
    e = e.select("project_path", F.date_format(at, "yyyy-MM-dd").alias("day"), F.hour(at).alias("hour"), F.struct("created_at", "id", F.concat(F.lit("## "), F.date_format(at, "HH:mm"), F.lit("\n\n"), F.substring("summary", 1, 200)).alias("t")).alias("s"))
    d = e.groupBy("project_path", "day", "hour").agg(F.sort_array(F.collect_list("s")).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["t"]), "\n\n")
    titles = e.select("project_path", "day").distinct().select("project_path", "day", F.lit(-1).alias("hour"), F.lit(0).alias("n"), F.concat(F.lit("# "), "day", F.lit("\n\n")).alias("text"))
    return titles.unionByName(d.select("project_path", "day", "hour", F.size("s").alias("n"), F.concat(body, F.lit("\n\n")).alias("text")))


def tx_project_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each project its sessions, days and distinct first sentences of summaries."""
    e = episodes(spark, sf_dir, "project_path", "session_id", "summary", "created_at").where("project_path IS NOT NULL")
    day = F.date_format(F.timestamp_millis(F.col("created_at")), "yyyy-MM-dd")
    first = trim_blanks(F.element_at(F.split("summary", r"\. "), 1))
    return e.groupBy("project_path").agg(F.count_distinct("session_id").alias("n_sessions"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct(day).alias("n_days"), F.count_distinct(first).alias("n_sentences"))


def tx_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log's tail is looked at for: failures and codes by kind and day."""
    ev = table(spark, sf_dir, "events")
    line = F.concat(F.col("event_type"), F.lit(" "), F.col("value").cast("string"), F.lit(" "), "props")
    e = ev.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", line.alias("line"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("line").contains("error")).alias("n_errors"), F.count_if(F.col("line").rlike(r"\b42\b")).alias("n_code"), F.max("k").alias("max_k"))


# changes


def up_latest_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows sent again under one id, the one read last."""
    e = table(spark, sf_dir, "episodes").where("id IS NOT NULL").select("id", "accessed_at", "access_count", "importance")
    return windows.latest(e, "id", ["accessed_at", "access_count"])


def up_replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by file after the dated files of documents' projects were replaced by one chunk for each document."""
    c = chunks(spark, sf_dir, "path", "text").select("path", "id", F.length("text").alias("n"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    new = d.select(F.regexp_replace("path", r"[^/]+$", "MEMORY.md").alias("path"), F.concat(F.lit("doc_"), "doc_id").alias("id"), F.length("text").alias("n"))
    return upsert.replaced(c, new, "path").groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_chars"))


def up_merged_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects after those of all documents and episodes were inserted or updated: parents and times change, descriptions and sources stay."""
    p = table(spark, sf_dir, "projects").select("full_path", "name", "parent_project", "description", "source", "created_at", "updated_at")
    seen = table(spark, sf_dir, "episodes").where("project_path IS NOT NULL").groupBy(F.col("project_path").alias("full_path")).agg(F.min("created_at").alias("created_at"), F.max("accessed_at").alias("updated_at"))
    new = seen.select("full_path", basename(F.col("full_path")).alias("name"), F.regexp_replace("full_path", "/[^/]*$", "").alias("parent_project"), F.lit(None).cast("string").alias("description"), F.lit("auto").alias("source"), "created_at", "updated_at")
    return upsert.merged(p, new, "full_path", ["name", "parent_project", "updated_at"], ["description", "source", "created_at"])


def up_backfilled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that name a known project but lack its path, with the first path of that name."""
    first = table(spark, sf_dir, "projects").groupBy(F.col("name").alias("project")).agg(F.min("full_path").alias("full_path"))
    e = episodes(spark, sf_dir, "project", "project_path").where("project_path IS NULL AND project IS NOT NULL")
    return e.join(if_small(first), "project").select("id", "project", "full_path")


def up_forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and what is left of them after every episode whose content is blank was deleted by id."""
    e = episodes(spark, sf_dir, "session_id", "full_content")
    gone = e.where(trim_blanks(F.col("full_content")) == "").select("id")
    return e.join(gone, "id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n"))


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Episodes of the last three days as candidates, and the earlier ones as the store."""
    e = episodes(spark, sf_dir, "scope", "project", "embedding", "created_at")
    cut = NOW - 3 * DAY_MS
    return e.where(F.col("created_at") > cut), e.where(F.col("created_at") <= cut)


def up_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the last three days' episodes: update a similar earlier one of the same scope and project, or add."""
    new, store = _batch(spark, sf_dir)
    return upsert.decided(new, upsert.best_matches(new, store, 128), 0.92)


def up_vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents' texts have a chunk of the same hash, so that no vector must be computed."""
    cache = chunks(spark, sf_dir, "text", "embedding").where("embedding IS NOT NULL").select(F.sha2("text", 256).alias("hash")).distinct().withColumn("hit", F.lit(True))
    e = episodes(spark, sf_dir, "summary", "full_content").select("id", F.explode(F.array("summary", "full_content")).alias("text")).where("text IS NOT NULL").select("id", F.sha2("text", 256).alias("hash"))
    return e.join(cache, "hash", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"), F.count_distinct("hash").alias("n_texts"))


# consolidation


def co_graduates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ordered pools of important episodes united: the 20 used most, the first source winning, and the 10 oldest global ones."""
    e = episodes(spark, sf_dir, "importance", "scope", "access_count", "graduated_at", "created_at").where("importance = 'high' AND graduated_at IS NULL")
    used = e.where("access_count >= 3").orderBy(F.col("access_count").desc(), F.col("created_at").desc(), "id").limit(20).select("id", F.lit("used").alias("why"))
    old = e.where((F.col("scope") == "global") & (F.col("created_at") < NOW - 14 * DAY_MS)).orderBy("created_at", "id").limit(10).select("id", F.lit("old").alias("why"))
    return used.unionByName(old).groupBy("id").agg(F.max("why").alias("why"))


def co_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that can go, by project: of episodes older than 30 days that were never read and aren't important."""
    e = episodes(spark, sf_dir, "project_path", "importance", "access_count", "full_content", "created_at")
    gone = (F.col("created_at") < NOW - 30 * DAY_MS) & (F.col("access_count") <= 0) & (F.col("importance") == "normal") & F.col("full_content").isNotNull()
    return e.groupBy("project_path").agg(F.count("*").alias("n"), F.count_if(gone).alias("n_gone"), F.sum(F.when(gone, F.length("full_content")).otherwise(0)).alias("n_chars"))


def co_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents that stay when each is cut to 40 lines by dropping its oldest sections; a section begins at "## "."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    s = d.select("doc_id", F.posexplode(F.split("text", r"(?:^|\n)## ")).alias("section", "body"))
    s = s.select("doc_id", "section", F.size(F.split("body", "\n")).alias("n_lines"))
    return windows.last_sections(s, "doc_id", 40)


def co_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average strength of retention by project: exp(-hours since reading / stability), stability growing with the hours that passed until it was read; and the rate of importance as a Beta mean."""
    e = episodes(spark, sf_dir, "project_path", "importance", "accessed_at", "created_at")
    hours = (F.lit(NOW) - F.col("accessed_at")) / F.lit(3_600_000.0)
    stability = F.least(F.lit(365.0), F.lit(7.0) * (1 + 0.1 * F.coalesce(F.log1p(F.greatest((F.col("accessed_at") - F.col("created_at")) / F.lit(3_600_000.0), F.lit(0.0)) / 24), F.lit(0.0))))
    strength = F.when(F.col("accessed_at").isNull() | (F.col("accessed_at") == 0), F.lit(0.5)).otherwise(F.exp(-hours / (stability * 24)))
    high = F.sum((F.col("importance") == "high").cast("bigint"))
    return e.groupBy("project_path").agg(F.round(F.avg(strength), 9).alias("strength"), F.round((high + 1) / (F.count("*") + 2), 9).alias("rate"), F.count("*").alias("n"))


def co_evergreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir, "path", "text")
    return c.groupBy(evergreen(F.col("path")).alias("evergreen")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a pattern, as the stream's source takes a plain path for a folder, and a table may be one file; the bound keeps micro-batches small
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parque[t]")


def st_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batches of every session's messages, from its log read as a stream."""
    t = _stream(spark, sf_dir, "transcript_entries")
    speaker = F.coalesce("type", "role")
    m = t.where(speaker.isin(jsonl.SPEAKERS)).select("session_id", "line_no", speaker.alias("speaker"), jsonl.text(F.col("content")).alias("text")).where("text <> '' AND session_id IS NOT NULL AND line_no IS NOT NULL")
    return sessions.drained(sessions.extraction_batches(m))


def st_event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    out = sessions.drained(sessions.counted(e, F.col("ts").cast("timestamp"), "1 hour", "1 day", "event_type"), "complete")
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 6).alias("total"))


_ALL = (agg_totals, agg_by_project, agg_by_scope, agg_sessions_per_project, agg_recent, agg_entities, agg_session_project, agg_transitions, agg_unembedded_paths, tx_messages, tx_tool_paths, tx_text_paths,
        tx_first_cwd, tx_chunks, tx_line_range, tx_recent_logs, tx_tail, tx_context, tx_day_log, tx_project_overview, tx_event_log, up_latest_episode, up_replaced_files, up_merged_projects, up_backfilled_paths, up_forgotten, up_similar, up_vector_cache,
        co_graduates, co_compressed, co_sections, co_strength, co_evergreen, st_extractions, st_event_hours)
QUERIES = {f.__name__: f for f in _ALL}

_TRIM = "' ' || chr(9) || chr(10) || chr(13)"
_TEXT = rf"""CASE WHEN content NOT LIKE '[{{%' THEN trim(content, {_TRIM}) WHEN json_valid(content) THEN trim(array_to_string(list_filter(list_transform(
  list_filter(CAST(content AS JSON[]), lambda x: json_extract_string(x, '$.type') = 'text'), lambda x: json_extract_string(x, '$.text')), lambda x: x <> ''), chr(10)), {_TRIM}) ELSE '' END"""
_MESSAGES = f"m AS (SELECT * FROM (SELECT entry_id, session_id, line_no, coalesce(type, role) AS speaker, {_TEXT} AS text FROM transcript_entries WHERE coalesce(type, role) IN ('user', 'assistant')) WHERE text <> '')"
_TOPIC = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in RULES) + " ELSE 'other' END"
_DAY = "strftime(make_timestamp(created_at * 1000), '%Y-%m-%d')"

SQL = {
    "agg_totals": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(embedding) AS n_vectors, count(DISTINCT project_path) AS n_paths FROM {t}" for t in ("episodes", "chunks")),
    "agg_by_project": f"WITH {E} SELECT coalesce(project, '(global)') AS project, n FROM (SELECT project, count(*) AS n FROM e GROUP BY 1)",
    "agg_by_scope": f"WITH {E} SELECT project, scope, importance, count(*) AS n FROM e GROUP BY ALL",
    "agg_sessions_per_project": f"WITH {E} SELECT project_path, count(DISTINCT session_id) AS n_sessions, count(*) AS n_episodes FROM e GROUP BY 1",
    "agg_recent": f"WITH {E} SELECT id, project, importance, substring(summary, 1, 80) AS summary, created_at FROM e ORDER BY created_at DESC, id LIMIT 10",
    "agg_entities": f"WITH {E} SELECT entity, count(*) AS n_episodes FROM (SELECT id, unnest(list_distinct(CAST(CAST(entities AS JSON) AS VARCHAR[]))) AS entity FROM (SELECT * FROM e WHERE json_valid(entities))) GROUP BY 1",
    "agg_session_project": f"""WITH {E}, v AS (SELECT session_id, project, count(*) AS votes, min((created_at, id)) AS f FROM e WHERE project IS NOT NULL GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY votes DESC, f) AS k FROM v) WHERE k = 1), l AS (SELECT session_id, arg_max(project_path, (created_at, id)) AS last_path FROM e WHERE project_path IS NOT NULL GROUP BY 1)
SELECT session_id, project, votes, last_path FROM b LEFT JOIN l USING (session_id)""",
    "agg_transitions": f"""WITH {E}, t AS (SELECT id, {_TOPIC("summary")} AS old, {_TOPIC("full_content")} AS new FROM e WHERE full_content IS NOT NULL), x AS (SELECT *, row_number() OVER (PARTITION BY old, new ORDER BY id) AS k FROM t WHERE old <> new)
SELECT old, new, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (k <= 3) AS examples FROM x GROUP BY 1, 2""",
    "agg_unembedded_paths": f"""WITH {C}, p AS (SELECT DISTINCT path, string_split(path, '/') AS s, list_position(string_split(path, '/'), '.claude') AS a FROM c WHERE embedding IS NULL AND path IS NOT NULL)
SELECT path, CASE WHEN path LIKE '/home/%' OR coalesce(a, 0) < 2 THEN 'global' ELSE 'project' END AS layer, CASE WHEN path NOT LIKE '/home/%' AND a > 1 THEN s[a - 1] END AS project FROM p""",
    "tx_messages": f"WITH {_MESSAGES} SELECT * FROM m",
    "tx_tool_paths": r"""WITH b AS (SELECT session_id, entry_id, unnest(CAST(content AS JSON[])) AS x FROM (SELECT * FROM transcript_entries WHERE content LIKE '[{%' AND json_valid(content))),
p AS (SELECT session_id, entry_id, unnest([json_extract_string(x, '$.input.file_path'), json_extract_string(x, '$.input.notebook_path'), json_extract_string(x, '$.input.path'),
  CASE WHEN regexp_matches(json_extract_string(x, '$.input.pattern'), '[*?\[{]') THEN regexp_replace(regexp_extract(json_extract_string(x, '$.input.pattern'), '^([^*?\[{]*)', 1), '/?[^/]*$', '') ELSE json_extract_string(x, '$.input.pattern') END]) AS path
  FROM b WHERE json_extract_string(x, '$.type') = 'tool_use')
SELECT session_id, path, count(DISTINCT entry_id) AS n FROM p WHERE path LIKE '/%' AND length(path) > 1 GROUP BY 1, 2""",
    "tx_text_paths": r"SELECT DISTINCT doc_id, regexp_replace(p, '[.:;]+$', '') AS path FROM (SELECT doc_id, unnest(regexp_extract_all(text, '/work/[A-Za-z0-9_./-]+')) AS p FROM documents)",
    "tx_first_cwd": "SELECT session_id, arg_min(cwd, (line_no, entry_id)) AS cwd FROM transcript_entries WHERE line_no <= 10 AND cwd <> '' GROUP BY 1",
    "tx_chunks": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, line, unnest(regexp_extract_all(l, '[^ \t\r\x0b\f]+')) AS token, unnest(generate_series(1, len(regexp_extract_all(l, '[^ \t\r\x0b\f]+')))) AS k FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM t),
p AS (SELECT *, unnest(generate_series(CAST(greatest(ceil((i - 399) / 320), 0) AS BIGINT), CAST(least(i // 320, greatest(ceil((n - 400) / 320), 0)) AS BIGINT))) AS piece FROM n)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(count(*) AS INTEGER) AS n_tokens, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line, sha256(string_agg(token, ' ' ORDER BY i)) AS hash FROM p GROUP BY 1, 2""",
    "tx_line_range": "WITH p AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[3:7], chr(10)) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, substring(t, 1, 10000) AS text, length(t) > 10000 AS truncated FROM p",
    "tx_recent_logs": f"""WITH {C}, p AS (SELECT DISTINCT project_path, path, split_part(path, '/', -1) AS name FROM c WHERE regexp_matches(split_part(path, '/', -1), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))
SELECT * FROM (SELECT project_path, CAST(row_number() OVER (PARTITION BY project_path ORDER BY name DESC, path) AS INTEGER) AS rank, path FROM p) WHERE rank <= 3""",
    "tx_tail": f"""WITH {_MESSAGES}, b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY session_id ORDER BY line_no DESC, entry_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT session_id, count(*) AS n, substring(string_agg(speaker || ': ' || text, chr(10) ORDER BY line_no, entry_id), 1, 6000) AS tail FROM b WHERE before < 6000 GROUP BY 1""",
    "tx_context": rf"""WITH {C}, t AS (SELECT project_path, id, updated_at, coalesce(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')), 0) AS k FROM c WHERE project_path IS NOT NULL),
b AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY project_path ORDER BY updated_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT project_path, count(*) AS n_chunks, CAST(sum(k) AS BIGINT) AS n_tokens, min(updated_at) AS oldest FROM b WHERE before < 2000 GROUP BY 1""",
    "tx_day_log": f"""WITH {E}, h AS (SELECT project_path, {_DAY} AS day, CAST(strftime(make_timestamp(created_at * 1000), '%H') AS INTEGER) AS hour, created_at, id,
  '## ' || strftime(make_timestamp(created_at * 1000), '%H:%M') || chr(10) || chr(10) || substring(summary, 1, 200) AS t FROM e WHERE importance = 'high' AND project_path IS NOT NULL AND trim(summary, {_TRIM}) <> '')
SELECT project_path, day, hour, CAST(count(*) AS INTEGER) AS n, string_agg(t, chr(10) || chr(10) ORDER BY created_at, id) || chr(10) || chr(10) AS text FROM h GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT project_path, day, -1, 0, '# ' || day || chr(10) || chr(10) FROM h""",
    "tx_project_overview": f"""WITH {E} SELECT project_path, count(DISTINCT session_id) AS n_sessions, min({_DAY}) AS first_day, max({_DAY}) AS last_day, count(DISTINCT {_DAY}) AS n_days,
  count(DISTINCT trim(string_split(summary, '. ')[1], {_TRIM})) AS n_sentences FROM e WHERE project_path IS NOT NULL GROUP BY 1""",
    "tx_event_log": r"""WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type || ' ' || value || ' ' || props AS line, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT day, count(*) AS n, count(*) FILTER (contains(line, 'error')) AS n_errors, count(*) FILTER (regexp_matches(line, '\b42\b')) AS n_code, max(k) AS max_k FROM l GROUP BY 1""",
    "up_latest_episode": "SELECT id, accessed_at, access_count, importance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY accessed_at DESC, access_count DESC) AS k FROM episodes WHERE id IS NOT NULL) WHERE k = 1",
    "up_replaced_files": f"""WITH {C}, n AS (SELECT regexp_replace(path, '[^/]+$', 'MEMORY.md') AS path, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT path, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_chars FROM (SELECT path, length(text) AS n FROM c WHERE path IS NULL OR path NOT IN (SELECT path FROM n) UNION ALL SELECT * FROM n) GROUP BY 1""",
    "up_merged_projects": """WITH n AS (SELECT project_path AS full_path, split_part(project_path, '/', -1) AS name, regexp_replace(project_path, '/[^/]*$', '') AS parent_project, min(created_at) AS created_at, max(accessed_at) AS updated_at
  FROM episodes WHERE project_path IS NOT NULL GROUP BY 1)
SELECT coalesce(s.full_path, n.full_path) AS full_path, coalesce(n.name, s.name) AS name, coalesce(n.parent_project, s.parent_project) AS parent_project, coalesce(n.updated_at, s.updated_at) AS updated_at,
  s.description, coalesce(s.source, CASE WHEN n.full_path IS NOT NULL THEN 'auto' END) AS source, coalesce(s.created_at, n.created_at) AS created_at FROM projects s FULL JOIN n ON n.full_path = s.full_path""",
    "up_backfilled_paths": f"WITH {E}, p AS (SELECT name, min(full_path) AS full_path FROM projects GROUP BY 1) SELECT id, project, full_path FROM e JOIN p ON p.name = e.project WHERE project_path IS NULL",
    "up_forgotten": f"WITH {E} SELECT session_id, count(*) AS n FROM e WHERE coalesce(trim(full_content, {_TRIM}) <> '', true) GROUP BY 1",
    "up_similar": f"""WITH {E}, x AS (SELECT id, scope, project, created_at, CAST(embedding AS DOUBLE[]) AS v FROM e WHERE len(embedding) = 128 AND list_dot_product(embedding, embedding) > 0),
p AS (SELECT n.id, s.id AS target, round(list_cosine_similarity(n.v, s.v), 9) AS similarity FROM x n JOIN x s ON n.scope = s.scope AND (n.scope = 'global' OR n.project IS NOT DISTINCT FROM s.project)
  WHERE n.created_at > {NOW - 3 * DAY_MS} AND s.created_at <= {NOW - 3 * DAY_MS}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, target) AS k FROM p) WHERE k = 1)
SELECT e.id, CASE WHEN similarity > 0.92 THEN 'update' ELSE 'add' END AS action, CASE WHEN similarity > 0.92 THEN target END AS target, similarity FROM e LEFT JOIN b USING (id) WHERE created_at > {NOW - 3 * DAY_MS}""",
    "up_vector_cache": f"""WITH {E}, {C}, h AS (SELECT DISTINCT sha256(text) AS hash FROM c WHERE embedding IS NOT NULL), t AS (SELECT sha256(t) AS hash FROM (SELECT unnest([summary, full_content]) AS t FROM e) WHERE t IS NOT NULL)
SELECT h.hash IS NOT NULL AS hit, count(*) AS n, count(DISTINCT t.hash) AS n_texts FROM t LEFT JOIN h USING (hash) GROUP BY 1""",
    "co_graduates": f"""WITH {E}, g AS (SELECT * FROM e WHERE importance = 'high' AND graduated_at IS NULL), u AS (SELECT id, 'used' AS why FROM g WHERE access_count >= 3 ORDER BY access_count DESC, created_at DESC, id LIMIT 20),
o AS (SELECT id, 'old' AS why FROM g WHERE scope = 'global' AND created_at < {NOW - 14 * DAY_MS} ORDER BY created_at, id LIMIT 10) SELECT id, max(why) AS why FROM (SELECT * FROM u UNION ALL SELECT * FROM o) GROUP BY 1""",
    "co_compressed": f"""WITH {E}, g AS (SELECT *, coalesce(created_at < {NOW - 30 * DAY_MS} AND access_count <= 0 AND importance = 'normal' AND full_content IS NOT NULL, false) AS gone FROM e)
SELECT project_path, count(*) AS n, count(*) FILTER (gone) AS n_gone, CAST(sum(CASE WHEN gone THEN length(full_content) ELSE 0 END) AS BIGINT) AS n_chars FROM g GROUP BY 1""",
    "co_sections": r"""WITH s AS (SELECT doc_id, unnest(b) AS body, CAST(unnest(generate_series(0, len(b) - 1)) AS INTEGER) AS section FROM (SELECT doc_id, regexp_split_to_array(text, '(?:^|\n)## ') AS b FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, section, CAST(len(string_split(body, chr(10))) AS INTEGER) AS n_lines FROM s),
w AS (SELECT *, sum(n_lines) OVER (PARTITION BY doc_id ORDER BY section DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newer, max(n_lines) FILTER (section = 0) OVER (PARTITION BY doc_id) AS pre, max(section) OVER (PARTITION BY doc_id) AS last FROM l)
SELECT doc_id, section, n_lines FROM w WHERE section = 0 OR section = last OR newer + pre <= 40""",
    "co_strength": f"""WITH {E} SELECT project_path, round(avg(CASE WHEN accessed_at IS NULL OR accessed_at = 0 THEN 0.5 ELSE exp(-(({NOW} - accessed_at) / 3600000.0) / (least(365.0, 7.0 * (1 + 0.1 * coalesce(ln(1 + greatest((accessed_at - created_at) / 3600000.0, 0.0) / 24), 0.0))) * 24)) END), 9) AS strength,
  round(CAST(count(*) FILTER (importance = 'high') + 1 AS DOUBLE) / (count(*) + 2), 9) AS rate, count(*) AS n FROM e GROUP BY 1""",
    "co_evergreen": f"""WITH {C} SELECT split_part(path, '/', -1) LIKE '%MEMORY.md' OR NOT regexp_matches(split_part(path, '/', -1), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS evergreen, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM c GROUP BY 1""",
    "st_extractions": f"""WITH {_MESSAGES}, u AS (SELECT session_id, line_no, coalesce(sum(CAST(speaker = 'user' AS INTEGER)) OVER (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(CAST(speaker = 'user' AS INTEGER)) OVER (PARTITION BY session_id) AS users FROM m WHERE session_id IS NOT NULL AND line_no IS NOT NULL),
b AS (SELECT session_id, line_no, users, CASE WHEN before < 5 THEN 1 ELSE 2 + (before - 5) // 15 END AS batch FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY session_id, batch ORDER BY line_no DESC) AS back FROM b WHERE users >= 5 + 15 * (batch - 1))
SELECT session_id, CAST(batch AS INTEGER) AS batch, min(line_no) AS first_line, max(line_no) AS last_line, CAST(count(*) AS INTEGER) AS n_messages FROM f WHERE back <= 100 GROUP BY 1, 2""",
    "st_event_hours": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
}
