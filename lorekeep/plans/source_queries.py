"""More queries: src_* (files and state), api_* (cards), flt_* (what is visible), and further tx_*, agg_*, up_*, co_*, hier_* and st_*."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions import jsonl
from lorekeep.functions.text import DAY_MS, basename, tokens
from lorekeep.operators import hierarchy, upsert, windows
from lorekeep.operators.skew import if_small, top_per_key
from lorekeep.plans.common import C, E, NOW, UP, chunks, episodes
from lorekeep.plans.retrieval_queries import SQL as RETRIEVAL_SQL
from lorekeep.plans.retrieval_queries import inferred_sql
from lorekeep.plans.store_queries import _DAY, _MESSAGES, _TEXT, _TRIM, SQL as STORE_SQL
from lorekeep.plans.store_queries import _stream, co_graduates, tx_messages, tx_tail
from lorekeep.session import shared_dir
from lorekeep.sources import files
from lorekeep.sources.tables import looked_up, table, trim_blanks
from lorekeep.streaming import sessions

#: The project that cards are asked for from.
HOME = "/work/code/ledgerly"
ID = r"^(ep|bl)_"


# files and state


def src_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a tree of files and read back: hidden and skipped directories and blank files don't count."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    place = F.col("doc_id") % 4
    root = files.written_files(d, "text", {"notes": place == 0, "notes/deep": place == 1, ".hidden": place == 2, "node_modules/pack": place == 3})
    f = files.directory(spark, root, "*.txt")
    return f.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum(F.length("text") - 1).alias("n_chars"))


def _as_line() -> Column:
    line = F.to_json(F.struct("entry_id", "session_id", "line_no", "uuid", "type", F.struct("role", "content").alias("message"), F.col("msg_timestamp").alias("timestamp"), "cwd"))
    # some lines are cut off, as where a log is read while it is written
    return F.when(F.col("entry_id") % 50 == 7, F.substring(line, F.lit(1), (F.length(line) / 2).cast("int"))).otherwise(line)


def src_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session logs as files with a JSON object on each line, read as a stream: messages with text, without lines that are cut off."""
    root = files.written_lines(table(spark, sf_dir, "transcript_entries"), _as_line())
    e = files.log_lines(spark.readStream.option("maxFilesPerTrigger", 64).text(root))
    speaker = F.coalesce("type", "role")
    m = e.where(speaker.isin(jsonl.SPEAKERS)).select("entry_id", "session_id", "line_no", speaker.alias("speaker"), jsonl.text(F.col("content")).alias("text"))
    return sessions.drained(m.where("text <> ''"))


def src_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's state as JSON, read with its fields made right: some states are cut off and have a spare, some have a number as a text."""
    t = table(spark, sf_dir, "transcript_entries").where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("n"), F.max("line_no").alias("last"))
    fields = [F.col("last").alias("lastExtractedAt"), F.col("n").cast("int").alias("messagesSinceExtraction")]
    right, odd = (F.to_json(F.struct(x.alias("byteOffset"), *fields)) for x in (F.col("n") * 100, (F.col("n") * 100).cast("string")))
    main = F.when(F.col("n") % 2 == 0, odd).otherwise(right)
    main = F.when(F.col("n") % 5 == 0, F.substring(main, 1, 20)).otherwise(main)
    spare = F.to_json(F.struct(F.lit(1).alias("byteOffset"), F.lit("spare").alias("rollingSummary")))
    return t.select("session_id", *[c.alias(k) for k, c in files.state(main, spare).items()])


# cards


def api_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of asked ids (here those that graduate, and one that is no id), with a line that tells another project's; and what reading them changes."""
    asked = co_graduates(spark, sf_dir).select("id").unionByName(spark.range(1).select(F.lit("doc:1").alias("id"))).where(F.col("id").rlike(ID))
    e = looked_up(episodes(spark, sf_dir, "project", "project_path", "scope", "importance", "summary", "full_content", "access_count"), asked)
    foreign = (F.col("scope") != "global") & (F.coalesce("project_path", F.lit("")) != HOME)
    lines = F.concat_ws("\n", F.concat(F.lit("# "), "summary"), F.when(foreign, F.concat(F.lit("from "), F.coalesce("project", F.lit("another project")))), F.concat(F.lit("importance: "), "importance"), F.nullif(trim_blanks(F.col("full_content")), F.lit("")))
    return e.select("id", lines.alias("card"), F.lit(NOW).alias("accessed_at"), (F.col("access_count") + 1).cast("bigint").alias("access_count"))


# what is visible


def flt_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each project's upserts are held against: the 500 rows read last that are its own or global; the null project sees global ones only."""
    e = episodes(spark, sf_dir, "project", "scope", "embedding", "accessed_at").where("embedding IS NOT NULL").select("id", "project", "scope", "accessed_at")
    newest = [F.col("accessed_at").desc(), F.col("id")]
    shared = e.where("scope = 'global'").orderBy(*newest).limit(500).select("id", "accessed_at")
    names = e.select(F.coalesce("project", F.lit("(none)")).alias("name")).distinct().unionByName(spark.range(1).select(F.lit("(none)").alias("name"))).distinct()
    own = top_per_key(e.where("scope <> 'global' AND project IS NOT NULL").select(F.col("project").alias("name"), "id", "accessed_at"), "name", newest, 500).drop("rank")
    every = names.crossJoin(F.broadcast(shared)).unionByName(own)
    return top_per_key(every, "name", newest, 500).select("name", "id", "rank")


def flt_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and lines by whether the session's id is one that is let in."""
    t = table(spark, sf_dir, "transcript_entries").select("session_id").unionByName(table(spark, sf_dir, "episodes").select("session_id"))
    return t.groupBy(F.coalesce(F.col("session_id").rlike("^[a-zA-Z0-9_-]+$"), F.lit(False)).alias("allowed")).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"))


# paths


def tx_line_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of each session's first 200 lines: of tool calls, or of a line's text where it calls none."""
    t = table(spark, sf_dir, "transcript_entries").where("line_no <= 200")
    return t.select("session_id", F.explode(jsonl.line_paths(F.col("type"), F.col("line_no"), F.col("content"))).alias("path")).groupBy("session_id", "path").agg(F.count("*").alias("n"))


def tx_named_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that a log line's raw content names, as values of JSON keys or in running text."""
    t = table(spark, sf_dir, "transcript_entries")
    return t.select("entry_id", F.explode(jsonl.named_paths(F.col("content"))).alias("path"))


def tx_session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of each session's log united with those that its episodes name, each once."""
    log = tx_line_paths(spark, sf_dir).select("session_id", "path")
    e = episodes(spark, sf_dir, "session_id", "full_content")
    return log.unionByName(e.select("session_id", F.explode(jsonl.named_paths(F.col("full_content"))).alias("path"))).distinct()


def tx_session_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's directory: the first that its first ten lines tell, unless that is a root; else the project of the paths that its lines name."""
    t = table(spark, sf_dir, "transcript_entries")
    p = table(spark, sf_dir, "projects")
    cwd = t.where("line_no <= 10 AND cwd <> ''").groupBy("session_id").agg(F.min_by("cwd", F.struct("line_no", "entry_id")).alias("cwd"))
    roots = if_small(p.where("parent_project IS NULL").select(F.col("full_path").alias("cwd")).distinct())
    other = hierarchy.inferred(tx_line_paths(spark, sf_dir), p, "session_id", "path").select("session_id", "project")
    every = t.where("session_id IS NOT NULL").select("session_id").distinct()
    out = every.join(cwd.join(roots, "cwd", "left_anti"), "session_id", "left").join(other, "session_id", "left")
    return out.select("session_id", F.coalesce("cwd", "project").alias("home"))


def hier_batch_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project of every batch of 40 lines of a session, by the paths that its lines name; two paths at least."""
    t = table(spark, sf_dir, "transcript_entries").where("session_id IS NOT NULL AND line_no IS NOT NULL")
    batch = F.concat("session_id", F.lit("#"), F.floor((F.col("line_no") - 1) / 40))
    paths = t.select(batch.alias("batch"), F.explode(jsonl.line_paths(F.col("type"), F.col("line_no"), F.col("content"))).alias("path"))
    return hierarchy.inferred(paths, table(spark, sf_dir, "projects"), "batch", "path").where("n_paths >= 2")


# texts


def tx_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last 50,000 characters of each document: lines that tell of warnings or errors, lines with one code, and the last 20 lines that aren't blank."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    tail = F.when(F.length("text") > 50_000, F.substring(F.col("text"), F.length("text") - 49_999, F.lit(50_000))).otherwise(F.col("text"))
    lines = F.filter(F.split(tail, "\n"), lambda x: trim_blanks(x) != "")
    d = d.select("doc_id", lines.alias("l"))
    count = lambda pattern: F.size(F.filter("l", lambda x: x.rlike(pattern)))
    last = F.slice("l", F.greatest(F.size("l") - 19, F.lit(1)), 20)
    return d.where(F.size("l") > 0).select("doc_id", count("WARN|ERROR|[Ff]ailed").alias("n_failed"), count(r"\b1463\b").alias("n_code"), F.sha2(F.array_join(last, "\n"), 256).alias("tail"))


def tx_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tails of sessions that are about to outgrow their context (more than 5,000 characters here), once each."""
    long = tx_messages(spark, sf_dir).groupBy("session_id").agg(F.sum(F.length("text")).alias("n_chars")).where("n_chars > 5000")
    return tx_tail(spark, sf_dir).join(long, "session_id").select("session_id", "n_chars", F.concat(F.lit("\n## flushed\n\n"), "tail", F.lit("\n")).alias("section"))


def tx_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each project: its newest chunks as sections, until 300 tokens are used up, the last cut to what is left; nothing where there is no token."""
    c = chunks(spark, sf_dir, "project_path", "path", "text", "updated_at").where("project_path IS NOT NULL").select("project_path", "id", "path", "updated_at", tokens(F.col("text")).alias("t"))
    newest = [F.col("updated_at").desc(), F.col("id")]
    c = windows.within_budget(c.withColumn("n", F.size("t")), "project_path", newest, F.col("n"), 300)
    before = F.coalesce(F.sum("n").over(W.partitionBy("project_path").orderBy(*newest).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    c = c.withColumn("before", before).where("n > 0")
    section = F.struct("before", F.concat(F.lit("## "), basename(F.col("path")), F.lit("\n"), F.array_join(F.slice("t", F.lit(1), 300 - F.col("before")), " ")).alias("s"))
    g = c.groupBy("project_path").agg(F.sort_array(F.collect_list(section)).alias("s"), F.least(F.sum("n"), F.lit(300)).cast("bigint").alias("n_tokens"))
    return g.select("project_path", "n_tokens", F.concat(F.lit("# "), basename(F.col("project_path")), F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["s"]), "\n\n")).alias("text"))


def tx_project_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each project and day how many episodes there are, how many different summaries, and how the first begins."""
    e = episodes(spark, sf_dir, "project_path", "summary", "created_at").where("project_path IS NOT NULL")
    day = F.date_format(F.timestamp_millis(F.col("created_at")), "yyyy-MM-dd")
    first = F.min_by(F.substring("summary", 1, 60), F.struct("created_at", "id"))
    return e.groupBy("project_path", day.alias("day")).agg(F.count("*").alias("n"), F.count_distinct("summary").alias("n_unique"), first.alias("snippet"))


# aggregates


def agg_session_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of each session's days joined by blank lines in order of time, null and blank ones left out; null where nothing is left."""
    e = episodes(spark, sf_dir, "session_id", "full_content", "created_at")
    day = F.date_format(F.timestamp_millis(F.col("created_at")), "yyyy-MM-dd")
    note = F.nullif(trim_blanks(F.col("full_content")), F.lit(""))
    g = e.groupBy("session_id", day.alias("day")).agg(F.sort_array(F.collect_list(F.when(note.isNotNull(), F.struct("created_at", "id", note.alias("t"))))).alias("l"))
    return g.select("session_id", "day", F.nullif(F.array_join(F.transform("l", lambda x: x["t"]), "\n\n"), F.lit("")).alias("notes"))


def agg_first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different sentences of each project's summaries, with how often and where each came first."""
    e = episodes(spark, sf_dir, "project_path", "summary", "created_at").where("project_path IS NOT NULL")
    s = e.select("project_path", "id", "created_at", F.posexplode(F.split("summary", r"\. ")).alias("pos", "sentence"))
    s = s.withColumn("sentence", trim_blanks(F.col("sentence"))).where("sentence <> ''")
    return s.groupBy("project_path", "sentence").agg(F.min_by("id", F.struct("created_at", "id", "pos")).alias("first_id"), F.count("*").alias("n"))


def agg_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far consolidation got: when the newest graduated episode was made, and how many came after it."""
    e = episodes(spark, sf_dir, "created_at", "graduated_at")
    mark = e.where("graduated_at IS NOT NULL").agg(F.max("created_at").alias("checkpoint"))
    return e.crossJoin(F.broadcast(mark)).groupBy("checkpoint").agg(F.count_if(F.col("created_at") > F.coalesce("checkpoint", F.lit(0))).alias("n_after"))


def agg_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes whose summary has a word of a project's name that isn't their own project: the first such project by path wins."""
    words = table(spark, sf_dir, "projects").select("full_path", F.explode(F.split(F.lower("name"), "-")).alias("word")).where(F.length("word") >= 4)
    rules = words.groupBy("word").agg(F.min("full_path").alias("tag"))
    e = episodes(spark, sf_dir, "project_path", "summary").select("id", "project_path", F.explode(F.array_distinct(tokens(F.col("summary")))).alias("word"))
    return e.join(if_small(rules), "word").groupBy("id").agg(F.min("tag").alias("tag"), F.first("project_path").alias("project_path")).where("NOT tag <=> project_path")


# changes


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cols = ("scope", "project", "project_path", "summary", "full_content", "entities", "importance", "embedding", "created_at", "access_count")
    e = episodes(spark, sf_dir, *cols)
    cut = NOW - 3 * DAY_MS
    roots = table(spark, sf_dir, "projects").where("parent_project IS NULL").select(F.col("full_path").alias("project_path"), F.lit(True).alias("is_root")).distinct()
    new = e.where(F.col("created_at") > cut).join(if_small(roots), "project_path", "left")
    new = new.withColumn("scope", upsert.effective_scope(F.col("scope"), F.col("project"), F.coalesce("is_root", F.lit(False)))).drop("is_root")
    return new, e.where(F.col("created_at") <= cut)


def up_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last three days' episodes add or change: an update joins summaries and contents, takes entities and importance, and counts as a use."""
    new, store = _applied(spark, sf_dir)
    return upsert.applied(new, store, upsert.decided(new, upsert.best_matches(new, store, 128), 0.92), ["created_at", "id"])


def up_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the last three days' episodes if each sees what those before it added."""
    new, store = _applied(spark, sf_dir)
    return upsert.decided_in_turn(new, store, 128, "created_at")


def up_forgotten_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left by scope after ids were forgotten (here those that graduate); what is no id of a record is refused."""
    gone = co_graduates(spark, sf_dir).select("id").unionByName(spark.range(1).select(F.lit("doc:1").alias("id"))).where(F.col("id").rlike(ID))
    return episodes(spark, sf_dir, "scope").join(if_small(gone), "id", "left_anti").groupBy("scope").agg(F.count("*").alias("n"))


def up_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by file after those of files that are no longer listed were deleted; listed are all memory files and the documents' paths."""
    c = chunks(spark, sf_dir, "path", "text")
    listed = c.where(basename(F.col("path")) == "MEMORY.md").select("path").unionByName(table(spark, sf_dir, "documents").select("path")).distinct()
    return c.join(listed, "path", "left_semi").groupBy("path").agg(F.count("*").alias("n"))


def co_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What graduates is appended to its project's memory file, unless a piece of the file has the text already; of what is new the newest stay until 40 lines are full."""
    g = co_graduates(spark, sf_dir)  # 30 rows at most
    e = episodes(spark, sf_dir, "project_path", "summary", "created_at")
    e = looked_up(e, g.select("id")).where("project_path IS NOT NULL").select("id", "project_path", "created_at", trim_blanks(F.col("summary")).alias("content"))
    c = chunks(spark, sf_dir, "path", "project_path", "text").where(basename(F.col("path")) == "MEMORY.md").select("project_path", "text")
    known = c.join(F.broadcast(e), "project_path").where(F.col("text").contains(F.col("content"))).select("id").distinct()
    new = e.join(known, "id", "left_anti")
    stamp = F.date_format(F.timestamp_millis(F.col("created_at")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    new = new.withColumn("section", F.concat(F.lit("\n## "), stamp, F.lit("\n"), "content", F.lit("\n")))
    n_lines = F.size(F.split("section", "\n"))
    return windows.within_budget(new, "project_path", [F.col("created_at").desc(), F.col("id")], n_lines, 40).select("id", "project_path", "section")


# streams


def st_replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of chunks by file that a stream of changes keeps up to date: first all chunks, then the documents' files are replaced, some of them deleted."""
    root = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    c = chunks(spark, sf_dir, "path", "text").where("path IS NOT NULL").select("path", "id", F.length("text").alias("n"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    new = d.select(F.regexp_replace("path", r"[^/]+$", "MEMORY.md").alias("path"), F.concat(F.lit("doc_"), "doc_id").alias("id"), F.when(F.col("doc_id") % 7 > 0, F.length("text")).alias("n"))
    for k, rows in enumerate((c, new)):
        rows.write.parquet(f"{root}/{k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/{k}")
        sessions.replaced_by_key(stream, "path", f"{root}/table", F.col("n").isNull())
    return sessions.read_version(spark, f"{root}/table").groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_chars"))


def st_topic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that stay on their session's topic, from the table read as a stream."""
    return sessions.drained(sessions.same_topic(_stream(spark, sf_dir, "episodes"), 128))


def st_timed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of messages that are full by number or by time, silent sessions' rests included."""
    t = _stream(spark, sf_dir, "transcript_entries")
    speaker = F.coalesce("type", "role")
    m = t.where(speaker.isin(jsonl.SPEAKERS)).select("session_id", "line_no", speaker.alias("speaker"), F.timestamp_micros(jsonl.micros(F.col("msg_timestamp"))).alias("at"))
    return sessions.drained(sessions.timed_batches(m.where("session_id IS NOT NULL AND line_no IS NOT NULL AND at IS NOT NULL")))


_ALL = (src_markdown, src_log_lines, src_states, api_cards, flt_snapshot, flt_session_ids, tx_line_paths, tx_named_paths, tx_session_paths, tx_session_home, hier_batch_inferred, tx_log_tail, tx_flushed, tx_context_text,
        tx_project_days, agg_session_notes, agg_first_sentences, agg_checkpoint, agg_tagged, up_applied, up_in_turn, up_forgotten_ids, up_unlinked, co_saved, st_replaced_files, st_topic_gate, st_timed_batches)
QUERIES = {f.__name__: f for f in _ALL}

_NAMED = lambda c: rf"list_distinct(list_transform(list_concat(regexp_extract_all({c}, '\"(?:file_path|path|file|notebook_path)\"\s*:\s*\"(/[^\"]+)\"', 1), regexp_extract_all({c}, '/work/[A-Za-z0-9_./-]+')), lambda p: regexp_replace(p, '[.:;]+$', '')))"
_CALLS = r"""tp AS (SELECT entry_id, list_distinct(list_filter(flatten(list_transform(list_filter(CAST(content AS JSON[]), lambda x: json_extract_string(x, '$.type') = 'tool_use'), lambda x: [json_extract_string(x, '$.input.file_path'),
  json_extract_string(x, '$.input.notebook_path'), json_extract_string(x, '$.input.path'), CASE WHEN regexp_matches(json_extract_string(x, '$.input.pattern'), '[*?\[{]')
  THEN regexp_replace(regexp_extract(json_extract_string(x, '$.input.pattern'), '^([^*?\[{]*)', 1), '/?[^/]*$', '') ELSE json_extract_string(x, '$.input.pattern') END])), lambda p: p LIKE '/%' AND length(p) > 1)) AS calls
  FROM (SELECT * FROM transcript_entries WHERE content LIKE '[{%' AND json_valid(content)))"""
_LINES = f"""{_CALLS}, lp AS (SELECT t.session_id, t.entry_id, t.line_no, unnest(CASE WHEN len(coalesce(calls, [])) > 0 THEN calls ELSE {_NAMED("content")} END) AS path FROM transcript_entries t LEFT JOIN tp USING (entry_id))"""
_GRADUATES = STORE_SQL["co_graduates"].removeprefix(f"WITH {E}, ")
_GRADUATES = f"{_GRADUATES[: _GRADUATES.rindex('SELECT id, max')]}, gr AS ({_GRADUATES[_GRADUATES.rindex('SELECT id, max') :]})".replace("LIMIT 10) ,", "LIMIT 10),")
_STAY = STORE_SQL["up_similar"]

SQL = {
    "src_markdown": r"""SELECT CASE doc_id % 4 WHEN 0 THEN 'notes' ELSE 'notes/deep' END AS folder, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents
WHERE doc_id % 4 < 2 AND regexp_matches(text, '[^ \t\n\r\x0b\f]') GROUP BY 1""",
    "src_log_lines": f"WITH {_MESSAGES} SELECT * FROM m WHERE entry_id % 50 <> 7",
    "src_states": """SELECT session_id, CASE WHEN n % 5 = 0 THEN 1 WHEN n % 2 = 0 THEN 0 ELSE n * 100 END AS "byteOffset", CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE last END AS BIGINT) AS "lastExtractedAt",
  CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE n END AS INTEGER) AS "messagesSinceExtraction", CASE WHEN n % 5 = 0 THEN 'spare' ELSE '' END AS "rollingSummary"
  FROM (SELECT session_id, count(*) AS n, max(line_no) AS last FROM transcript_entries WHERE session_id IS NOT NULL GROUP BY 1)""",
    "api_cards": f"""WITH {E}, {_GRADUATES} SELECT e.id, concat_ws(chr(10), '# ' || summary, CASE WHEN scope <> 'global' AND coalesce(project_path, '') <> '{HOME}' THEN 'from ' || coalesce(project, 'another project') END,
  'importance: ' || importance, nullif(trim(full_content, {_TRIM}), '')) AS card, CAST({NOW} AS BIGINT) AS accessed_at, CAST(access_count + 1 AS BIGINT) AS access_count FROM e JOIN gr USING (id)""",
    "flt_snapshot": f"""WITH {E}, v AS (SELECT * FROM e WHERE embedding IS NOT NULL), n AS (SELECT DISTINCT coalesce(project, '(none)') AS name FROM v UNION SELECT '(none)'),
x AS (SELECT name, v.id, row_number() OVER (PARTITION BY name ORDER BY accessed_at DESC, v.id) AS k FROM n JOIN v ON scope = 'global' OR v.project = name) SELECT name, id, CAST(k AS INTEGER) AS rank FROM x WHERE k <= 500""",
    "flt_session_ids": "SELECT coalesce(regexp_matches(session_id, '^[a-zA-Z0-9_-]+$'), false) AS allowed, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM (SELECT session_id FROM transcript_entries UNION ALL SELECT session_id FROM episodes) GROUP BY 1",
    "tx_line_paths": f"WITH {_LINES} SELECT session_id, path, count(*) AS n FROM lp WHERE line_no <= 200 GROUP BY 1, 2",
    "tx_named_paths": f"SELECT entry_id, unnest({_NAMED('content')}) AS path FROM transcript_entries",
    "tx_session_paths": f"WITH {E}, {_LINES} SELECT session_id, path FROM lp WHERE line_no <= 200 UNION SELECT session_id, unnest({_NAMED('full_content')}) FROM e",
    "tx_session_home": f"""WITH {_LINES}, w AS (SELECT session_id, arg_min(cwd, (line_no, entry_id)) AS cwd FROM transcript_entries WHERE line_no <= 10 AND cwd <> '' GROUP BY 1),
p AS (SELECT DISTINCT session_id, path FROM lp WHERE line_no <= 200 AND path LIKE '/%'), i AS (WITH {inferred_sql("session_id")})
SELECT s.session_id, coalesce(CASE WHEN cwd NOT IN (SELECT full_path FROM projects WHERE parent_project IS NULL) THEN cwd END, project) AS home
FROM (SELECT DISTINCT session_id FROM transcript_entries WHERE session_id IS NOT NULL) s LEFT JOIN w USING (session_id) LEFT JOIN i USING (session_id)""",
    "hier_batch_inferred": f"""WITH {_LINES}, p AS (SELECT DISTINCT session_id || '#' || (line_no - 1) // 40 AS batch, path FROM lp WHERE path LIKE '/%' AND session_id IS NOT NULL AND line_no IS NOT NULL), i AS (WITH {inferred_sql("batch")})
SELECT * FROM i WHERE n_paths >= 2""",
    "tx_log_tail": rf"""WITH l AS (SELECT doc_id, list_filter(string_split(right(text, 50000), chr(10)), lambda x: trim(x, {_TRIM}) <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(list_filter(l, lambda x: regexp_matches(x, 'WARN|ERROR|[Ff]ailed'))) AS INTEGER) AS n_failed, CAST(len(list_filter(l, lambda x: regexp_matches(x, '\b1463\b'))) AS INTEGER) AS n_code,
  sha256(array_to_string(l[greatest(len(l) - 19, 1):], chr(10))) AS tail FROM l WHERE len(l) > 0""",
    "tx_flushed": f"""WITH t AS ({STORE_SQL["tx_tail"]}), u AS (WITH {_MESSAGES} SELECT session_id, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM m GROUP BY 1)
SELECT session_id, n_chars, chr(10) || '## flushed' || chr(10) || chr(10) || tail || chr(10) AS section FROM t JOIN u USING (session_id) WHERE n_chars > 5000""",
    "tx_context_text": rf"""WITH {C}, t AS (SELECT project_path, id, path, updated_at, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), []) AS t FROM c WHERE project_path IS NOT NULL),
b AS (SELECT *, len(t) AS n, coalesce(sum(len(t)) OVER (PARTITION BY project_path ORDER BY updated_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT project_path, CAST(least(sum(n), 300) AS BIGINT) AS n_tokens, '# ' || split_part(project_path, '/', -1) || chr(10) || chr(10) ||
  string_agg('## ' || split_part(path, '/', -1) || chr(10) || array_to_string(t[1:300 - before], ' '), chr(10) || chr(10) ORDER BY before) AS text FROM b WHERE before < 300 AND n > 0 GROUP BY 1""",
    "tx_project_days": f"""WITH {E} SELECT project_path, {_DAY} AS day, count(*) AS n, count(DISTINCT summary) AS n_unique, arg_min(substring(summary, 1, 60), (created_at, id)) AS snippet FROM e WHERE project_path IS NOT NULL GROUP BY 1, 2""",
    "agg_session_notes": f"""WITH {E} SELECT session_id, {_DAY} AS day, string_agg(nullif(trim(full_content, {_TRIM}), ''), chr(10) || chr(10) ORDER BY created_at, id) AS notes FROM e GROUP BY 1, 2""",
    "agg_first_sentences": f"""WITH {E}, s AS (SELECT project_path, id, created_at, unnest(string_split(summary, '. ')) AS s, unnest(generate_series(0, len(string_split(summary, '. ')) - 1)) AS pos FROM e WHERE project_path IS NOT NULL),
t AS (SELECT *, trim(s, {_TRIM}) AS sentence FROM s) SELECT project_path, sentence, arg_min(id, (created_at, id, pos)) AS first_id, count(*) AS n FROM t WHERE sentence <> '' GROUP BY 1, 2""",
    "agg_checkpoint": f"WITH {E}, m AS (SELECT max(created_at) AS checkpoint FROM e WHERE graduated_at IS NOT NULL) SELECT checkpoint, count(*) FILTER (created_at > coalesce(checkpoint, 0)) AS n_after FROM e, m GROUP BY 1",
    "agg_tagged": rf"""WITH {E}, r AS (SELECT word, min(full_path) AS tag FROM (SELECT full_path, unnest(string_split(lower(name), '-')) AS word FROM projects) WHERE length(word) >= 4 GROUP BY 1),
w AS (SELECT id, project_path, unnest(list_distinct(regexp_extract_all(lower(summary), '[\p{{L}}\p{{N}}]+'))) AS word FROM e),
t AS (SELECT id, any_value(project_path) AS project_path, min(tag) AS tag FROM w JOIN r USING (word) GROUP BY 1) SELECT id, tag, project_path FROM t WHERE tag IS DISTINCT FROM project_path""",
    "up_applied": f"""WITH {E}, x AS (SELECT e.*, CASE WHEN created_at <= {NOW - 3 * DAY_MS} THEN scope WHEN project IS NULL OR project_path IN (SELECT full_path FROM projects WHERE parent_project IS NULL) THEN 'global' ELSE 'project' END AS eff,
  CASE WHEN len(embedding) = 128 AND list_dot_product(embedding, embedding) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM e),
p AS (SELECT n.id, s.id AS target, round(list_cosine_similarity(n.v, s.v), 9) AS similarity FROM x n JOIN x s ON n.eff = s.eff AND (n.eff = 'global' OR n.project IS NOT DISTINCT FROM s.project)
  WHERE n.created_at > {NOW - 3 * DAY_MS} AND s.created_at <= {NOW - 3 * DAY_MS} AND n.v IS NOT NULL AND s.v IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, target) AS k FROM p) WHERE k = 1),
d AS (SELECT x.*, CASE WHEN similarity > 0.92 THEN target END AS target FROM x LEFT JOIN b USING (id) WHERE created_at > {NOW - 3 * DAY_MS}),
u AS (SELECT target, list(summary ORDER BY created_at, id) AS ss, list(full_content ORDER BY created_at, id) AS cs, arg_max(entities, (created_at, id)) AS entities, arg_max(importance, (created_at, id)) AS importance, count(*) AS n FROM d WHERE target IS NOT NULL GROUP BY 1)
SELECT s.id, s.scope, list_reduce(list_concat([s.summary], ss), lambda a, c: CASE WHEN length(a || ' | ' || c) > 500 THEN c ELSE a || ' | ' || c END) AS summary,
  coalesce(right(trim(list_reduce(list_filter(list_concat([s.full_content], cs), lambda y: y IS NOT NULL), lambda a, c: right(trim(a || chr(10) || '---' || chr(10) || c), 4000))), 4000), '') AS full_content,
  CAST(s.access_count + n AS BIGINT) AS access_count, u.importance, n AS n_updates FROM u JOIN x s ON s.id = u.target WHERE len(list_filter(list_concat([s.full_content], cs), lambda y: y IS NOT NULL)) > 0
UNION ALL SELECT s.id, s.scope, list_reduce(list_concat([s.summary], ss), lambda a, c: CASE WHEN length(a || ' | ' || c) > 500 THEN c ELSE a || ' | ' || c END), '', CAST(s.access_count + n AS BIGINT), u.importance, n
  FROM u JOIN x s ON s.id = u.target WHERE len(list_filter(list_concat([s.full_content], cs), lambda y: y IS NOT NULL)) = 0
UNION ALL SELECT id, eff, summary, full_content, 0, importance, 0 FROM d WHERE target IS NULL""",
    "up_forgotten_ids": f"WITH {E}, {_GRADUATES} SELECT scope, count(*) AS n FROM e WHERE id NOT IN (SELECT id FROM gr) GROUP BY 1",
    "up_unlinked": f"""WITH {C} SELECT path, count(*) AS n FROM c WHERE path IN (SELECT path FROM c WHERE split_part(path, '/', -1) = 'MEMORY.md' UNION SELECT path FROM documents) GROUP BY 1""",
    "co_saved": f"""WITH {E}, {C}, {_GRADUATES}, n AS (SELECT e.id, project_path, created_at, trim(summary, {_TRIM}) AS content FROM e JOIN gr USING (id) WHERE project_path IS NOT NULL),
s AS (SELECT id, project_path, created_at, chr(10) || '## ' || strftime(make_timestamp(created_at * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || chr(10) || content || chr(10) AS section FROM n
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project_path = n.project_path AND split_part(c.path, '/', -1) = 'MEMORY.md' AND contains(c.text, n.content))),
b AS (SELECT *, coalesce(sum(len(string_split(section, chr(10)))) OVER (PARTITION BY project_path ORDER BY created_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT id, project_path, section FROM b WHERE before < 40""",
    "st_replaced_files": f"""WITH {C}, n AS (SELECT regexp_replace(path, '[^/]+$', 'MEMORY.md') AS path, CASE WHEN doc_id % 7 > 0 THEN length(text) END AS n FROM documents WHERE text IS NOT NULL)
SELECT path, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_chars FROM (SELECT path, length(text) AS n FROM c WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT * FROM n WHERE n IS NOT NULL) GROUP BY 1""",
    "st_topic_gate": RETRIEVAL_SQL["ir_topic_change"].replace("SELECT * FROM x WHERE", "SELECT session_id, id FROM x WHERE"),
}
