"""Changes to stored tables: replacing, merging and similarity upserts; each gives the new state as a DataFrame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import written

#: A block of candidates, and one of the store, has about as many rows.
BLOCK_ROWS = 4_096


def replaced(store: DataFrame, new: DataFrame, key: str, instead: DataFrame | None = None) -> DataFrame:
    """The store with all rows of the keys in ``new`` replaced by ``new``, or by the rows ``instead``."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new if instead is None else instead)


def merged(store: DataFrame, new: DataFrame, key: str, overwrite: list[str], keep: list[str]) -> DataFrame:
    """Insert or update by key: ``overwrite`` columns take the new value, ``keep`` columns the stored one where there is one."""
    s, n = store.alias("s"), new.alias("n")
    pick = lambda c, a, b: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full").select(pick(key, "s", "n"), *[pick(c, "n", "s") for c in overwrite], *[pick(c, "s", "n") for c in keep])


def effective_scope(scope: Column, project: Column, is_root: Column) -> Column:
    """Within a project that isn't a root everything is of the project, elsewhere everything is global."""
    return F.when(project.isNull() | is_root, F.lit("global")).otherwise(F.lit("project"))


def _unit_rows(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows aren't all zero, their vectors scaled to length 1)."""
    x = np.stack(vectors.to_list()).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    return norm > 0, x[norm > 0] / norm[norm > 0, None]


def _met(candidates: DataFrame, store: DataFrame, dim: int, above: float | None) -> DataFrame:
    """(id, match, similarity) of pairs of the same scope and project: of each two blocks each candidate's best, or all of a similarity over ``above``, but no row with itself."""

    def rows(df: DataFrame) -> DataFrame:
        project = F.when(F.col("scope") != "global", F.col("project"))
        return df.where((F.size("embedding") == dim) & F.col("scope").isNotNull()).select("id", "scope", project.alias("project"), "embedding")

    c, s = rows(candidates), rows(store)
    count = lambda df, name: df.groupBy("scope", "project").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    a, b = count(c, "n_c").alias("a"), count(s, "n_s").alias("b")
    kinds = a.join(b, F.col("a.scope").eqNullSafe(F.col("b.scope")) & F.col("a.project").eqNullSafe(F.col("b.project"))).select(F.col("a.scope").alias("k_scope"), F.col("a.project").alias("k_project"), "n_c", "n_s")

    def spread(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        on = F.col("scope").eqNullSafe(F.col("k_scope")) & F.col("project").eqNullSafe(F.col("k_project"))
        return df.join(kinds, on).select("scope", "project", at, each, F.lit(side).alias("side"), "id", "embedding").select("scope", "project", "n_c", "n_s", "side", "id", "embedding")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        new, old = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
        out = pd.DataFrame({"id": pd.Series([], dtype=object), "match": pd.Series([], dtype=object), "similarity": pd.Series([], dtype="float64")})
        if not len(new) or not len(old):
            return out
        (some, x), (others, y) = _unit_rows(new["embedding"], dim), _unit_rows(old["embedding"], dim)
        if not len(x) or not len(y):
            return out
        sims = np.round(x @ y.T, 9)
        ids, matches = new["id"].to_numpy()[some], old["id"].to_numpy()[others]
        at, k = (np.arange(len(x)), sims.argmax(1)) if above is None else np.nonzero((sims > above) & (ids[:, None] != matches))
        return pd.DataFrame({"id": ids[at], "match": matches[k], "similarity": sims[at, k]})

    both = spread(c, "n_c", "n_s", 0).unionByName(spread(s, "n_s", "n_c", 1))
    return both.groupBy("scope", "project", "n_c", "n_s").applyInPandas(meet, "id string, match string, similarity double")


def best_matches(candidates: DataFrame, store: DataFrame, dim: int, most: int | None = None) -> DataFrame:
    """(id, match, similarity): for each candidate the most similar stored row of the same scope and project.

    Both have (id, scope, project, embedding). Candidates and store are spread over blocks of each scope and project by the
    hashes of their ids; each block of candidates meets each block of the store in a group of its own, and the best of the groups is
    kept. No number of candidates is refused, unless ``most`` says so. Similarities are rounded to 9 digits; of equal
    ones the smallest id is taken. Rows without a usable vector match none.
    """
    if most is not None and candidates.where(F.size("embedding") == dim).limit(most + 1).count() > most:
        raise ValueError(f"a batch has at most {most} candidates")
    top = _met(candidates, store, dim, None).groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match")).alias("b"))
    return top.select("id", F.col("b.match").alias("match"), (-F.col("b.s")).alias("similarity"))


def decided_in_turn(candidates: DataFrame, store: DataFrame, dim: int, order: str, above: float = 0.92) -> DataFrame:
    """(id, action, target, similarity) like :func:`decided`, candidates coming one after the other by (``order``, id): what one adds, those after it can update.

    A candidate is decided when all earlier ones similar to it are, all such candidates at once, so the number of rounds is the longest
    chain of similar candidates. Vectors count as they came.
    """
    own = candidates.select("id", F.struct(order, "id").alias("turn"))
    pairs = _met(candidates, candidates, dim, above).join(own, "id").join(own.select(F.col("id").alias("match"), F.col("turn").alias("before")), "match")
    pairs = written(pairs.where("before < turn").select("id", "match", "similarity"))
    stored = best_matches(candidates, store, dim).where(F.col("similarity") > above)
    # an undecided candidate has a null action; ``best`` is its best match so far
    none = F.lit(None).cast("struct<s: double, match: string>")
    found = stored.select("id", F.struct((-F.col("similarity")).alias("s"), "match").alias("best"))
    state = written(candidates.select("id").join(found, "id", "left").select("id", F.lit(None).cast("string").alias("action"), "best"))
    while state.where("action IS NULL").limit(1).count():
        earlier = pairs.join(state.select(F.col("id").alias("match"), F.col("action").alias("theirs")), "match")
        option = F.when(F.col("theirs") == "add", F.struct((-F.col("similarity")).alias("s"), "match"))
        earlier = earlier.groupBy("id").agg(F.count_if(F.col("theirs").isNull()).alias("waits"), F.min(F.coalesce(option, none)).alias("added"))
        now = state.join(earlier, "id", "left")
        ready = F.col("action").isNull() & (F.coalesce("waits", F.lit(0)) == 0)
        best = F.when(ready, F.coalesce(F.least("best", "added"), F.col("best"), F.col("added"))).otherwise(F.col("best"))
        now = now.select("id", F.when(ready, F.when(best.isNull(), "add").otherwise("update")).otherwise(F.col("action")).alias("action"), best.alias("best"))
        state = written(now)
    return state.select("id", "action", F.col("best.match").alias("target"), (-F.col("best.s")).alias("similarity"))


def decided(candidates: DataFrame, matches: DataFrame, above: float = 0.92) -> DataFrame:
    """(id, action, target, similarity): update the match where its similarity exceeds ``above``, else add."""
    c = candidates.select("id").join(matches, "id", "left")
    hit = F.coalesce(F.col("similarity") > above, F.lit(False))
    return c.select("id", F.when(hit, "update").otherwise("add").alias("action"), F.when(hit, F.col("match")).alias("target"), "similarity")


def applied(candidates: DataFrame, store: DataFrame, decisions: DataFrame, order: list[str]) -> DataFrame:
    """(id, scope, summary, full_content, access_count, importance, n_updates) of the rows that a batch changes or adds, as :func:`decided`.

    Candidates with one target are applied in ``order``, each as :func:`updated` says; every one counts as a use, and the last gives the
    importance. An added row has no uses.
    """
    c = candidates.select("id", *[x for x in order if x != "id"], "scope", "summary", "full_content", "importance").join(decisions.select("id", "target"), "id")
    c_of = F.struct(*order, "summary", "full_content", "importance")
    steps = c.where("target IS NOT NULL").groupBy("target").agg(F.sort_array(F.collect_list(c_of)).alias("steps"))

    def step(row: Column, new: Column) -> Column:
        summary, content = updated(row["summary"], new["summary"], row["content"], new["full_content"])
        return F.struct(summary.alias("summary"), content.alias("content"))

    s = store.withColumnRenamed("id", "target").select("target", "scope", "summary", "full_content", "access_count").join(steps, "target")
    s = s.withColumn("row", F.aggregate("steps", F.struct("summary", F.col("full_content").alias("content")), step))
    n = F.size("steps").cast("bigint")
    changed = s.select(F.col("target").alias("id"), "scope", "row.summary", F.col("row.content").alias("full_content"), (F.col("access_count") + n).cast("bigint").alias("access_count"), F.element_at("steps", -1)["importance"].alias("importance"), n.alias("n_updates"))
    zero = F.lit(0).cast("bigint")
    return changed.unionByName(c.where("target IS NULL").select("id", "scope", "summary", "full_content", zero.alias("access_count"), "importance", zero.alias("n_updates")))


def updated(old_summary: Column, new_summary: Column, old_content: Column, new_content: Column) -> tuple[Column, Column]:
    """(summary, content) of a row after an update: summaries joined unless that exceeds 500 characters, contents joined and cut to the last 4,000."""
    both = F.concat(old_summary, F.lit(" | "), new_summary)
    content = F.trim(F.concat_ws("\n---\n", old_content, new_content))
    return F.when(F.length(both) > 500, new_summary).otherwise(both), F.substring(content, F.greatest(F.length(content) - 3999, F.lit(1)), F.lit(4000))
