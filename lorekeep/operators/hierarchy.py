"""The project forest: closure, roots, nearest ancestors by path, roll-ups, and which project a set of paths belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.operators.skew import if_small
from lorekeep.session import written

#: Rounds that follow parents; a deeper forest is refused.
DEEPEST = 64


def ancestors(projects: DataFrame) -> DataFrame:
    """(full_path, ancestor, depth): every project with itself (0) and all projects above it.

    Follows ``parent_project`` level by level; a parent that doesn't exist ends the way, and so does one that was passed
    already, so that cycles end. One small join per level, not one per project; every level is written down, so none is worked out twice.
    """
    links = projects.select("full_path", "parent_project").distinct()
    known = links.select(F.col("full_path").alias("ancestor"), F.col("parent_project").alias("next"))
    level = links.select("full_path", F.col("full_path").alias("ancestor"), F.lit(0).alias("depth"), F.array("full_path").alias("way"), F.col("parent_project").alias("up"))
    out = None
    for _ in range(DEEPEST):
        level = written(level)
        if not level.limit(1).count():
            return out.groupBy("full_path", "ancestor").agg(F.min("depth").alias("depth")) if out is not None else level.select("full_path", "ancestor", "depth")
        out = level.select("full_path", "ancestor", "depth") if out is None else out.unionByName(level.select("full_path", "ancestor", "depth"))
        above = level.where("up IS NOT NULL AND NOT array_contains(way, up)").join(known.withColumnRenamed("ancestor", "up"), "up")
        level = above.select("full_path", F.col("up").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("way", F.array("up")).alias("way"), F.col("next").alias("up"))
    raise ValueError(f"the forest is deeper than {DEEPEST} levels")


def roots(projects: DataFrame) -> DataFrame:
    """(full_path, root): the topmost project above each."""
    return ancestors(projects).groupBy("full_path").agg(F.max_by("ancestor", F.struct("depth", "ancestor")).alias("root"))


def families(projects: DataFrame) -> DataFrame:
    """(name, family): for each project name the sorted paths of the projects so called and of all below them."""
    below = ancestors(projects).select("full_path", F.col("ancestor").alias("top"))
    return projects.select("name", F.col("full_path").alias("top")).join(below, "top").groupBy("name").agg(F.sort_array(F.collect_set("full_path")).alias("family"))


def prefixes(path: Column) -> Column:
    """All proper directory prefixes of a path, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def nearest(paths: DataFrame, projects: DataFrame, path_col: str, itself: bool = False) -> DataFrame:
    """(path_col, project): the project with the longest path above each distinct path; null if there is none.

    An equi-join on the exploded prefixes, so that no pair of path and project is tried that can't match.
    """
    each = paths.select(path_col).where(F.col(path_col).isNotNull()).distinct()
    above = prefixes(F.col(path_col))
    above = F.concat(above, F.array(path_col)) if itself else above
    found = each.select(path_col, F.explode(above).alias("project")).join(projects.select(F.col("full_path").alias("project")).distinct(), "project", "left_semi")
    best = found.groupBy(path_col).agg(F.max_by("project", F.length("project")).alias("project"))
    return each.join(best, path_col, "left")


def rolled_up(counts: DataFrame, projects: DataFrame) -> DataFrame:
    """(root, n): counts by ``project_path`` added up at the topmost project; unknown paths stand for themselves."""
    r = if_small(roots(projects).withColumnRenamed("full_path", "project_path"))
    return counts.join(r, "project_path", "left").groupBy(F.coalesce("root", "project_path").alias("root")).agg(F.sum("n").alias("n"))


def inferred(paths: DataFrame, projects: DataFrame, group: str, path_col: str, share: float = 0.6, shallow: int = 3) -> DataFrame:
    """(group, project, n_paths, votes): the project of each group's distinct absolute paths.

    Fewer than two paths: null. If the longest common directory lies in a known project that isn't a root (``shallow``
    segments or fewer), that one; else the most frequent nearest project, equal counts by path, if it has at least
    ``share`` of the paths.
    """
    p = paths.where(F.col(path_col).startswith("/")).select(group, path_col).distinct()
    n = p.groupBy(group).agg(F.count(F.lit(1)).alias("n_paths"))
    near = nearest(p, projects, path_col)
    votes = p.join(near, path_col).where(F.col("project").isNotNull()).groupBy(group, "project").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(group).agg(F.max_by(F.struct("project", "votes"), F.struct("votes", F.col("project"))).alias("b"))
    # a directory is common to all paths if as many paths as there are have it above them
    common = p.select(group, F.explode(prefixes(F.col(path_col))).alias("dir")).groupBy(group, "dir").agg(F.count(F.lit(1)).alias("k"))
    common = common.join(n, group).where("k = n_paths").groupBy(group).agg(F.max_by("dir", F.length("dir")).alias("dir"))
    home = nearest(common, projects, "dir", itself=True).withColumnRenamed("project", "home")
    home = common.join(home, "dir").where(F.size(F.split("home", "/")) > shallow).select(group, "home")
    out = n.join(best, group, "left").join(home, group, "left")
    voted = F.when(F.col("b.votes") >= F.col("n_paths") * share, F.col("b.project"))
    return out.select(group, F.when(F.col("n_paths") >= 2, F.coalesce("home", voted)).alias("project"), "n_paths", F.coalesce("b.votes", F.lit(0).cast("bigint")).alias("votes"))
