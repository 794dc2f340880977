"""Sums along the tree of paths, and sketches of them that merge over time.

A folder's sums are those of all files below it.  Changes are added up by file, commit and
author before they are handed to the folders above, and the folders' rows are dealt by folder
and commit first, so that the root, which has all rows, is as many tasks' work as any other.

Sketches hold distinct commits and authors of a path in a period in a few kilobytes at most;
those of any range of periods are merged without a look at the changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.evolution import Roles

#: log2 of a sketch's registers. The relative standard error of its counts is 1.04 / sqrt(2**PRECISION).
PRECISION = 12


def folders(path: Column) -> Column:
    """The folders above a path, from the root, which is empty, downwards. A leading slash makes no
    folder of its own."""
    parts = F.array_remove(F.split(path, "/", -1), "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def folder_evolution(changes: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """folder, depth, files, commits (distinct ones), changes, churn, top_author (by changes; ties: the
    first by name), top_author_share of each folder. Rows without a path belong to none; a null
    commit or author is one of its own, though no null commit is counted."""
    parts = changes.select(F.expr(roles.path).cast("string").alias("path"), F.expr(roles.commit).alias("commit"), F.expr(roles.author).alias("author"), F.expr(roles.churn).alias("churn")).where("path IS NOT NULL")
    files = parts.groupBy("path", "commit", "author").agg(F.count("*").alias("n"), F.sum("churn").alias("churn"))
    each = files.select(F.explode(folders(F.col("path"))).alias("folder"), "commit", "author", "n", "churn").groupBy("folder", "commit", "author").agg(F.sum("n").alias("n"), F.sum("churn").alias("churn"))
    owners = each.groupBy("folder", "author").agg(F.sum("n").alias("n"), F.sum("churn").alias("churn"))
    owners = owners.groupBy("folder").agg(F.sum("n").alias("changes"), F.sum("churn").alias("churn"), F.min(F.struct((-F.col("n")).alias("less"), "author")).alias("top"))
    commits = each.where("commit IS NOT NULL").select("folder", "commit").distinct().groupBy("folder").agg(F.count("*").alias("commits"))
    held = files.select("path").distinct().select(F.explode(folders(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))
    out = owners.join(held, "folder").join(commits, "folder", "left")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    share = F.round(-F.col("top.less") / F.col("changes"), 3)
    return out.select("folder", depth.alias("depth"), "files", F.coalesce("commits", F.lit(0)).alias("commits"), "changes", "churn", F.col("top.author").alias("top_author"), share.alias("top_author_share"))


def sketched(changes: DataFrame, period: Column, roles: Roles = Roles(), precision: int = PRECISION) -> DataFrame:
    """path, period, changes, churn, commits and authors (sketches) of each path and period: a table to
    keep, to which further periods are added."""
    rows = changes.select(F.expr(roles.path).alias("path"), period.alias("period"), F.expr(roles.commit).cast("string").alias("commit"), F.expr(roles.author).cast("string").alias("author"), F.expr(roles.churn).alias("churn"))
    return rows.groupBy("path", "period").agg(F.count("*").alias("changes"), F.sum("churn").alias("churn"), F.hll_sketch_agg("commit", precision).alias("commits"), F.hll_sketch_agg("author", precision).alias("authors"))


def over_periods(sketches: DataFrame, first: Column | None = None, last: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """path (or by), changes, churn, commits, authors over the periods from first to last (both
    included; None: no end): sums are exact, distinct numbers are the merged sketches' estimates."""
    rows = sketches
    if first is not None:
        rows = rows.where(F.col("period") >= first)
    if last is not None:
        rows = rows.where(F.col("period") <= last)
    merged = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    return rows.groupBy(*(by or ["path"])).agg(F.sum("changes").alias("changes"), F.sum("churn").alias("churn"), merged("commits"), merged("authors"))
