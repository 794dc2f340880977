"""How files change: churn, coupling, ownership, recency, and their summary.

The operators take change rows (a row a commit and file) and the names of the columns
that play the parts, so that any table with these parts will do.  None reads the clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions.expr import HALF_LIFE_DAYS, age_days, decay
from loomgraph.sources.shared import written


@dataclass(frozen=True)
class Roles:
    """Columns (names or SQL expressions) of change rows."""

    path: str = "path"
    commit: str = "hash"
    author: str = "author_email"
    ts: str = "committed_at"
    churn: str = "additions + deletions"


def churn(changes: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """path, commits, churn, last_touched; the most changed first."""
    return (
        changes.groupBy(F.expr(roles.path).alias("path"))
        .agg(F.count("*").alias("commits"), F.sum(F.expr(roles.churn)).alias("churn"), F.max(F.expr(roles.ts)).alias("last_touched"))
        .orderBy(F.col("churn").desc(), "path")
    )


#: Paths of a commit in one block of its self-join.
COUPLED = 2_000
#: Rows, and pairs, that one task of a coupling holds, about.
SHARE = 1_000_000


def _shares(n: int | None, share: int) -> int:
    return max(1, -(-(n or 0) // share))


def coupling(changes: DataFrame, roles: Roles = Roles(), min_support: int = 2, block: int = COUPLED, share: int = SHARE) -> DataFrame:
    """file_a < file_b, support (pairs of rows in the same commits), conf_a_to_b, conf_b_to_a
    (support over the distinct commits of either); the best supported first.

    Rows are added up to one a commit and path before the self-join: a path that a commit
    holds twice doubles a product instead of the pairs. The paths of a commit with more than
    `block` are dealt to blocks, and each pair of blocks is a join key of its own, so that no
    task holds all pairs of a large commit. Rows and pairs are counted first and dealt to as
    many tasks as hold about `share` of them each, whatever the session's number of shuffle
    partitions."""
    change = changes.select(F.expr(roles.commit).alias("commit"), F.expr(roles.path).alias("path"))
    parts = _shares(change.count(), share)
    rows = written(change.repartition(parts, "commit", "path").groupBy("commit", "path").agg(F.count("*").alias("n")), "rows")
    sizes, seen = rows.select("commit").repartition(parts, "commit").groupBy("commit").agg(F.count("*").alias("size")), Observation()
    sizes = sizes.observe(seen, F.sum(F.expr("size * (size - 1) div 2")).alias("pairs"))
    large = written(sizes.where(F.col("size") > block).select("commit", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large")
    parts = max(parts, _shares(seen.get["pairs"], share))
    dealt = rows.join(large, "commit", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = dealt.select("commit", F.col("own").alias("block_a"), every.alias("block_b"), F.col("path").alias("file_a"), F.col("n").alias("na"))
    b = dealt.select("commit", every.alias("block_a"), F.col("own").alias("block_b"), F.col("path").alias("file_b"), F.col("n").alias("nb"))
    keys = ["commit", "block_a", "block_b"]
    joined = a.repartition(parts, *keys).join(b.repartition(parts, *keys), keys).where("file_a < file_b").select("file_a", "file_b", (F.col("na") * F.col("nb")).alias("support"))
    pairs = joined.repartition(parts, "file_a", "file_b").groupBy("file_a", "file_b").agg(F.sum("support").alias("support"))
    totals = rows.select("path").repartition(parts, "path").groupBy("path").agg(F.count("*").alias("commits"))
    pairs = pairs.where(F.col("support") >= min_support)
    out = pairs.join(totals.select(F.col("path").alias("file_a"), F.col("commits").alias("ta")), "file_a")
    out = out.join(totals.select(F.col("path").alias("file_b"), F.col("commits").alias("tb")), "file_b")
    share = lambda t: F.round(F.col("support") / F.col(t), 3)
    out = out.select("file_a", "file_b", "support", share("ta").alias("conf_a_to_b"), share("tb").alias("conf_b_to_a"))
    return out.orderBy(F.col("support").desc(), F.greatest("conf_a_to_b", "conf_b_to_a").desc(), "file_a", "file_b")


def ownership(changes: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """path, top_author (ties: the first by name), top_author_share, total_commits."""
    by_author = changes.groupBy(F.expr(roles.path).alias("path"), F.expr(roles.author).alias("author")).agg(F.count("*").alias("cnt"))
    out = by_author.groupBy("path").agg(F.min(F.struct((-F.col("cnt")).alias("less"), "author")).alias("top"), F.sum("cnt").alias("total_commits"))
    share = F.round(-F.col("top.less") / F.col("total_commits"), 3)
    return out.select("path", F.col("top.author").alias("top_author"), share.alias("top_author_share"), "total_commits").orderBy(F.col("top_author_share").desc(), "path")


def recency(changes: DataFrame, as_of: Column, roles: Roles = Roles(), half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """path, last_touched, age_days, recency_score; the most recent first."""
    last = changes.groupBy(F.expr(roles.path).alias("path")).agg(F.max(F.expr(roles.ts)).alias("last_touched"))
    out = last.withColumn("age_days", age_days(F.col("last_touched"), as_of))
    return out.withColumn("recency_score", F.round(decay(F.col("age_days"), half_life_days), 4)).orderBy(F.col("recency_score").desc(), "path")


def file_evolution(changes: DataFrame, as_of: Column, version: int, roles: Roles = Roles(), half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """One row a path: commit_count, churn, last_commit_at, top_author, top_author_share,
    recency_score (both 32-bit, not rounded), version.

    Two levels of aggregation, by (path, author) and by path, give what a window over each
    author's rows would, without sorting the rows."""
    by_author = changes.groupBy(F.expr(roles.path).alias("path"), F.expr(roles.author).alias("author")).agg(F.count("*").alias("cnt"), F.sum(F.expr(roles.churn)).alias("churn"), F.max(F.expr(roles.ts)).alias("ts"))
    out = by_author.groupBy("path").agg(F.sum("cnt").alias("commit_count"), F.sum("churn").alias("churn"), F.max("ts").alias("last_commit_at"), F.min(F.struct((-F.col("cnt")).alias("less"), "author")).alias("top"))
    return out.select(
        "path", "commit_count", "churn", "last_commit_at", F.col("top.author").alias("top_author"),
        (-F.col("top.less") / F.col("commit_count")).cast("float").alias("top_author_share"),
        decay(age_days(F.col("last_commit_at"), as_of), half_life_days).cast("float").alias("recency_score"), F.lit(version).cast("long").alias("version"),
    )


def with_author_counts(changes: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """changes with cnt_by_author: rows of the same path and author. Counts are aggregated and joined
    back, so that a pair with very many rows is no task of its own."""
    pair = changes.select("*", F.expr(roles.path).alias("_path"), F.expr(roles.author).alias("_author"))
    counts = pair.groupBy("_path", "_author").agg(F.count("*").alias("cnt_by_author")).toDF("_p", "_a", "cnt_by_author")
    same = F.col("_path").eqNullSafe(F.col("_p")) & F.col("_author").eqNullSafe(F.col("_a"))
    return pair.join(counts, same).select(*changes.columns, "cnt_by_author")


def distinct_commits(changes: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """path, commits: exact distinct counts."""
    return changes.groupBy(F.expr(roles.path).alias("path")).agg(F.count_distinct(F.expr(roles.commit)).alias("commits"))
