"""Files through their names: change rows with the file that a path was at the time.

A path's life is cut into spans by renames: one begins when a file is renamed to the path,
and one ends when its file is renamed away, so that what is changed under the old name after
that is another file.  A span that a rename began goes on from a span of the old path; these
steps are a forest, and pointer doubling leads each span to its root, the file's first name,
in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.asof import asof_join
from loomgraph.sources.shared import written


@dataclass(frozen=True)
class Moves:
    """Columns (names or SQL expressions) of change rows. old_path: of a rename, else null or empty."""

    path: str = "path"
    old_path: str = "old_path"
    commit: str = "hash"
    ts: str = "committed_at"


#: Within a commit files leave their names first, then take others, then are changed.
_LOOK, _OUT, _IN, _CHANGE = range(-1, 3)


def followed(changes: DataFrame, moves: Moves = Moves(), parts: int | None = None) -> DataFrame:
    """changes with file and last_name: the file that the row's path was, and its last path. A file is
    named by its first path and, where that path had been another file's, by an @ and the commit
    in which that one left it.

    Commits are in the order of ts and commit. A rename onto a path that is there ends the file
    that was; names swapped in one commit are swapped. Of several renames to one path in a commit
    one counts. Rows without path, commit or time are files of their own, named null. Other
    columns are carried along; their names must not be `file`, `last_name` and `span_row`."""
    path, old, commit, ts = (F.expr(x) for x in (moves.path, moves.old_path, moves.commit, moves.ts))
    when = lambda kind: F.struct(ts.alias("ts"), commit.cast("string").alias("commit"), F.lit(kind).alias("kind"))
    renamed = old.isNotNull() & (old.cast("string") != "")
    moved = changes.where(renamed & path.isNotNull() & commit.isNotNull() & ts.isNotNull())
    text = lambda c: c.cast("string")
    came = moved.select(text(path).alias("at_path"), when(_IN).alias("at"), text(old).alias("came_from")).groupBy("at_path", "at").agg(F.min("came_from").alias("came_from"))
    left = moved.select(text(old).alias("at_path"), when(_OUT).alias("at"), F.lit(None).cast("string").alias("came_from")).distinct()
    cuts = written(came.unionByName(left), "cuts")
    cuts = written(cuts.withColumn("span", F.concat_ws("\x01", "at_path", "at.commit", F.col("at.kind").cast("string"))), "spans")
    first = lambda p: F.concat_ws("\x01", p, F.lit(""))
    keys = lambda p: {"path": (p, F.col("at_path"))}
    span_of = lambda p: F.coalesce("match.span", first(p))
    # each span that a rename began goes on from the old path's span just before that
    look = cuts.where("came_from IS NOT NULL").select("span", "came_from", F.struct(F.col("at.ts").alias("ts"), F.col("at.commit").alias("commit"), F.lit(_LOOK).alias("kind")).alias("look"))
    parents = asof_join(look, cuts, keys(F.col("came_from")), (F.col("look"), F.col("at")), parts=parts).select("span", span_of(F.col("came_from")).alias("up"))
    up = written(parents, "parents")
    while True:
        above = up.select(F.col("span").alias("up"), F.col("up").alias("next"))
        now = written(up.join(above, "up", "left").select("span", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "parents")
        done = now.where("moved").isEmpty()
        up = now.drop("moved")
        if done:
            break
    # the last path of a file is that of its last span
    ended = cuts.where("came_from IS NOT NULL").select("span", "at_path", "at").join(up, "span").groupBy("up").agg(F.max_by("at_path", "at").alias("last_name")).withColumnRenamed("up", "root")
    # a rename's row is of the span that it began
    rows = changes.withColumn("span_row", when(_CHANGE))
    placed = asof_join(rows, cuts, keys(text(path)), (F.when(ts.isNotNull() & commit.isNotNull(), F.col("span_row")), F.col("at")), parts=parts)
    placed = placed.withColumn("span", span_of(text(path))).drop("match", "span_row")
    placed = placed.join(up, "span", "left").withColumn("root", F.coalesce("up", "span")).drop("up", "span").join(ended, "root", "left")
    begun = F.split("root", "\x01")
    number = F.when(begun[1] == "", F.lit("")).otherwise(F.concat(F.lit("@"), begun[1]))
    known = path.isNotNull() & ts.isNotNull() & commit.isNotNull()
    return placed.withColumn("file", F.when(known, F.concat(begun[0], number))).withColumn("last_name", F.when(known, F.coalesce("last_name", begun[0]))).select(*changes.columns, "file", "last_name")
