"""Changes that keep arriving: taken in once, and summed up by file as they come.

Both streams hold what they know of the past in keyed state beside their checkpoint, so that
what a batch reads is the batch alone, however large the tables have become.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.evolution import Roles
from loomgraph.sources.files import Files


def append_changes(changes: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = ("hash", "path"), at: str | None = None, delay: str | None = None) -> StreamingQuery:
    """Appends a stream of change rows to a Parquet table, each key once; of different rows with one
    key that arrive in one batch one stays, of those of several batches the first. Null keys are
    keys too.

    The state holds the keys seen. With at (a time column) and delay it lets go of keys that are
    older than the newest row by more than that, and a row that late is not taken in; the
    query's progress says how many there were. Files are listed in the table's log when a batch
    is done, so a batch that comes again after a crash adds nothing."""
    if (at is None) != (delay is None):
        raise ValueError("at and delay go together")
    once = changes.dropDuplicates(list(keys)) if at is None else changes.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
    return once.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summarise_changes(changes: DataFrame, table: str, checkpoint: str, roles: Roles = Roles()) -> StreamingQuery:
    """Keeps path, commit_count, churn and last_commit_at of each path up to date: a batch writes the
    paths that it has changed, as a folder of its own that it writes again if it comes again. Rows
    may come in any order and as late as they like; each counts, so repeated ones must be gone
    (append_changes)."""
    sums = changes.groupBy(F.expr(roles.path).alias("path")).agg(F.count("*").alias("commit_count"), F.sum(F.expr(roles.churn)).alias("churn"), F.max(F.expr(roles.ts)).alias("last_commit_at"))

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return sums.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries(spark: SparkSession, table: str) -> DataFrame:
    """The latest summary of each path; raises where nothing was summed up yet."""
    rows = spark.read.option("basePath", table).parquet(table)
    rest = [c for c in rows.columns if c not in ("path", "batch")]
    return rows.groupBy("path").agg(F.max_by(F.struct(*rest), "batch").alias("row")).select("path", "row.*")


def fold_summaries(spark: SparkSession, table: str, keep: int = 20) -> int:
    """Writes the latest summaries over the folders of all but the last batches, in one; for a time
    when no batch runs. Returns how many folders went."""
    files = Files(spark, table)
    numbers = sorted(int(n.split("=")[1]) for n, _, _ in files.names("") if n.startswith("batch="))
    old = numbers[:-keep] if keep else numbers
    if len(old) < 2:
        return 0
    rows = spark.read.option("basePath", table).parquet(*[f"{table}/batch={n}" for n in old])
    rest = [c for c in rows.columns if c not in ("path", "batch")]
    rows.groupBy("path").agg(F.max_by(F.struct(*rest), "batch").alias("row")).select("path", "row.*").write.mode("overwrite").parquet(f"{table}/_folding")
    spark.read.parquet(f"{table}/_folding").write.mode("overwrite").parquet(f"{table}/batch={old[-1]}")
    for n in old[:-1]:
        files.delete(f"batch={n}")
    files.delete("_folding")
    return len(old) - 1
