r"""A repository's history as a data source of commits.

`spark.read.format("git_history")` reads the log in ranges of commits, one a partition, each
by a git of its own where the partition is read; the driver only counts the commits. The
repository must be mounted at the same place on every executor.  The log comes in git's
NUL-separated form (-z), in which a rename gives both of its paths as fields of their own
and no path is quoted.
"""

from __future__ import annotations

import itertools
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.session import ship

COMMIT = (
    "hash string, author_name string, author_email string, committed_at timestamp, message string, "
    "changes array<struct<path: string, old_path: string, additions: bigint, deletions: bigint, is_rename: boolean>>"
)
#: Commits a partition, at least.
RANGE = 2_000
#: Partitions a core, at most: each walks past the commits before its own, so their number must not grow with the history.
RANGES = 4
_LOG = ("log", "--no-merges", "-M", "-z")


def git(root: str | Path, *args: str, env: dict[str, str] | None = None) -> str:
    """What a git command prints; raises if it fails."""
    done = subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)
    return done.stdout.decode(errors="replace")


def tracked_files(root: str | Path, pattern: str = "*.py") -> list[str]:
    return [name for name in git(root, "ls-files", "-z", pattern).split("\0") if name]


def _changes(fields: Iterator[str]) -> Iterator[tuple]:
    """(path, old path, additions, deletions, whether a rename) from a commit's fields; counts of
    binary files, which git gives as -, are 0."""
    for field in fields:
        if not field:
            continue
        added, removed, path = field.lstrip("\n").split("\t", 2)
        # an empty path announces a rename: the next two fields are its sides
        old, new = ("", path) if path else (next(fields), next(fields))
        yield new, old, *(0 if n == "-" else int(n) for n in (added, removed)), not path


def streamed(root: str | Path, *args: str, mark: bytes) -> Iterator[bytes]:
    """What a git command prints, cut at each mark, as it comes; raises if the command fails."""
    with subprocess.Popen(["git", "-C", str(root), *args], stdout=subprocess.PIPE) as run:
        rest = b""
        while part := run.stdout.read(1 << 20):
            *whole, rest = (rest + part).split(mark)
            yield from whole
        yield rest
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, "git")


def commits(root: str | Path, *which: str) -> Iterator[tuple]:
    """The commits that a log lists, as rows of COMMIT."""
    for raw in itertools.islice(streamed(root, *_LOG, *which, "--numstat", "--format=%x01%H%x02%an%x02%ae%x02%at%x02%s", mark=b"\x01"), 1, None):
        record = raw.decode(errors="replace")
        head, *fields = record.split("\0")
        name, author, email, at, message = head.split("\x02", 4)
        yield name, author, email, datetime.fromtimestamp(int(at), timezone.utc), message, list(_changes(iter(fields)))


def count_names(root: str | Path, *which: str) -> int:
    """How many changed paths git names in the commits that a log lists."""
    return sum(1 for name in streamed(root, *_LOG, "--name-only", "--format=", *which, mark=b"\0") if name.strip())


class GitHistory(DataSource):
    """Options: path, the repository; range, commits a partition, at least; most, partitions at most;
    counted: true for the number of changed paths of each range, as git names them, instead of commits."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def _counted(self) -> bool:
        return self.options.get("counted", "false") == "true"

    def schema(self) -> str:
        return "changes bigint" if self._counted() else COMMIT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)), int(self.options.get("most", 64)), self._counted())


class _Reader(DataSourceReader):
    def __init__(self, root: str, size: int, most: int, counted: bool = False):
        self.root, self.size, self.most, self.counted = root, size, most, counted

    def partitions(self) -> list[InputPartition]:
        # the log is read up to the commit that is the head now, whatever is committed meanwhile
        head = git(self.root, "rev-parse", "HEAD").strip()
        n = int(git(self.root, "rev-list", "--no-merges", "--count", head))
        size = max(self.size, -(-n // self.most))
        return [InputPartition((head, at, size)) for at in range(0, max(1, n), size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        head, at, size = partition.value
        which = f"--skip={at}", f"--max-count={size}", head
        return iter([(count_names(self.root, *which),)]) if self.counted else commits(self.root, *which)


def _history(spark: SparkSession, root: str | Path, size: int, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(GitHistory)
    most = RANGES * spark.sparkContext.defaultParallelism
    return spark.read.format("git_history").options(range=size, most=most, **options).load(str(root))


def read_commits(spark: SparkSession, root: str | Path, size: int = RANGE) -> DataFrame:
    """The history without merges, a row a commit. size: commits a partition, at least."""
    return _history(spark, root, size)


def counted_changes(spark: SparkSession, root: str | Path, size: int = RANGE) -> DataFrame:
    """changes: how many paths git names as changed, a row a range of commits."""
    return _history(spark, root, size, counted="true")


def tables_of(history: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(commits, change rows) of rows of COMMIT."""
    whose = F.lit(project).alias("project")
    change = F.col("change")
    rows = history.select("hash", "committed_at", "author_email", F.explode("changes").alias("change"))
    changes = rows.select(whose, "hash", "committed_at", "author_email", change.path.alias("path"), change.old_path.alias("old_path"), change.additions.alias("additions"), change.deletions.alias("deletions"), change.is_rename.cast("tinyint").alias("is_rename"))
    return history.select(whose, "hash", "author_name", "author_email", "committed_at", "message"), changes


def count_reasons(root: str | Path, commits: int, changes: int, spark: SparkSession | None = None) -> list[str]:
    """Where git's own counts differ from those of the tables; nothing if all agree. With a session, ranges
    are counted where they are read."""
    named = counted_changes(spark, Path(root).resolve()).agg(F.sum("changes")).first()[0] if spark else count_names(root)
    expected = {"commits": (commits, int(git(root, "rev-list", "--no-merges", "--count", "HEAD"))), "changes": (changes, named)}
    return [f"history: {ours} {what} read, git counts {theirs}" for what, (ours, theirs) in expected.items() if ours != theirs]
