"""The graph's tables as generations of immutable Parquet files.

A generation is a manifest: which files each table consists of, and which rows of older
files are gone.  A load writes files of its own and then makes the manifest of the next
generation, once: of two loads that began from the same generation one is published and the
other gets ConcurrentLoad.  Files are never changed or moved, so who has read a generation
keeps it, whatever is published or compacted after.

Tables that are made of sources (nodes, edges, embeddings) can be loaded in part: the rows
of changed sources are new files, and a tombstone for each changed or removed source
hides its rows in older ones.  Compaction writes the rows that are left to new files, as a
generation of its own.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.latest import latest_version
from loomgraph.sources.files import Files

SCHEMA_VERSION = 2
#: Columns and logical keys of the tables.
TABLES = {
    "nodes": ("project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string, doc string, version long", ["project", "qualified_name"]),
    "edges": ("project string, source string, target string, type string, properties string, version long", ["project", "type", "source", "target"]),
    "git_commits": ("project string, hash string, author_name string, author_email string, committed_at timestamp, message string", []),
    "git_file_changes": ("project string, hash string, committed_at timestamp, author_email string, path string, old_path string, additions long, deletions long, is_rename tinyint", []),
    "file_evolution": ("path string, commit_count long, churn long, last_commit_at timestamp, top_author string, top_author_share float, recency_score float, version long", ["path"]),
    "embeddings": ("project string, qualified_name string, vec array<float>, version long", ["project", "qualified_name"]),
}
#: What is known of each source: its content's hash and what the parser found.
SOURCES = "sources"
_SOURCE_ROW = "path string, sha string, lines long, nodes long, edges long, symbols long, parsed boolean, version long"
#: Tables that are made of sources; their files hold the source of each row as well.
BY_SOURCE = ("nodes", "edges", "embeddings", SOURCES)
ORIGIN = "_origin"
#: Seconds that files stay after the last of the kept generations has let go of them.
RETAINED = 3600.0
#: Bytes of a row group: rows of few distinct values take little, and a task reads whole groups.
ROW_GROUP = 16 << 20
#: Rows whose keys one task counts, about.
COUNTED = 1_000_000
#: States of a project. degraded is never shown as indexed.
STATES = ("uninitialized", "queued", "running", "indexed", "degraded", "failed")


class SchemaVersionError(RuntimeError):
    """The folder was written by another version."""


def project_slug(root: str | Path) -> str:
    real = os.path.realpath(root)
    return re.sub(r"[^A-Za-z0-9._-]+", "-", os.path.basename(real)) + "-" + sha256(real.encode()).hexdigest()[:8]


class ConcurrentLoad(RuntimeError):
    """Another load was published since this one began."""


class MissingFiles(RuntimeError):
    """Files that a published generation lists are not there."""


def _alive(pid: int) -> bool:
    """Whether a process of this machine runs."""
    try:
        os.kill(pid, 0)
    except (ProcessLookupError, OverflowError):
        return False
    except PermissionError:
        pass
    return pid > 0


def columns_of(table: str) -> list[str]:
    schema = _SOURCE_ROW if table == SOURCES else TABLES[table][0]
    return [c.split()[0] for c in schema.split(", ")]


def _schema_of(table: str) -> str:
    return _SOURCE_ROW if table == SOURCES else TABLES[table][0]


def _keys_of(table: str) -> list[str]:
    return ["path"] if table == SOURCES else TABLES[table][1]


class Load:
    """Files of a generation that isn't published yet."""

    def __init__(self, store: Store, parent: dict | None):
        self.store, self.parent = store, parent
        self.generation = (parent["generation"] if parent else 0) + 1
        self.id = f"{self.generation:09d}-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, dict] = {}

    def _put(self, df: DataFrame, table: str) -> dict:
        name = f"data/{table}/{self.id}"
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(self.store.files.address(name))
        return {"path": name, "files": [[n, size] for n, size, _ in self.store.files.names(name) if n.endswith(".parquet")]}

    def _rows(self, table: str, df: DataFrame) -> DataFrame:
        extra = [ORIGIN] if table in BY_SOURCE and ORIGIN in df.columns else []
        out = df.select(*columns_of(table), *extra)
        return out if extra or table not in BY_SOURCE else out.withColumn(ORIGIN, F.lit(None).cast("string"))

    def write(self, table: str, df: DataFrame) -> None:
        """All rows of the table."""
        part = self._put(self._rows(table, df), table)
        self.tables[table] = {"parts": [part], "gone": [], "contested": table in BY_SOURCE and self._contested(table, part)}

    def change(self, table: str, df: DataFrame, origins: DataFrame) -> None:
        """Rows (with their sources in ORIGIN) beside those that the table has of other sources than
        origins (path). Only these rows are written."""
        before = self.parent["tables"].get(table) if self.parent else None
        if before is None:
            return self.write(table, df)
        part = self._put(self._rows(table, df), table)
        gone = self._put(origins.select(F.col("path").alias(ORIGIN), F.lit(self.generation).cast("long").alias("before")), f"gone_{table}")
        contested = before["contested"] or self._contested(table, part, before, gone)
        self.tables[table] = {"parts": [*before["parts"], part], "gone": [*before["gone"], gone], "contested": contested}

    def _contested(self, table: str, part: dict, before: dict | None = None, gone: dict | None = None) -> bool:
        """Whether a key of the new rows has rows of other sources as well."""
        keys = _keys_of(table)
        new = self.store._files_of(table, [part]).select(*keys)
        if before is not None:
            old = self.store._live(table, before | {"gone": [*before["gone"], gone]}).select(*keys)
            if not old.join(new, keys, "left_semi").isEmpty():
                return True
        # dealt by key before they are counted: a task holds the keys of its share, not of all that it reads
        shares = max(1, -(-new.count() // COUNTED))
        return not new.repartition(shares, *keys).groupBy(*keys).count().where("count > 1").isEmpty()

    def publish(self) -> int:
        """Makes this the current generation; raises ConcurrentLoad if it no longer is the next one."""
        base = self.parent["tables"] if self.parent else {}
        manifest = {"generation": self.generation, "parent": self.parent and self.parent["generation"], "load": self.id, "tables": base | self.tables}
        if not self.store.files.create(_manifest_name(self.generation), json.dumps(manifest)):
            raise ConcurrentLoad(f"generation {self.generation} was published by another load: begin anew")
        return self.generation


def _manifest_name(generation: int) -> str:
    return f"generations/{generation:09d}.json"


class Store:
    """A project's tables below a place that driver and executors share: a mounted folder, or the
    address of a store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.files = spark, Files(spark, folder)
        self.folder = self.files.local if self.files.local is not None else self.files.place
        found = self.files.read("manifest.json")
        if found is None:
            self.files.create("manifest.json", json.dumps({"schema_version": SCHEMA_VERSION}))
            found = self.files.read("manifest.json")
        version = json.loads(found)["schema_version"]
        if version != SCHEMA_VERSION:
            raise SchemaVersionError(f"{self.folder} has schema version {version}, this is {SCHEMA_VERSION}: index it anew")
        self._open: dict[int, Load] = {}

    # --- generations

    def generations(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n, _, _ in self.files.names("generations") if n.endswith(".json") and n[0] != ".")

    @property
    def generation(self) -> int | None:
        return max(self.generations(), default=None)

    def manifest(self, generation: int | None = None) -> dict | None:
        """Of a generation, the current one if none is named; None without one."""
        generation = self.generation if generation is None else generation
        text = None if generation is None else self.files.read(_manifest_name(generation))
        if text is None and generation is not None:
            raise MissingFiles(f"generation {generation} has no manifest")
        return text and json.loads(text)

    def begin(self) -> Load:
        """A load of the next generation."""
        return Load(self, self.manifest())

    def next_version(self) -> int:
        return (self.generation or 0) + 1

    def write(self, version: int, table: str, df: DataFrame) -> None:
        """Writes a table of the load with that number, which begins with its first table."""
        load = self._open.get(version) or self.begin()
        if load.generation != version:
            raise ConcurrentLoad(f"the next generation is {load.generation}, not {version}")
        self._open[version] = load
        load.write(table, df)

    def publish(self, version: int) -> None:
        """Makes the load with that number the current generation."""
        (self._open.pop(version, None) or self.begin()).publish()

    def vacuum(self, keep: int = 2, retained: float = RETAINED) -> int:
        """Removes files of loads that none of the latest generations lists and that are older than
        `retained` seconds, so that readers and running loads have theirs. Returns how many loads'
        folders went."""
        numbers, used, gone = self.generations(), set(), 0
        for g in numbers[-keep:]:
            for t in self.manifest(g)["tables"].values():
                used |= {p["path"] for p in (*t["parts"], *t["gone"])}
        for g in numbers[:-keep]:
            self.files.delete(_manifest_name(g))
        for table, _, _ in self.files.names("data"):
            for load, _, at in self.files.names(f"data/{table}"):
                if f"data/{table}/{load}" not in used and self.files.age(at) > retained:
                    self.files.delete(f"data/{table}/{load}")
                    gone += 1
        return gone

    # --- tables

    def _files_of(self, table: str, parts: list[dict], session: SparkSession | None = None, schema: str | None = None) -> DataFrame:
        spark = session or self.spark
        schema = schema or _schema_of(table) + (f", {ORIGIN} string" if table in BY_SOURCE else "")
        paths = [self.files.address(f"{p['path']}/{name}") for p in parts for name, _ in p["files"]]
        if not paths:
            return spark.createDataFrame([], schema)
        try:
            return spark.read.schema(schema).parquet(*paths)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise MissingFiles(f"{table}: {str(e).splitlines()[0]}") from e
            raise

    def _live(self, table: str, about: dict, session: SparkSession | None = None) -> DataFrame:
        """The rows whose sources have no tombstone after them."""
        rows = self._files_of(table, about["parts"], session)
        if not about["gone"]:
            return rows
        gone = self._files_of(table, about["gone"], session, f"{ORIGIN} string, before long").groupBy(F.col(ORIGIN).alias("_gone")).agg(F.max("before").alias("_before"))
        return rows.join(gone, (F.col(ORIGIN) == F.col("_gone")) & (F.col("version") < F.col("_before")), "left_anti")

    def read(self, table: str, session: SparkSession | None = None, generation: int | None = None) -> DataFrame:
        """A table of a generation, the current one if none is named; empty without one. Raises if
        files that the generation lists are not there."""
        manifest, columns = self.manifest(generation), columns_of(table)
        about = manifest and manifest["tables"].get(table)
        if not about:
            return (session or self.spark).createDataFrame([], _schema_of(table))
        rows = self._live(table, about, session)
        if about["contested"]:
            # of rows with one key in several sources the latest counts, then the one further down
            order = [F.col(c) for c in ("version", "start_line", "end_line", "label") if c in columns] + [F.col(ORIGIN)]
            rows = latest_version(rows, _keys_of(table), order)
        return rows.select(*columns)

    def compact(self, table: str, target_bytes: int = 128 << 20) -> int:
        """The current rows of the table in as few files as hold target_bytes each, as a generation of
        its own, without tombstones. Returns the number of files."""
        load = self.begin()
        about = load.parent and load.parent["tables"].get(table)
        if not about:
            return 0
        sizes = [size for p in about["parts"] for _, size in p["files"]]
        n = max(1, -(-sum(sizes) // target_bytes))
        if len(sizes) <= n and not about["gone"]:
            return len(sizes)
        part = load._put(self._live(table, about).coalesce(n), table)
        load.tables[table] = {"parts": [part], "gone": [], "contested": table in BY_SOURCE and load._contested(table, part)}
        load.publish()
        return len(part["files"])

    def sql(self, text: str, **values) -> DataFrame:
        """A query over the current tables by their names; values are bound as :name. The names hold
        in a session of its own, so that projects and a user's views don't meet."""
        session, now = self.spark.newSession(), self.generation
        for table in TABLES:
            self.read(table, session, now).createOrReplaceTempView(table)
        return session.sql(text, args=values)

    def tables(self) -> list[str]:
        """The tables of the current generation."""
        manifest = self.manifest()
        return sorted(t for t in TABLES if manifest and t in manifest["tables"])

    def has_rows(self, table: str) -> bool:
        return not self.read(table).isEmpty()

    def rows(self, text: str, **values) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.sql(text, **values).collect()]

    def csv(self, text: str, **values) -> str:
        """A small result as CSV text with a header."""
        return self.sql(text, **values).toPandas().to_csv(index=False)

    def load_json_lines(self, version: int, table: str, path: str) -> None:
        """Writes a table of a generation from JSON lines."""
        self.write(version, table, self.spark.read.schema(TABLES[table][0]).json(path))

    def delete(self) -> None:
        """Forgets the graph; the folder and its version stay. Refused while a load runs, which a
        load of a process that is gone doesn't."""
        now = self.status()
        if now["state"] in ("queued", "running") and _alive(now.get("pid", 0)):
            raise RuntimeError("the project is being indexed")
        for name in ("generations", "data", "status.json"):
            self.files.delete(name)
        self._open.clear()

    # --- status

    def set_status(self, state: str, **more) -> None:
        """The project's state; within a run, what was said before of its job stays."""
        if state not in STATES:
            raise ValueError(f"unknown state {state!r}")
        before = self.status()
        if before["state"] in ("queued", "running") and state != "queued":
            more = {k: v for k, v in before.items() if k not in ("state", "pid", "updated_at")} | more
        self.files.replace("status.json", json.dumps({"state": state, **more, "pid": os.getpid(), "updated_at": time.time()}))

    def status(self) -> dict:
        text = self.files.read("status.json")
        return json.loads(text) if text else {"state": "uninitialized"}
