"""The index job: sources and history of a repository to a new generation of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.embed import Embedder, embedded
from loomgraph.functions.expr import embedding_text
from loomgraph.operators import evolution, resolve
from loomgraph.operators.latest import latest_version
from loomgraph.sources import git, python_source
from loomgraph.sources.shared import scratch, written
from loomgraph.sources.storage import ORIGIN, SOURCES, TABLES, Store

#: Symbols per thousand lines below which a parse is doubted.
LEAST_DENSITY = 5.0


@dataclass(frozen=True)
class IndexResult:
    """nodes and edges are rows found; the tables hold one a key."""

    version: int
    files: int
    nodes: int
    edges: int
    degraded_reasons: list[str] = field(default_factory=list)


def density(symbols: Column, lines: Column) -> Column:
    """Symbols per thousand lines."""
    return symbols / F.greatest(lines / 1000, F.lit(0.001))


def too_sparse(files: Column, symbols: Column, lines: Column, least: float = LEAST_DENSITY) -> Column:
    """Whether files were read but hold too few symbols to be believed."""
    return (files > 0) & (density(symbols, lines) < least)


def density_reasons(counts: DataFrame) -> list[str]:
    """The gate's answer for one row of files, symbols and lines."""
    one = tuple(F.coalesce(F.col(c), F.lit(0)) for c in ("files", "symbols", "lines"))
    row = counts.select(*[c.alias(n) for c, n in zip(one, ("files", "symbols", "lines"), strict=True)], density(*one[1:]).alias("density"), too_sparse(*one).alias("bad")).first()
    return [f"nodes-per-KLOC: {row['density']:.1f} is below {LEAST_DENSITY} ({row['symbols']} symbols in {row['lines']} lines)"] if row["bad"] else []


def vector_reasons(symbols: int, vectors: int) -> list[str]:
    """The vector gate: every symbol that has a text has a vector."""
    return [] if symbols == vectors else [f"vectors: {vectors} of {symbols} symbols"]


def deprecation_share(rows: DataFrame) -> DataFrame:
    """symbols, flagged, percent of parsed rows."""
    symbols = rows.where("kind = 'node' AND label <> 'File'")
    flagged = F.count_if(F.contains("properties", F.lit("true")))
    return symbols.agg(F.count("*").alias("symbols"), flagged.alias("flagged"), F.round(100 * flagged / F.greatest(F.count("*"), F.lit(1)), 4).alias("percent"))


def deprecation_audit(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """project, symbols, flagged, percent, names (the flagged ones) over all .py files below each
    root, tracked or not."""
    out = None
    for project, root in sorted(roots.items()):
        rows = python_source.parsed(python_source.read_sources(spark, str(Path(root).resolve())))
        names = rows.where("kind = 'node' AND label <> 'File' AND properties LIKE '%true%'").agg(F.array_sort(F.collect_set("qualified_name")).alias("names"))
        one = deprecation_share(rows).crossJoin(names).select(F.lit(project).alias("project"), "symbols", "flagged", "percent", "names")  # a row each
        out = one if out is None else out.union(one)
    return out


def _per_source(rows: DataFrame, hashes: DataFrame, version: int) -> DataFrame:
    """What the store keeps of each parsed source."""
    kind = F.col("kind")
    found = rows.groupBy(F.col("file_path").alias("path")).agg(
        F.sum("lines").alias("lines"), F.count_if(kind == "node").alias("nodes"), F.count_if(kind == "edge").alias("edges"),
        F.count_if((kind == "node") & (F.col("label") != "File")).alias("symbols"), F.coalesce(F.bool_and("parsed"), F.lit(True)).alias("parsed"),
    )
    return found.join(hashes, "path").withColumn("version", F.lit(version).cast("long")).withColumn(ORIGIN, F.col("path"))


def index_repository(
    store: Store, root: str | Path, project: str, as_of: Column, embedder: Embedder | None = None, on_progress: Callable[[str], None] | None = None, whole: bool = False, job: str | None = None, resolve_names: bool = False,
) -> IndexResult:
    """Writes a generation and publishes it. Of sources, only those are parsed and written whose
    content differs from what the generation before was made of; whole: all. embedder: optional;
    one that isn't available is passed over. resolve_names: further CALLS edges to the
    definitions that calls through imports mean, for which all sources are parsed. A failure, or
    another load that is published meanwhile, leaves the generation before in place, state failed."""
    spark, say = store.spark, on_progress or (lambda step: None)
    load = store.begin()
    version = load.generation
    store.set_status("running", version=version, step="parse", files_done=0, nodes_persisted=0, **({"job": job} if job else {}))
    try:
        say("parse")
        tracked = git.tracked_files(root)
        with scratch(spark):
            sources = python_source.read_sources(spark, str(Path(root).resolve()), tracked) if tracked else spark.createDataFrame([], "path string, content binary")
            # a source is named by path, its content by a hash
            hashes = written(sources.select("path", F.sha2("content", 256).alias("sha")), "hashes")
            use_vectors = bool(embedder and embedder.available())
            before = store.read(SOURCES)
            parts = not whole and not resolve_names and store.generation is not None and not before.isEmpty() and use_vectors == ("embeddings" in load.parent["tables"])
            old = written(before.select("path", "sha"), "before") if parts else spark.createDataFrame([], "path string, sha string")
            changed = written(hashes.join(old, ["path", "sha"], "left_anti"), "changed")
            origins = written(changed.select("path").union(old.join(hashes, "path", "left_anti").select("path")), "origins")
            put = (lambda table, df: load.change(table, df, origins)) if parts else load.write
            store.set_status("running", files_total=hashes.count(), files_changed=changed.count())
            rows = written(python_source.parsed(sources.join(changed.select("path"), "path", "left_semi")), "parsed")
            origin = lambda df: df.withColumn(ORIGIN, F.col("file_path"))
            nodes = origin(python_source.nodes_of(rows, project, version))
            edges = origin(rows.where("kind = 'edge'")).select(F.lit(project).alias("project"), "source", "target", F.col("label").alias("type"), F.lit("{}").alias("properties"), F.lit(version).cast("long").alias("version"), ORIGIN)
            if resolve_names:
                meant = resolve.resolved_calls(rows).join(rows.where("kind = 'use'").groupBy("source").agg(F.min("file_path").alias(ORIGIN)), "source")
                edges = edges.unionByName(meant.select(F.lit(project).alias("project"), "source", "target", F.lit("CALLS").alias("type"), F.lit("{}").alias("properties"), F.lit(version).cast("long").alias("version"), ORIGIN))
            # of equal keys in one source the one further down wins; those of several sources stay until they are read
            put("nodes", latest_version(nodes, [*TABLES["nodes"][1], ORIGIN], [F.col("version"), F.col("start_line"), F.col("end_line"), F.col("label")]))
            put("edges", edges.dropDuplicates([*TABLES["edges"][1], ORIGIN]))
            put(SOURCES, _per_source(rows, hashes, version))
            store.set_status("running", files_done=changed.count(), nodes_persisted=rows.where("kind = 'node'").count())
            reasons = []
            if use_vectors:
                say("embed")
                store.set_status("running", step="embed")
                texts = nodes.where("label <> 'File'").select("qualified_name", ORIGIN, embedding_text(F.col("name"), F.col("doc")).alias("text")).dropDuplicates(["qualified_name", ORIGIN])
                texts = written(texts, "texts")
                keyed = texts.withColumn("key", F.struct("qualified_name", ORIGIN).cast("string"))
                vectors = embedded(keyed.select(F.col("key").alias("qualified_name"), "text"), embedder).select(F.col("qualified_name").alias("key"), "vec")
                vectors = written(keyed.select("qualified_name", ORIGIN, "key").join(vectors, "key"), "vectors")
                put("embeddings", vectors.select(F.lit(project).alias("project"), "qualified_name", "vec", F.lit(version).cast("long").alias("version"), ORIGIN))
                reasons += vector_reasons(texts.count(), vectors.count())
            say("history")
            store.set_status("running", step="history")
            log = written(git.read_commits(spark, Path(root).resolve()), "log")
            commits, changes = git.tables_of(log, project)
            load.write("git_commits", commits)
            changes = written(changes, "changes")
            load.write("git_file_changes", changes)
            load.write("file_evolution", evolution.file_evolution(changes, as_of, version))
            kept = before.join(origins, "path", "left_anti") if parts else before.limit(0)
            about = kept.select("lines", "nodes", "edges", "symbols", "parsed").union(_per_source(rows, hashes, version).select("lines", "nodes", "edges", "symbols", "parsed"))
            count = about.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "nodes", "edges", "symbols")], F.count("*").alias("files"), F.count_if(~F.col("parsed")).alias("bad"))
            row = count.first()
            reasons += git.count_reasons(root, commits.count(), changes.count(), spark)
            reasons += density_reasons(count.select("files", "symbols", "lines"))
            if row["bad"]:
                reasons.append(f"{row['bad']} of {row['files']} files don't parse")
            load.publish()
    except Exception as e:
        store.set_status("failed", error=str(e)[:500])
        raise
    store.vacuum()
    store.set_status("degraded" if reasons else "indexed", version=version, reasons=reasons, step="done")
    return IndexResult(version, row["files"], row["nodes"], row["edges"], reasons)
