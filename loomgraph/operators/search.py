"""Hybrid ranked search over symbols.

Candidates match the query in name or qualified name (or are among the nearest
vectors); their score adds up lexical similarity, vector similarity, recency,
centrality and a deprecation penalty, each rounded before it is weighted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expr import age_days, contains_ci, cosine_similarity, decay, json_flag, lexical, matches


@dataclass(frozen=True)
class RankConfig:
    """Weights, the lexical mode (jaccard or binary) and the number of nearest vectors."""

    lex: float = 0.35
    vec: float = 0.30
    rec: float = 0.20
    cen: float = 0.15
    dep: float = -0.20
    lexical_mode: str = "jaccard"
    vector_candidates: int = 100


@dataclass(frozen=True)
class Graph:
    """nodes: qualified_name, label, name, file_path, start_line, end_line, properties; edges:
    source, target, type; changes: path, committed_at; vectors (or None): qualified_name, vec."""

    nodes: DataFrame
    edges: DataFrame
    changes: DataFrame
    vectors: DataFrame | None = None


@dataclass(frozen=True)
class Query:
    text: str | None = None
    name_pattern: str | None = None
    label: str | None = None
    vector: list[float] | None = field(default=None)

    def __post_init__(self) -> None:
        if not (self.text or self.name_pattern or self.label):
            raise ValueError("a search needs a text, a name pattern or a label")


@dataclass(frozen=True)
class SearchPage:
    items: list[dict]
    total: int
    has_more: bool


def _similarities(vectors: DataFrame, vector: list[float], id_col: str) -> DataFrame:
    """id and sim (cosine; 0 for a zero vector) of the sound vectors with as many dimensions, a matrix
    product a batch."""
    asked = np.asarray(vector, np.float64)
    asked = asked / (np.linalg.norm(asked) or 1.0)
    dims = len(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            norms = np.sqrt(np.einsum("ij,ij->i", x, x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x @ asked) / np.where(norms > 0, norms, 1.0))], names=[id_col, "sim"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.where(sound(dims)).select(id_col, "vec").mapInArrow(run, f"`{id_col}` {kind}, sim double")


def sound(dims: int | None = None) -> Column:
    """Whether vec is a vector (of so many dimensions) without null, NaN or infinite components; others
    are near to nothing."""
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(whole if dims is None else (F.size("vec") == dims) & whole, F.lit(False))


def nearest(vectors: DataFrame, vector: list[float], k: int, id_col: str = "qualified_name") -> DataFrame:
    """The k most similar vectors, ties by id: planned as a top-k in each task, then of all."""
    return _similarities(vectors, vector, id_col).orderBy(F.col("sim").desc(), id_col).limit(k)


class VectorIndex:
    """Vectors kept for many queries: packed once into matrices of unit length, a row a block, in
    the executors' memory or on their disks. Vectors that aren't sound are left out, and those
    of different lengths lie in blocks of their own; ids may be of any type."""

    def __init__(self, vectors: DataFrame, id_col: str = "qualified_name", block: int = 8192):
        self.id_col, self.kind = id_col, vectors.schema[id_col].dataType.simpleString()
        kind = vectors.select(id_col).limit(0).toArrow().schema.field(0).type
        schema = pa.schema([("ids", pa.list_(kind)), ("dims", pa.int32()), ("unit", pa.binary())])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = np.diff(batch.column(1).offsets.to_numpy())
                for dims in np.unique(lengths).tolist():
                    own = batch.filter(pa.array(lengths == dims))
                    for at in range(0, own.num_rows, block):
                        part = own.slice(at, block)
                        x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                        norms = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
                        unit = (x / np.where(norms > 0, norms, 1)).astype(np.float32)
                        yield pa.RecordBatch.from_pylist([{"ids": part.column(0).to_pylist(), "dims": dims, "unit": unit.tobytes()}], schema)

        self.blocks = vectors.where(sound()).select(id_col, "vec").mapInArrow(pack, f"ids array<{self.kind}>, dims int, unit binary").persist(StorageLevel.MEMORY_AND_DISK)

    def nearest(self, vector: list[float], k: int) -> DataFrame:
        """The k most similar vectors: each block hands on k rows."""
        asked = np.asarray(vector, np.float32)
        asked = asked / (np.linalg.norm(asked) or 1.0)
        id_col = self.id_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    if batch.column(1)[i].as_py() != len(asked):
                        continue
                    sim = np.frombuffer(batch.column(2)[i].as_buffer(), np.float32).reshape(-1, len(asked)) @ asked
                    kth = np.partition(sim, len(sim) - min(k, len(sim)))[len(sim) - min(k, len(sim))]
                    some = np.flatnonzero(sim >= kth)  # ties stay, the ids decide below
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.take(pa.array(some)), pa.array(sim[some].astype(np.float64))], names=[id_col, "sim"])

        return self.blocks.mapInArrow(run, f"`{id_col}` {self.kind}, sim double").orderBy(F.col("sim").desc(), id_col).limit(k)

    def close(self) -> None:
        self.blocks.unpersist()


def candidates(graph: Graph, query: Query, config: RankConfig = RankConfig()) -> DataFrame:
    """Nodes that match; the nearest vectors join in by an existence join, before label and
    pattern filter."""
    nodes = graph.nodes
    conditions: list[Column] = []
    if query.text:
        match = contains_ci(F.col("name"), query.text) | contains_ci(F.col("qualified_name"), query.text)
        if query.vector and graph.vectors is not None:
            top = nearest(graph.vectors, query.vector, config.vector_candidates).select("qualified_name", F.lit(True).alias("_near"))
            nodes = nodes.join(F.broadcast(top), "qualified_name", "left")  # vector_candidates rows at most
            match = match | F.coalesce("_near", F.lit(False))
        conditions.append(match)
    if query.name_pattern:
        conditions.append(matches(F.col("name"), query.name_pattern))
    if query.label:
        conditions.append(F.col("label") == query.label)
    for c in conditions:
        nodes = nodes.where(c)
    return nodes.select(*graph.nodes.columns)


def scored(graph: Graph, query: Query, as_of: Column, config: RankConfig = RankConfig(), found: DataFrame | None = None) -> DataFrame:
    """Candidates (found, if they are known) with lex, vec, rec, cen, dep and score."""
    found = candidates(graph, query, config) if found is None else found
    # only the candidates' files; the largest degree is of all symbols
    recency = graph.changes.join(found.select(F.col("file_path").alias("path")), "path", "left_semi").groupBy(F.col("path").alias("file_path")).agg(decay(age_days(F.max("committed_at"), as_of)).alias("_rec"))
    degree = graph.edges.where("type = 'CALLS'").groupBy(F.col("target").alias("qualified_name")).agg(F.count("*").alias("_deg"))
    most = degree.agg(F.greatest(F.max("_deg"), F.lit(1)).alias("_most"))
    out = found.join(recency, "file_path", "left").join(degree, "qualified_name", "left").join(F.broadcast(most))
    vec = F.lit(0.0)
    if query.text and query.vector and graph.vectors is not None:
        out = out.join(graph.vectors.select("qualified_name", "vec"), "qualified_name", "left")
        vec = cosine_similarity(F.col("vec"), F.array(*[F.lit(float(x)) for x in query.vector]), len(query.vector))
    signals = out.select(
        "qualified_name", "label", "name", "file_path", "start_line", "end_line",
        F.round(lexical(F.col("name"), F.col("qualified_name"), query.text, config.lexical_mode), 3).alias("lex"),
        F.round(vec, 3).alias("vec"), F.round(F.coalesce("_rec", F.lit(0.0)), 3).alias("rec"),
        F.round(F.coalesce("_deg", F.lit(0)) / F.col("_most"), 3).alias("cen"), json_flag(F.col("properties"), "deprecated").cast("tinyint").alias("dep"),
    )
    score = sum((F.lit(getattr(config, s)) * F.col(s) for s in ("lex", "vec", "rec", "cen")), F.lit(0.0)) + F.lit(config.dep) * F.col("dep")
    return signals.withColumn("score", F.round(score, 4))


def ranked(graph: Graph, query: Query, as_of: Column, config: RankConfig = RankConfig(), limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of scored candidates, the best first, ties by qualified name."""
    return _page(scored(graph, query, as_of, config), limit, offset)


def _page(scores: DataFrame, limit: int, offset: int) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "qualified_name").offset(offset).limit(limit)


def search_graph(graph: Graph, query: Query, as_of: Column, config: RankConfig = RankConfig(), limit: int = 200, offset: int = 0) -> SearchPage:
    """A page with the total, which stays right past the last page."""
    # the nearest vectors are searched once for the page and its total
    found = candidates(graph, query, config).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        items = [r.asDict() for r in _page(scored(graph, query, as_of, config, found), limit, offset).collect()]
        total = found.count()
    finally:
        found.unpersist()
    return SearchPage(items, total, offset + len(items) < total)
