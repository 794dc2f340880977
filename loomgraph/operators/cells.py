"""An inverted file of vectors: cells around centroids, of which a search reads a few.

Centroids are fitted on a bounded sample of the vectors; every vector is stored, in the cell
of its nearest centroid, as a row of a block of one cell, and the blocks lie in a folder a
cell.  A search compares the query with the centroids and reads the nearest cells alone:
others are pruned before the read.  The exact mode reads on: the similarity of a vector is at
most that of its centroid plus the cell's radius, so that cells whose bound is below the kth
similarity found hold none of the result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.search import sound
from loomgraph.session import ship
from loomgraph.sources.files import Files
from loomgraph.sources.shared import written

#: Sums of 32-bit products may be off by so much.
SLACK = 1e-4
#: Rows of a query and one of its cells that are handed on at once, about.
PLACES = 65_536
#: Bytes of vectors in a part that is kept in memory, about.
KEPT = 64 << 20


@dataclass(frozen=True)
class Cells:
    """cells: their number; None: the root of the number of vectors, 4096 at most. sample: vectors that
    centroids are fitted on, at most (those with the smallest hashes of their ids). rounds: of the
    fitting. block: vectors in a row, at most. probes: cells that a search reads, at least; where that
    finds less than `recall` of the `near` most similar vectors, measured on `trials` of the sample
    against a full comparison, it reads as many as do."""

    cells: int | None = None
    sample: int = 65_536
    rounds: int = 8
    block: int = 2_048
    probes: int = 16
    recall: float = 0.95
    near: int = 10
    trials: int = 256


def fitted(x: np.ndarray, cells: int, rounds: int, seed: int = 1) -> np.ndarray:
    """Centroids [cell, component] of unit vectors, by rounds of assigning and averaging."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]].astype(np.float32)
    for _ in range(rounds):
        best = np.concatenate([(part @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for part in np.array_split(x, max(1, len(x) // 8192))])
        order = np.argsort(best, kind="stable")
        starts = np.searchsorted(best[order], np.arange(len(c)))
        full = np.flatnonzero(np.diff(starts, append=len(x)))
        sums = np.add.reduceat(x[order].astype(np.float64), starts[full], axis=0)
        c[full] = sums / np.diff(starts, append=len(x))[full, None]
    return c


def needed_probes(x: np.ndarray, c: np.ndarray, how: Cells) -> int:
    """The number of cells, how.probes at least, that hold how.recall of the how.near vectors of x (unit
    vectors) most similar to each of how.trials of them. Where x is a sample, the nearest of all
    vectors are nearer than those of x, so that their cells come no later."""
    if len(x) == 0 or len(c) <= how.probes:
        return how.probes
    asked = x[:: max(1, len(x) // how.trials)][: how.trials]
    sims = asked @ x.T
    k = min(how.near, len(x))
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    half = 0.5 * (c * c).sum(1)
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)  # of each cell in a search's order
    cell = np.stack([(x[t] @ c.T - half).argmax(1) for t in top])
    ranks = np.sort(np.take_along_axis(place, cell, axis=1).ravel())
    return max(how.probes, int(ranks[min(len(ranks) - 1, int(np.ceil(how.recall * len(ranks))) - 1)]) + 1)


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return (x / np.where(norms > 0, norms, 1)).astype(np.float32)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class CellIndex:
    """An index in a folder, of vectors of `dims` components."""

    def __init__(self, spark: SparkSession, place: str):
        """Opens the index at a place that build() has written to."""
        self.spark, self.place = spark, place
        about = json.loads(Files(spark, place).read("about.json"))
        self.id_col, self.kind, self.dims, self.probes = (about[k] for k in ("id_col", "kind", "dims", "probes"))
        rows = spark.read.parquet(f"{place}/cells").orderBy("cell").collect()  # a row a cell
        self.cells = np.array([r["cell"] for r in rows], np.int64)
        self.centroids = np.array([r["centroid"] for r in rows], np.float32).reshape(-1, self.dims)
        self.radius = np.array([r["radius"] for r in rows], np.float64)
        self.blocks = spark.read.schema(f"ids array<{self.kind}>, unit binary, cell int").parquet(f"{place}/blocks") if rows else None
        ship(spark)

    @classmethod
    def build(cls, vectors: DataFrame, place: str, id_col: str = "qualified_name", how: Cells = Cells()) -> CellIndex:
        """Indexes all sound vectors (column vec) of the most frequent length; those of other lengths
        aren't comparable with them and are left out, as unsound ones are. Repeated ids are
        vectors of their own. An empty table makes an index that finds nothing."""
        spark = vectors.sparkSession
        ship(spark)
        kept = vectors.where(sound() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "vec")
        lengths = kept.groupBy(F.size("vec").alias("dims")).count().orderBy(F.col("count").desc(), "dims").limit(1).collect()
        dims, n = (lengths[0]["dims"], lengths[0]["count"]) if lengths else (1, 0)
        kept = kept.where(F.size("vec") == dims)
        kind = vectors.schema[id_col].dataType.simpleString()
        sample = kept.withColumn("at", F.xxhash64("id")).orderBy("at").limit(how.sample).select("vec").toArrow() if n else None
        number = max(1, min(how.cells or int(n**0.5), 4096, n))
        some = _unit(_rows(sample["vec"].combine_chunks(), dims)) if n else np.zeros((0, dims), np.float32)
        centroids = fitted(some, number, how.rounds) if n else some
        probes = needed_probes(some, centroids, how)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = 0.5 * (centroids * centroids).sum(1)
            for batch in batches:
                x = _unit(_rows(batch.column(1), dims))
                cell = np.concatenate([(part @ centroids.T - half).argmax(1) for part in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.zeros(0, np.int64)
                away = np.sqrt(((x.astype(np.float64) - centroids[cell]) ** 2).sum(1))
                unit = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(away), batch.column(0), unit], names=["cell", "away", "id", "unit"])

        rows = written(kept.mapInArrow(assigned, f"cell int, away double, id {kind}, unit array<float>"), "assigned")
        about = rows.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        made = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<float>")
        made.join(about, "cell").write.mode("overwrite").parquet(f"{place}/cells")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    for at in range(a, b, how.block):
                        part = batch.slice(at, min(how.block, b - at))
                        x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f4")
                        yield pa.RecordBatch.from_arrays([pa.array([part.column(1).to_pylist()], pa.list_(part.schema.field(1).type)), pa.array([x.tobytes()], pa.binary()), pa.array([int(cell[a])], pa.int32())], names=["ids", "unit", "cell"])

        # a cell with many vectors is dealt to several tasks
        share = 32 * how.block
        dealt = rows.join(F.broadcast(about.select("cell", F.ceil(F.col("n") / share).alias("parts"))), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        dealt = dealt.repartition(F.col("cell"), F.col("part")).sortWithinPartitions("cell").select("cell", "id", "unit")
        dealt.mapInArrow(packed, f"ids array<{kind}>, unit binary, cell int").write.mode("overwrite").partitionBy("cell").parquet(f"{place}/blocks")
        Files(spark, place).replace("about.json", json.dumps({"id_col": id_col, "kind": kind, "dims": dims, "probes": probes}))
        return cls(spark, place)

    def keep(self) -> CellIndex:
        """Holds the blocks in the executors' memory, or on their disks, for many searches: in parts of
        KEPT bytes, about, by cell, of which a search skips what holds none of its cells."""
        if self.blocks is not None:
            size = self.blocks.agg(F.sum(F.length("unit")).alias("n")).first()["n"] or 0
            self.blocks = self.blocks.repartitionByRange(max(1, -(-size // KEPT)), "cell").sortWithinPartitions("cell").persist(StorageLevel.MEMORY_AND_DISK)
            self.blocks.count()
        return self

    def close(self) -> None:
        if self.blocks is not None:
            self.blocks.unpersist()

    def _asked(self, vector: list[float]) -> np.ndarray | None:
        asked = np.asarray(vector, np.float64)
        if self.blocks is None or len(asked) != self.dims or not np.isfinite(asked).all():
            return None
        return asked / (np.linalg.norm(asked) or 1.0)

    def _bounds(self, asked: np.ndarray) -> np.ndarray:
        """What no vector of a cell exceeds in similarity."""
        return self.centroids.astype(np.float64) @ asked + self.radius + SLACK

    def _scored(self, cells: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
        """The k most similar vectors of some cells."""
        own, dims = asked.astype(np.float32), self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    sim = np.frombuffer(batch.column(1)[i].as_buffer(), "<f4").reshape(-1, dims) @ own
                    last = max(0, len(sim) - k)
                    some = np.flatnonzero(sim >= np.partition(sim, last)[last])
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.take(pa.array(some)), pa.array(sim[some].astype(np.float64))], names=["id", "sim"])

        near = self.blocks.where(F.col("cell").isin(cells.tolist())).select("ids", "unit").mapInArrow(run, f"id {self.kind}, sim double")
        return near.orderBy(F.col("sim").desc(), "id").limit(k).withColumnRenamed("id", self.id_col)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"`{self.id_col}` {self.kind}, sim double")

    def nearest(self, vector: list[float], k: int, probes: int | None = None) -> DataFrame:
        """The k most similar vectors of the nearest cells, ties by id."""
        asked = self._asked(vector)
        if asked is None:
            return self._none()
        order = np.argsort(-(self.centroids @ asked.astype(np.float32)), kind="stable")
        return self._scored(self.cells[order[: probes or self.probes]], asked, k)

    def nearest_exact(self, vector: list[float], k: int) -> DataFrame:
        """The k most similar of all vectors: those of the nearest cells, and then of each other cell that
        may hold one."""
        asked = self._asked(vector)
        if asked is None:
            return self._none()
        bounds = self._bounds(asked)
        order = np.argsort(-bounds, kind="stable")
        first = self._scored(self.cells[order[: self.probes]], asked, k).collect()  # k rows
        floor = first[-1]["sim"] if len(first) == k else -np.inf
        return self._scored(self.cells[bounds >= floor], asked, k)

    def nearest_of(self, queries: DataFrame, k: int, query_id: str, probes: int | None = None) -> DataFrame:
        """query_id, rank, the id column and sim: the k most similar vectors of the nearest cells for
        each row of queries (query_id, vec), in blocks. Unsound queries have none."""
        asked = queries.where(sound(self.dims)).select(F.col(query_id).alias("query"), "vec")
        if self.blocks is None:
            return asked.select(F.col("query").alias(query_id), F.lit(1).alias("rank"), F.lit(None).cast(self.kind).alias(self.id_col), F.lit(0.0).alias("sim")).limit(0)
        kind, dims, centroids, cells, most = queries.schema[query_id].dataType.simpleString(), self.dims, self.centroids, self.cells, probes or self.probes

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, PLACES // min(most, len(cells)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    x = _unit(_rows(batch.column(1), dims))
                    near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :most]
                    row = np.repeat(np.arange(len(x)), near.shape[1])
                    unit = pa.FixedSizeListArray.from_arrays(pa.array(x[row].ravel()), dims).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), unit, pa.array(cells[near.ravel()], pa.int32())], names=["query", "asked", "cell"])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    sims = np.frombuffer(batch.column(1)[i].as_buffer(), "<f4").reshape(-1, dims) @ _rows(batch.column(3)[i].values.field(1), dims).T
                    last = max(0, len(sims) - k)
                    v, q = np.nonzero(sims >= np.partition(sims, last, axis=0)[last])
                    yield pa.RecordBatch.from_arrays([batch.column(3)[i].values.field(0).take(pa.array(q)), batch.column(0)[i].values.take(pa.array(v)), pa.array(sims[v, q].astype(np.float64))], names=["query", "id", "sim"])

        # queries of a cell in groups of a bounded size: a group meets each block of its cell
        places = asked.mapInArrow(probed, f"query {kind}, asked array<float>, cell int").withColumn("group", F.pmod(F.xxhash64("query"), F.lit(64)))
        groups = places.groupBy("cell", "group").agg(F.collect_list(F.struct("query", "asked")).alias("asked"))
        pairs = self.blocks.join(groups, "cell").select("ids", "unit", "cell", "asked")
        order = Window.partitionBy("query").orderBy(F.col("sim").desc(), "id")
        out = pairs.mapInArrow(scored, f"query {kind}, id {self.kind}, sim double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return out.select(F.col("query").alias(query_id), "rank", F.col("id").alias(self.id_col), "sim")
