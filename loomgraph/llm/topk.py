"""Exact top-k search by vector-approximation files.

Vectors are packed into blocks; a block holds a grid (`cells` intervals a dimension,
set by the block's own quantiles), each vector's cells as one byte a dimension, and,
in a column of its own, the exact vectors.  Two passes over pairs of a block of queries
and a block of vectors:

1. Cells alone, without the exact vectors: the interval ends give a lower bound of every
   score. The kth largest lower bound of all blocks is a floor of a query's result.
2. The cells' upper bounds leave the few vectors that may reach the floor. Their exact
   vectors are read in the order of falling bounds, until no bound reaches the kth
   score found.

Vector blocks are dealt to buckets, query blocks are copied to each bucket, and the two
meet in an equi-join on the bucket; a task holds one block of each.  The copies are shuffled,
never broadcast: the planner takes them for one copy and would send all through the driver.
A pair hands on k rows a query at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.session import ship


@dataclass(frozen=True)
class Search:
    """k: of each query. scale: components become floor(scale * x). cells: a dimension, up
    to 256. block: vectors; queries: queries in a block. buckets: of vector blocks, at most."""

    k: int = 10
    scale: int = 1024
    cells: int = 16
    block: int = 8_192
    queries: int = 512
    buckets: int = 512


def quantised(vectors: DataFrame, id_col: str, vec_col: str, how: Search) -> DataFrame:
    """vec_id and q (array<long>) of the vectors that take part. Components beyond a long's
    range become its ends."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ends = F.lit(-float(1 << 63)), F.lit(float((1 << 63) - 1024))
    q = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * F.lit(float(how.scale)), ends[0]), ends[1])).cast("long"))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; missing last components are 0."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def blocks_of(q: DataFrame, size: int, cells: int) -> DataFrame:
    """Blocks of about `size` vectors, as they lie: n, dims, ids, exact, edges, codes.

    edges: cells + 1 interval ends a dimension; codes: each component's interval."""
    ship(q.sparkSession)

    def pack(ids: np.ndarray, x: np.ndarray) -> dict:
        at = np.linspace(0, 1, cells + 1)
        edges = np.quantile(x, at, axis=0, method="lower").astype(np.int64) if x.shape[1] else np.zeros((cells + 1, 0), np.int64)
        codes = np.zeros(x.shape, np.uint8)
        for d in range(x.shape[1]):
            codes[:, d] = np.clip(np.searchsorted(edges[:, d], x[:, d], side="right") - 1, 0, cells - 1)
        return {"n": len(ids), "dims": x.shape[1], "ids": ids.tobytes(), "exact": x.astype("<i8").tobytes(), "edges": edges.tobytes(), "codes": codes.tobytes()}

    schema = pa.schema([("n", pa.int64()), ("dims", pa.int64()), *[(c, pa.binary()) for c in ("ids", "exact", "edges", "codes")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, have = [], [], 0

        def flush() -> pa.RecordBatch:
            dims = max(p.shape[1] for p in parts)
            x = np.concatenate([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])
            return pa.RecordBatch.from_pylist([pack(np.concatenate(ids), x)], schema)

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, min(size, batch.num_rows - at))
                ids.append(part.column(0).to_numpy())
                parts.append(_matrix(part.column(1)))
                have += len(ids[-1])
                if have >= size:
                    yield flush()
                    ids, parts, have = [], [], 0
        if have:
            yield flush()

    return q.mapInArrow(run, "n long, dims long, ids binary, exact binary, edges binary, codes binary")


def _read(block: dict, column: str, kind, dims: int) -> np.ndarray:
    """A matrix of the block, without the components that the other side lacks (they are 0 there)."""
    return np.frombuffer(block[column], kind).reshape(-1, block["dims"])[:, :dims] if block["dims"] else np.zeros((block["n"] if column != "edges" else 1, 0), kind)


def bounds(queries: dict, vectors: dict, lower: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """(queries, lower or upper bounds of their scores [query, vector]) by the vectors' cells."""
    dims = min(queries["dims"], vectors["dims"])
    real = _read(queries, "exact", "<i8", dims).astype(np.float64)
    codes, edges = _read(vectors, "codes", np.uint8, dims), _read(vectors, "edges", "<i8", dims).astype(np.float64)
    columns = np.arange(dims)
    low, high = edges[codes, columns].T.copy(), edges[codes.astype(np.int64) + 1, columns].T.copy()
    most, sign = np.abs(edges).max(initial=0), -1.0 if lower else 1.0
    if lower:
        low, high = high, low
    for at in range(0, len(real), 64):
        part = real[at : at + 64]
        out = np.maximum(part, 0) @ high + np.minimum(part, 0) @ low
        # sums of doubles may be off in their last places: a bound is widened by more than that
        out += sign * (1 + np.abs(out) * 1e-9 + (np.abs(part).sum(1) * most * 1e-12)[:, None])
        yield slice(at, at + len(part)), out


def block_floor(queries: dict, vectors: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the query in its block, lower bound) of the k highest lower bounds of each query;
    the query's own id is passed over."""
    ids, query_ids = np.frombuffer(vectors["ids"], np.int64), np.frombuffer(queries["ids"], np.int64)
    number, low = [], []
    for part, bound in bounds(queries, vectors, lower=True):
        bound = np.where(ids[None, :] == query_ids[part, None], -np.inf, bound)
        top = -np.partition(-bound, min(k, bound.shape[1]) - 1, axis=1)[:, :k]
        row, _ = sound = np.nonzero(top > -np.inf)
        number.append(row + part.start)
        low.append(top[sound])
    return np.concatenate(number), np.concatenate(low)


def scores(exact: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, exact: as longs where they can't overflow, else as whole numbers of any size,
    held to a long's range at the end of the search."""
    most = int(np.abs(exact.astype(np.float64)).max(initial=0)) * int(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query))
    if most < 1 << 62:
        return exact @ query
    return exact.astype(object) @ query.astype(object) if len(query) else np.zeros(len(exact), np.int64)


def block_top(queries: dict, vectors: dict, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query id, vec id, score) of the k best of a block of vectors for each of a block of
    queries, of those that may reach the query's floor; the query's own id is passed over."""
    dims = min(queries["dims"], vectors["dims"])
    asked, exact = _read(queries, "exact", "<i8", dims), _read(vectors, "exact", "<i8", dims)
    ids, query_ids = np.frombuffer(vectors["ids"], np.int64), np.frombuffer(queries["ids"], np.int64)
    out_query, out_id, out_score = [], [], []
    for part, upper in bounds(queries, vectors, lower=False):
        for i, bound in enumerate(upper, part.start):
            rows = np.flatnonzero((bound >= floors[i]) & (ids != query_ids[i]))
            rows = rows[np.argsort(-bound[rows], kind="stable")]
            best, take = np.zeros(0, np.int64), 0
            while take < len(rows):
                more = rows[take : take + max(4 * k, take)]
                best = np.concatenate([best, scores(exact[more], asked[i])])
                take += len(more)
                # certain, if the kth score is beyond every bound not read
                if take < len(rows) and take >= k and sorted(best.tolist())[-k] > bound[rows[take]]:
                    break
            read = ids[rows[:take]]
            order = sorted(range(take), key=lambda j: (-best[j], read[j]))[:k]
            out_query += [int(query_ids[i])] * len(order)
            out_id += read[order].tolist()
            out_score += [int(best[j]) for j in order]
    return np.array(out_query, np.int64), np.array(out_id, np.int64), out_score


def top_k(vectors: DataFrame, is_query: Column, how: Search = Search(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector that is_query holds for, its k
    vectors with the highest inner products, ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows
    without an id. A query's own id is no candidate, in whichever row. Vectors of different
    lengths are compared as if the shorter went on with zeros. Repeated rows are ranked as
    rows of their own, repeated queries give the result of one. Scores are exact; those beyond
    a long's range are ranked as they are and returned as its ends. Other columns are not
    read. An empty table gives no rows."""
    q = written(quantised(vectors, id_col, vec_col, how), "quantised")
    n_queries = q.where(is_query).count()
    number = F.monotonically_increasing_id().alias("no")
    rows = written(blocks_of(q, how.block, how.cells).select("*", number), "vectors")
    asked = blocks_of(q.where(is_query).dropDuplicates(["vec_id"]).repartition(max(1, math.ceil(n_queries / how.queries))), how.queries, how.cells)
    asked = written(asked.select("*", number), "queries")
    buckets = max(1, min(how.buckets, rows.count()))
    side = lambda df, p, names: df.select("bucket", *[F.col(c).alias(f"{p}{c}") for c in names])
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("no"), F.lit(buckets)))
    copies = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))).hint("merge")
    k = how.k
    ship(vectors.sparkSession)

    def halves(batch: pa.RecordBatch) -> Iterator[tuple[dict, dict]]:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            yield tuple({c[2:]: v for c, v in row.items() if c.startswith(p)} for p in ("a_", "v_"))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, held in halves(batch):
                place, bound = block_floor(mine, held, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), mine["no"]), pa.int64()), pa.array(place, pa.int64()), pa.array(bound, pa.float64())], names=["no", "place", "low"])

    pairs = side(copies(asked), "a_", ["no", "n", "dims", "ids", "exact"]).join(side(placed, "v_", ["n", "dims", "ids", "edges", "codes"]), "bucket").drop("bucket")
    order = Window.partitionBy("no", "place").orderBy(F.col("low").desc())
    lows = pairs.mapInArrow(low, "no long, place long, low double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # a query with fewer than k candidates has no floor
    floors = lows.groupBy("no", "place").agg(F.when(F.count("*") >= k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("low"))
    floors = floors.groupBy("no").agg(F.collect_list(F.struct("place", "low")).alias("floors"))  # a block's queries
    asked = written(asked.join(floors, "no", "left"), "floors")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, held in halves(batch):
                floor = np.full(mine["n"], -np.inf)
                for x in mine["floors"] or []:
                    floor[x["place"]] = x["low"]
                query, vec, score = block_top(mine, held, floor, k)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array([Decimal(x) for x in score], pa.decimal128(38, 0))], names=["query_id", "vec_id", "score"])

    pairs = side(copies(asked), "a_", ["n", "dims", "ids", "exact", "floors"]).join(side(placed, "v_", ["n", "dims", "ids", "edges", "codes", "exact"]), "bucket").drop("bucket")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = pairs.mapInArrow(best, "query_id long, vec_id long, score decimal(38,0)").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = F.least(F.greatest(F.col("score"), F.lit(Decimal(-(1 << 63)))), F.lit(Decimal((1 << 63) - 1)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", held.cast("long").alias("score"))
