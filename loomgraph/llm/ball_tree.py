"""K-means by ball-tree filtering.

Vectors are packed, as they lie in their partitions, into blocks, and each block holds a
metric tree. A node stores its centre, its radius, its number of vectors and their
integer sum; a node's vectors are one range of the block. A round walks each tree from
its root with the centroids that may still be nearest: by the triangle inequality a
centroid is out for a whole ball, if its distance less the radius is above another's
distance plus the radius. A ball with one centroid left adds its stored count and sum,
whole; a leaf with several compares its vectors one by one, in integers.

A round is one job over the written trees. A task adds up what its blocks give, so that
a row a centroid, dimension and task is shuffled; the driver sees the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.session import ship

#: Sums are kept as high and low parts of so many bits, so that longs hold them at any size of components.
_LOW = 31
_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Clustering:
    """clusters: number of centroids. rounds: of assigning and moving. dims: components that a
    vector must have. scale: components become floor(scale * x). seed: of the order in which
    the first centroids are taken. block: vectors in a tree. leaf: vectors in a leaf, at most."""

    clusters: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    seed: int = 3
    block: int = 8_192
    leaf: int = 32


def kept(vectors: DataFrame, how: Clustering, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and q (array<long>) of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    sound = (F.size(x) == how.dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ends = F.lit(-float(1 << 63)), F.lit(float((1 << 63) - 1024))
    q = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * F.lit(float(how.scale)), ends[0]), ends[1])).cast("long"))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q"))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances [vector, centroid], exact: in doubles where they hold every whole number
    that occurs, else in longs, else in integers of any size."""
    most = max([0, *(abs(int(e)) for a in (x, centroids) if a.size for e in (a.min(), a.max()))])
    far = 4 * max(1, x.shape[1]) * most * most
    kind = np.float64 if far < 1 << 53 else np.int64 if far < 1 << 62 else object
    a, c = x.astype(kind), centroids.astype(kind)
    out = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    return out.astype(np.int64) if kind is np.float64 else out


def halves(x: np.ndarray) -> np.ndarray:
    """[..., 2]: x's high and low parts."""
    return np.stack([x >> _LOW, x & ((1 << _LOW) - 1)], -1)


def grown(x: np.ndarray, leaf: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the vectors, nodes) of a tree over x. Nodes: start, end (their range in that order),
    left, right (-1 at a leaf), centre, radius and sums (halves). Vectors that are all equal
    are one leaf, however many."""
    order, real = np.arange(len(x)), x.astype(np.float64)
    start, end, left, right, centre, radius, sums = [], [], [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        own = real[order[lo:hi]]
        middle = own.mean(0)
        away = np.sqrt(((own - middle) ** 2).sum(1))
        start.append(lo), end.append(hi), left.append(-1), right.append(-1)
        centre.append(middle), radius.append(away.max()), sums.append(halves(x[order[lo:hi]]).sum(0))
        return len(start) - 1

    todo = [node(0, len(x))]
    while todo:
        n = todo.pop()
        lo, hi = start[n], end[n]
        rows = order[lo:hi]
        if hi - lo <= leaf or (x[rows] == x[rows[0]]).all():
            continue
        own = real[rows]
        one = own[((own - centre[n]) ** 2).sum(1).argmax()]
        other = own[((own - one) ** 2).sum(1).argmax()]
        half = (hi - lo) // 2
        order[lo:hi] = rows[np.argpartition(own @ (other - one), half)]
        left[n], right[n] = node(lo, lo + half), node(lo + half, hi)
        todo += [left[n], right[n]]
    nodes = {"start": start, "end": end, "left": left, "right": right, "centre": centre, "radius": radius, "sums": sums}
    return order, {k: np.array(v) for k, v in nodes.items()}


#: How each binary column of a block is read.
_KINDS = {"x": np.int64, "start": np.int64, "end": np.int64, "left": np.int64, "right": np.int64, "centre": np.float64, "radius": np.float64, "sums": np.int64}
_BLOCK = "ids array<long>, " + ", ".join(f"{c} binary" for c in _KINDS)


def trees(q: DataFrame, how: Clustering) -> DataFrame:
    """A row a block: ids, the vectors in the tree's order, and the nodes."""
    ship(q.sparkSession)
    schema = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in _KINDS)])

    def packed(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        x, ids = np.concatenate(parts), pa.concat_arrays(ids)
        order, nodes = grown(x, how.leaf)
        row = {"ids": ids.take(pa.array(order)).to_pylist(), "x": x[order]} | nodes
        return pa.RecordBatch.from_pylist([{c: v if c == "ids" else v.astype(_KINDS[c]).tobytes() for c, v in row.items()}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, have = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(how.block - have, batch.num_rows - at))
                ids.append(part.column(0))
                parts.append(part.column(1).flatten().to_numpy().reshape(-1, how.dims))
                have += part.num_rows
                at += part.num_rows
                if have == how.block:
                    yield packed(ids, parts)
                    ids, parts, have = [], [], 0
        if have:
            yield packed(ids, parts)

    return q.mapInArrow(run, _BLOCK)


def read_block(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    for i in range(batch.num_rows):
        block = {c: np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in _KINDS.items()}
        for c, shape in (("x", (-1, dims)), ("centre", (-1, dims)), ("sums", (-1, dims, 2))):
            block[c] = block[c].reshape(shape)
        yield batch.column("ids")[i].values, block


def assign(block: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(balls, their centroids, cluster of each vector): the nodes assigned whole, and -1 for the
    vectors in them; the others' clusters are exact, ties to the smaller number."""
    real = centroids.astype(np.float64)
    cluster = np.full(len(block["x"]), -1)
    balls, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    front, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    leaves, left_over = [np.zeros(0, np.int64)], [np.zeros((0, len(centroids)), bool)]
    while len(front):
        away = np.sqrt(((block["centre"][front][:, None, :] - real[None]) ** 2).sum(2))
        # doubles may be off in their last places: a centroid is out only beyond more than that
        reach = block["radius"][front][:, None] + 1e-9 * (1 + away + np.abs(real).max(initial=0))
        may = may & (away - reach <= np.where(may, away + reach, np.inf).min(1)[:, None])
        whole, is_leaf = may.sum(1) == 1, block["left"][front] < 0
        balls.append(front[whole])
        owners.append(may[whole].argmax(1))
        leaves.append(front[~whole & is_leaf])
        left_over.append(may[~whole & is_leaf])
        deeper = ~whole & ~is_leaf
        front, may = np.concatenate([block["left"][front[deeper]], block["right"][front[deeper]]]), np.concatenate([may[deeper], may[deeper]])
    leaves, left_over = np.concatenate(leaves), np.concatenate(left_over)
    sizes = block["end"][leaves] - block["start"][leaves]
    if len(leaves):
        rows = np.concatenate([np.arange(a, b) for a, b in zip(block["start"][leaves], block["end"][leaves], strict=True)])
        away = squared(block["x"][rows], centroids)
        away[~np.repeat(left_over, sizes, 0)] = away.max() + 1 if away.dtype == object else _MOST
        cluster[rows] = away.argmin(1)
    return np.concatenate(balls), np.concatenate(owners), cluster


def first_centroids(q: DataFrame, how: Clustering) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id; equal hashes in the order of components.
    Rows without an id come only after all others."""
    key = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = q.withColumn("at", key).orderBy(F.col("at").asc_nulls_last(), "q").limit(how.clusters).select("q").collect()
    return [list(r["q"]) for r in rows]


def moved(blocks: DataFrame, centroids: list[list[int]], how: Clustering) -> list[list[int]]:
    """Each centroid's next place: the floor of the mean of its vectors; without any it stays."""
    now = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(now), np.int64), np.zeros((len(now), how.dims, 2), np.int64)
        for batch in batches:
            for _, block in read_block(batch, how.dims):
                balls, owners, cluster = assign(block, now)
                np.add.at(count, owners, block["end"][balls] - block["start"][balls])
                np.add.at(sums, owners, block["sums"][balls])
                for k in range(len(now)):
                    own = block["x"][cluster == k]
                    count[k] += len(own)
                    sums[k] += halves(own).sum(0)
        full = np.flatnonzero(count)
        n = len(full) * how.dims
        columns = [np.repeat(full, how.dims), np.tile(np.arange(how.dims), len(full)), np.repeat(count[full], how.dims), sums[full, :, 0].reshape(n), sums[full, :, 1].reshape(n)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "dim", "n", "high", "low"])

    parts = blocks.mapInArrow(run, "cluster long, dim long, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "dim").agg(wide("n"), wide("high"), wide("low")).collect():  # clusters x dims rows
        out[r["cluster"]][r["dim"]] = ((int(r["high"]) << _LOW) + int(r["low"])) // int(r["n"])
    return out


def assigned(blocks: DataFrame, centroids: list[list[int]], how: Clustering) -> DataFrame:
    """vec_id, cluster and distance of each vector."""
    now = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in read_block(batch, how.dims):
                balls, owners, cluster = assign(block, now)
                for ball, owner in zip(balls, owners, strict=True):
                    cluster[block["start"][ball] : block["end"][ball]] = owner
                away = np.zeros(len(cluster), np.int64)
                for k in range(len(now)):
                    own = cluster == k
                    away[own] = [min(d, _MOST) for d in squared(block["x"][own], now[k : k + 1])[:, 0].tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def _held(total: Column) -> Column:
    return F.least(total, F.lit(Decimal(_MOST))).cast("long")


def cluster(vectors: DataFrame, how: Clustering = Clustering(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each
    vector after `rounds` rounds and a last assignment.

    Vectors that are null, hold null or non-finite components or have another number of
    components than `dims` take no part. Repeated rows count as often as they are there. A
    null id is kept; such a row is a first centroid only where all other rows are. With fewer
    vectors than clusters, there are as many clusters as vectors. Components beyond a long's
    range become its ends, and so do distances and their sums; all comparisons are exact.
    Other columns are not read. An empty table gives no rows."""
    spark = vectors.sparkSession
    q = written(kept(vectors, how, id_col, vec_col), "kept")
    centroids = first_centroids(q, how)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = written(trees(q, how), "trees")
    for _ in range(how.rounds):
        now = moved(blocks, centroids, how)
        if now == centroids:
            break  # further rounds would change nothing
        centroids = now
    out = written(assigned(blocks, centroids, how), "assigned")
    sums = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(k, Decimal(sums.get(k, 0)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, total decimal(38,0), centroid_sha256 string")
    every = F.lit(Decimal(sum(sums.values())))
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", _held(F.col("total")).alias("cluster_inertia"), _held(every).alias("inertia"), "centroid_sha256")
