"""Ranked lexical search by block-max pruning.

The index is built once and knows no queries.  Documents are packed, as they lie in
their partitions, into segments, and a segment is a row:

- its dictionary of terms, with the number of its documents that hold each;
- its forward index: the (term, frequency) pairs of each document;
- its blocks, ranges of `block` documents: per block and term the highest impact that a
  document of the block has from the term.  Impacts depend on the corpus' mean length, so
  a second pass makes the maxima from the forward index.

A search brings blocks of queries and segments together in an equi-join on a bucket.  A
query's bound for a block is the weighted sum of the block's maxima.  A first pass
scores each query's best block of every segment; the kth score found is the query's
floor.  The second pass goes through a segment's blocks in the order of falling bounds,
scores them from the forward index, and stops when the bound drops below the floor or
below the kth score found in the segment.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bucketed, bytes_in_parts, lower_bytes, written
from loomgraph.session import ship

#: Terms in UTF-8: digits, letters and whatever lies beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class Lexical:
    """k: documents of each query. block: documents in a block. documents, postings: in a segment,
    about, at most; a longer document may exceed it. queries, query_bytes: in a block of queries, at
    most. buckets: of segments, at most."""

    k: int = 20
    block: int = 32
    documents: int = 1_024
    postings: int = 200_000
    queries: int = 256
    query_bytes: int = 4_000_000
    buckets: int = 1_024


def term_counts(text: bytes) -> tuple[int, Counter]:
    """(number of terms, term -> occurrences) of a whole text in UTF-8."""
    found: Counter = Counter()
    for part in bytes_in_parts(text, TERM):
        found.update(TERM.findall(lower_bytes(part)))
    return found.total(), found


#: Binary columns: kinds of their numbers.
_FORWARD = {"sizes": np.int64, "starts": np.int64, "codes": np.int32, "tfs": np.int32, "dfs": np.int32}
_MAXIMA = {"block_starts": np.int64, "block_codes": np.int32, "maxima": np.int32}


def forward(docs: DataFrame, how: Lexical, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a segment: ids, sizes (terms of each document), terms (joined by newlines, which no term
    holds), starts, codes and tfs (the documents' postings), dfs (by term), and the sums n_docs
    (documents with a term) and n_terms. Documents without terms are left out."""
    ship(docs.sparkSession)
    names = ["ids", "terms", *_FORWARD, "n_docs", "n_terms"]
    kinds = [pa.list_(pa.int64()), pa.binary(), *[pa.binary()] * len(_FORWARD), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def packed(ids: list, sizes: list[int], counts: list[Counter]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        codes = np.fromiter((number.setdefault(t, len(number)) for c in counts for t in c), np.int32)
        tfs = np.fromiter((n for c in counts for n in c.values()), np.int32)
        starts = np.cumsum([0, *map(len, counts)])
        own = {"sizes": sizes, "starts": starts, "codes": codes, "tfs": tfs, "dfs": np.bincount(codes, minlength=len(number))}
        row = {"ids": ids, "terms": b"\n".join(number), "n_docs": len(ids), "n_terms": sum(sizes)} | {c: np.asarray(v, _FORWARD[c]).tobytes() for c, v in own.items()}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, counts, have = [], [], [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_buffer()
                n, found = term_counts(text.to_pybytes()) if text is not None else (0, None)
                if not n:
                    continue
                ids.append(batch.column(0)[at].as_py())
                sizes.append(n)
                counts.append(found)
                have += len(found)
                if have >= how.postings or len(ids) >= how.documents:
                    yield packed(ids, sizes, counts)
                    ids, sizes, counts, have = [], [], [], 0
        if ids:
            yield packed(ids, sizes, counts)

    types = "ids array<long>, terms binary, " + ", ".join(f"{c} binary" for c in _FORWARD) + ", n_docs long, n_terms long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, types)


def impacts(tfs: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence of a term adds, before its weight, in postings of documents of those sizes."""
    m = 75 + (25 * sizes * n_docs) // n_terms
    tf = tfs.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def with_maxima(segments: DataFrame, n_docs: int, n_terms: int, how: Lexical) -> DataFrame:
    """Segments with each posting's impact in place of its frequency, and with their blocks:
    block_starts, block_codes and maxima (the terms of each block)."""
    names = ["ids", "terms", "starts", "codes", "dfs", "impacts", *_MAXIMA]
    schema = pa.schema([(c, pa.list_(pa.int64()) if c == "ids" else pa.binary()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = {c: np.frombuffer(row[c], kind) for c, kind in _FORWARD.items()}
                lengths = np.diff(own["starts"])
                gain = impacts(own["tfs"], np.repeat(own["sizes"], lengths), n_docs, n_terms)
                block = np.repeat(np.arange(len(lengths)) // how.block, lengths)
                key = block * len(own["dfs"]) + own["codes"]
                order = np.argsort(key, kind="stable")
                pairs, first = np.unique(key[order], return_index=True)
                at, codes = np.divmod(pairs, len(own["dfs"]))
                n_blocks = int(block[-1]) + 1
                made = {"block_starts": np.searchsorted(at, np.arange(n_blocks + 1)), "block_codes": codes, "maxima": np.maximum.reduceat(gain[order], first)}
                out = {c: row[c] for c in ("ids", "terms", "starts", "codes", "dfs")} | {"impacts": gain.astype(np.int32).tobytes()}
                yield pa.RecordBatch.from_pylist([out | {c: v.astype(_MAXIMA[c]).tobytes() for c, v in made.items()}], schema)

    types = ", ".join(f"{c} {'array<long>' if c == 'ids' else 'binary'}" for c in names)
    return segments.mapInArrow(run, types)


@dataclass(frozen=True)
class Index:
    """segments: the written table, dealt by bucket. buckets: their number. n_docs: documents with a term."""

    segments: DataFrame
    buckets: int
    n_docs: int


def build_index(docs: DataFrame, how: Lexical = Lexical(), id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of all documents with a term; it serves any number of searches."""
    plain = written(forward(docs, how, id_col, text_col), "forward")
    total = plain.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    buckets = max(1, min(how.buckets, plain.count()))
    made = with_maxima(plain, int(total["n"]), max(1, int(total["l"])), how).withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    return Index(bucketed(made, "bucket", "segments"), buckets, int(total["n"]))


def query_blocks(items: DataFrame, how: Lexical, id_col: str, text_col: str) -> DataFrame:
    """A row for each block of queries: no, item_ids, terms (a block's distinct ones, joined by newlines),
    starts, codes and repeats (each query's terms). Queries of one id and text are one."""
    ship(items.sparkSession)
    names = ["no", "item_ids", "terms", "starts", "codes", "repeats"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number: dict[bytes, int] = {}
                counts = [term_counts(x["text"] or b"")[1] for x in row["items"]]
                codes = np.fromiter((number.setdefault(t, len(number)) for c in counts for t in c), np.int32)
                repeats = np.fromiter((n for c in counts for n in c.values()), np.int64)
                starts = np.cumsum([0, *map(len, counts)])
                yield pa.RecordBatch.from_pylist([{"no": row["no"], "item_ids": [x["id"] for x in row["items"]], "terms": b"\n".join(number), "starts": starts.astype(np.int64).tobytes(), "codes": codes.tobytes(), "repeats": repeats.tobytes()}], schema)

    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull()).distinct()
    # parts of a hash first, so that the numbers need no single task
    n_parts = max(1, -(-rows.count() // (4 * how.queries)))
    order = Window.partitionBy("part").orderBy("id", "text")
    by_number, by_bytes = F.floor((F.row_number().over(order) - 1) / how.queries), F.floor(F.sum(F.length("text")).over(order) / how.query_bytes)
    placed = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n_parts))).withColumn("at", F.struct(by_number, by_bytes))
    grouped = placed.groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("items"))
    return written(grouped, "grouped").select(F.monotonically_increasing_id().alias("no"), "items").mapInArrow(run, "no long, item_ids array<long>, terms binary, starts binary, codes binary, repeats binary")


def shared_terms(asked: dict, held: dict) -> tuple[np.ndarray, np.ndarray]:
    """(codes in the block of queries, codes in the segment) of the terms that both have."""
    mine = {t: i for i, t in enumerate(asked["terms"].split(b"\n"))} if asked["terms"] else {}
    both = [(mine[t], i) for i, t in enumerate(held["terms"].split(b"\n")) if t in mine]
    out = np.array(both, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _rows_of(starts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The starts of the ranges, when only the kept entries stay."""
    return np.concatenate([[0], np.cumsum(keep)])[starts]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the ranges between starts, in longs; an empty one is 0."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def search_segment(asked: dict, held: dict, weights: np.ndarray, floors: np.ndarray | None, how: Lexical) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(query's number in its block, place of the document in the segment, score) of documents that may be
    among a query's k best. floors: scores that the queries' k best reach; without them only the
    block with the highest bound is scored."""
    mine, theirs = shared_terms(asked, held)
    starts, codes, gain, block_starts, block_codes, maxima = (np.frombuffer(held[c], k) for c, k in (("starts", np.int64), ("codes", np.int32), ("impacts", np.int32), ("block_starts", np.int64), ("block_codes", np.int32), ("maxima", np.int32)))
    to_local = np.full(len(np.frombuffer(held["dfs"], np.int32)) + 1, -1)
    to_local[theirs] = np.arange(len(theirs))
    keep, keep_max = to_local[codes] >= 0, to_local[block_codes] >= 0
    starts, codes, gain = _rows_of(starts, keep), to_local[codes[keep]], gain[keep].astype(np.int64)
    block_starts, block_codes, maxima = _rows_of(block_starts, keep_max), to_local[block_codes[keep_max]], maxima[keep_max].astype(np.int64)
    n_docs, n_blocks = len(starts) - 1, len(block_starts) - 1
    query_starts, query_codes, repeats = (np.frombuffer(asked[c], k) for c, k in (("starts", np.int64), ("codes", np.int32), ("repeats", np.int64)))
    from_mine = np.full(len(weights) + 1, -1)
    from_mine[mine] = np.arange(len(mine))
    number, place, score = [], [], []
    for q in range(len(query_starts) - 1):
        own = slice(query_starts[q], query_starts[q + 1])
        local = from_mine[query_codes[own]]
        w = np.zeros(len(theirs), np.int64)
        w[local[local >= 0]] = (weights[query_codes[own]] * repeats[own])[local >= 0]
        if not w.any():
            continue
        bounds = _sums(w[block_codes] * maxima, block_starts)
        order = np.argsort(-bounds, kind="stable")
        floor, best = int(floors[q]) if floors is not None else 1, np.zeros(0, np.int64)
        for b in order[: 1 if floors is None else n_blocks]:
            if bounds[b] < floor:
                break
            lo, hi = b * how.block, min(n_docs, (b + 1) * how.block)
            part = slice(starts[lo], starts[hi])
            got = _sums(w[codes[part]] * gain[part], starts[lo : hi + 1] - starts[lo])
            good = np.flatnonzero(got >= floor)
            if len(good):
                number.append(np.full(len(good), q))
                place.append(lo + good)
                score.append(got[good])
                best = np.sort(np.concatenate([best, got[good]]))[-how.k :]
                if len(best) == how.k:
                    floor = max(floor, int(best[0]))
    return number, place, score


def search(index: Index, items: DataFrame, how: Lexical = Lexical(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each query's k documents with the highest scores above 0, equal
    scores by ascending doc_id, a null one last.

    Queries and documents that are null, empty or have no terms take no part. Repeated documents
    are ranked as rows of their own; repeated queries give the result of one; queries that share an
    id (or have none) but not the text have ranks of their own. Other columns are not read. Empty
    tables give no rows."""
    blocks = written(query_blocks(items, how, id_col, text_col), "queries")
    side = lambda df, p, names: df.select("bucket", *[F.col(c).alias(f"{p}{c}") for c in names])
    copies = lambda df, names: side(df.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.buckets - 1).cast("long")))), "a_", names)
    held = lambda names: side(index.segments, "v_", names)
    # the queries' side is small and hashed, so that segments are neither shuffled nor sorted
    meet = lambda asked, names: asked.hint("shuffle_hash").join(held(names), "bucket").drop("bucket")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                yield tuple({c[2:]: v for c, v in row.items() if c.startswith(p)} for p in ("a_", "v_"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, segment in halves(batches):
            mine, theirs = shared_terms(asked, segment)
            dfs = np.frombuffer(segment["dfs"], np.int32)[theirs].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), asked["no"]), pa.int64()), pa.array(mine, pa.int64()), pa.array(dfs, pa.int64())], names=["no", "code", "df"])

    # terms' weights: the log of the whole corpus' frequencies, a sum over segments
    df = meet(copies(blocks, ["no", "terms"]), ["terms", "dfs"]).mapInArrow(frequencies, "no long, code long, df long")
    df = df.groupBy("no", "code").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = df.select("no", F.struct("code", weight.alias("weight")).alias("w")).groupBy("no").agg(F.collect_list("w").alias("weights"))
    blocks = written(blocks.join(weights, "no"), "weighted")

    def weights_of(asked: dict) -> np.ndarray:
        out = np.zeros(asked["terms"].count(b"\n") + 1, np.int64)
        for w in asked["weights"]:
            out[w["code"]] = w["weight"]
        return out

    asking = ["no", "item_ids", "terms", "starts", "codes", "repeats", "weights"]
    holding = ["ids", "terms", "dfs", "starts", "codes", "impacts", *_MAXIMA]

    def searcher(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for asked, segment in halves(batches):
                floors = None
                if not first:
                    floors = np.ones(len(asked["item_ids"]), np.int64)
                    for x in asked["floors"] or []:
                        floors[x["place"]] = x["floor"]
                number, place, score = (np.concatenate([np.zeros(0, np.int64), *a]) for a in search_segment(asked, segment, weights_of(asked), floors, how))
                items, ids = pa.array(asked["item_ids"], pa.int64()), pa.array(segment["ids"], pa.int64())
                columns = {"no": pa.array(np.full(len(number), asked["no"]), pa.int64()), "place": pa.array(number, pa.int64()), "score": pa.array(score, pa.int64())}
                if not first:
                    columns |= {"item_id": items.take(pa.array(number)), "doc_id": ids.take(pa.array(place))}
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

        return run

    pairs = meet(copies(blocks, asking), holding)
    top = Window.partitionBy("no", "place").orderBy(F.col("score").desc())
    found = pairs.mapInArrow(searcher(True), "no long, place long, score long").withColumn("rank", F.row_number().over(top)).where(F.col("rank") == how.k)
    floors = found.groupBy("no").agg(F.collect_list(F.struct("place", F.col("score").alias("floor"))).alias("floors"))  # a block's queries
    blocks = written(blocks.join(floors, "no", "left"), "floors")
    pairs = meet(copies(blocks, [*asking, "floors"]), holding)
    order = Window.partitionBy("no", "place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = pairs.mapInArrow(searcher(False), "no long, place long, score long, item_id long, doc_id long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
