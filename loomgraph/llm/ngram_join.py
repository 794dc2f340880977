"""N-gram Jaccard join: documents whose shingle sets overlap enough, as components.

A document's set is its distinct word shingles as 64-bit hashes.  Equal sets are one
node.  Two nodes link when 100 * |x & y| >= percent * |x | y|, so the overlap is at
least ceil(percent * n / 100) for either's size n.

1. Filter. Of the n - T + l smallest hashes of a set, a partner shares l or more (T: the
   least overlap, l: a part of n). Sets that share fewer with any other set are done;
   that is nearly all of them, and no shuffle so far holds more than those prefixes.
2. The others are read again. Shingles that only one of them has can't overlap; a set with
   fewer than T others is done. The rest are ordered by how many sets hold them, the
   rarest first, and sets that share one of the first n - T + 1 are put in one group
   (connected components over one edge a posting).
3. T-occurrence search in each group, by DivideSkip: a query's shortest inverted lists
   are merged, sets that occur in too few are dropped, the rest are sought in the longest
   lists by binary search until the overlap is reached or out of reach. Sets that are
   known to be connected are skipped: one link to a component is enough.

Groups of over `block` shingles, all sets together, are cut into blocks of about that many, so
that a task's memory is bounded in bytes whatever the texts' lengths; each is searched
with the same few hubs; of what isn't connected to the group's core then, blocks are
searched against all blocks. So a large group of near copies costs a search a set, no
pairs are emitted, and every link between different components is found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import own_names, plain_columns, sized, written
from loomgraph.llm.components import components
from loomgraph.llm.token_fst import text_blocks
from loomgraph.session import ship


@dataclass(frozen=True)
class Join:
    """words: of a shingle. percent: of the union. extra: percent of a set by which the
    filter's prefixes are longer. block: shingles of all sets in a search. hubs: sets that each
    block of a large group is searched with."""

    words: int = 4
    percent: int = 85
    extra: int = 8
    block: int = 400_000
    hubs: int = 16


# Odd multipliers of the hashes.
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at a time; a longer word is hashed as a whole.
_WINDOW = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        for k, x in enumerate((int(_M[0]), pow(int(_M[0]), -1, 1 << 64))):
            many = np.full(max(n, _WINDOW), np.uint64(x))
            many[0] = 1
            _powers[k] = np.multiply.accumulate(many)
    return _powers


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of every word of data, which begins and ends with a space."""
    space = _SPACE[data]
    edges = np.flatnonzero(space[:-1] != space[1:]) + 1
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The hashes of words: the sum of a word's bytes' values times powers is a difference of
    running sums."""
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + _WINDOW, side="right")))
        first, last = int(starts[at]), int(stops[to - 1])
        power, inverse = _powers_to(last - first)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTE[data[first:last]] * power[: last - first], out=sums[1:])
        begin = starts[at:to] - first
        hashes[at:to] = _mixed((sums[stops[at:to] - first] - sums[begin]) * inverse[begin])
        at = to
    return hashes


def words_of(starts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The number of words of each text, by the starts of all in the joined texts."""
    return np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0).astype(np.int64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of the texts, in order."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    starts, stops = word_spans(data)
    return span_hashes(data, starts, stops), np.repeat(np.arange(len(texts)), words_of(starts, texts))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer words the whole sequence is one."""
    hashes, text = word_hashes(texts)
    counts = np.bincount(text, minlength=len(texts))
    n = len(hashes) - words + 1
    if n > 0:
        whole = hashes[:n].copy()
        for k in range(1, words):
            whole = whole * _M[3] + hashes[k : k + n]
        inside = text[:n] == text[words - 1 :]
        shingles, owner = _mixed(whole[inside]), text[:n][inside]
    else:
        shingles, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        value = np.full(len(short), 0, np.uint64)
        for k in range(words - 1):
            has = counts[short] > k
            value[has] = value[has] * _M[3] + hashes[first[short[has]] + k]
        shingles = np.concatenate([shingles, _mixed(value ^ _M[0] * counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[fresh], owner[fresh]
    return np.split(shingles, np.searchsorted(owner, np.arange(1, len(texts))))


def _least(n, percent: int):
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def summaries(docs: DataFrame, how: Join) -> DataFrame:
    """doc_id, text_hash, n, node (hash of the set), prefix (its smallest hashes)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, prefix, sizes = [], [], [], []
            for block in text_blocks(batch.column(2), 2_000_000):
                for s in shingle_sets(block, how.words):
                    k = len(s)
                    n.append(k)
                    node.append(_mixed(_mixed(s ^ _M[1]).sum(keepdims=True) + np.uint64(k))[0] if k else np.uint64(0))
                    prefix.append(s[: k - _least(k, how.percent) + max(1, -(-how.extra * k // 100))] if k else s)
                    sizes.append(len(prefix[-1]))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)), arrays], names=["doc_id", "text_hash", "n", "node", "prefix"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, node long, prefix array<long>")


def full_sets(docs: DataFrame, how: Join) -> DataFrame:
    """node, n, shingles of docs (node, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column(1), 2_000_000):
                sets = shingle_sets(block, how.words)
                sizes = [len(s) for s in sets]
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.array(sizes, pa.int64()), arrays], names=["node", "n", "shingles"])
                at += len(block)

    return docs.mapInArrow(run, "node long, n long, shingles array<long>")


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Candidates of a T-occurrence query: (members of the merged short lists, in how many
    of them, the long lists). lists: sorted, the shortest first. The longest ones, fewer
    than `least`, aren't merged; a member of `least` lists then occurs in a short one."""
    total = sum(map(len, lists))
    longest = len(lists[-1]) if lists else 0
    skip = min(least - 1, int(least / (0.01 * np.log2(longest + 2) + 1)), len(lists) - 1)
    short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
    if sum(map(len, short)) <= 256:
        merged = np.fromiter(heapq.merge(*[x.tolist() for x in short]), np.int64)
    else:
        merged = np.sort(np.concatenate(short), kind="stable")  # merges the sorted runs
    if not total:
        return merged, merged, long
    cut = np.flatnonzero(np.diff(merged, prepend=-1))
    seen = np.diff(cut, append=len(merged))
    keep = seen >= least - skip
    return merged[cut[keep]], seen[keep], long


def search(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], query: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (node, node) that connect the sets' components: for each query set and each
    component (labels: those known) that it isn't yet connected to, a link if there is one.

    sets: the shingles of each that other sets may hold."""
    _, comp = np.unique(np.asarray(labels, np.int64), return_inverse=True)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    values, codes = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(codes, kind="stable")
    at = np.searchsorted(codes[order], np.arange(len(values) + 1))
    postings = owner[order]
    coded = np.split(codes, np.cumsum([len(s) for s in sets])[:-1]) if len(sets) else []
    lengths = np.diff(at)
    links = []
    for i in np.flatnonzero(query).tolist():
        n = int(sizes[i])
        mine = coded[i][np.argsort(lengths[coded[i]], kind="stable")]
        least = _least(n, percent)
        if len(mine) < least:
            continue
        found, seen, long = divide_skip([postings[at[c] : at[c + 1]] for c in mine.tolist()], least)
        need = -(-percent * (n + sizes[found]) // (100 + percent))
        fit = (comp[found] != comp[i]) & (need <= np.minimum(n, sizes[found]))
        order = np.argsort(-seen[fit], kind="stable")
        found, seen, need = found[fit][order], seen[fit][order], need[fit][order]
        while len(found):
            j, have, least_here = int(found[0]), int(seen[0]), int(need[0])
            for k, x in enumerate(long):
                if have >= least_here or have + len(long) - k < least_here:
                    break
                p = int(np.searchsorted(x, j))
                have += p < len(x) and x[p] == j
            rest = slice(1, None)
            if have >= least_here:
                links.append((int(nodes[i]), int(nodes[j])))
                comp[comp == comp[j]] = comp[i]
                rest = comp[found] != comp[i]
            found, seen, need = found[rest], seen[rest], need[rest]
    return links


def _searched(groups: DataFrame, keys: list[str], how: Join) -> DataFrame:
    """Links (a, b) found in groups of (node, n, items, query, label)."""
    ship(groups.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[~pdf.duplicated(["node", "query"])]
        links = search(pdf["node"].to_numpy(), pdf["n"].to_numpy(), [np.asarray(x, np.int64) for x in pdf["items"]], pdf["query"].to_numpy(bool), pdf["label"].to_numpy().tolist(), how.percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # groups are small in bytes, not in work
    return groups.select(*keys, "node", "n", "items", "query", "label").repartition(parts, *keys).groupBy(*keys).applyInPandas(run, "a long, b long")


def links_of(sets: DataFrame, how: Join) -> DataFrame:
    """Links (a, b) that connect the components of sets (node, n, shingles)."""
    posts = sets.select("node", "n", F.explode("shingles").alias("s"))
    held = posts.groupBy("s").agg(F.count("*").alias("df"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("s", "df")
    least = F.ceil(F.col("n") * how.percent / 100)
    shared = posts.join(held, "s").groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("df", "s"))).alias("items"))
    shared = shared.select("node", "n", F.transform("items", lambda x: x["s"]).alias("items")).where(F.size("items") >= least)
    shared = written(shared, "shared")
    firsts = F.col("n") - least + 1 - (F.col("n") - F.size("items"))
    prefix = written(shared.where(firsts > 0).select("node", F.explode(F.slice("items", F.lit(1), firsts.cast("int"))).alias("s")), "prefixes")
    hubs = prefix.groupBy("s").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other").select("s", "hub")
    groups = components(prefix.join(hubs, "s").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    groups = groups.select("node", F.col("label").alias("grp"))
    rows = shared.join(groups, "node")
    count = rows.groupBy("grp").agg(F.sum(F.size("items")).alias("members"))
    rows = written(rows.join(count, "grp").select("grp", "members", "node", "n", "items", F.lit(True).alias("query"), F.col("node").alias("label")), "groups")
    small = written(_searched(rows.where(F.col("members") <= how.block), ["grp"], how), "links")
    large = rows.where(F.col("members") > how.block)
    if large.isEmpty():
        return small
    blocks = F.ceil(F.col("members") / how.block).cast("int")
    in_block = F.pmod(F.xxhash64("node"), blocks)
    hub_rows = large.withColumn("k", F.row_number().over(Window.partitionBy("grp", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy("n", "node"))).where("k = 1")
    hub_rows = hub_rows.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("n", "node"))).where(F.col("k") <= how.hubs).drop("k")
    with_hubs = large.withColumn("block", in_block.cast("int")).unionByName(hub_rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))
    first = written(_searched(with_hubs, ["grp", "block"], how), "links")
    labels = components(first)
    known = written(large.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "known")
    per_label = known.groupBy("grp", "label").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("core"))
    known = known.join(per_label, "grp")
    rest = known.where("label <> core").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    # every block of the rest meets every block of the group, the rest's sets as queries
    queries = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    hit = queries.select("grp", "block", F.col("other")).distinct()
    index = known.withColumn("query", F.lit(False)).withColumn("other", in_block.cast("int")).join(hit, ["grp", "other"])
    second = _searched(queries.select("grp", "block", "other", "node", "n", "items", "query", "label").unionByName(index.select("grp", "block", "other", "node", "n", "items", "query", "label")), ["grp", "block", "other"], how)
    return small.union(first).union(written(second, "links"))


def _classes(docs: DataFrame, how: Join, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n, node, label (of the node's component; null if n is 0)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    each = written(summaries(src, how), "summaries")
    posts = each.where("n > 0").select("node", "n", F.explode("prefix").alias("s"))
    held = posts.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("s")
    enough = F.greatest(F.lit(1), F.ceil(F.col("n") * how.extra * how.percent / 10_000))
    alive = posts.join(held, "s").groupBy("node", "n").agg(F.count_distinct("s").alias("c")).where(F.col("c") >= enough).select("node")
    firsts = each.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
    chosen = firsts.join(alive, "node").select("node", F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash"))
    texts = src.join(sized(written(chosen, "alive")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("node", "text")
    sets = written(full_sets(texts, how), "sets")
    labels = components(links_of(sets, how))
    return each.drop("prefix").join(labels, "node", "left").select("doc_id", "text_hash", "n", "node", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))


def ngram_components(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by
    links, its own included).

    Null, empty and white texts have an empty set and are linked with nothing. Repeated
    rows are equal sets: they link. Rows that share an id but not a text are nodes of their
    own. A row without an id links like others but is nobody's component_id. An empty table
    gives no rows. Other columns of docs are not read."""
    found = written(_classes(docs, how, id_col, text_col), "classes")
    ids = found.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    some = found.where("label is not null").join(ids, "label").select("doc_id", "n", "component_id")
    none = found.where("label is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


@plain_columns
def one_of_each(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """One document of each component, that with the smallest id (a null one is the last; of
    different texts under one id the one with the smaller hash); columns of docs unchanged.

    Rows that share id and text become one. Rows that share an id alone are judged apart. Null,
    empty and white texts are linked with nothing and stay. Columns of docs may have any
    names. An empty table gives no rows."""
    found = written(_classes(docs, how, "doc_id", "text").where("label is not null"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"))
    best = found.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("members")).where("members > 1")
    at, text_hash, stays, times = own_names(docs, "join_id", "join_hash", "join_stays", "join_times")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    judged = found.join(best, "label").groupBy(F.col("doc_id").alias(at), F.col("text_hash").alias(text_hash)).agg(F.max(is_best).alias(stays), F.count("*").alias(times))
    # documents alone in their component aren't looked up
    judged = sized(written(judged.where(~F.col(stays) | (F.col(times) > 1)), "judged"))
    mine = docs["doc_id"].cast("long").eqNullSafe(judged[at]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == judged[text_hash])
    both = docs.join(judged, mine, "left").where(F.coalesce(judged[stays], F.lit(True)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = both.where(F.col(times).isNull()).select(*columns)
    same = Window.partitionBy(at, text_hash).orderBy(F.lit(1))
    return kept.unionByName(both.where(F.col(times).isNotNull()).withColumn(stays, F.row_number().over(same)).where(F.col(stays) == 1).select(*columns))
