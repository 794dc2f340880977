"""Operators on the symbol graph: degrees, guarded traversal, schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import written

#: Deepest traversal.
MAX_DEPTH = 10
#: What a step follows: from the first column to the second.
DIRECTIONS = {"callees": ("source", "target"), "callers": ("target", "source")}


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """here, there: the distinct steps that a traversal may take."""
    try:
        here, there = DIRECTIONS[direction]
    except KeyError:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}; got {direction!r}") from None
    return edges.select(F.col(here).alias("here"), F.col(there).alias("there")).distinct()


def held_depth(depth: int) -> int:
    """A depth within 1 to MAX_DEPTH."""
    return sorted((1, int(depth), MAX_DEPTH))[1]


def in_degree(edges: DataFrame, target: str = "target") -> DataFrame:
    """node, deg."""
    return edges.groupBy(F.col(target).alias("node")).agg(F.count("*").alias("deg"))


def centrality(edges: DataFrame, target: str = "target") -> DataFrame:
    """node, deg, cen: the degree over the largest one."""
    deg = in_degree(edges, target)
    most = deg.agg(F.greatest(F.max("deg"), F.lit(1)).alias("most"))  # one row
    return deg.join(F.broadcast(most)).select("node", "deg", F.round(F.col("deg") / F.col("most"), 3).alias("cen"))


def trace_path(edges: DataFrame, start: str, direction: str = "callees", depth: int = 5) -> DataFrame:
    """node, path, depth of each simple path from start, which needn't exist; start itself is
    the path of depth 0. edges: source, target (other columns are not read); repeated edges
    count once. depth is held to 1..MAX_DEPTH, and no path visits a node twice, so the
    recursion ends on cycles. Paths can be many on dense graphs: Spark stops at
    spark.sql.cteRecursionRowLimit rows with an error; see reachable() for nodes only."""
    view = f"steps_{uuid.uuid4().hex}"
    steps(edges, direction).createOrReplaceTempView(view)
    # a path says all: its last element is the node, its length the depth
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE found(path) AS (
              SELECT array(CAST(:start AS STRING))
              UNION ALL
              SELECT array_append(f.path, s.there) FROM {view} s JOIN found f ON s.here = element_at(f.path, -1)
              WHERE size(f.path) <= :most AND array_position(f.path, s.there) = 0)
            SELECT element_at(path, -1) AS node, path, size(path) - 1 AS depth FROM found ORDER BY depth, node, path""",
        args={"start": start, "most": held_depth(depth)},
    )


class Paths:
    """The simple paths of a traversal as a table a depth, written one after the other: their number is
    known before any is read, and a page is read from the tables of its depths alone. to: only
    paths that end there, for which steps that can't reach it in time are never taken."""

    def __init__(self, edges: DataFrame, start: str, direction: str = "callees", depth: int = 5, to: str | None = None):
        spark, most = edges.sparkSession, held_depth(depth)
        step = written(steps(edges, direction), "steps")
        left = None
        if to is not None:
            back = reachable(edges, to, next(d for d in DIRECTIONS if d != direction), most)
            left = written(back.select(F.col("node").alias("there"), F.col("depth").alias("far")), "distances")
        level = spark.createDataFrame([([start],)], "path array<string>")
        self.tables, self.to = [], to
        for k in range(most + 1):
            table = written(level, f"paths{k}")
            self.tables.append(table)
            if k == most or table.isEmpty():
                break
            onward = table.where(F.lit(True) if to is None else F.element_at("path", -1) != to).join(step, F.element_at("path", -1) == F.col("here")).where(~F.array_contains("path", F.col("there")))
            if left is not None:
                onward = onward.join(left, "there").where(F.col("far") <= most - k - 1)
            level = onward.select(F.array_append("path", F.col("there")).alias("path"))
        self.numbers = [self._of(t).count() for t in self.tables]

    def _of(self, table: DataFrame) -> DataFrame:
        return table if self.to is None else table.where(F.element_at("path", -1) == self.to)

    def counts(self) -> DataFrame:
        """depth, n: how many paths have each depth."""
        rows = [(k, n) for k, n in enumerate(self.numbers) if n]
        return self.tables[0].sparkSession.createDataFrame(rows, "depth int, n long")

    def page(self, offset: int, limit: int) -> DataFrame:
        """node, path, depth of some of the paths in the order of depth, node and path."""
        out, before = None, 0
        for k, n in enumerate(self.numbers):
            skip, take = max(0, offset - before), min(offset + limit, before + n) - max(offset, before)
            before += n
            if take > 0:
                found = self._of(self.tables[k]).select(F.element_at("path", -1).alias("node"), "path", F.lit(k).alias("depth")).orderBy("node", "path").offset(skip).limit(take)
                out = found if out is None else out.union(found)
        return out if out is not None else self.tables[0].select(F.lit("").alias("node"), "path", F.lit(0).alias("depth")).limit(0)


def reachable(edges: DataFrame, start: str, direction: str = "callees", depth: int = 5) -> DataFrame:
    """node, depth: each node that can be reached, at its least depth. Its size is that of the
    graph, not of its paths: a step is one join of the nodes new in the step before, and a
    written table."""
    step = steps(edges, direction).toDF("node", "next")
    seen = new = edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    for k in range(1, held_depth(depth) + 1):
        new = new.join(step, "node").select(F.col("next").alias("node"), F.lit(k).alias("depth")).distinct().join(seen.select("node"), "node", "left_anti")
        new = written(new, "reached")
        if new.isEmpty():
            break
        seen = seen.union(new)
    return seen


def schema_info(nodes: DataFrame, edges: DataFrame, label: str = "label", kind: str = "type") -> DataFrame:
    """kind ('label' or 'edge_type'), value: the distinct ones, in order."""
    out = nodes.select(F.lit("label").alias("kind"), F.col(label).alias("value")).distinct()
    return out.union(edges.select(F.lit("edge_type").alias("kind"), F.col(kind).alias("value")).distinct()).orderBy("kind", "value")
