"""Registered queries on histories in time (as-of joins, files through their names), on dense graphs and on
names by trigrams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import evolution, graph, renames, rollup, trigrams
from loomgraph.operators.asof import asof_join
from loomgraph.sources.shared import fresh_path, written


def previous_change(spark: SparkSession, d: str) -> DataFrame:
    """For each change the last one of the same file on an earlier day: who made it, and how long before."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
    tie = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")]
    part = F.col("l_partkey")
    out = asof_join(lines, lines, {"part": (part, part)}, (F.expr("l_shipdate - INTERVAL 1 DAY"), F.col("l_shipdate")), tie)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("match.l_returnflag").alias("author_before"), F.datediff("l_shipdate", "match.l_shipdate").cast("long").alias("days"))


def _moved(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes of files, of which every sixth renames one and some swap two."""
    events = spark.read.parquet(f"{d}/events.parquet")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    id_, user = F.col("event_id"), F.col("user_id")
    own, other, next_ = name(user % 20), name((user * 3 + id_) % 23), name((user + 1) % 20)
    row = lambda path, old: F.struct(path.alias("path"), old.alias("old_path"))
    none = F.lit(None).cast("string")
    rows = F.when((id_ % 6 == 0) & (own != other), F.array(row(other, own))).when(id_ % 50 == 1, F.array(row(own, next_), row(next_, own))).otherwise(F.array(row(own, none)))
    made = events.select(id_.alias("hash"), F.col("ts").alias("committed_at"), "event_type", F.col("value"), F.explode(rows).alias("change"))
    return made.select("hash", "committed_at", "event_type", "value", "change.path", "change.old_path")


FOLLOWED = evolution.Roles(path="file", author="event_type", churn="value")


def followed_churn(spark: SparkSession, d: str) -> DataFrame:
    """Commits, churn and the last name of each file through its names."""
    rows = written(renames.followed(_moved(spark, d)), "followed")
    churn = evolution.churn(rows, FOLLOWED).withColumnRenamed("path", "file")
    names = rows.groupBy("file").agg(F.max("last_name").alias("last_name"))
    return churn.join(names, "file").select("file", "last_name", "commits", F.round("churn", 2).alias("churn"), "last_touched")


def followed_ownership(spark: SparkSession, d: str) -> DataFrame:
    """The owner of each file through its names."""
    return evolution.ownership(renames.followed(_moved(spark, d)), FOLLOWED).withColumnRenamed("path", "file")


def _near_nations(spark: SparkSession, d: str) -> DataFrame:
    """A dense graph: nations and those whose suppliers shipped in the same orders."""
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("s"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").join(suppliers, "l_suppkey").select("l_orderkey", "s").distinct()
    a, b = lines.withColumnRenamed("s", "source"), lines.withColumnRenamed("s", "target")
    return a.join(b, "l_orderkey").where("source <> target").select("source", "target").distinct()


def path_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many simple paths of each depth a dense graph has."""
    return graph.Paths(_near_nations(spark, d), "1", "callees", 4).counts()


def paths_to(spark: SparkSession, d: str) -> DataFrame:
    """A page of the paths from one node to another."""
    page = graph.Paths(_near_nations(spark, d), "1", "callees", 4, to="7").page(150, 2000)
    return page.select("node", F.array_join("path", " > ").alias("path"), "depth")


def name_substrings(spark: SparkSession, d: str) -> DataFrame:
    """The customers' and parts' names that contain a text or match a pattern, by trigrams."""
    index = trigrams.index_of(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name"), fresh_path(spark, "trigrams"), "p_name")
    parts = [index.containing("WIDG").withColumn("asked", F.lit("substring")), index.matching("^(red|blue) wid.*t$").withColumn("asked", F.lit("pattern")), index.matching("((a+)+e?d ?)+widget").withColumn("asked", F.lit("repetitions"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("asked", "p_partkey", "p_name")


PAGE_FILES = evolution.Roles(path="path", commit="page_id DIV 7", author="concat('w', page_id % 5)", churn="length(html)")


def folder_sums(spark: SparkSession, d: str) -> DataFrame:
    """Pages as changes of the files that their addresses name: sums of each folder."""
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("path", F.regexp_replace("url", "^[a-z]+://", ""))
    return rollup.folder_evolution(pages, PAGE_FILES)


def sketched_range(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orders of each supplier in a range of months by stored sketches, beside exact numbers:
    whether the estimate is within five standard errors."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    roles = evolution.Roles(path="l_suppkey", commit="l_orderkey", author="l_partkey", churn="l_linenumber")
    stored = written(rollup.sketched(lines, F.date_format("l_shipdate", "yyyy-MM"), roles), "sketches")
    found = rollup.over_periods(stored, F.lit("1997-03"), F.lit("2000-10"))
    exact = lines.where("date_format(l_shipdate, 'yyyy-MM') BETWEEN '1997-03' AND '2000-10'").groupBy(F.col("l_suppkey").alias("path")).agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))
    near = lambda got, want: F.abs(F.col(got) - F.col(want)) <= F.lit(5 * 1.04 / 2 ** (rollup.PRECISION / 2)) * F.col(want)
    return found.join(exact, "path").select("path", "changes", "churn", "orders", "parts", (near("commits", "orders") & near("authors", "parts")).alias("near"))


QUERIES = {f.__name__: f for f in (previous_change, followed_churn, followed_ownership, path_counts, paths_to, name_substrings, folder_sums, sketched_range)}

_DENSE = """
l AS (SELECT DISTINCT l_orderkey, s_nationkey::VARCHAR AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
edges AS (SELECT DISTINCT a.s AS source, b.s AS target FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.s <> b.s),
walk(node, path, depth) AS (
  SELECT '1', ['1'], 0 UNION ALL
  SELECT target, list_append(path, target), depth + 1 FROM walk JOIN edges ON source = node WHERE depth < {depth} AND NOT list_contains(path, target))"""

_FOLLOWED = """
e AS (
  SELECT event_id AS hash, ts, event_type, value, 'f' || (user_id % 20) AS own, 'f' || ((user_id * 3 + event_id) % 23) AS other, 'f' || ((user_id + 1) % 20) AS nxt,
    4 * dense_rank() OVER (ORDER BY ts, event_id::VARCHAR) AS pos FROM events),
ch AS (
  SELECT *, other AS path, own AS old FROM e WHERE hash % 6 = 0 AND own <> other
  UNION ALL SELECT *, own, nxt FROM e WHERE hash % 50 = 1 AND NOT (hash % 6 = 0 AND own <> other)
  UNION ALL SELECT *, nxt, own FROM e WHERE hash % 50 = 1 AND NOT (hash % 6 = 0 AND own <> other)
  UNION ALL SELECT *, own, NULL FROM e WHERE NOT (hash % 6 = 0 AND own <> other) AND hash % 50 <> 1),
cuts AS MATERIALIZED (
  SELECT path AS at_path, pos + 1 AS p, min(old) AS came, hash, path || '#' || (pos + 1) AS span FROM ch WHERE old IS NOT NULL GROUP BY path, pos, hash
  UNION ALL SELECT DISTINCT old, pos, NULL, hash, old || '#' || pos FROM ch WHERE old IS NOT NULL),
up AS MATERIALIZED (
  SELECT a.span, a.at_path, a.p, coalesce(b.span, a.came || '#') AS up FROM (SELECT *, p - 2 AS look FROM cuts WHERE came IS NOT NULL) a
  ASOF LEFT JOIN cuts b ON a.came = b.at_path AND a.look >= b.p),
walk(span, at_path, p, root) AS (SELECT span, at_path, p, up FROM up UNION ALL SELECT w.span, w.at_path, w.p, up.up FROM walk w JOIN up ON up.span = w.root),
roots AS MATERIALIZED (SELECT span, any_value(at_path) AS at_path, any_value(p) AS p, any_value(root) AS root FROM walk WHERE root NOT IN (SELECT span FROM up) GROUP BY span),
names AS (SELECT root, arg_max(at_path, p) AS last_name FROM roots GROUP BY root),
placed AS (SELECT ch.*, coalesce(b.span, ch.path || '#') AS span FROM (SELECT *, pos + 2 AS look FROM ch) ch ASOF LEFT JOIN cuts b ON ch.path = b.at_path AND ch.look >= b.p),
rooted AS (SELECT placed.*, coalesce(roots.root, placed.span) AS root FROM placed LEFT JOIN roots ON roots.span = placed.span),
f AS MATERIALIZED (
  SELECT r.*, CASE WHEN c.hash IS NULL THEN split_part(r.root, '#', 1) ELSE c.at_path || '@' || c.hash END AS file, coalesce(names.last_name, split_part(r.root, '#', 1)) AS last_name
  FROM rooted r LEFT JOIN cuts c ON c.span = r.root LEFT JOIN names ON names.root = r.root)"""

SQL = {
    "previous_change": """
WITH r AS (SELECT l_partkey AS p, l_shipdate AS d, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS flag FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, r.flag AS author_before, date_diff('day', r.d, l_shipdate) AS days
FROM lineitem ASOF LEFT JOIN r ON l_partkey = r.p AND l_shipdate - INTERVAL 1 DAY >= r.d""",
    "folder_sums": """
WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, page_id // 7 AS c, 'w' || page_id % 5 AS author, length(html) AS churn FROM pages WHERE url IS NOT NULL),
e AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
f AS (SELECT path, c, author, churn, unnest(list_transform(range(greatest(len(parts), 1)), lambda k: array_to_string(parts[1:k], '/'))) AS folder FROM e),
a AS (SELECT folder, author, count(*) AS n FROM f GROUP BY 1, 2),
t AS (SELECT folder, arg_min(author, (-n, author)) AS top_author, max(n) AS n FROM a GROUP BY folder)
SELECT f.folder, CASE WHEN f.folder = '' THEN 0 ELSE len(string_split(f.folder, '/')) END::INTEGER AS depth, count(DISTINCT path) AS files, count(DISTINCT c) AS commits, count(*) AS changes, sum(churn)::BIGINT AS churn,
  any_value(t.top_author) AS top_author, round(any_value(t.n) / count(*), 3) AS top_author_share FROM f JOIN t ON t.folder = f.folder GROUP BY f.folder""",
    "sketched_range": """
SELECT l_suppkey AS path, count(*) AS changes, sum(l_linenumber)::BIGINT AS churn, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, true AS near
FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '1997-03' AND '2000-10' GROUP BY 1""",
    "path_counts": f"WITH RECURSIVE {_DENSE.format(depth=4).strip()} SELECT depth, count(*) AS n FROM walk GROUP BY depth",
    "paths_to": f"WITH RECURSIVE {_DENSE.format(depth=4).strip()} SELECT node, array_to_string(path, ' > ') AS path, depth FROM walk WHERE node = '7' ORDER BY depth, node, walk.path LIMIT 2000 OFFSET 150",
    "name_substrings": """
SELECT 'substring' AS asked, p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widg')
UNION ALL SELECT 'pattern', p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) wid.*t$')
UNION ALL SELECT 'repetitions', p_partkey, p_name FROM part WHERE regexp_matches(p_name, '((a+)+e?d ?)+widget')""",
    "followed_churn": f"""
WITH RECURSIVE {_FOLLOWED.strip()}
SELECT file, max(last_name) AS last_name, count(*) AS commits, round(sum(value), 2) AS churn, max(ts) AS last_touched FROM f GROUP BY file""",
    "followed_ownership": f"""
WITH RECURSIVE {_FOLLOWED.strip()},
a AS (SELECT file, event_type AS author, count(*) AS c FROM f GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY c DESC, author) AS k, sum(c) OVER (PARTITION BY file) AS total FROM a)
SELECT file, author AS top_author, round(c / total, 3) AS top_author_share, total::BIGINT AS total_commits FROM k WHERE k = 1""",
}
