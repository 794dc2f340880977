"""Registered queries over a repository, its index job, store, service and stream, and their SQL.

The repository is made from the pages: each page is a commit that writes a module's next
version, some with a file of an odd name, its renaming, a binary file or a merged branch beside
it, so SQL over the pages knows its whole history and what the last version holds.

Git writes and compares a folder's whole list for each commit that touches it, so files that stay would
make the work grow with the square of the pages. Merges, which the history doesn't list, put such files
on the shelf after every SPAN ids, and the last merge brings all of them back.
"""

from __future__ import annotations

import json
import os
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.expr import json_flag
from loomgraph.plans.index_job import index_repository
from loomgraph.service import Service
from loomgraph.sources import git
from loomgraph.sources.files import local_path
from loomgraph.sources.shared import fresh_path, written
from loomgraph.sources.storage import Store
from loomgraph.operators.evolution import Roles
from loomgraph.streaming import append_changes, summaries, summarise_changes

#: Modules that the pages are versions of, and the second in which page 0 is committed.
MODULES, EPOCH = 40, 1_700_000_000
#: Ids after which a merge shelves files; a multiple of 9, so that a file is renamed before it is shelved.
SPAN = 63
#: Folders whose files are shelved.
SHELVED = ("bin", "docs", "side")
AS_OF = "2024-01-31 00:00:00"
_made: dict[tuple[str, str], tuple[Path, Store]] = {}


def _version(page: Column, digest: Column) -> Column:
    """A module's text; no two versions share a line. One name is bound by an import, one hidden by a
    parameter, and one function says that it is deprecated."""
    line = lambda text: F.regexp_replace(F.lit(text), "#", page.cast("string"))
    more = F.array_join(F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (page % 3).cast("int")), lambda k: F.concat(line("X#_"), k.cast("string"), line(" = #\n"))), "")
    return F.concat(line("from lib# import tool as t#\n"), line('D# = "'), digest, F.lit('"\n'), line("def f#(x#):\n    return g#(t#(x#))\ndef g#(t#):\n    raise DeprecationWarning(t#())\n"), more)


def _span(page: Column) -> Column:
    """The first id of the span that a page is in."""
    return page - F.pmod(page, F.lit(SPAN))


def _marked(pages: DataFrame) -> DataFrame:
    """page_id, and whether the page is first or last of its span, and has the ids beside it there."""
    order = Window.partitionBy(_span(F.col("page_id"))).orderBy("page_id")
    before, after = F.lag("page_id").over(order), F.lead("page_id").over(order)
    beside = lambda other, by: F.coalesce(other == F.col("page_id") + by, F.lit(False))
    return pages.select("page_id", before.isNull().alias("first"), after.isNull().alias("last"), beside(before, -1).alias("has_before"), beside(after, 1).alias("has_after"))


def _text(n: Column) -> Column:
    return n.cast("string")


def _odd(folder: str, n: Column) -> Column:
    """A path that git quotes."""
    return F.concat(F.lit(f'{folder}/n "'), _text(n), F.lit('"\té.md'))


def _note(n: Column) -> Column:
    return F.concat(F.lit("note "), _text(n), F.lit("\n"))


def _beside(page: Column) -> dict[str, tuple[Column, Column]]:
    """(path, text) of the files that pages have beside their module, by kind."""
    return {
        "odd": (_odd("docs", page), _note(page)), "moved": (_odd("docs/moved", page - 1), _note(page - 1)),
        "binary": (F.concat(F.lit("bin/b"), _text(page), F.lit(".dat")), F.concat(F.lit("\0\1"), _text(page), F.lit("\n\0"))),
        "side": (F.concat(F.lit("side/s"), _text(page), F.lit(".txt")), _note(page)),
    }


def _stream(pages: DataFrame, marks: DataFrame, ends: tuple[int, int]) -> DataFrame:
    """page_id and value: what git's import reads of each page: its commit, and by its number a file
    whose name needs quotes, that file's renaming, a binary file, or a merge of a side branch. Spans but
    the first and last (ends) end with a merge that shelves what they and the one before have left."""
    page, module = F.col("page_id"), F.col("page_id") % MODULES
    data = lambda text: F.concat(F.lit("data "), _text(F.octet_length(text)), F.lit("\n"), text, F.lit("\n"))
    who = lambda late: F.concat(F.lit("w"), _text(page % 5), F.lit(" <w"), _text(page % 5), F.lit("@example.com> "), _text(EPOCH + 3600 * page + late), F.lit(" +0000\n"))
    commit = lambda branch, late, message: F.concat(F.lit(f"commit refs/heads/{branch}\nauthor "), who(late), F.lit("committer "), who(late), data(F.concat(F.lit(message), _text(page))))
    quoted = lambda path: F.concat(F.lit('"'), F.replace(F.replace(path, F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    put = lambda path, text: F.concat(F.lit("M 100644 inline "), quoted(path), F.lit("\n"), data(text))
    files = _beside(page)
    more = F.when(page % 9 == 4, put(*files["odd"])).when((page % 9 == 5) & F.col("has_before"), F.concat(F.lit("R "), quoted(_odd("docs", page - 1)), F.lit(" "), quoted(files["moved"][0]), F.lit("\n")))
    more = more.when(page % 9 == 7, put(*files["binary"])).otherwise("")
    branch = F.concat(commit("side", 60, "side "), F.lit("from refs/heads/main\n"), put(*files["side"]), commit("main", 120, "merge "), F.lit("merge refs/heads/side\n"), put(*files["side"]))
    value = F.concat(commit("main", 0, "page "), put(F.concat(F.lit("src/m"), _text(module), F.lit(".py")), _version(page, F.col("digest"))), more, F.when(page % 9 == 8, branch).otherwise(""))
    inner, latest = _span(page) != _span(F.lit(ends[0])), _span(page) == _span(F.lit(ends[1]))
    # a merge's other parent is the commit before the span
    value = F.concat(F.when(F.col("first") & inner, F.lit("reset refs/heads/shelf\nfrom refs/heads/main\n\n")).otherwise(""), value)
    shelve = F.concat(commit("main", 180, "shelve "), F.lit("merge refs/heads/shelf\n" + "".join(f"D {folder}\n" for folder in SHELVED)))
    value = F.concat(value, F.when(F.col("last") & inner & ~latest, shelve).otherwise(""))
    # marks take little in files and much in memory: by their size they would be broadcast
    return pages.join(marks.hint("merge"), "page_id").select("page_id", value.alias("value"))


def _held(marks: DataFrame) -> DataFrame:
    """value: a line of git's index for each file that pages have beside their module in the last
    version, and its path."""
    page, blob = F.col("page_id"), lambda text: F.sha1(F.concat(F.lit("blob "), _text(F.octet_length(text)), F.lit("\0"), text).cast("binary"))
    line = lambda path, text: F.struct(F.concat(F.lit("100644 "), blob(text), F.lit("\t"), path).alias("value"), path.alias("path"))
    files = {kind: line(*of) for kind, of in _beside(page).items()}
    held = F.when((page % 9 == 4) & ~F.col("has_after"), files["odd"]).when((page % 9 == 5) & F.col("has_before"), files["moved"]).when(page % 9 == 7, files["binary"]).when(page % 9 == 8, files["side"])
    return marks.select(held.alias("held")).where("held IS NOT NULL").select("held.*")


def _bring_back(spark: SparkSession, root: Path, marks: DataFrame, at: int) -> None:
    """The last merge, in the second `at`: all shelved files are back. Git's index takes them as sorted lines."""
    lines = fresh_path(spark, "held")
    _held(marks).repartitionByRange("path").sortWithinPartitions("path").select("value").write.text(lines)
    run = lambda *args, **more: git.git(root, "-c", "user.name=w0", "-c", "user.email=w0@example.com", *args, **more).strip()
    run("read-tree", "refs/heads/main")
    subprocess.run(["sh", "-c", 'cat "$0"/part-* | git -C "$1" update-index --add --index-info', str(local_path(lines)), str(root)], check=True)
    when = {name: f"@{at} +0000" for name in ("GIT_AUTHOR_DATE", "GIT_COMMITTER_DATE")}  # after 2099 git takes seconds only with an @
    made = run("commit-tree", "-p", "refs/heads/main", "-p", "refs/heads/shelf", "-m", "bring back", run("write-tree"), env=os.environ | when)
    run("update-ref", "refs/heads/main", made)


def _repository(spark: SparkSession, d: str) -> Path:
    """The pages' repository. Tasks write its import stream, and git reads that from the files."""
    root, stream = local_path(fresh_path(spark, "repository")), fresh_path(spark, "import")
    place = local_path(stream)
    if root is None or place is None:
        raise RuntimeError("git's repositories lie on mounted disks: spark.checkpoint.dir must be one")
    found = spark.read.parquet(f"{d}/pages.parquet").where("page_id IS NOT NULL")
    pages = found.select("page_id", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest")).dropDuplicates(["page_id"])
    marks = written(_marked(found.select("page_id").distinct()), "marks")
    ends = marks.agg(F.min("page_id"), F.max("page_id")).first()
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    if ends[0] is None:
        return root
    _stream(pages, marks, ends).repartitionByRange("page_id").sortWithinPartitions("page_id").select("value").write.text(stream)
    # deltas leave little to compress, which took more than half of the time
    subprocess.run(["sh", "-c", 'cat "$0"/part-* | git -C "$1" -c core.compression=0 fast-import --quiet', str(place), str(root)], check=True)
    if ends[0] // SPAN != ends[1] // SPAN:
        _bring_back(spark, root, marks, EPOCH + 3600 * ends[1] + 180)
    subprocess.run(["git", "-C", str(root), "symbolic-ref", "HEAD", "refs/heads/main"], check=True)
    subprocess.run(["git", "-C", str(root), "-c", "checkout.workers=0", "reset", "-q", "--hard"], check=True)  # 0: one a core
    subprocess.run(["git", "-C", str(root), "commit-graph", "write", "--reachable"], check=True, capture_output=True)  # walks read it instead of each commit
    return root


def indexed(spark: SparkSession, d: str) -> tuple[Path, Store]:
    """The repository of the pages and its store, made and indexed once an application."""
    key = spark.sparkContext.applicationId, d
    if key not in _made:
        root = _repository(spark, d)
        store = Store(spark, fresh_path(spark, "store"))
        index_repository(store, root, "pages", F.lit(AS_OF).cast("timestamp"))
        _made[key] = root, store
    return _made[key]


def history_commits(spark: SparkSession, d: str) -> DataFrame:
    root, _ = indexed(spark, d)
    commits, _ = git.tables_of(git.read_commits(spark, root, 64), "pages")
    return commits.select("author_name", "author_email", F.unix_timestamp("committed_at").alias("committed_at"), "message")


def history_changes(spark: SparkSession, d: str) -> DataFrame:
    _, store = indexed(spark, d)
    named = store.read("git_commits").select("hash", "message")
    return store.read("git_file_changes").join(named, "hash").select("message", "path", F.coalesce("old_path", F.lit("")).alias("old_path"), "additions", "deletions", F.col("is_rename").cast("int").alias("is_rename"))


def indexed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d)[1].read("nodes").select("label", "name", "qualified_name", "file_path", "start_line", "end_line", json_flag(F.col("properties"), "deprecated").alias("deprecated"))


def indexed_edges(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d)[1].read("edges").select("source", "target", "type")


def indexed_evolution(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d)[1].read("file_evolution").select("path", "commit_count", "churn", "top_author", F.round(F.col("top_author_share").cast("double"), 4).alias("top_author_share"))


def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Three loads of a table, JSON lines among them, of which the last published one is read with a
    bound value; a load that isn't published, and one that comes again, show nothing."""
    store = Store(spark, fresh_path(spark, "store"))
    orders = spark.read.parquet(f"{d}/orders.parquet")
    rows = lambda version: orders.select(F.lit("p").alias("project"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"), F.col("o_orderstatus").alias("type"), F.lit("{}").alias("properties"), F.lit(version).cast("long").alias("version"))
    first = store.next_version()
    store.write(first, "edges", rows(first).limit(10))
    store.publish(first)
    lines, second = fresh_path(spark, "lines"), store.next_version()
    rows(second).write.json(lines)
    store.load_json_lines(second, "edges", lines)
    store.publish(second)
    store.compact("edges")
    store.write(store.next_version(), "edges", rows(9).limit(3))  # never published
    return store.sql("SELECT type, count(*) AS n, count(DISTINCT source) AS sources, max(version) AS version FROM edges WHERE type <> :other GROUP BY type", other="P")


def service_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the service's operations as (op, answer)."""
    root, store = indexed(spark, d)
    service = Service(spark, str(root), fresh_path(spark, "service"))
    service.store = store
    ask = lambda op, **params: service.handle(json.dumps({"op": op, "params": params}))["result"]
    last = store.read("nodes").where("label = 'Function' AND name LIKE 'f%'").orderBy(F.length("name").desc(), F.col("name").desc()).first()["qualified_name"]
    schema = ask("schema_info")
    rows = [
        ("status", ask("status")["state"]), ("labels", ",".join(schema["labels"])), ("edge_types", ",".join(schema["edge_types"])), ("snippet", ask("snippet", qualified_name=last)["text"]),
        ("callees", ",".join(x["node"].rsplit(".", 1)[1][0] for x in ask("trace", qualified_name=last, depth=99))), ("total", str(ask("search", label="Function", limit=3, offset=1000)["total"])),
        ("refused", str(service.handle('{"op": "search", "params": {"query": "f", "min_degree": 1}}')["ok"])), ("unknown", str(service.handle('{"op": "none"}')["ok"])),
    ]
    return spark.createDataFrame(rows, "op string, answer string")


def streamed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive twice, taken in by micro-batches."""
    source, table, checkpoint = (fresh_path(spark, n) for n in ("stream", "changes", "checkpoint"))
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("hash"), F.col("user_id").cast("string").alias("path"), "value")
    for _ in range(2):
        events.write.mode("append").parquet(source)
        append_changes(spark.readStream.schema(events.schema).parquet(source), table, checkpoint).awaitTermination()
    return spark.read.parquet(table)


def streamed_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Running sums of each user's events, of which each arrives twice and in no order: once taken in,
    then summed up, both by micro-batches that stop and go on."""
    source, table, sums = (fresh_path(spark, n) for n in ("stream", "changes", "sums"))
    checks = [fresh_path(spark, "checkpoint") for _ in range(2)]
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("hash"), F.col("user_id").cast("string").alias("path"), F.col("ts").alias("committed_at"), "value")
    for turn in range(2):
        for half in (0, 1):  # all rows come in two parts, and all come again
            events.where(F.pmod(F.xxhash64("hash"), F.lit(2)) == (half + turn) % 2).write.mode("append").parquet(source)
            append_changes(spark.readStream.schema(events.schema).parquet(source), table, checks[0]).awaitTermination()
            summarise_changes(spark.readStream.schema(events.schema).parquet(table), sums, checks[1], Roles(churn="value")).awaitTermination()
    return summaries(spark, sums).select("path", "commit_count", F.round("churn", 2).alias("churn"), "last_commit_at")


QUERIES = {f.__name__: f for f in (history_commits, history_changes, indexed_nodes, indexed_edges, indexed_evolution, stored_rows, service_answers, streamed_changes, streamed_summaries)}

_V = f"""
v AS (
  SELECT page_id AS p, 'src/m' || (page_id % {MODULES})::VARCHAR AS m, 6 + page_id % 3 AS n, lag(6 + page_id % 3, 1, 0) OVER (PARTITION BY page_id % {MODULES} ORDER BY page_id) AS old,
    page_id = max(page_id) OVER (PARTITION BY page_id % {MODULES}) AS last FROM pages),
ch AS (
  SELECT p, 'page ' || p::VARCHAR AS message, m || '.py' AS path, '' AS old_path, n::BIGINT AS additions, old::BIGINT AS deletions, 0 AS is_rename FROM v
  UNION ALL SELECT p, 'page ' || p::VARCHAR, 'docs/n "' || p::VARCHAR || '"' || chr(9) || 'é.md', '', 1, 0, 0 FROM v WHERE p % 9 = 4
  UNION ALL SELECT p, 'page ' || p::VARCHAR, 'docs/moved/n "' || (p - 1)::VARCHAR || '"' || chr(9) || 'é.md', 'docs/n "' || (p - 1)::VARCHAR || '"' || chr(9) || 'é.md', 0, 0, 1 FROM v WHERE p % 9 = 5 AND p - 1 IN (SELECT p FROM v)
  UNION ALL SELECT p, 'page ' || p::VARCHAR, 'bin/b' || p::VARCHAR || '.dat', '', 0, 0, 0 FROM v WHERE p % 9 = 7
  UNION ALL SELECT p, 'side ' || p::VARCHAR, 'side/s' || p::VARCHAR || '.txt', '', 1, 0, 0 FROM v WHERE p % 9 = 8)"""

SQL = {
    "history_commits": f"""
WITH c AS (SELECT page_id, 0 AS late, 'page ' AS what FROM pages UNION ALL SELECT page_id, 60, 'side ' FROM pages WHERE page_id % 9 = 8)
SELECT 'w' || (page_id % 5)::VARCHAR AS author_name, 'w' || (page_id % 5)::VARCHAR || '@example.com' AS author_email, {EPOCH} + 3600 * page_id + late AS committed_at, what || page_id::VARCHAR AS message FROM c""",
    "history_changes": f"WITH {_V.strip()} SELECT message, path, old_path, additions, deletions, is_rename FROM ch",
    "indexed_nodes": f"""
WITH {_V.strip()}
SELECT 'File' AS label, replace(m, 'src/', '') || '.py' AS name, m || '.py' AS qualified_name, m || '.py' AS file_path, 1 AS start_line, (n + 1)::INTEGER AS end_line, false AS deprecated FROM v WHERE last
UNION ALL SELECT 'Function', x || p::VARCHAR, replace(m, '/', '.') || '.' || x || p::VARCHAR, m || '.py', CASE x WHEN 'f' THEN 3 ELSE 5 END, CASE x WHEN 'f' THEN 4 ELSE 6 END, x = 'g' FROM v, (VALUES ('f'), ('g')) t(x) WHERE last""",
    "indexed_edges": f"""
WITH {_V.strip()}
SELECT m || '.py' AS source, replace(m, '/', '.') || '.' || x || p::VARCHAR AS target, 'DEFINES' AS type FROM v, (VALUES ('f'), ('g')) t(x) WHERE last
UNION ALL SELECT m || '.py', 'lib' || p::VARCHAR || '.tool', 'IMPORTS' FROM v WHERE last
UNION ALL SELECT replace(m, '/', '.') || '.f' || p::VARCHAR, replace(m, '/', '.') || '.g' || p::VARCHAR, 'CALLS' FROM v WHERE last
UNION ALL SELECT replace(m, '/', '.') || '.f' || p::VARCHAR, 'lib' || p::VARCHAR || '.tool', 'CALLS' FROM v WHERE last""",
    "indexed_evolution": f"""
WITH {_V.strip()},
a AS (SELECT path, 'w' || (p % 5)::VARCHAR || '@example.com' AS author, count(*) AS c FROM ch GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY c DESC, author) AS k, sum(c) OVER (PARTITION BY path) AS total FROM a)
SELECT k.path, total::BIGINT AS commit_count, s.churn, author AS top_author, round((c / total)::FLOAT::DOUBLE, 4) AS top_author_share
FROM k JOIN (SELECT path, sum(additions + deletions)::BIGINT AS churn FROM ch GROUP BY 1) s ON s.path = k.path WHERE k.k = 1""",
    "stored_rows": "SELECT o_orderstatus AS type, count(*) AS n, count(DISTINCT o_custkey) AS sources, 2::BIGINT AS version FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "service_answers": f"""
WITH {_V.strip()},
x AS (SELECT max(p)::VARCHAR AS p FROM v)
SELECT 'status' AS op, 'indexed' AS answer UNION ALL SELECT 'labels', 'File,Function' UNION ALL SELECT 'edge_types', 'CALLS,DEFINES,IMPORTS' UNION ALL SELECT 'refused', 'False' UNION ALL SELECT 'unknown', 'False'
UNION ALL SELECT 'callees', 'f,t,g' UNION ALL SELECT 'total', (2 * count(*))::VARCHAR FROM v WHERE last
UNION ALL SELECT 'snippet', 'def f' || p || '(x' || p || '):' || chr(10) || '    return g' || p || '(t' || p || '(x' || p || '))' FROM x""",
    "streamed_summaries": "SELECT user_id::VARCHAR AS path, count(*) AS commit_count, round(sum(value), 2) AS churn, max(ts) AS last_commit_at FROM events GROUP BY 1",
    "streamed_changes": "SELECT DISTINCT event_id::VARCHAR AS hash, user_id::VARCHAR AS path, value FROM events",
}
