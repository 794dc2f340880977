"""Work that grows with its input: shares by count, recall of vectors without clusters."""

import random
import re
import subprocess
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import topk
from loomgraph.operators import evolution
from loomgraph.operators.cells import CellIndex, Cells
from loomgraph.plans import repository_queries
from loomgraph.sources import git, python_source, storage
from loomgraph.sources.shared import fresh_path


@pytest.mark.parametrize("share", [40, 1_000_000])
def test_coupling_is_dealt_by_counts(spark, share):
    r = random.Random(4)
    rows = [(f"c{r.randrange(60)}", f"p{r.randrange(25)}") for _ in range(500)]
    changes = spark.createDataFrame(rows, "hash string, path string")
    found = evolution.coupling(changes, min_support=1, block=7, share=share)
    held = Counter(rows)
    want = Counter()
    for commit in {c for c, _ in rows}:
        for a, b in combinations(sorted(p for c, p in held if c == commit), 2):
            want[a, b] += held[commit, a] * held[commit, b]
    assert {(x["file_a"], x["file_b"]): x["support"] for x in found.collect()} == dict(want)
    pairs = sum(n * (n - 1) // 2 for n in Counter(c for c, _ in held).values())
    dealt = re.findall(r"RepartitionByExpression \[file_a#\d+L?, file_b#\d+L?\], (\d+)", found._jdf.queryExecution().toString())
    assert set(dealt) == {str(max(1, -(-pairs // share)))}


def test_stored_keys_are_counted_in_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "COUNTED", 500)
    monkeypatch.setattr(storage, "ROW_GROUP", 1 << 14)
    store = storage.Store(spark, tmp_path / "s")
    edges = lambda n: spark.range(n).selectExpr("'p' AS project", "concat('s', id % 3000) AS source", "'t' AS target", "'CALLS' AS type", "'{}' AS properties", "1L AS version").coalesce(1)
    for n, contested in ((3000, False), (3001, True)):
        load = store.begin()
        load.write("edges", edges(n))
        assert load.tables["edges"]["contested"] is contested
        (part,) = load.tables["edges"]["parts"]
        files = [pq.ParquetFile(tmp_path / "s" / part["path"] / name) for name, _ in part["files"]]
        assert max(f.num_row_groups for f in files) > 1


def test_cells_reach_their_recall_without_clusters(spark):
    x = np.random.default_rng(9).normal(size=(6000, 32)).astype(np.float32)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<float>").repartition(3)
    index = CellIndex.build(vectors, fresh_path(spark, "cells"), "id", Cells(probes=4))
    assert 4 < index.probes < len(index.cells)
    asked = vectors.where("id % 50 = 0").withColumnRenamed("id", "q")
    found = {}
    for a in index.nearest_of(asked, 10, "q").collect():
        found.setdefault(a["q"], set()).add(a["id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(len(found[q] & set(np.argsort(-(u @ u[q]), kind="stable")[:10].tolist())) for q in range(0, 6000, 50))
    assert hits >= 0.9 * 10 * 120


def test_sources_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    spark.range(64).selectExpr("concat('m', id, '.py') AS path", "encode('def f():\\n    pass\\n', 'utf-8') AS content").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = python_source.parsed(spark.read.parquet(str(tmp_path / "t")))
    assert rows.where("kind = 'node'").count() == 128
    assert rows.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism


def test_ranges_of_a_history_are_bounded(spark, repository):
    root, run = repository
    for k in range(20):
        run("commit", "-q", "--allow-empty", "-m", f"e{k}")
    reader = git._Reader(str(root), 1, 4)
    parts = reader.partitions()
    assert len(parts) == 4
    assert [r[4] for p in parts for r in reader.read(p)] == [r[4] for r in git.commits(root)]
    assert git.read_commits(spark, root, 1).rdd.getNumPartitions() <= git.RANGES * spark.sparkContext.defaultParallelism
    assert git.read_commits(spark, root, 1).count() == 22


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    plans = []
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    kept = topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: (plans.append(plan_of(df)), kept(df, name))[1])
    x = np.random.default_rng(3).normal(size=(600, 16))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = topk.top_k(vectors, F.col("vec_id") % 100 == 0, topk.Search(block=64, queries=8))
    plans.append(plan_of(got))
    joined = [p for p in plans if "explode" in p]
    assert len(joined) == 2
    for p in joined:  # one with the floors' join, of a row a block of queries, beside it
        assert not re.search(r"BroadcastHashJoin \[bucket|BroadcastNestedLoopJoin", p)
        assert re.search(r"SortMergeJoin \[bucket", p)
    assert got.count() == 60


@pytest.mark.parametrize("ids", [[*range(400), *range(1000, 9000 * 30, 9 * 500 + 1), *range(300_004, 300_094, 9)], [5], [*range(4, 40)], [62, 63], [8, 80, 800, 801]], ids=["many", "one", "a span", "two spans", "apart"])
def test_trees_of_the_pages_are_bounded_and_the_last_is_whole(spark, tmp_path, ids):
    spark.createDataFrame([(k, f"<p>{k}</p>") for k in ids], "page_id long, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    root = repository_queries._repository(spark, str(tmp_path))
    run = lambda *args: subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True).stdout.decode()
    there = set(ids)
    want = {f"src/m{p % 40}.py" for p in ids} | {f"bin/b{p}.dat" for p in ids if p % 9 == 7} | {f"side/s{p}.txt" for p in ids if p % 9 == 8}
    want |= {f'docs/n "{p}"\té.md' for p in ids if p % 9 == 4 and p + 1 not in there} | {f'docs/moved/n "{p - 1}"\té.md' for p in ids if p % 9 == 5 and p - 1 in there}
    assert set(run("ls-files", "-z").split("\0")) - {""} == want and run("status", "--porcelain") == ""
    assert all((root / name).is_file() for name in want)
    assert [(root / n).read_bytes() for n in sorted(want) if n.startswith("bin/")] == [f"\0\1{p}\n\0".encode() for p in sorted(ids, key=str) if p % 9 == 7]
    sizes = [sum(not x.startswith("src/") for x in run("ls-tree", "-r", "-z", "--name-only", c).split("\0") if x) for c in run("rev-list", "HEAD").split()[1:]]
    assert max(sizes, default=0) <= 42  # the files of two spans
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    log = list(git.commits(root))
    got = [(message, path, old, added, removed, int(rename)) for *_, message, changes in log for path, old, added, removed, rename in changes]
    assert sorted(got) == sorted(con.execute(repository_queries.SQL["history_changes"]).fetchall())
    got = [(name, email, int(at.timestamp()), message) for _, name, email, at, message, _ in log]
    assert sorted(got) == sorted(con.execute(repository_queries.SQL["history_commits"]).fetchall())


def test_changes_are_counted_in_ranges(spark, repository):
    root, run = repository
    for k in range(20):
        (root / "a.py").write_text(f"x = {k}\n")
        run("commit", "-qam", f"e{k}")
    counted = git.counted_changes(spark, root, 3)
    parts = [r["changes"] for r in counted.collect()]
    assert len(parts) == 8 and sum(parts) == git.count_names(root) == 24
    assert git.count_reasons(root, 22, 24, spark) == git.count_reasons(root, 22, 24) == []
    assert git.count_reasons(root, 22, 23, spark) == git.count_reasons(root, 22, 23) == ["history: 23 changes read, git counts 24"]
