"""Planted facts and micro-tables for the core operators."""

import json
import subprocess
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import expr
from loomgraph.operators import evolution, graph, latest, search
from loomgraph.plans import rank_eval
from loomgraph.plans.index_job import density_reasons, index_repository, vector_reasons
from loomgraph.service import Service
from loomgraph.sources import git, python_source
from loomgraph.sources.storage import SchemaVersionError, Store

NOW = datetime(2024, 6, 1)
def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")



def changes(spark, rows):
    return spark.createDataFrame(rows, "hash string, path string, author_email string, committed_at timestamp, additions long, deletions long")


@pytest.fixture(scope="module")
def history(spark):
    rows = []
    for k in range(10):
        who = "noor" if k in (2, 7) else "ines"
        rows.append((f"c{k}", "lib/loom.py", who, NOW - timedelta(days=k + 1), 3, 1))
        if k > 3:
            rows.append((f"c{k}", "spec/loom_spec.py", who, NOW - timedelta(days=k + 1), 1, 0))
    rows.append(("first", "lib/spindle.py", "emil", NOW - timedelta(days=500), 5, 0))
    return changes(spark, rows)


def test_churn(history):
    top = evolution.churn(history).first()
    assert (top["path"], top["commits"], top["churn"]) == ("lib/loom.py", 10, 40)


def test_coupling_and_ownership(history):
    pair = evolution.coupling(history).first()
    assert (pair["file_a"], pair["file_b"], pair["support"], pair["conf_b_to_a"]) == ("lib/loom.py", "spec/loom_spec.py", 6, 1.0)
    assert {r["path"]: (r["top_author"], r["top_author_share"]) for r in evolution.ownership(history).collect()}["lib/loom.py"] == ("ines", 0.8)


def test_coupling_counts_pairs_of_rows(spark):
    rows = [("c", "a", "x", NOW, 1, 0)] * 2 + [("c", "b", "x", NOW, 1, 0)] * 3
    assert evolution.coupling(changes(spark, rows)).first()["support"] == 6


def test_recency_and_summary(history):
    score = {r["path"]: r["recency_score"] for r in evolution.recency(history, as_of()).collect()}
    assert score["lib/loom.py"] > 0.9 and score["lib/spindle.py"] < 0.001
    rows = {r["path"]: r for r in evolution.file_evolution(history, as_of(), 3).collect()}
    assert len(rows) == 3 and rows["lib/loom.py"]["version"] == 3 and rows["lib/loom.py"]["top_author_share"] == pytest.approx(0.8)


def test_latest_version(spark):
    df = spark.createDataFrame([("p", 10, 1), ("p", 12, 2), ("q", 1, 1)], "k string, line int, version int")
    assert sorted(map(tuple, latest.latest_version(df, ["k"], [F.col("version")]).collect())) == [("p", 12, 2), ("q", 1, 1)]


@pytest.mark.parametrize(("name", "tokens"), [("HttpResponseRedirect", ["http", "response", "redirect"]), ("get_user_by_id", ["get", "user", "by", "id"]), ("XMLHttpRequest2", ["xml", "http", "request2"])])
def test_subtokens(spark, name, tokens):
    assert spark.range(1).select(expr.subtokens(F.lit(name)).alias("t")).first()["t"] == tokens


@pytest.mark.parametrize(("path", "old", "new"), [("lib/{ => yarn}/knot.py", "lib/knot.py", "lib/yarn/knot.py"), ("{a => b}/x{y}.py", "a/x{y}.py", "b/x{y}.py"), ("warp.py => weft/warp.py", "warp.py", "weft/warp.py"), ("lib/plain.py", None, "lib/plain.py"), ("lib/{odd}.py", None, "lib/{odd}.py")])
def test_renames(spark, path, old, new):
    row = spark.range(1).select(expr.rename_sides(F.lit(path)).alias("r")).select("r.*").first()
    assert (row["old"], row["new"]) == (old, new)


@pytest.fixture(scope="module")
def ring(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")], "source string, target string")


def test_trace(ring):
    rows = {r["node"]: r for r in graph.trace_path(ring, "a", "callees", 99).collect()}
    assert set(rows) == set("abcd") and rows["d"]["path"] == list("abcd") and rows["d"]["depth"] == 3
    assert {r["node"] for r in graph.trace_path(ring, "d", "callers").collect()} == set("abcd")
    assert {(r["node"], r["depth"]) for r in graph.reachable(ring, "a").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    with pytest.raises(ValueError):
        graph.trace_path(ring, "a", "sideways")


def a_graph(spark, nodes, vectors=None):
    rows = [(q, "Class", q.split(".")[-1], "f.py", 1, 2, p) for q, p in nodes]
    n = spark.createDataFrame(rows, "qualified_name string, label string, name string, file_path string, start_line int, end_line int, properties string")
    e = spark.createDataFrame([], "source string, target string, type string")
    c = spark.createDataFrame([], "path string, committed_at timestamp")
    v = None if vectors is None else spark.createDataFrame(vectors, "qualified_name string, vec array<float>")
    return search.Graph(n, e, c, v)


def test_deprecated_twin(spark):
    g = a_graph(spark, [("old.Widget", '{"deprecated": true}'), ("pkg.Widget", "{}")])
    page = search.search_graph(g, search.Query("Widget"), as_of())
    assert [r["qualified_name"] for r in page.items] == ["pkg.Widget", "old.Widget"] and [r["dep"] for r in page.items] == [0, 1]
    even = search.search_graph(g, search.Query("Widget"), as_of(), search.RankConfig(dep=0.0))
    assert even.items[0]["score"] == even.items[1]["score"]


def test_lexical_modes_and_paging(spark):
    g = a_graph(spark, [("x.MetaData", "{}"), ("x.MetaDataFactoryBuilder", "{}")])
    lex = {r["name"]: r["lex"] for r in search.scored(g, search.Query("MetaData"), as_of()).collect()}
    assert lex["MetaData"] == 1.0 > lex["MetaDataFactoryBuilder"]
    binary = search.scored(g, search.Query("MetaData"), as_of(), search.RankConfig(lexical_mode="binary")).collect()
    assert {r["lex"] for r in binary} == {1.0}
    past = search.search_graph(g, search.Query("MetaData"), as_of(), offset=5)
    assert (past.items, past.total, past.has_more) == ([], 2, False)
    with pytest.raises(ValueError):
        search.Query()


def test_vectors(spark):
    g = a_graph(spark, [("pkg.render", "{}"), ("pkg.template", "{}"), ("pkg.none", "{}")], [("pkg.render", [1.0, 0.0]), ("pkg.template", [0.0, 1.0])])
    rows = {r["qualified_name"]: r["vec"] for r in search.scored(g, search.Query("pkg", vector=[1.0, 0.0]), as_of()).collect()}
    assert rows == {"pkg.render": 1.0, "pkg.template": 0.0, "pkg.none": 0.0}


SOURCE = b'''import os.path as p
from lib import helper, other as o
from . import near

@deprecated
def old(): pass

def run(cb, helper2):
    """First line
    goes on.

    Not this."""
    helper(o(1))
    cb()
    x.attr()
    later()

def later():
    later2 = 1
    def later2(): pass
    later2()

class Box:
    def __init__(self):
        warnings.warn("gone", DeprecationWarning)
    def size(self):
        return run(1, 2)
'''


def test_parser():
    rows = python_source.parse_source("pkg/mod.py", SOURCE)
    nodes = {r["qualified_name"]: r for r in rows if r["kind"] == "node"}
    assert set(nodes) == {"pkg/mod.py", *(f"pkg.mod.{x}" for x in ("old", "run", "later", "later.later2", "Box", "Box.__init__", "Box.size"))}
    edges = {(r["source"], r["label"], r["target"]) for r in rows if r["kind"] == "edge"}
    assert {e for e in edges if e[1] == "CALLS"} == {("pkg.mod.run", "CALLS", "lib.helper"), ("pkg.mod.run", "CALLS", "lib.other"), ("pkg.mod.run", "CALLS", "pkg.mod.later"), ("pkg.mod.Box.size", "CALLS", "pkg.mod.run")}
    assert {e[2] for e in edges if e[1] == "IMPORTS"} == {"os.path", "lib.helper", "lib.other", ".near"}
    flagged = {k for k, r in nodes.items() if "true" in r["properties"]}
    assert flagged == {"pkg.mod.old", "pkg.mod.Box", "pkg.mod.Box.__init__"}
    assert nodes["pkg.mod.run"]["doc"] == "First line     goes on."
    assert nodes["pkg.mod.old"]["start_line"] == 6


@pytest.mark.parametrize("bad", [b"def (:\n", b"\x00" * 50, b"\xff\xfe bad", b""])
def test_malformed_sources(bad):
    rows = python_source.parse_source("a.py", bad)
    assert rows[0]["label"] == "File" and len(rows) == 1


def test_rank_eval(spark):
    pool = spark.createDataFrame([("g", f"c{k}", k, 1.0, float(k == 0)) for k in range(3)], "golden string, candidate string, pool_pos int, lex double, dep double")
    goldens = spark.createDataFrame([("g", "staleness", "c1"), ("h", "staleness", "zz")], "golden string, slice string, expected string")
    got = {(r["slice"], r["config"]): r["mrr"] for r in rank_eval.mrr_by_slice(pool, goldens, {"blind": {"lex": 1.0}, "hybrid": {"lex": 1.0, "dep": -0.2}}).collect()}
    assert got == {("staleness", "blind"): 0.25, ("staleness", "hybrid"): 0.5}
    assert rank_eval.gates(got, "staleness") == []
    band = rank_eval.noise_band(spark.createDataFrame([("a", 1.0), ("a", 0.5), ("b", 3.0)], "k string, x double"), "k", "x").collect()
    assert {r["k"]: r["stdev"] for r in band} == {"a": 0.353553, "b": 0.0}
    assert rank_eval.parsed_verdict('so: {"covered": [true, false], "score": 1}', 2)["score"] == 1
    with pytest.raises(ValueError):
        rank_eval.parsed_verdict('{"covered": []}', 2)
    with pytest.raises(ValueError):
        rank_eval.checked_goldens([{"id": "a", "question": "", "repo": "", "category": "x", "key_points": ["k"]}] * 2, {"x"})


def test_density_gate(spark):
    count = lambda *row: spark.createDataFrame([row], "files long, symbols long, lines long")
    assert density_reasons(count(1, 0, 5000)) and not density_reasons(count(1, 100, 1000)) and not density_reasons(count(0, 0, None))
    assert vector_reasons(3, 2) and not vector_reasons(3, 3)


def test_index_and_service(spark, tmp_path, repository):
    root, run = repository
    service = Service(spark, str(root), str(tmp_path / "data"))
    assert service.handle('{"op": "status"}')["result"]["state"] == "uninitialized"
    service.op_index(wait=True)
    assert service.op_status()["state"] == "indexed", service.op_status()
    moved = service.store.read("git_file_changes").where("is_rename = 1").first()
    assert (moved["old_path"], moved["path"]) == ("b.py", "c.py")
    assert service.store.read("git_commits").where("message = 'one\ttab'").count() == 1
    assert service.op_schema_info() == {"labels": ["File", "Function"], "edge_types": ["CALLS", "DEFINES", "IMPORTS"]}
    assert service.op_snippet("a.g")["text"] == "def g():\n    return 1"
    assert [r["node"] for r in service.op_trace("a.f")] == ["a.f", "a.g"]
    assert service.op_search(query="h")["total"] == 1
    for line in ('{"op": "nothing"}', "no json", json.dumps({"op": "search", "params": {"query": "f", "min_degree": 1}}), '{"op": "snippet", "params": {"qualified_name": "x"}}'):
        assert service.handle(line)["ok"] is False
    (root / "a.py").unlink()
    run("commit", "-qam", "gone")
    index_repository(service.store, root, service.project, as_of())
    assert service.store.read("nodes").where("file_path = 'a.py'").isEmpty()
    before = service.store.generation
    with pytest.raises(Exception):
        index_repository(service.store, tmp_path / "nowhere", service.project, as_of())
    assert service.store.generation == before and service.op_status()["state"] == "failed"
    service.op_delete_project()
    assert service.store.read("nodes").isEmpty() and service.op_status()["state"] == "uninitialized"


def test_version_gate(spark, tmp_path):
    Store(spark, tmp_path / "s")
    (tmp_path / "s" / "manifest.json").write_text('{"schema_version": 99}')
    with pytest.raises(SchemaVersionError):
        Store(spark, tmp_path / "s")


def test_store_queries_and_json_lines(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    (tmp_path / "edges.jsonl").write_text('{"project": "p", "source": "a", "target": "b", "type": "CALLS", "properties": "{}", "version": 1}\n')
    store.load_json_lines(1, "edges", str(tmp_path / "edges.jsonl"))
    assert store.rows("SELECT * FROM edges") == []  # not published yet
    store.publish(1)
    assert store.rows("SELECT target FROM edges WHERE source = :who", who="a") == [{"target": "b"}]
    assert store.csv("SELECT source, target FROM edges") == "source,target\na,b\n"
    assert store.next_version() == 2


def test_git_counts(repository):
    root, _ = repository
    assert git.count_reasons(root, 2, 4) == [] and git.count_reasons(root, 1, 1)


def test_streamed_changes(spark, tmp_path):
    from loomgraph.streaming import append_changes

    schema = "hash string, path string, additions long"
    source, table = tmp_path / "in", str(tmp_path / "table")
    for k, rows in enumerate(([("a", "x", 1), ("a", "x", 1)], [("a", "x", 1), ("b", "x", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        append_changes(spark.readStream.schema(schema).parquet(str(source)), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [("a", "x", 1), ("b", "x", 2)]


def test_random_coupling_against_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(f"c{r.randint(0, 9)}", f"p{r.randint(0, 5)}", "x", NOW, 1, 0) for _ in range(80)]
    want: dict = {}
    for (h1, p1, *_), (h2, p2, *_) in combinations(rows, 2):
        if h1 == h2 and p1 != p2:
            key = tuple(sorted((p1, p2)))
            want[key] = want.get(key, 0) + 1
    got = {(x["file_a"], x["file_b"]): x["support"] for x in evolution.coupling(changes(spark, rows), min_support=1).collect()}
    assert got == want
