"""History, parser, vectors, service, socket, command line, tools, evaluation files."""

import io
import json
import os
import shutil
import subprocess
import sys
import threading
import time
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest

from loomgraph import mcp
from loomgraph.client import Client, ServiceError
from loomgraph.functions.embed import HashedTokens
from loomgraph.operators import evolution, search
from loomgraph.plans import rank_eval
from loomgraph.plans.index_job import deprecation_audit
from loomgraph.service import Service
from loomgraph.sources import git, python_source
from loomgraph.sources.storage import Store

ROOT = Path(__file__).parents[1]


def test_library_without_the_corpus_operators(tmp_path):
    """In a copy without both folders, with the pipeline's file still there and without it."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'churn' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); import loomgraph.cli, loomgraph.service, loomgraph.streaming"
    for step in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert done.returncode == 0, (step, done.stderr)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


# --- parser


BROKEN = b"""import os

@decorated
def whole():
    return helper()

def cut(a, b:
    return whole()

class Box:
    def one(self):
        return whole()

    def two(self)
        return 1

    def three(self):
        x = (1,
        return x

def helper():
    pass
"""


def test_what_parses_of_a_broken_source_is_kept():
    rows = python_source.parse_source("pkg/m.py", BROKEN)
    names = {r["qualified_name"] for r in rows if r["kind"] == "node"}
    assert not rows[0]["parsed"] and {"pkg.m.whole", "pkg.m.Box", "pkg.m.Box.one", "pkg.m.helper"} <= names
    calls = {(r["source"], r["target"]) for r in rows if r["label"] == "CALLS"}
    assert {("pkg.m.whole", "pkg.m.helper"), ("pkg.m.Box.one", "pkg.m.whole")} <= calls
    at = {r["qualified_name"]: r["start_line"] for r in rows if r["kind"] == "node"}
    assert at["pkg.m.whole"] == 4 and at["pkg.m.helper"] == 21
    fine = python_source.parse_source("m.py", b"def f():\r\n    'One\xc3\xa9'\r\n")
    assert fine[0]["parsed"] and fine[1]["doc"] == "Oneé"


def test_a_long_source_is_parsed_in_linear_time():
    text = "".join(f"def f{k}():\n    'Says {k}.'\n    return {k}\n" for k in range(8000)).encode()
    began = time.process_time()
    assert len(python_source.parse_source("m.py", text)) == 1 + 2 * 8000
    assert time.process_time() - began < 10


def test_audit_reads_untracked_files(spark, tmp_path):
    for name, text in (("one/a.py", "def f():\n    pass\n"), ("two/b.py", "import warnings\ndef g():\n    warnings.warn('x', DeprecationWarning)\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["project"]: r for r in deprecation_audit(spark, {"p": str(tmp_path / "one"), "q": str(tmp_path / "two")}).collect()}
    assert (got["p"]["symbols"], got["p"]["flagged"]) == (1, 0) and got["q"]["names"] == ["b.g"] and got["q"]["percent"] == 100.0


# --- history


def test_history_in_ranges(spark, repository):
    root, run = repository
    for k in range(5):
        (root / "odd name\twith tab.py").write_text(f"x = {k}\n")
        run("add", "-A")
        run("commit", "-qm", f"step {k}")
    run("commit", "-q", "--allow-empty", "-m", "nothing")
    history = git.read_commits(spark, root, 2)
    commits, changes = git.tables_of(history, "p")
    assert history.rdd.getNumPartitions() == 4 and commits.count() == 8
    assert git.count_reasons(root, commits.count(), changes.count()) == []
    assert changes.where("path = 'odd name\twith tab.py'").count() == 5
    assert tuple(changes.where("path = 'raw.bin'").select("additions", "deletions").first()) == (0, 0)
    assert "one\ttab" in {r["message"] for r in commits.collect()}


# --- coupling, vectors


def test_coupling_of_large_commits_in_blocks(spark):
    rows = [(f"c{k % 3}", f"p{k:03}", "x", datetime(2024, 6, 1), 1, 0) for k in range(90)] + [("c0", "p000", "x", datetime(2024, 6, 1), 1, 0)]
    changes = spark.createDataFrame(rows, "hash string, path string, author_email string, committed_at timestamp, additions long, deletions long")
    find = lambda **how: sorted(map(tuple, evolution.coupling(changes, min_support=1, **how).collect()))
    assert find() == find(block=7) and len(find()) == 3 * 30 * 29 // 2


def test_vector_index_against_a_plain_search(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 16)).astype("float32")
    x[10] = 0
    x[20] = x[21]
    vectors = spark.createDataFrame([(f"s{k:03}", v.tolist()) for k, v in enumerate(x)], "qualified_name string, vec array<float>").repartition(3)
    index = search.VectorIndex(vectors, block=64)
    for k in (0, 20, 299):
        want = [tuple(t) for t in search.nearest(vectors, x[k].tolist(), 12).collect()]
        got = [tuple(t) for t in index.nearest(x[k].tolist(), 12).collect()]
        assert [a for a, _ in got][2:] == [a for a, _ in want][2:] and np.allclose([b for _, b in got], [b for _, b in want], atol=1e-5)
    assert {a for a, _ in index.nearest(x[20].tolist(), 2).collect()} == {"s020", "s021"}
    index.close()


# --- service, socket, command line, tools


@pytest.fixture
def served(spark, tmp_path, repository):
    root, run = repository
    (root / "win.py").write_bytes(b"def w():\r\n    return 1\r\n")
    run("add", "-A")
    service = Service(spark, str(root), str(tmp_path / "data"), HashedTokens(32))
    service.op_index(wait=True)
    assert service.op_status()["state"] == "indexed", service.op_status()
    place = tmp_path / "s.sock"
    thread = threading.Thread(target=service.serve_socket, args=(place,), daemon=True)
    thread.start()
    while not place.exists():
        time.sleep(0.01)
    yield service, Client(place, timeout=60), thread
    if Client(place).alive():
        Client(place).call("shutdown")


def test_socket_and_client(served):
    service, client, thread = served
    assert client.alive() and client.call("status")["state"] == "indexed"
    got = client.call("snippet", qualified_name="win.w")
    assert got["text"] == "def w():\n    return 1" and got["qualified_name"] == "win.w"
    (project,) = client.call("list_projects")
    assert project["state"] == "indexed" and project["root"] == os.path.realpath(service.root)
    page = client.call("search", query="h")  # symbols that only the vector finds come too
    assert page["total"] > 1 and any(x["vec"] > 0 for x in page["items"]) and not page["has_more"]
    assert client.call("search", query="h", offset=100) == {"items": [], "total": page["total"], "has_more": False}
    assert service.store.tables() == ["edges", "embeddings", "file_evolution", "git_commits", "git_file_changes", "nodes"]
    assert service.store.compact("nodes") == 1 and service.store.read("nodes").count() > 3
    with pytest.raises(ServiceError, match="unknown operation"):
        client.call("nothing")
    assert client.call("shutdown") == {"stopped": True}
    thread.join(10)
    assert not client.alive()
    with pytest.raises(ServiceError, match="no service"):
        client.call("ping")


def test_tools(served):
    _, client, _ = served
    ask = lambda method, **params: mcp.answer({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}, lambda: client)
    assert ask("initialize", protocolVersion="2024-11-05")["result"]["protocolVersion"] == "2024-11-05"
    assert len(ask("tools/list")["result"]["tools"]) == 8
    call = lambda name, **arguments: ask("tools/call", name=name, arguments=arguments)["result"]
    assert call("index_status")["structuredContent"]["state"] == "indexed"
    assert [x["node"] for x in call("trace_path", function_name="a.f")["structuredContent"]["result"]] == ["a.f", "a.g"]
    assert call("search_graph", query="f", limit=1)["structuredContent"]["total"] >= 1
    assert call("get_graph_schema")["structuredContent"]["labels"] == ["File", "Function"]
    for bad in (call("search_graph", query="f", min_degree=1), call("trace_path"), call("trace_path", function_name="a.f", direction="up"), call("trace_path", function_name=1), call("get_code_snippet", qualified_name="none"), call("index_status", x=1)):
        assert bad["isError"] and bad["content"][0]["text"]
    assert ask("tools/call", name="none")["error"]["code"] == -32602 and ask("none")["error"]["code"] == -32601
    assert mcp.answer({"jsonrpc": "2.0", "method": "notifications/initialized"}, lambda: client) is None
    out = io.StringIO()
    mcp.serve(io.StringIO('no json\n[]\n{"jsonrpc": "2.0", "id": 7, "method": "ping"}\n'), out, lambda: client)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [None, None, 7]


def test_daemon_on_the_command_line(tmp_path, repository):
    root, _ = repository
    run = lambda *args: subprocess.run([sys.executable, "-m", "loomgraph.cli", *args, "--root", str(root), "--data", str(tmp_path / "d")], cwd=ROOT, capture_output=True, text=True, timeout=200)
    assert run("status").returncode == 2 and run("daemon", "status").returncode == 1 and "not running" in run("daemon", "stop").stdout
    try:
        started = run("daemon", "start")
        assert started.stdout == "started\n", started.stderr
        assert "already" in run("daemon", "start").stdout and run("daemon", "status").returncode == 0
        os.kill(int(next((tmp_path / "d").rglob("daemon.pid")).read_text()), 9)
        end = time.monotonic() + 20
        while run("daemon", "status").returncode != 2 and time.monotonic() < end:
            time.sleep(0.2)
        assert run("daemon", "status").returncode == 2  # its pid file is left
    finally:
        assert run("daemon", "stop").returncode == 0
    assert run("daemon", "status").returncode == 1


def test_delete_after_a_process_that_is_gone(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    store.set_status("running")
    with pytest.raises(RuntimeError):
        store.delete()
    (tmp_path / "s" / "status.json").write_text(json.dumps({"state": "running", "pid": 2**22 + 5}))
    store.delete()
    assert store.status()["state"] == "uninitialized"


# --- evaluation


def test_goldens_and_corpus_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.yaml").write_text("- {id: a, question: q, repo: r, category: impact, key_points: [x, y]}\n")
    (tmp_path / "g" / "b.yaml").write_text("- {id: b, question: q, repo: r, category: evolution, key_points: [x]}\n")
    goldens = rank_eval.load_goldens(tmp_path / "g")
    assert [g.id for g in goldens] == ["a", "b"]
    prompt = rank_eval.judge_prompt(goldens[0], "an answer")
    assert "1. x" in prompt and "2. y" in prompt and "an answer" in prompt
    (tmp_path / "g" / "c.yaml").write_text("- {id: a, question: q, repo: r, category: impact, key_points: [x]}\n")
    with pytest.raises(ValueError, match="repeated"):
        rank_eval.load_goldens(tmp_path / "g")
    (tmp_path / "r.yaml").write_text("- {query: g, expected: c1, repo: r, slice: staleness}\n")
    ranking = rank_eval.load_ranking_goldens(spark, tmp_path / "r.yaml")
    pool = spark.createDataFrame([("g", f"c{k}", k, 1.0, float(k == 0)) for k in range(3)], "golden string, candidate string, pool_pos int, lex double, dep double")
    run = rank_eval.ranking_run(pool, ranking, {"blind": {"lex": 1.0}, "hybrid": {"lex": 1.0, "dep": -0.2}}, "staleness", tmp_path / "runs", {"commit": "abc"})
    assert run["passed"] and run["provenance"] == {"commit": "abc"} and len(list((tmp_path / "runs").glob("rank-*.json"))) == 1
    (tmp_path / "r.yaml").write_text("- {query: g, expected: c1, slice: other}\n")
    with pytest.raises(ValueError):
        rank_eval.load_ranking_goldens(spark, tmp_path / "r.yaml")
    (tmp_path / "c.yaml").write_text("repos: [{name: n, repo: r, sha: abcdef1, language: python}]\n")
    assert rank_eval.load_corpus(tmp_path / "c.yaml")["n"]["sha"] == "abcdef1"
