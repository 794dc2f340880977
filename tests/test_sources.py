"""The error-recovering parser, names across files, generations of the store."""

import random
import shutil
import subprocess
import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.embed import HashedTokens
from loomgraph.operators import resolve
from loomgraph.plans.index_job import index_repository
from loomgraph.sources import python_source
from loomgraph.sources.storage import TABLES, ConcurrentLoad, MissingFiles, Store


def calls_of(rows):
    return {(r["source"], r["target"]) for r in rows if r["label"] == "CALLS"}


def symbols_of(rows):
    return {r["qualified_name"]: r for r in rows if r["kind"] == "node" and r["label"] != "File"}


def test_each_broken_method_costs_itself_alone():
    took = []
    for n in (2_000, 10_000):
        parts = [f"    def good{k}(self):\n        'Doc {k}.'\n        return helper({k})\n    def bad{k}(self, x:\n        return helper(\n" for k in range(n)]
        text = "class A:\n" + "".join(parts) + "\ndef helper(x):\n    return x\n"
        began = time.process_time()
        rows = python_source.parse_source("m.py", text.encode())
        took.append(time.process_time() - began)
        assert len(symbols_of(rows)) == n + 2 and len(calls_of(rows)) == n
        r = symbols_of(rows)["m.A.good7"]
        assert (r["start_line"], r["end_line"], r["doc"]) == (37, 39, "Doc 7.")
    assert took[1] < 15 * took[0] + 1


def test_a_random_damage_leaves_the_other_functions():
    r = random.Random(3)
    damages = ["def f{k}(a, b:\n    return g(\n", "def f{k}(a)\n    return g()\n", "def f{k}():\n    x = [1,\n    return 2\n", "def f{k}():\n    x = 'abc\n    return g()\n", "def f{k}():\n    return g())\n", "def f{k}():\n    if g(:\n        return 1\n    else:\n        return g()\n", "def f{k}():\n  if x:\n        a = 1\n      b = g()\n"]
    sound = "@mark\ndef f{k}(a=(1,\n  2)):\n    '''Says\n    {k}.'''\n    try:\n        return g(a)  # (\n    except g() as e:\n        pass\n    else:\n        g()\n"
    for turn in range(60):
        kinds = [r.random() < 0.4 for _ in range(r.randint(2, 12))]
        parts = [(r.choice(damages) if bad else sound).format(k=k) for k, bad in enumerate(kinds)]
        text = "def g(*a):\n    return 1\n" + "".join(parts)
        rows = python_source.parse_source("m.py", text.encode())
        at, found = 3, symbols_of(rows)
        for k, bad in enumerate(kinds):
            if not bad:
                x = found[f"m.f{k}"]
                assert (x["start_line"], x["end_line"], x["doc"]) == (at + 1, at + parts[k].count("\n") - 1, f"Says     {k}."), (turn, text)
                assert (f"m.f{k}", "m.g") in calls_of(rows)
            at += parts[k].count("\n")
        assert rows[0]["parsed"] == (not any(kinds))


def test_blocks_of_broken_heads():
    rows = python_source.parse_source("m.py", b"def g(): pass\nclass A(:\n    def one(self):\n        return g()\ndef f(g:\n    def inner():\n        return g()\n    return g()\nif g(:\n    g()\n")
    assert set(symbols_of(rows)) == {"m.g", "m.A.one", "m.f.inner"} and calls_of(rows) == {("m.A.one", "m.g"), ("m", "m.g")}
    for bad in (b"def f(:\n    return json.", b"foo(bar(baz(", b"\x00\xff\x01" * 50, b"@\n" * 50, b"  else:\n x\n@a\nelse:\n", b"(" * 5000, b'"""\n' * 1001, b"".join(b" " * k + b"if (x:\n" for k in range(150)), b"", b"\n\n"):
        assert python_source.parse_source("b.py", bad)[0]["label"] == "File"


FILES = {
    "pkg/__init__.py": "from .a import run\nfrom .deep import *\nfrom .star import *\nhidden = 1\nfrom .a import hidden\n",
    "pkg/a.py": "from .b import walk as run\n\ndef hidden(): pass\n",
    "pkg/b.py": "from pkg.c import walk\n",
    "pkg/c.py": "def walk():\n    return 1\n",
    "pkg/deep/__init__.py": "from ..c import walk as stroll\nfrom .low import _private, low\n",
    "pkg/deep/low.py": "def low(): pass\ndef _private(): pass\n",
    "pkg/star.py": "__all__ = ['_shown']\ndef _shown(): pass\ndef unlisted(): pass\n",
    "pkg/x.py": "from .y import loop, back\n",
    "pkg/y.py": "from .x import loop\nfrom .x import back as there\ndef back(): pass\n",
    "pkg/two.py": "from .c import *\nfrom .other import *\n",
    "pkg/other.py": "def walk(): pass\ndef only(): pass\n",
    "use.py": "from pkg import run, stroll, low, _private, _shown, unlisted, hidden\nfrom pkg.x import loop, back\nfrom pkg.two import walk, only\nimport pkg\n"
    "def f():\n    run(); stroll(); low(); _private(); _shown(); unlisted(); hidden(); loop(); back(); walk(); only(); pkg()\ndef g(run):\n    run()\n",
    "late.py": "from pkg.two import *\ndef h():\n    only(); walk(); print()\n",
    "lost.py": "from .... import x\ndef h():\n    x()\n",
}


def test_names_go_through_files(spark):
    sources = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")
    got = {(r["source"], r["target"]) for r in resolve.resolved_calls(python_source.parsed(sources)).collect()}
    f = {t for s, t in got if s == "use.f"}
    assert f == {"pkg.c.walk", "pkg.deep.low.low", "pkg.star._shown", "pkg.y.back", "pkg.other.only"}  # not: hidden (rebound), loop (a cycle), walk of two (ambiguous)
    assert got - {("use.f", t) for t in f} == {("late.h", "pkg.other.only")}
    assert resolve.resolved_calls(python_source.parsed(sources.limit(0))).isEmpty()


def test_names_against_a_plain_search(spark):
    r = random.Random(8)
    for _ in range(2):
        texts, defs, alias, stars, bound = {}, set(), {}, defaultdict(list), set()
        modules = [f"m{k}" for k in range(25)]
        for m in modules:
            lines = []
            for n in "abcd":
                kind = r.random()
                if kind < 0.12:
                    lines.append(f"def {n}(): pass")
                    defs.add((m, n))
                elif kind < 0.6:
                    to = r.choice(modules), r.choice("abcd")
                    lines.append(f"from {to[0]} import {to[1]} as {n}")
                    alias[m, n] = to
                    if r.random() < 0.1:
                        lines.append(f"{n} = 1")
                        bound.add((m, n))
            for _ in range(r.choice((0, 0, 1, 2))):
                to = r.choice(modules)
                lines.append(f"from {to} import *")
                stars[m].append(to)
            texts[m] = "\n".join(lines)

        def meant(place, seen=()):
            if place in defs:
                return {place}
            if place in seen or place in bound:
                return set()
            after = [alias[place]] if place in alias else [(to, place[1]) for to in stars[place[0]]]
            return {x for p in after for x in meant(p, (*seen, place))}

        user = "".join(f"from {m} import {n} as {m}{n}\n" for m in modules for n in "abcd") + "".join(f"def u_{m}{n}():\n    {m}{n}()\n" for m in modules for n in "abcd")
        rows = [(f"{m}.py", bytearray(t.encode())) for m, t in texts.items()] + [("user.py", bytearray(user.encode()))]
        got = {(x["source"], x["target"]) for x in resolve.resolved_calls(python_source.parsed(spark.createDataFrame(rows, "path string, content binary"))).collect()}
        want = {(f"user.u_{m}{n}", f"{x[0][0]}.{x[0][1]}") for m in modules for n in "abcd" if len(x := list(meant((m, n)))) == 1}
        assert got == want and want


# --- generations


def _git_repository(tmp_path, n=40):
    root = tmp_path / "many"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(n):
        (root / f"m{k}.py").write_text(f"def f{k}():\n    return g{k}()\n\ndef g{k}():\n    return {k}\n")
    run("add", "-A")
    run("commit", "-qm", "all")
    return root, run


def test_an_index_of_changed_sources_writes_those_alone(spark, tmp_path):
    root, run = _git_repository(tmp_path)
    store, now = Store(spark, tmp_path / "s"), F.lit("2024-06-01").cast("timestamp")
    first = index_repository(store, root, "p", now, HashedTokens(16))
    before = store.read("nodes")  # a reader from before keeps its generation
    n = before.count()
    assert n == 40 * 3 and first.degraded_reasons == []
    (root / "m3.py").write_text("def f3():\n    return f3()\n")
    (root / "m5.py").unlink()
    (root / "new.py").write_text("def fresh():\n    pass\n")
    run("add", "-A")
    run("commit", "-qm", "changes")
    second = index_repository(store, root, "p", now, HashedTokens(16))
    assert second.version == 2 and second.files == 40 and second.nodes == 38 * 3 + 2 + 2 and second.degraded_reasons == []
    parts = store.manifest()["tables"]["nodes"]["parts"]
    assert len(parts) == 2 and store._files_of("nodes", parts[1:]).select("file_path").distinct().count() == 2
    assert store.manifest()["tables"]["nodes"]["parts"][0] == store.manifest(1)["tables"]["nodes"]["parts"][0]
    same = index_repository(Store(spark, tmp_path / "whole"), root, "p", now, HashedTokens(16))
    assert (same.nodes, same.edges, same.files) == (second.nodes, second.edges, second.files)
    for table, drop in (("nodes", "version"), ("edges", "version"), ("embeddings", "version"), ("file_evolution", "version")):
        got, want = ({str(r) for r in s.read(table).drop(drop).collect()} for s in (store, Store(spark, tmp_path / "whole")))
        assert got == want and got
    rows = {str(r) for r in store.read("nodes").collect()}
    during = store.read("nodes")
    assert store.compact("nodes") == 1 and store.generation == 3 and not store.manifest()["tables"]["nodes"]["gone"]
    assert rows == {str(r) for r in store.read("nodes").collect()} == {str(r) for r in during.collect()}
    assert before.count() == n and store.read("nodes", generation=1).count() == n
    assert store.vacuum(keep=1) == 0  # all files are young
    assert store.vacuum(keep=1, retained=-1) > 0 and store.generations() == [3]
    assert rows == {str(r) for r in store.read("nodes").collect()}
    third = index_repository(store, root, "p", now, HashedTokens(16))
    assert third.nodes == second.nodes and rows == {str(r) for r in store.read("nodes").collect()}  # nothing changed
    lost = store.manifest()["tables"]["nodes"]["parts"][0]
    shutil.rmtree(tmp_path / "s" / lost["path"])
    with pytest.raises(MissingFiles):
        store.read("nodes")


def test_of_two_loads_one_is_published(spark, tmp_path):
    one, two = Store(spark, tmp_path / "s"), Store(spark, tmp_path / "s")
    row = lambda target: spark.createDataFrame([("p", "a", target, "CALLS", "{}", 1)], TABLES["edges"][0])
    a, b = one.begin(), two.begin()
    a.write("edges", row("a"))
    b.write("edges", row("b"))
    results = []

    def publish(load):
        try:
            results.append(load.publish())
        except ConcurrentLoad as e:
            results.append(str(e))

    threads = [threading.Thread(target=publish, args=(x,)) for x in (a, b)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(type, results), key=str) == sorted([int, str], key=str) and "another load" in next(r for r in results if isinstance(r, str))
    assert one.read("edges").count() == 1 and one.generations() == [1]
    with pytest.raises(ConcurrentLoad):
        one.write(1, "edges", row("c"))


def test_a_key_of_two_sources_is_one_row_until_its_source_goes(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    node = lambda path, line, v: ("p", "Function", "f", "a.f", path, line, line, "{}", "", v, path)
    frame = lambda *rows: spark.createDataFrame(rows, TABLES["nodes"][0] + ", _origin string")
    paths = lambda *names: spark.createDataFrame([(x,) for x in names], "path string")
    load = store.begin()
    load.write("nodes", frame(node("a.py", 1, 1)))
    load.publish()
    load = store.begin()
    load.change("nodes", frame(node("a/__init__.py", 5, 2)), paths("a/__init__.py"))
    load.publish()
    assert [r["file_path"] for r in store.read("nodes").collect()] == ["a/__init__.py"]
    load = store.begin()
    load.change("nodes", frame().limit(0), paths("a/__init__.py"))
    load.publish()
    assert [r["file_path"] for r in store.read("nodes").collect()] == ["a.py"]


def test_a_store_behind_a_file_system_of_spark(spark, tmp_path):
    spark._jsparkSession.sessionState().newHadoopConf()
    spark.conf.set("fs.viewfs.mounttable.graphs.link./in", f"file://{tmp_path}")
    store = Store(spark, "viewfs://graphs/in/s")
    row = spark.createDataFrame([("p", "a", "b", "CALLS", "{}", 1)], TABLES["edges"][0])
    store.write(1, "edges", row)
    store.publish(1)
    assert Store(spark, "viewfs://graphs/in/s").read("edges").count() == 1 and not store.files.create("generations/000000001.json", "")
    store.set_status("indexed")
    assert store.status()["state"] == "indexed" and (tmp_path / "s" / "status.json").exists()
    store.delete()
    assert store.generation is None and store.read("edges").isEmpty()


def test_an_index_with_names_through_files(spark, tmp_path):
    root = tmp_path / "linked"
    (root / "pkg").mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, text in (("pkg/__init__.py", "from .a import run\n"), ("pkg/a.py", "from .b import work as run\n"), ("pkg/b.py", "def work():\n    return 1\n"), ("main.py", "from pkg import run\n\ndef main():\n    return run()\n")):
        (root / name).write_text(text)
    run("add", "-A")
    run("commit", "-qm", "all")
    now = F.lit("2024-06-01").cast("timestamp")
    plain, linked = Store(spark, tmp_path / "plain"), Store(spark, tmp_path / "with")
    index_repository(plain, root, "p", now)
    index_repository(linked, root, "p", now, resolve_names=True)
    calls = lambda s: {(r["source"], r["target"]) for r in s.read("edges").where("type = 'CALLS'").collect()}
    assert calls(plain) == {("main.main", "pkg.run")} and calls(linked) == {("main.main", "pkg.run"), ("main.main", "pkg.b.work")}
    assert {"pkg/__init__.py", "main.py"} <= {r["file_path"] for r in plain.read("nodes").where("label = 'File'").collect()}
