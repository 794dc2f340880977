"""As-of joins, files through their names, paths of dense graphs, names by trigrams."""

import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph import streaming
from loomgraph.functions.expr import matches
from loomgraph.operators import evolution, graph, renames, rollup, trigrams
from loomgraph.operators.asof import asof_join
from loomgraph.sources.shared import fresh_path

DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_asof_against_a_plain_search(spark, parts):
    r = random.Random(parts)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(k, key(), r.choice([None, *range(25)])) for k in range(400)] + [(1000 + k, "hot", 7) for k in range(80)]
    right = [(k, key(), r.choice([None, *range(25)])) for k in range(150)]
    a, b = spark.createDataFrame(left, "id long, k string, t int"), spark.createDataFrame(right, "id long, k string, t int")
    got = asof_join(a, b, {"k": (F.col("k"), F.col("k"))}, (F.col("t"), F.col("t")), [F.col("id")], parts)
    assert got.columns == ["id", "k", "t", "match"]
    for row in got.collect():
        want = max(((t, i) for i, k, t in right if k is not None and k == row["k"] and t is not None and row["t"] is not None and t <= row["t"]), default=(None, None))
        assert (row["match"] and row["match"]["id"]) == want[1]
    assert got.count() == len(left)
    assert asof_join(a, b.limit(0), {"k": (F.col("k"), F.col("k"))}, (F.col("t"), F.col("t"))).where("match IS NOT NULL").isEmpty()
    assert asof_join(a.limit(0), b, {"k": (F.col("k"), F.col("k"))}, (F.col("t"), F.col("t"))).isEmpty()


def plain_files(rows):
    """Of each (commit number, path, old path) the file, by walking through the history."""
    held, left, born, out = {}, {}, {}, []
    for commit in sorted({c for c, *_ in rows}):
        own = [(p, o) for c, p, o in rows if c == commit]
        moved = [(p, o) for p, o in own if o]
        sources = {o: held.get(o) or (o + (f"@{left[o]}" if o in left else "")) for _, o in moved}
        for o in sources:
            held.pop(o, None)
            left[o] = commit
        for p in {p for p, _ in moved}:
            held[p] = sources[min(o for q, o in moved if q == p)]
        for p, o in own:
            if p not in held:
                held[p] = p + (f"@{left[p]}" if p in left else "")
            out.append((commit, p, o, held[p]))
            born.setdefault(held[p], p)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_files_are_followed_through_renames_reuse_and_swaps(spark, seed):
    r = random.Random(seed)
    rows = [(k, f"n{k}", f"n{k - 1}") for k in range(1, 11)] + [(20, "n3", None), (21, "n10", None)]  # a chain of ten, then reuse
    for c in range(30, 200):
        kind, a, b = r.random(), *r.sample("abcdef", 2)
        if kind < 0.3:
            rows.append((c, a, b))
        elif kind < 0.4:
            rows += [(c, a, b), (c, b, a)]
        elif kind < 0.5:
            rows += [(c, a, b), (c, b, None)]  # the old name is another file in the same commit
        else:
            rows += [(c, p, None) for p in {a, b}]
    df = spark.createDataFrame([(f"{c:04}", DAY + timedelta(hours=c // 2), p, o, c) for c, p, o in rows], "hash string, committed_at timestamp, path string, old_path string, c int")
    got = renames.followed(df, parts=3)
    assert got.columns == [*df.columns, "file", "last_name"]
    found = sorted(((x["c"], x["path"], x["old_path"] or "", re.sub(r"@0*(\d+)$", r"@\1", x["file"])) for x in got.collect()))
    assert found == sorted((c, p, o or "", f) for c, p, o, f in plain_files(rows))
    chain = {x["file"] for x in got.where("c <= 10 OR c = 21").collect()}
    assert chain == {"n0"} and {x["last_name"] for x in got.where("c = 5").collect()} == {"n10"} and got.where("c = 20").first()["file"] == "n3@0004"
    assert renames.followed(df.limit(0)).isEmpty()
    lost = df.union(spark.createDataFrame([(None, DAY, "x", "y", -1), ("z", None, "x", None, -2), ("z", DAY, None, "y", -3)], df.schema))
    assert [x["file"] for x in renames.followed(lost).where("c < 0").collect()] == [None] * 3


def test_paths_of_a_dense_graph_are_counted_and_paged(spark):
    n = 22
    edges = spark.createDataFrame([(str(a), str(b)) for a in range(n) for b in range(n) if a != b], "source string, target string")
    paths = graph.Paths(edges, "0", "callees", 5)
    want, total = [1], 1
    for k in range(5):
        want.append(want[-1] * (n - 1 - k))
    assert {r["depth"]: r["n"] for r in paths.counts().collect()} == dict(enumerate(want)) and sum(want) > 2_000_000
    page = [tuple(r) for r in paths.page(1 + 21, 3).collect()]
    assert page == [("1", ["0", "10", "1"], 2), ("1", ["0", "11", "1"], 2), ("1", ["0", "12", "1"], 2)]
    small = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "d"), ("b", "x"), ("x", "y")], "source string, target string")
    all_ = sorted((r["node"], tuple(r["path"])) for r in graph.trace_path(small, "a", depth=4).collect())
    every = graph.Paths(small, "a", depth=4)
    assert sorted((r["node"], tuple(r["path"])) for r in every.page(0, 100).collect()) == all_
    to = graph.Paths(small, "a", depth=4, to="d")
    assert [tuple(r["path"]) for r in to.page(0, 9).collect()] == sorted((p for n, p in all_ if n == "d"), key=lambda p: (len(p), p))
    assert all("x" not in r["path"] for t in to.tables for r in t.collect())  # never on the way to d
    assert graph.Paths(small, "a", depth=3, to="nowhere").counts().isEmpty() and every.page(100, 5).isEmpty()


def test_trigrams_find_what_a_scan_does(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcAB_.é") for _ in range(r.randint(0, 9)))
    names = [word() + r.choice(["", "Handler", "parse_", "get"]) + word() for _ in range(600)] + ["", None, "ab", "İstanbul"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    index = trigrams.index_of(rows, fresh_path(spark, "trigrams"), "name")
    asked = [n[a : a + r.randint(1, 6)] for n in r.sample([n for n in names if n], 25) for a in [r.randint(0, 3)]] + ["zzz", "HANDLER", "İst"]
    union = None
    for k, t in enumerate(asked):
        one = index.containing(t).select(F.lit(k).alias("k"), "id") if t else None
        union = one if union is None else union if one is None else union.union(one)
    found = {(x["k"], x["id"]) for x in union.collect()}
    assert found == {(k, i) for k, t in enumerate(asked) if t for i, n in enumerate(names) if n is not None and t.lower() in n.lower()}
    patterns = ["Handler", "^parse_", "(ab|ba)Handler?", "a.*get$", "Hand(le)?r", "x?parse_+a", "[ab]{2,}get", "parse|get", "ha?nd", "Hand\\.|get", "get\\b", "(?i)HANDLER", "\\.Handler", "gets?", "p{1,2}arse", "parse_{0}"]
    for p in patterns:
        assert {x["id"] for x in index.matching(p).collect()} == {i for i, n in enumerate(names) if n is not None and re.search(p, n)}, p
    plan = index.having(trigrams.grams("handler"))._jdf.queryExecution().toString()
    assert "folder" in plan and "PartitionFilters" in plan


def test_required_runs_are_in_whatever_matches():
    r, pieces = random.Random(6), ["a", "b", "c", "d", "a*", "b+", "c?", "d{2}", "a{0,2}", "b{1,}", ".", "[ab]", "[^c]", "(ab)", "(a|b)", "(cd)?", "(?:bc)+", "\\.", "\\w", "^", "$", "abc", "dcb"]
    checked = 0
    for _ in range(10_000):
        pattern = "".join(r.choice(pieces) for _ in range(r.randint(1, 7)))
        runs = trigrams.required_runs(pattern)
        for _ in range(6):
            text = "".join(r.choice("abcd.") for _ in range(r.randint(0, 12)))
            try:
                hit = re.search(pattern, text)
            except re.error:
                break
            if hit:
                assert all(x in text for x in runs), (pattern, text, runs)
                checked += bool(runs)
    assert checked > 50


def test_patterns_that_go_back_end(spark):
    text = spark.createDataFrame([("a" * 5000 + "b",), ("aaac",), (None,)], "s string")
    began = time.monotonic()
    assert [r["m"] for r in text.select(matches(F.col("s"), "^(a+)+c$").alias("m")).collect()] == [False, True, None]
    assert [r["m"] for r in text.select(matches(F.col("s"), "(a|aa)+$").alias("m")).collect()] == [False, False, None]
    assert time.monotonic() - began < 60
    with pytest.raises(ValueError):
        matches(F.col("s"), "(a)\\1")


def test_streams_of_late_and_repeated_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"h{k}", r.choice(["a", "b", None]), DAY + timedelta(days=r.randint(0, 60)), r.randint(0, 50)) for k in range(200)]
    schema = "hash string, path string, committed_at timestamp, additions long"
    source, table, sums, checks = (str(tmp_path / n) for n in ("in", "table", "sums", "checks"))
    shuffled = rows * 2
    r.shuffle(shuffled)
    roles = evolution.Roles(churn="additions")
    for turn in range(4):
        spark.createDataFrame(shuffled[turn::4], schema).write.mode("append").parquet(source)
        query = streaming.append_changes(spark.readStream.schema(schema).parquet(source), table, f"{checks}/1")
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == len(shuffled[turn::4])  # of a batch, not of the table
        streaming.summarise_changes(spark.readStream.schema(schema).parquet(table), sums, f"{checks}/2", roles).awaitTermination()
    assert sorted(map(str, spark.read.parquet(table).collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))
    want = {p: (sum(x[1] == p for x in rows), sum(x[3] for x in rows if x[1] == p), max(x[2] for x in rows if x[1] == p)) for p in ("a", "b", None)}
    read = lambda: {x["path"]: (x["commit_count"], x["churn"], x["last_commit_at"]) for x in streaming.summaries(spark, sums).collect()}
    assert read() == want
    assert streaming.fold_summaries(spark, sums, keep=1) == 2 and read() == want and streaming.fold_summaries(spark, sums, keep=1) == 0
    late = streaming.append_changes(spark.readStream.schema(schema).parquet(source), str(tmp_path / "t2"), f"{checks}/3", at="committed_at", delay="90 days")
    late.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 200  # nothing is later than that
    with pytest.raises(ValueError):
        streaming.append_changes(spark.readStream.schema(schema).parquet(source), table, f"{checks}/1", at="committed_at")


def test_folders_have_the_sums_of_what_is_below(spark):
    r = random.Random(7)
    names = ["a", "b", "c"]
    rows = [(f"h{r.randint(0, 30)}", "/".join(r.choice(names) for _ in range(r.randint(1, 4))), r.choice(["x", "y", "z", None]), r.randint(0, 9)) for _ in range(300)] + [("h1", None, "x", 5), (None, "a/b", "x", 1), ("h2", "/a//d.py", "y", 2), ("h2", "", "y", 3)]
    df = spark.createDataFrame(rows, "hash string, path string, author_email string, churn int")
    got = {x["folder"]: tuple(x)[1:] for x in rollup.folder_evolution(df, evolution.Roles(churn="churn")).collect()}
    want = {}
    for h, p, a, c in rows:
        if p is not None:
            parts = [x for x in p.split("/") if x]
            for k in range(max(1, len(parts))):
                want.setdefault("/".join(parts[:k]), []).append((h, p, a, c))
    assert set(got) == set(want) and "a/b" in got
    for folder, own in want.items():
        authors = {a: sum(x[2] == a for x in own) for a in {x[2] for x in own}}
        top = min(authors, key=lambda a: (-authors[a], a is not None, a or ""))
        depth = len(folder.split("/")) if folder else 0
        assert got[folder] == (depth, len({x[1] for x in own}), len({x[0] for x in own} - {None}), len(own), sum(x[3] for x in own), top, round(authors[top] / len(own), 3)), folder
    assert rollup.folder_evolution(df.limit(0), evolution.Roles(churn="churn")).isEmpty()


def test_sketches_of_periods_merge(spark):
    rows = spark.range(60_000).selectExpr("concat('p', id % 3) AS path", "concat('h', id DIV 2) AS hash", "concat('w', id % 40) AS author_email", "CAST(id % 10 AS int) AS month", "1L AS churn")
    stored = rollup.sketched(rows, F.col("month"), evolution.Roles(churn="churn"))
    exact = {r["path"]: r for r in rows.where("month BETWEEN 2 AND 6").groupBy("path").agg(F.count_distinct("hash").alias("commits"), F.count_distinct("author_email").alias("authors"), F.count("*").alias("changes")).collect()}
    for r in rollup.over_periods(stored, F.lit(2), F.lit(6)).collect():
        e = exact[r["path"]]
        assert r["changes"] == r["churn"] == e["changes"] and r["authors"] == e["authors"] and abs(r["commits"] - e["commits"]) < 0.07 * e["commits"]
    assert abs(rollup.over_periods(stored, by=["period"]).where("period = 3").first()["commits"] - 6000) < 400
