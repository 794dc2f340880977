"""Vectors that aren't sound, the cell index, reports and verdicts."""

import json

import numpy as np
import pytest

from loomgraph.operators import search
from loomgraph.operators.cells import CellIndex, Cells
from loomgraph.plans import rank_eval
from loomgraph.sources.shared import fresh_path

NAN = float("nan")


def frame(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"qualified_name {kind}, vec array<float>")


def brute(rows, q, k):
    q = np.asarray(q) / (np.linalg.norm(q) or 1)
    sims = [(-float(np.dot(v, q) / (np.linalg.norm(v) or 1)), i) for i, v in rows]
    return [(i, -s) for s, i in sorted(sims)[:k]]


def test_unsound_vectors_are_near_to_nothing(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("nan", [NAN, 1.0]), ("nul", [None, 1.0]), ("inf", [float("inf"), 0.0]), ("z", [0.0, 0.0]), ("long", [1.0, 0.0, 0.0]), ("none", None), ("empty", [])]
    vectors = frame(spark, rows).coalesce(1)
    index = search.VectorIndex(vectors)
    cells = CellIndex.build(vectors, fresh_path(spark, "cells"))
    for found in (search.nearest(vectors, [1.0, 0.0], 2), index.nearest([1.0, 0.0], 2), cells.nearest_exact([1.0, 0.0], 2), cells.nearest([1.0, 0.0], 2)):
        assert [r["qualified_name"] for r in found.collect()] == ["a", "b"]
    assert [r["qualified_name"] for r in index.nearest([1.0, 0.0, 0.0], 2).collect()] == ["long"]
    assert index.nearest([1.0], 2).isEmpty() and cells.nearest([1.0], 2).isEmpty() and cells.nearest_exact([NAN, 1.0], 2).isEmpty()
    numbers = search.VectorIndex(frame(spark, [(7, [1.0, 0.0]), (8, [0.0, 1.0])], "int"))
    assert [r["qualified_name"] for r in numbers.nearest([1.0, 0.0], 1).collect()] == [7]
    none = CellIndex.build(vectors.limit(0), fresh_path(spark, "cells"))
    assert none.nearest([1.0, 0.0], 2).isEmpty() and none.nearest_exact([1.0], 2).isEmpty() and none.nearest_of(vectors.withColumnRenamed("qualified_name", "q"), 2, "q").isEmpty()


def test_cells_against_a_full_comparison(spark):
    r = np.random.default_rng(6)
    middles = r.normal(size=(30, 24))
    x = (middles[r.integers(0, 30, 3000)] + 0.4 * r.normal(size=(3000, 24))).astype(np.float32)
    x[:700] = x[0]  # a cell with many vectors
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]
    vectors = frame(spark, rows, "long").repartition(4)
    place = fresh_path(spark, "cells")
    built = CellIndex.build(vectors, place, how=Cells(block=64, probes=8))
    index = CellIndex(spark, place)
    assert index.blocks.count() == built.blocks.count() and index.blocks.selectExpr("sum(size(ids)) AS n").first()["n"] == 3000
    for q in (x[5], x[1500], r.normal(size=24)):
        got = [(a["qualified_name"], a["sim"]) for a in index.nearest_exact(q.tolist(), 25).collect()]
        want = brute(rows, q, 25)
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)
        if q is not x[5]:
            assert [i for i, _ in got] == [i for i, _ in want]
    queries = vectors.where("qualified_name % 100 = 0 AND qualified_name >= 700").withColumnRenamed("qualified_name", "q")
    found = {}
    for a in index.nearest_of(queries, 10, "q").collect():
        found.setdefault(a["q"], set()).add(a["qualified_name"])
    assert len(found) == 23
    hits = sum(len(found[q] & {i for i, _ in brute(rows, x[q], 10)}) for q in found)
    assert hits >= 0.9 * 10 * len(found)
    one = [a["qualified_name"] for a in index.nearest(x[1500].tolist(), 10).collect()]
    assert 1500 in one and "PartitionFilters: [isnotnull" not in one
    plan = index._scored(index.cells[:2], np.ones(24) / 24**0.5, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:40]


def test_reports_have_questions_and_calls(spark, tmp_path):
    answers = spark.createDataFrame([("a", True, 1.0, 10, 3, False, "ok"), ("b", False, 0.5, 20, 2, False, "one | missing")], "golden_id string, passed boolean, score double, tokens long, num_turns int, is_error boolean, notes string")
    calls = spark.createDataFrame([("a", "graph_search"), ("a", "graph_search"), ("a", "read"), ("c", "graph_search")], "golden_id string, tool string")
    rows = rank_eval.question_rows(answers, calls, "graph")
    got = {r["golden_id"]: r.asDict() for r in rows.collect()}
    assert got["a"]["tool_calls"] == {"graph_search": 2, "read": 1} and (got["a"]["graph_calls"], got["b"]["graph_calls"], got["b"]["tool_calls"]) == (2, 0, {})
    from pyspark.sql import functions as F

    summary = rank_eval.report_summary(rows.withColumn("all", F.lit(1)), "all").drop("all").first().asDict()
    assert (summary["n"], summary["passed"], summary["graph_adoption"], summary["graph_tool_calls"]) == (2, 1, 0.5, 2)
    data, page = rank_eval.write_report(tmp_path, "r1", summary, [{"golden_id": "b", "reason": "judge_fail"}], list(got.values()), {"condition": "C"})
    written = json.loads(data.read_text())
    assert written["condition"] == "C" and [q["golden_id"] for q in written["questions"]] == list(got) and "one \\| missing" in page.read_text()


def test_verdicts():
    v = rank_eval.verdict_of('```json\n{"covered": [true, false], "pass": false, "score": 0.5, "notes": "n"}\n```', 2)
    assert (v.passed, v.score, v.covered, v.notes) == (False, 0.5, (True, False), "n")
    assert rank_eval.verdict_of('{"covered": [true, true]}', 2) == rank_eval.Verdict(True, 1.0, (True, True))
    for bad in ('{"covered": [1, 0]}', '{"covered": [true, true], "score": 2}', '{"covered": [true, true], "pass": "yes"}', '{"covered": [true]}', "no"):
        with pytest.raises(ValueError):
            rank_eval.verdict_of(bad, 2)
