"""Offline evaluation of rankings and answers, as grouped aggregations."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranks that count.
CUT_OFF = 10
#: Gates: the least gain on the slice that is to improve, the largest loss elsewhere.
LEAST_GAIN, LARGEST_LOSS = 0.10, 0.02


def reranked(pool: DataFrame, weights: dict[str, float], keys: tuple[str, ...] = ("golden",)) -> DataFrame:
    """pool with rank: by the weighted sum of signals, ties by pool_pos, which the caller sets."""
    score = sum((F.lit(float(w)) * F.col(s) for s, w in weights.items()), F.lit(0.0))
    return pool.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "pool_pos")))


def reciprocal_rank(rank, k: int = CUT_OFF):
    return F.when(rank <= k, 1 / rank).otherwise(0.0)


def mrr_by_slice(pool: DataFrame, goldens: DataFrame, configs: dict[str, dict[str, float]], k: int = CUT_OFF) -> DataFrame:
    """slice, config, n, mrr. pool: golden, candidate, pool_pos and signals; goldens: golden,
    slice, expected. A golden whose expected candidate isn't in the pool scores 0."""
    out = None
    for name, weights in configs.items():
        hit = reranked(pool, weights).select(F.col("golden").alias("_g"), F.col("candidate").alias("_c"), "rank")
        got = goldens.join(hit, (F.col("golden") == F.col("_g")) & (F.col("expected") == F.col("_c")), "left")
        rows = got.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(reciprocal_rank(F.col("rank"), k), F.lit(0.0))), 6).alias("mrr")).select("slice", F.lit(name).alias("config"), "n", "mrr")
        out = rows if out is None else out.union(rows)
    return out


def gates(mrr: dict[tuple[str, str], float], improved: str, base: str = "blind", new: str = "hybrid") -> list[str]:
    """Reasons why the new configuration doesn't pass: mrr by (slice, config)."""
    reasons = []
    for name in sorted({s for s, _ in mrr}):
        gain = mrr[name, new] - mrr[name, base]
        if name == improved and gain < LEAST_GAIN:
            reasons.append(f"{name}: gain {gain:.3f} is below {LEAST_GAIN}")
        elif name != improved and -gain > LARGEST_LOSS:
            reasons.append(f"{name}: loss {-gain:.3f} is above {LARGEST_LOSS}")
    return reasons


def noise_band(rows: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """key, n, mean, min, max, stdev (of a sample; 0 for a single row)."""
    v = F.col(value)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(v), digits).alias("mean"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), digits).alias("stdev"))


def report_summary(rows: DataFrame, key: str) -> DataFrame:
    """n, passed, quality, tokens_total, tokens_mean, graph_adoption of answers (passed, tokens,
    used_graph) by key; an answer is a row. With a column graph_calls (of each answer), their sum
    is graph_tool_calls."""
    n = F.count("*")
    calls = [F.coalesce(F.sum("graph_calls"), F.lit(0)).cast("long").alias("graph_tool_calls")] if "graph_calls" in rows.columns else []
    return rows.groupBy(key).agg(
        n.alias("n"), F.count_if("passed").alias("passed"), F.round(F.count_if("passed") / n, 6).alias("quality"), F.sum("tokens").alias("tokens_total"),
        F.round(F.sum("tokens") / n, 4).alias("tokens_mean"), F.round(F.count_if("used_graph") / n, 6).alias("graph_adoption"), *calls,
    )


def question_rows(answers: DataFrame, calls: DataFrame, graph_tools: str) -> DataFrame:
    """A row a question of a report: golden_id, passed, score, tokens, num_turns, is_error, notes,
    tool_calls (map of tool and number), graph_calls, used_graph. answers: the first seven;
    calls: golden_id, tool, a row a call; graph_tools: part of the names of the graph's tools."""
    tally = tool_tally(calls).groupBy("golden_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "n")))).alias("tool_calls"), F.sum(F.when(F.contains("tool", F.lit(graph_tools)), F.col("n")).otherwise(0)).alias("graph_calls"),
    )
    out = answers.join(tally, "golden_id", "left").withColumn("graph_calls", F.coalesce("graph_calls", F.lit(0)))
    none = F.create_map().cast("map<string,bigint>")
    return out.select("golden_id", "passed", "score", "tokens", "num_turns", "is_error", "notes", F.coalesce("tool_calls", none).alias("tool_calls"), "graph_calls", (F.col("graph_calls") > 0).alias("used_graph"))


def failures(rows: DataFrame) -> DataFrame:
    """golden_id, reason of answers that fail; an agent's error comes before the verdict."""
    return rows.where("is_error OR NOT passed").select("golden_id", F.when(F.col("is_error"), "agent_error").otherwise("judge_fail").alias("reason"))


def token_total(*fields: str):
    """Sum of usage columns; missing ones count 0."""
    return sum((F.coalesce(F.col(f), F.lit(0)) for f in fields), F.lit(0))


def tool_tally(calls: DataFrame) -> DataFrame:
    """golden_id, tool, n."""
    return calls.groupBy("golden_id", "tool").agg(F.count("*").alias("n"))


def leaked_tools(used: DataFrame, allowed: list[str]) -> DataFrame:
    """golden_id and tools (array) that a condition doesn't allow."""
    leak = F.array_except("tools", F.array(*[F.lit(t) for t in allowed]).cast("array<string>"))
    return used.select("golden_id", leak.alias("leaked")).where(F.size("leaked") > 0)


@dataclass(frozen=True)
class Golden:
    id: str
    question: str
    repo: str
    category: str
    key_points: tuple[str, ...]


def checked_goldens(rows: list[dict], categories: set[str]) -> list[Golden]:
    """Goldens from records; raises on empty key points, unknown categories, repeated ids."""
    out, seen = [], set()
    for r in rows:
        if not r.get("key_points"):
            raise ValueError(f"{r['id']}: no key points")
        if r["category"] not in categories:
            raise ValueError(f"{r['id']}: unknown category {r['category']}")
        if r["id"] in seen:
            raise ValueError(f"{r['id']}: repeated")
        seen.add(r["id"])
        out.append(Golden(r["id"], r["question"], r["repo"], r["category"], tuple(r["key_points"])))
    return out


def _yaml(path: Path):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package pyyaml") from e
    return yaml.safe_load(path.read_text()) or []


#: The categories of questions.
CATEGORIES = frozenset({"symbol_lookup", "caller_callee", "impact", "architecture", "data_flow", "evolution"})
#: Slices of ranking goldens.
SLICES = frozenset({"staleness", "general", "semantic"})


def load_goldens(folder: Path, categories: frozenset[str] = CATEGORIES) -> list[Golden]:
    """The goldens of all YAML files of a folder, checked together."""
    return checked_goldens([r for path in sorted(Path(folder).glob("*.yaml")) for r in _yaml(path)], set(categories))


def load_ranking_goldens(spark: SparkSession, path: Path, slices: frozenset[str] = SLICES) -> DataFrame:
    """golden, slice, expected, repo of a YAML list of (query, expected, repo, slice)."""
    rows = []
    for r in _yaml(Path(path)):
        if r.get("slice") not in slices or not r.get("query") or not r.get("expected"):
            raise ValueError(f"no ranking golden: {r}")
        rows.append((r["query"], r["slice"], r["expected"], r.get("repo", "")))
    return spark.createDataFrame(rows, "golden string, slice string, expected string, repo string")


def load_corpus(path: Path) -> dict[str, dict]:
    """The repositories of a corpus file by name; each has its address and commit."""
    out = {}
    for r in _yaml(Path(path))["repos"]:
        if r["name"] in out or not re.fullmatch(r"[0-9a-f]{7,40}", str(r["sha"])):
            raise ValueError(f"{r['name']}: repeated, or no commit")
        out[r["name"]] = {"repo": r["repo"], "sha": r["sha"], "language": r["language"], "role": r.get("role", "")}
    return out


def ranking_run(pool: DataFrame, goldens: DataFrame, configs: dict[str, dict[str, float]], improved: str, folder: Path, provenance: dict, base: str = "blind", new: str = "hybrid") -> dict:
    """MRR of each slice and configuration, the gates' reasons, and where they come from, as a JSON
    artifact named by its content: a later run doesn't overwrite an earlier one."""
    rows = [r.asDict() for r in mrr_by_slice(pool, goldens, configs).orderBy("slice", "config").collect()]
    reasons = gates({(r["slice"], r["config"]): r["mrr"] for r in rows}, improved, base, new)
    run = {"provenance": provenance, "configs": configs, "mrr": rows, "passed": not reasons, "reasons": reasons}
    text = json.dumps(run, indent=2, sort_keys=True)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"rank-{hashlib.sha256(text.encode()).hexdigest()[:12]}.json").write_text(text)
    return run


def judge_prompt(golden: Golden, answer: str) -> str:
    """What a judge is asked: one flag for each key point, as JSON."""
    points = "\n".join(f"{k}. {p}" for k, p in enumerate(golden.key_points, 1))
    return (
        f"Question:\n{golden.question}\n\nKey points:\n{points}\n\nAnswer to judge:\n{answer}\n\n"
        f'For each of the {len(golden.key_points)} key points say whether the answer covers it. Reply with JSON alone: {{"covered": [true or false, ...], "pass": true if all are, "score": 0 to 1, "notes": "a few words"}}'
    )


@dataclass(frozen=True)
class Verdict:
    """A judge's answer on one question."""

    passed: bool
    score: float
    covered: tuple[bool, ...]
    notes: str = ""


def verdict_of(text: str, key_points: int) -> Verdict:
    """The verdict in a judge's answer: `pass` and `score` where they are given, else what the flags
    say; raises ValueError where a field isn't what it should be."""
    found = parsed_verdict(text, key_points)
    covered = found["covered"]
    if not all(isinstance(x, bool) for x in covered):
        raise ValueError(f"covered holds more than true and false: {covered}")
    passed, score = found.get("pass", all(covered)), found.get("score", sum(covered) / max(1, len(covered)))
    if not isinstance(passed, bool) or isinstance(score, bool) or not isinstance(score, (int, float)) or not 0 <= score <= 1:
        raise ValueError(f"no verdict: pass {passed!r}, score {score!r}")
    return Verdict(passed, float(score), tuple(covered), str(found.get("notes") or ""))


def parsed_verdict(text: str, key_points: int) -> dict:
    """The first JSON object of a judge's answer; `covered` must have one flag a key point."""
    start = text.index("{")
    verdict, _ = json.JSONDecoder().raw_decode(text[start:])
    if len(verdict.get("covered", [])) != key_points:
        raise ValueError(f"covered has {len(verdict.get('covered', []))} flags for {key_points} key points")
    return verdict


def write_report(folder: Path, run_id: str, summary: dict, failed: list[dict], questions: list[dict] | None = None, about: dict | None = None) -> tuple[Path, Path]:
    """The report as JSON and as Markdown. questions: rows of question_rows(); about: what the run
    was made with (condition, models, versions, corpus)."""
    folder.mkdir(parents=True, exist_ok=True)
    data, page = folder / f"{run_id}.json", folder / f"{run_id}.md"
    data.write_text(json.dumps({**(about or {}), "run_id": run_id, "summary": summary, "questions": questions or [], "failures": failed}, indent=2, sort_keys=True))
    lines = [f"# Run {run_id}", "", "| | |", "|-|-|", *[f"| {k} | {v} |" for k, v in summary.items()], "", *[f"- {f['golden_id']}: {f['reason']}" for f in failed]]
    if questions:
        cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
        lines += ["", "| " + " | ".join(questions[0]) + " |", "|" + "-|" * len(questions[0]), *["| " + " | ".join(cell(v) for v in q.values()) + " |" for q in questions]]
    page.write_text("\n".join(lines) + "\n")
    return data, page
