"""Registered queries of the core operators and their SQL for DuckDB.

The tables have no repositories, so they play the parts: rows of lineitem or events
are changes, parts are symbols, consecutive events of a user are call edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import embed, expr
from loomgraph.operators import evolution, graph, latest, search
from loomgraph.operators.cells import CellIndex, Cells
from loomgraph.plans import index_job, rank_eval
from loomgraph.sources import python_source
from loomgraph.sources.shared import fresh_path, written

LINE_PARTS = evolution.Roles(path="l_partkey", commit="l_orderkey", author="l_returnflag", ts="l_shipdate", churn="l_quantity + l_linenumber")
LINE_SUPPLIERS = evolution.Roles(path="l_suppkey", commit="l_orderkey", author="l_returnflag", ts="l_shipdate", churn="l_quantity + l_linenumber")
EVENT_USERS = evolution.Roles(path="user_id", commit="event_id", author="event_type", ts="ts", churn="value")
LINE_AS_OF, EVENT_AS_OF = "2001-12-01 00:00:00", "2024-01-31 00:00:00"
SEARCH_TEXT, FIRST_VECTOR = "red widget", 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- evolution


def churn(spark: SparkSession, d: str) -> DataFrame:
    return evolution.churn(table(spark, d, "lineitem"), LINE_PARTS)


def coupling(spark: SparkSession, d: str) -> DataFrame:
    return evolution.coupling(table(spark, d, "lineitem"), LINE_SUPPLIERS, 20)


def coupling_sparse(spark: SparkSession, d: str) -> DataFrame:
    return evolution.coupling(table(spark, d, "lineitem"), LINE_PARTS, 2)


def ownership(spark: SparkSession, d: str) -> DataFrame:
    return evolution.ownership(table(spark, d, "events"), EVENT_USERS)


def recency(spark: SparkSession, d: str) -> DataFrame:
    return evolution.recency(table(spark, d, "lineitem"), as_of(LINE_AS_OF), LINE_PARTS)


def file_evolution(spark: SparkSession, d: str) -> DataFrame:
    out = evolution.file_evolution(table(spark, d, "events"), as_of(EVENT_AS_OF), 7, EVENT_USERS)
    return out.withColumn("churn", F.round("churn", 4)).withColumn("top_author_share", F.round(F.col("top_author_share").cast("double"), 5)).withColumn("recency_score", F.round(F.col("recency_score").cast("double"), 5))


def author_counts(spark: SparkSession, d: str) -> DataFrame:
    return evolution.with_author_counts(table(spark, d, "events").select("event_id", "user_id", "event_type"), EVENT_USERS)


def exact_distinct(spark: SparkSession, d: str) -> DataFrame:
    return evolution.distinct_commits(table(spark, d, "lineitem"), LINE_PARTS)


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    rest = [c for c in df.columns if c not in ("l_orderkey", "l_linenumber", "l_shipdate")]
    return latest.latest_version(df, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), *[F.col(c) for c in rest]])


# --- graph


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Call edges: an event's type and the type of the user's next one."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    pairs = table(spark, d, "events").select(F.col("event_type").alias("source"), nxt.alias("target"))
    return pairs.where("target IS NOT NULL AND source <> target").distinct().withColumn("type", F.lit("CALLS"))


def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.centrality(transitions(spark, d))


def _walk(df: DataFrame) -> DataFrame:
    return df.select("node", F.array_join("path", " > ").alias("path"), "depth")


def trace_callees(spark: SparkSession, d: str) -> DataFrame:
    return _walk(graph.trace_path(transitions(spark, d), "click", "callees", 10))


def trace_callers(spark: SparkSession, d: str) -> DataFrame:
    return _walk(graph.trace_path(transitions(spark, d), "click", "callers", 3))


def reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(transitions(spark, d), "click", "callees", 10)


def schema_info(spark: SparkSession, d: str) -> DataFrame:
    return graph.schema_info(table(spark, d, "part"), table(spark, d, "events"), "p_type", "event_type")


# --- search


def symbols(spark: SparkSession, d: str) -> DataFrame:
    qualified = F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(
        qualified.alias("qualified_name"), F.col("p_type").alias("label"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("file_path"), F.col("p_size").alias("start_line"),
        (F.col("p_size") + 10).alias("end_line"), F.to_json(F.named_struct(F.lit("deprecated"), F.col("p_size") % 7 == 0)).alias("properties"),
    )


def symbol_graph(spark: SparkSession, d: str) -> search.Graph:
    nodes, lines = symbols(spark, d), table(spark, d, "lineitem")
    names = nodes.select("qualified_name", F.col("file_path").cast("long").alias("key"))
    edges = lines.select("l_suppkey", "l_partkey").distinct().join(names, F.col("l_partkey") == F.col("key")).select(F.col("l_suppkey").cast("string").alias("source"), F.col("qualified_name").alias("target"), F.lit("CALLS").alias("type"))
    changes = lines.select(F.col("l_partkey").cast("string").alias("path"), F.col("l_shipdate").alias("committed_at"))
    vectors = table(spark, d, "embeddings").join(names, F.col("vec_id") == F.col("key")).select("qualified_name", F.col("embedding").alias("vec"))
    return search.Graph(nodes, edges, changes, vectors)


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == FIRST_VECTOR).first()["embedding"])


def filter_ci_substring(spark: SparkSession, d: str) -> DataFrame:
    return search.candidates(search.Graph(symbols(spark, d), None, None), search.Query("RED")).select("qualified_name", "name")


def filter_regex(spark: SparkSession, d: str) -> DataFrame:
    return search.candidates(search.Graph(symbols(spark, d), None, None), search.Query(name_pattern="^(red|blue) .*t$")).select("qualified_name", "name")


def filter_label(spark: SparkSession, d: str) -> DataFrame:
    kind = "STANDARD"
    return search.candidates(search.Graph(symbols(spark, d), None, None), search.Query(label=kind)).select("qualified_name", "label")


def subtoken_jaccard(spark: SparkSession, d: str) -> DataFrame:
    lex = expr.lexical(F.col("name"), F.col("qualified_name"), SEARCH_TEXT)
    return symbols(spark, d).select("qualified_name", F.array_join(expr.subtokens(F.col("qualified_name")), " ").alias("tokens"), F.round(lex, 3).alias("lex"))


def lexical_binary(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("qualified_name", expr.lexical(F.col("name"), F.col("qualified_name"), "red", "binary").alias("lex"))


def json_flag(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("qualified_name", expr.json_flag(F.col("properties"), "deprecated").alias("deprecated"), expr.json_flag(F.col("properties"), "none").alias("missing"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return search.nearest(vectors, first_vector(spark, d), 100, "vec_id").select("vec_id", F.round("sim", 6).alias("sim"))


def _damaged_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, of which some have a component that is NaN or null, are cut short or are null."""
    at = F.col("vec_id") % 10
    damaged = F.when(at == 3, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))).when(at == 4, F.transform("embedding", lambda x, i: F.when(i != 7, x)))
    damaged = damaged.when(at == 5, F.slice("embedding", 1, 40)).when(at == 6, F.lit(None)).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", damaged.cast("array<float>").alias("vec"))


def vector_topk_sound(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of vectors of which many aren't sound."""
    return search.nearest(_damaged_vectors(spark, d), first_vector(spark, d), 100, "vec_id").select("vec_id", F.round("sim", 6).alias("sim"))


def _cells(spark: SparkSession, d: str) -> CellIndex:
    return CellIndex.build(_damaged_vectors(spark, d), fresh_path(spark, "cells"), "vec_id")


def vector_cells_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same by cells and their bounds."""
    return _cells(spark, d).nearest_exact(first_vector(spark, d), 100).select("vec_id", F.round("sim", 5).alias("sim"))


def vector_cells_recall(spark: SparkSession, d: str) -> DataFrame:
    """For the vectors whose id is divisible by 100: how many of the 10 most similar ones by a full
    comparison the cells find, and whether that is 0.9 of all."""
    index, vectors = _cells(spark, d), written(_damaged_vectors(spark, d).where(search.sound(64)), "sound")
    queries = vectors.where(F.col("vec_id") % 100 == 0)
    asked = queries.withColumnRenamed("vec_id", "query_id")
    found = index.nearest_of(asked, 10, "query_id")
    every = CellIndex.build(vectors, fresh_path(spark, "all"), "vec_id", Cells(cells=1, probes=1)).nearest_of(asked, 10, "query_id")
    both = every.select("query_id", "vec_id", F.lit(1).alias("is")).join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    sums = both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))
    return sums.select("queries", "neighbours", "recalled")


def vector_left_guard(spark: SparkSession, d: str) -> DataFrame:
    g, v = symbol_graph(spark, d), first_vector(spark, d)
    sim = expr.cosine_similarity(F.col("vec"), F.array(*[F.lit(x) for x in v]), len(v))
    return g.nodes.join(g.vectors, "qualified_name", "left").select("qualified_name", F.round(sim, 6).alias("vec"))


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    return search.candidates(symbol_graph(spark, d), search.Query(SEARCH_TEXT, vector=first_vector(spark, d))).select("qualified_name")


def _search(spark: SparkSession, d: str, limit: int, offset: int) -> DataFrame:
    query = search.Query("red", vector=first_vector(spark, d))
    return search.ranked(symbol_graph(spark, d), query, as_of(LINE_AS_OF), limit=limit, offset=offset)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, 20, 0)


def hybrid_search_page2(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, 20, 20)


def search_total(spark: SparkSession, d: str) -> DataFrame:
    """The totals of search pages by text and vector: the first, one within, one past the last."""
    g, query = symbol_graph(spark, d), search.Query("red", vector=first_vector(spark, d))
    rows = []
    for offset in (0, 40, 1_000_000):
        page = search.search_graph(g, query, as_of(LINE_AS_OF), limit=30, offset=offset)
        rows.append((offset, len(page.items), page.total, page.has_more))
    return spark.createDataFrame(rows, "first long, n long, total long, has_more boolean")


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Whether a hashed query vector finds the symbols with the same tokens: symbols by text and
    vector, with the nearest ones' similarity."""
    model = embed.HashedTokens(64)
    names = symbols(spark, d).select("name").distinct()
    vectors = embed.embedded(names.select(F.col("name").alias("qualified_name"), F.col("name").alias("text")), model)
    near = search.nearest(vectors, model.vectors(["red widget"])[0].tolist(), 1)
    return near.select("qualified_name", F.round("sim", 4).alias("sim"))


# --- text and evaluation


def rename_expand(spark: SparkSession, d: str) -> DataFrame:
    """Change paths made from page addresses: plain, with a brace, and with an arrow."""
    path = F.regexp_replace("url", r"^[a-z]+://", "")
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("src/{ => core}/"), path)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("old/"), path, F.lit(" => new/"), path)).otherwise(path)
    pages = table(spark, d, "pages").select("page_id", expr.rename_sides(made).alias("p"))
    return pages.select("page_id", F.col("p.old").alias("old_path"), F.col("p.new").alias("path"))


def snippet(spark: SparkSession, d: str) -> DataFrame:
    r"""Lines of texts whose lines end in \n, \r\n or \r, by id."""
    text = F.when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 2, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", expr.lines_between(text, F.lit(2), F.lit(4)).alias("snippet"))


def module_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.regexp_replace("url", r"^[a-z]+://", ""), F.when(F.col("page_id") % 2 == 0, F.lit("/__init__.py")).otherwise(F.lit(".py")))
    return table(spark, d, "pages").select("page_id", expr.module_name(path).alias("module"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    doc = F.when(F.col("start_line") % 2 == 0, F.col("label"))
    return symbols(spark, d).select("qualified_name", expr.embedding_text(F.col("qualified_name"), doc).alias("text"))


def density_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents as symbols, their lines as lines, sources as projects."""
    lines = F.size(F.split("text", "\n", -1))
    out = table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("files"), F.count("*").alias("docs"), F.sum(lines).alias("lines"))
    density, bad = index_job.density(F.col("docs"), F.col("lines")), index_job.too_sparse(F.col("files"), F.col("docs"), F.col("lines"), 100.0)
    return out.select("source", "docs", F.round(density, 6).alias("density"), bad.alias("degraded"))


#: Weights of the signals in the three configurations that are compared.
CONFIGS = {"blind": {"lex": 0.35}, "hybrid": {"lex": 0.35, "rec": 0.2}, "hybrid_dep": {"lex": 0.35, "rec": 0.2, "dep": -0.2}}


def _pool(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return labels.select(F.concat(F.lit("q"), (F.col("doc_id") % 20).cast("string")).alias("golden"), F.when(F.col("doc_id") % 20 < 10, "general").otherwise("staleness").alias("slice"), F.col("doc_id").alias("candidate"), F.col("doc_id").alias("pool_pos"), F.col("quality").cast("double").alias("lex"), F.col("toxic").cast("double").alias("dep"), (F.col("doc_id") % 7 / 8).alias("rec"))


def mrr_by_slice(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    goldens = pool.groupBy("golden", "slice").agg(F.max("candidate").alias("expected"))
    return rank_eval.mrr_by_slice(pool, goldens, CONFIGS)


def ranking_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates' verdict on the registered configurations, as one row."""
    rows = mrr_by_slice(spark, d).collect()
    reasons = rank_eval.gates({(r["slice"], r["config"]): r["mrr"] for r in rows}, "staleness")
    return spark.createDataFrame([(not reasons, len(reasons))], "passed boolean, reasons long")


def noise_band(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("role", F.char_length("text").alias("x"))
    return rank_eval.noise_band(rows, "role", "x", 4)


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.lit(1).alias("all"), (F.col("quality") == 1).alias("passed"), F.col("doc_id").alias("tokens"), (F.col("toxic") == 1).alias("used_graph"))
    return rank_eval.report_summary(rows, "all").drop("all")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as answers with the tools they used."""
    turns = table(spark, d, "conversations")
    tool = F.concat(F.lit("tool"), (F.length("text") % 4).cast("string"))
    return turns.select(F.col("conv_id").cast("string").alias("golden_id"), tool.alias("tool"), (F.length("text") % 5 == 0).alias("is_error"), (F.col("turn") % 2 == 0).alias("passed"), F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("input"), F.length("text").cast("long").alias("output"))


def tool_tally(spark: SparkSession, d: str) -> DataFrame:
    return rank_eval.tool_tally(_answers(spark, d))


def leaked_tools(spark: SparkSession, d: str) -> DataFrame:
    used = _answers(spark, d).groupBy("golden_id").agg(F.collect_set("tool").alias("tools"))
    return rank_eval.leaked_tools(used, ["tool0", "tool1"]).select("golden_id", F.array_join(F.array_sort("leaked"), " ").alias("leaked"))


def failed_answers(spark: SparkSession, d: str) -> DataFrame:
    return rank_eval.failures(_answers(spark, d)).groupBy("golden_id", "reason").agg(F.count("*").alias("n"))


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).groupBy("golden_id").agg(F.sum(rank_eval.token_total("input", "output")).alias("tokens"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a module: a function a line of its text, which is the docstring."""
    line = lambda x, i: F.concat(F.lit("def f"), i.cast("string"), F.lit('():\n    """'), F.regexp_replace(x, "[^A-Za-z0-9 ]", ""), F.lit('"""\n    return helper()\n'))
    body = F.array_join(F.transform(F.split("text", "\n", -1), line), "")
    code = F.concat(F.lit("import os.path\nfrom lib import helper\n\n"), body)
    path = F.concat(F.lit("corpus/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, d, "documents").where("text IS NOT NULL").select(path.alias("path"), F.encode(code, "utf-8").alias("content"))


def parsed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return python_source.nodes_of(python_source.parsed(_sources(spark, d)), "p", 1).select("label", "name", "qualified_name", "file_path", "start_line", "end_line", "doc")


def parsed_edges(spark: SparkSession, d: str) -> DataFrame:
    return python_source.edges_of(python_source.parsed(_sources(spark, d)), "p", 1).select("source", "target", "type")


def deprecation_share(spark: SparkSession, d: str) -> DataFrame:
    rows = symbols(spark, d).select(F.lit("node").alias("kind"), "label", "properties")
    return index_job.deprecation_share(rows)


QUERIES = {f.__name__: f for f in (
    churn, coupling, coupling_sparse, ownership, recency, file_evolution, author_counts, latest_version, exact_distinct, in_degree, trace_callees, trace_callers, reachable, schema_info,
    filter_ci_substring, filter_regex, filter_label, subtoken_jaccard, lexical_binary, json_flag, vector_topk, vector_topk_sound, vector_cells_exact, vector_cells_recall, vector_left_guard, candidate_union, hybrid_search, hybrid_search_page2, search_total,
    semantic_search, rename_expand, snippet, module_names, embedding_texts, density_gate, mrr_by_slice, ranking_gates, noise_band, report_summary, tool_tally, leaked_tools, failed_answers, token_totals,
    parsed_nodes, parsed_edges, deprecation_share,
)}


def _coupling_sql(path: str, support: int) -> str:
    return f"""
WITH pairs AS (
  SELECT a.{path} AS file_a, b.{path} AS file_b, count(*) AS support FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.{path} < b.{path} GROUP BY 1, 2),
t AS (SELECT {path} AS p, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT file_a, file_b, support, round(support / ta.n, 3) AS conf_a_to_b, round(support / tb.n, 3) AS conf_b_to_a
FROM pairs JOIN t ta ON ta.p = file_a JOIN t tb ON tb.p = file_b WHERE support >= {support}"""


_EDGES = """
edges AS (
  SELECT DISTINCT source, target FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS target FROM events) WHERE target IS NOT NULL AND source <> target)"""


def _trace_sql(src: str, dst: str, depth: int) -> str:
    return f"""
WITH RECURSIVE {_EDGES.strip()},
walk(node, path, depth) AS (
  SELECT 'click', ['click'], 0 UNION ALL
  SELECT e.{dst}, list_append(path, e.{dst}), depth + 1 FROM walk JOIN edges e ON e.{src} = node WHERE depth < {depth} AND NOT list_contains(path, e.{dst}))
SELECT node, array_to_string(path, ' > ') AS path, depth FROM walk"""


_TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({s}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^A-Za-z0-9]+'), lambda x: x <> '')"
_SYMBOLS = """
symbols AS (
  SELECT concat_ws('.', p_brand, p_name, p_partkey::VARCHAR) AS qualified_name, p_type AS label, p_name AS name, p_partkey::VARCHAR AS file_path, p_size AS start_line, p_size + 10 AS end_line,
         p_partkey AS key, (p_size % 7 = 0) AS deprecated FROM part)"""


def _lex_sql(query: str) -> str:
    tokens = "[" + ", ".join(f"'{t}'" for t in query.split()) + "]"
    own = _TOKENS.format(s="name")
    return f"greatest(len(list_intersect({own}, {tokens})) / greatest(len(list_distinct(list_concat({own}, {tokens}))), 1), CASE WHEN contains(lower(qualified_name), '{query}') THEN 0.15 ELSE 0.0 END)"


_SIM = "list_cosine_similarity({v}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


def _search_sql(limit: int, offset: int) -> str:
    return f"""
WITH {_SYMBOLS.strip()},
vectors AS (SELECT qualified_name, embedding AS v FROM embeddings JOIN symbols ON vec_id = key),
top AS (SELECT qualified_name FROM (SELECT qualified_name, {_SIM.format(v='v')} AS sim FROM vectors) ORDER BY sim DESC, qualified_name LIMIT 100),
recency AS (SELECT l_partkey::VARCHAR AS path, exp(-ln(2) / 30 * date_diff('day', max(l_shipdate), TIMESTAMP '{LINE_AS_OF}')) AS r FROM lineitem GROUP BY 1),
degree AS (SELECT qualified_name, count(*) AS deg FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN symbols ON l_partkey = key GROUP BY 1),
signals AS (
  SELECT n.qualified_name, label, name, n.file_path, start_line, end_line, round({_lex_sql('red').replace('qualified_name', 'n.qualified_name')}, 3) AS lex,
    round(CASE WHEN v IS NULL THEN 0.0 ELSE {_SIM.format(v='v')} END, 3) AS vec, round(coalesce(r, 0), 3) AS rec,
    round(coalesce(deg, 0) / (SELECT greatest(max(deg), 1) FROM degree), 3) AS cen, deprecated::TINYINT AS dep
  FROM symbols n LEFT JOIN vectors e ON n.qualified_name = e.qualified_name LEFT JOIN recency ON n.file_path = path LEFT JOIN degree d ON n.qualified_name = d.qualified_name
  WHERE contains(lower(name), 'red') OR contains(lower(n.qualified_name), 'red') OR n.qualified_name IN (SELECT qualified_name FROM top))
SELECT *, round(0.35 * lex + 0.3 * vec + 0.2 * rec + 0.15 * cen - 0.2 * dep, 4) AS score FROM signals ORDER BY score DESC, qualified_name LIMIT {limit} OFFSET {offset}"""


_MRR = """
WITH pool AS (SELECT 'q' || (doc_id % 20)::VARCHAR AS golden, CASE WHEN doc_id % 20 < 10 THEN 'general' ELSE 'staleness' END AS slice, doc_id, quality, toxic, doc_id % 7 / 8 AS rec FROM labels),
g AS (SELECT golden, slice, max(doc_id) AS expected FROM pool GROUP BY 1, 2),
configs(config, wl, wr, wd) AS (VALUES ('blind', 0.35::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('hybrid', 0.35::DOUBLE, 0.2::DOUBLE, 0.0::DOUBLE), ('hybrid_dep', 0.35::DOUBLE, 0.2::DOUBLE, -0.2::DOUBLE)),
r AS (SELECT config, golden, doc_id, row_number() OVER (PARTITION BY config, golden ORDER BY wl * quality + wr * rec + wd * toxic DESC, doc_id) AS k FROM pool, configs)
SELECT slice, config, count(*) AS n, round(avg(CASE WHEN k <= 10 THEN 1.0::DOUBLE / k ELSE 0 END), 6) AS mrr FROM g JOIN r ON r.golden = g.golden AND r.doc_id = g.expected GROUP BY 1, 2"""
_ANSWERS = """
a AS (SELECT conv_id::VARCHAR AS golden_id, 'tool' || (length(text) % 4)::VARCHAR AS tool, length(text) % 5 = 0 AS is_error, turn % 2 = 0 AS passed, CASE WHEN turn % 3 > 0 THEN turn ELSE 0 END + length(text) AS tokens FROM conversations)"""
_LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, 'corpus/d' || doc_id::VARCHAR || '.py' AS path, 'corpus.d' || doc_id::VARCHAR AS module, i, line FROM l)"""

SQL = {
    "churn": "SELECT l_partkey AS path, count(*) AS commits, sum(l_quantity + l_linenumber) AS churn, max(l_shipdate) AS last_touched FROM lineitem GROUP BY 1",
    "coupling": _coupling_sql("l_suppkey", 20),
    "coupling_sparse": _coupling_sql("l_partkey", 2),
    "ownership": """
WITH a AS (SELECT user_id AS path, event_type AS author, count(*) AS c FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY c DESC, author) AS k, sum(c) OVER (PARTITION BY path) AS total FROM a)
SELECT path, author AS top_author, round(c / total, 3) AS top_author_share, total::BIGINT AS total_commits FROM k WHERE k = 1""",
    "recency": f"""
SELECT path, last_touched, date_diff('day', last_touched, TIMESTAMP '{LINE_AS_OF}')::INTEGER AS age_days, round(exp(-ln(2) / 30 * date_diff('day', last_touched, TIMESTAMP '{LINE_AS_OF}')), 4) AS recency_score
FROM (SELECT l_partkey AS path, max(l_shipdate) AS last_touched FROM lineitem GROUP BY 1)""",
    "file_evolution": f"""
WITH w AS (SELECT user_id AS path, value, ts, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events),
g AS (SELECT path, count(*) AS commit_count, sum(value) AS churn, max(ts) AS last_commit_at, max(c) AS top FROM w GROUP BY 1),
t AS (SELECT w.path, min(event_type) AS top_author FROM w JOIN g ON w.path = g.path AND w.c = g.top GROUP BY 1)
SELECT path, commit_count, round(churn, 4) AS churn, last_commit_at, top_author, round((top / commit_count)::FLOAT::DOUBLE, 5) AS top_author_share,
  round(exp(-ln(2) / 30 * date_diff('day', last_commit_at, TIMESTAMP '{EVENT_AS_OF}'))::FLOAT::DOUBLE, 5) AS recency_score, 7::BIGINT AS version
FROM g JOIN t USING (path)""",
    "author_counts": "SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS cnt_by_author FROM events",
    "latest_version": """
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
  l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS k FROM lineitem) WHERE k = 1""",
    "exact_distinct": "SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1",
    "in_degree": f"WITH {_EDGES.strip()}, d AS (SELECT target AS node, count(*) AS deg FROM edges GROUP BY 1) SELECT node, deg, round(deg / (SELECT greatest(max(deg), 1) FROM d), 3) AS cen FROM d",
    "trace_callees": _trace_sql("source", "target", 10),
    "trace_callers": _trace_sql("target", "source", 3),
    "reachable": _trace_sql("source", "target", 10).replace("SELECT node, array_to_string(path, ' > ') AS path, depth FROM walk", "SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node"),
    "schema_info": "SELECT DISTINCT 'label' AS kind, p_type AS value FROM part UNION ALL SELECT DISTINCT 'edge_type', event_type FROM events",
    "filter_ci_substring": f"WITH {_SYMBOLS.strip()} SELECT qualified_name, name FROM symbols WHERE contains(lower(name), 'red') OR contains(lower(qualified_name), 'red')",
    "filter_regex": f"WITH {_SYMBOLS.strip()} SELECT qualified_name, name FROM symbols WHERE regexp_matches(name, '^(red|blue) .*t$')",
    "filter_label": f"WITH {_SYMBOLS.strip()} SELECT qualified_name, label FROM symbols WHERE label = 'STANDARD'",
    "subtoken_jaccard": f"WITH {_SYMBOLS.strip()} SELECT qualified_name, array_to_string({_TOKENS.format(s='qualified_name')}, ' ') AS tokens, round({_lex_sql(SEARCH_TEXT)}, 3) AS lex FROM symbols",
    "lexical_binary": f"WITH {_SYMBOLS.strip()} SELECT qualified_name, CASE WHEN contains(lower(name), 'red') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS lex FROM symbols",
    "json_flag": f"WITH {_SYMBOLS.strip()} SELECT qualified_name, deprecated, false AS missing FROM symbols",
    "vector_topk": f"SELECT vec_id, round(sim, 6) AS sim FROM (SELECT vec_id, {_SIM.format(v='embedding')} AS sim FROM embeddings) ORDER BY sim DESC, vec_id LIMIT 100",
    "vector_topk_sound": f"SELECT vec_id, round(sim, 6) AS sim FROM (SELECT vec_id, {_SIM.format(v='embedding')} AS sim FROM embeddings WHERE vec_id % 10 NOT IN (3, 4, 5, 6)) ORDER BY sim DESC, vec_id LIMIT 100",
    "vector_cells_exact": f"SELECT vec_id, round(sim, 5) AS sim FROM (SELECT vec_id, {_SIM.format(v='embedding')} AS sim FROM embeddings WHERE vec_id % 10 NOT IN (3, 4, 5, 6)) ORDER BY sim DESC, vec_id LIMIT 100",
    "vector_cells_recall": "SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) FROM embeddings WHERE vec_id % 10 NOT IN (3, 4, 5, 6)))::BIGINT AS neighbours, true AS recalled FROM embeddings WHERE vec_id % 100 = 0",
    "vector_left_guard": f"WITH {_SYMBOLS.strip()} SELECT qualified_name, round(CASE WHEN embedding IS NULL THEN 0.0 ELSE {_SIM.format(v='embedding')} END, 6) AS vec FROM symbols LEFT JOIN embeddings ON vec_id = key",
    "candidate_union": f"""
WITH {_SYMBOLS.strip()},
top AS (SELECT qualified_name FROM (SELECT qualified_name, {_SIM.format(v='embedding')} AS sim FROM embeddings JOIN symbols ON vec_id = key) ORDER BY sim DESC, qualified_name LIMIT 100)
SELECT qualified_name FROM symbols WHERE contains(lower(name), '{SEARCH_TEXT}') OR contains(lower(qualified_name), '{SEARCH_TEXT}') OR qualified_name IN (SELECT qualified_name FROM top)""",
    "hybrid_search": _search_sql(20, 0),
    "hybrid_search_page2": _search_sql(20, 20),
    "search_total": f"""
WITH {_SYMBOLS.strip()},
top AS (SELECT qualified_name FROM (SELECT qualified_name, {_SIM.format(v='embedding')} AS sim FROM embeddings JOIN symbols ON vec_id = key) ORDER BY sim DESC, qualified_name LIMIT 100),
t AS (SELECT count(*) AS total FROM symbols WHERE contains(lower(name), 'red') OR contains(lower(qualified_name), 'red') OR qualified_name IN (SELECT qualified_name FROM top))
SELECT f.first::BIGINT AS first, greatest(0, least(30, total - f.first))::BIGINT AS n, total, f.first + greatest(0, least(30, total - f.first)) < total AS has_more FROM t, (VALUES (0), (40), (1000000)) f(first)""",
    "semantic_search": "SELECT p_name AS qualified_name, 1.0::DOUBLE AS sim FROM part WHERE lower(p_name) = 'red widget' GROUP BY 1",
    "rename_expand": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace('src//' || u, '//', '/') WHEN 1 THEN 'old/' || u END AS old_path,
  CASE page_id % 3 WHEN 0 THEN replace('src/core/' || u, '//', '/') WHEN 1 THEN 'new/' || u ELSE u END AS path FROM p""",
    "snippet": "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents",
    "module_names": r"SELECT page_id, replace('src/' || regexp_replace(url, '^[a-z]+://', ''), '/', '.') AS module FROM pages",
    "embedding_texts": f"WITH {_SYMBOLS.strip()} SELECT qualified_name, trim(array_to_string({_TOKENS.format(s='qualified_name')}, ' ') || '. ' || CASE WHEN start_line % 2 = 0 THEN label ELSE '' END) AS text FROM symbols",
    "density_gate": """
SELECT source, docs, round(docs / greatest(lines / 1000, 0.001), 6) AS density, docs / greatest(lines / 1000, 0.001) < 100 AS degraded
FROM (SELECT source, count(*) AS docs, sum(len(string_split(text, chr(10)))) AS lines FROM documents GROUP BY 1)""",
    "mrr_by_slice": _MRR,
    "ranking_gates": f"""
WITH m AS ({_MRR}),
w AS (SELECT b.slice, n.mrr - b.mrr AS gain FROM m b JOIN m n ON b.slice = n.slice WHERE b.config = 'blind' AND n.config = 'hybrid'),
bad AS (SELECT count_if(CASE WHEN slice = 'staleness' THEN gain < 0.1 ELSE -gain > 0.02 END)::BIGINT AS reasons FROM w)
SELECT reasons = 0 AS passed, reasons FROM bad""",
    "noise_band": "SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean, min(length(text))::DOUBLE AS min, max(length(text))::DOUBLE AS max, round(coalesce(stddev_samp(length(text)), 0), 4) AS stdev FROM conversations GROUP BY 1",
    "report_summary": """
SELECT count(*) AS n, count_if(quality = 1)::BIGINT AS passed, round(count_if(quality = 1) / count(*), 6) AS quality, sum(doc_id)::BIGINT AS tokens_total, round(sum(doc_id) / count(*), 4) AS tokens_mean, round(count_if(toxic = 1) / count(*), 6) AS graph_adoption FROM labels""",
    "tool_tally": f"WITH {_ANSWERS.strip()} SELECT golden_id, tool, count(*) AS n FROM a GROUP BY 1, 2",
    "leaked_tools": f"WITH {_ANSWERS.strip()} SELECT golden_id, string_agg(DISTINCT tool, ' ' ORDER BY tool) AS leaked FROM a WHERE tool NOT IN ('tool0', 'tool1') GROUP BY 1",
    "failed_answers": f"WITH {_ANSWERS.strip()} SELECT golden_id, CASE WHEN is_error THEN 'agent_error' ELSE 'judge_fail' END AS reason, count(*) AS n FROM a WHERE is_error OR NOT passed GROUP BY 1, 2",
    "token_totals": f"WITH {_ANSWERS.strip()} SELECT golden_id, sum(tokens)::BIGINT AS tokens FROM a GROUP BY 1",
    "parsed_nodes": f"""
WITH {_LINES.strip()}
SELECT 'Function' AS label, 'f' || i::VARCHAR AS name, module || '.f' || i::VARCHAR AS qualified_name, path AS file_path, (4 + 3 * i)::INTEGER AS start_line, (6 + 3 * i)::INTEGER AS end_line,
  substr(trim(regexp_replace(line, '[^A-Za-z0-9 ]', '', 'g')), 1, 200) AS doc FROM n
UNION ALL SELECT 'File', 'd' || doc_id::VARCHAR || '.py', path, path, 1, (4 + 3 * count(*))::INTEGER, '' FROM n GROUP BY doc_id, path""",
    "parsed_edges": f"""
WITH {_LINES.strip()}
SELECT path AS source, module || '.f' || i::VARCHAR AS target, 'DEFINES' AS type FROM n
UNION ALL SELECT module || '.f' || i::VARCHAR, 'lib.helper', 'CALLS' FROM n
UNION ALL SELECT DISTINCT path, t.x, 'IMPORTS' FROM n, (VALUES ('os.path'), ('lib.helper')) t(x)""",
    "deprecation_share": f"WITH {_SYMBOLS.strip()} SELECT count(*) AS symbols, count_if(deprecated)::BIGINT AS flagged, round(100 * count_if(deprecated) / count(*), 4) AS percent FROM symbols",
}
