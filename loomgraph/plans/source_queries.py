"""Registered queries over sources made from the tables, with damage and with names that go
through several files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.sources import python_source
from loomgraph.sources.shared import written


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a class with a method a line, whose text is its description. Of three methods
    one is sound, one has a head and one a body that is cut off."""
    text = F.translate(F.coalesce("text", F.lit("")), '"\\\r\f\0', "'/   ")
    head = lambda i: F.when(i % 3 == 1, "(self, x:\n").otherwise("(self):\n")
    end = lambda i: F.when(i % 3 == 2, "(\n").otherwise("()\n")
    method = lambda x, i: F.concat(F.lit("    def m"), i.cast("string"), head(i), F.lit('        """'), x, F.lit('"""\n        return helper'), end(i))
    code = F.concat(F.lit("from lib import helper\nclass C:\n"), F.array_join(F.transform(F.split(text, "\n", -1), method), ""))
    path = F.concat(F.lit("corpus/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    return spark.read.parquet(f"{d}/documents.parquet").select(path.alias("path"), F.encode(code, "utf-8").alias("content"))


def damaged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and calls of the damaged sources."""
    rows = python_source.parsed(_damaged(spark, d)).where("(kind = 'node' AND label <> 'File') OR label = 'CALLS'")
    squeezed = F.trim(F.regexp_replace("doc", r"[^\x21-\x7E]+", " "))
    return rows.select("label", F.coalesce("qualified_name", "source").alias("symbol"), "target", "start_line", "end_line", squeezed.alias("doc"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a module. Every fifth defines a function, and the others import it from the module
    before under a name of their own or, some, with all it has; some bind the name to something
    else after that. Each calls what it has imported."""
    k = F.col("p_partkey").cast("long")
    star = (k % 7 == 3) & (k % 5 != 0)
    before = F.when((k - 1) % 7 == 3, F.when((k - 1) % 5 != 0, k - 2).otherwise(k - 1)).otherwise(k - 1)  # the name that the module before has
    s = lambda x: x.cast("string")
    own = F.concat(F.lit("def g"), s(k), F.lit("():\n    return 0\n"))
    renamed = F.concat(F.lit("from .m"), s(k - 1), F.lit(" import g"), s(before), F.lit(" as g"), s(k), F.when(k % 11 == 4, F.concat(F.lit("\ng"), s(k), F.lit(" = None"))).otherwise(""), F.lit("\ndef c"), s(k), F.lit("():\n    return g"), s(k), F.lit("()\n"))
    all_ = F.concat(F.lit("from .m"), s(k - 1), F.lit(" import *\ndef c"), s(k), F.lit("():\n    return g"), s(k - 1), F.lit("()\n"))
    code = F.when(k % 5 == 0, own).when(star, all_).otherwise(renamed)
    return spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("pkg/m"), s(k), F.lit(".py")).alias("path"), F.encode(code, "utf-8").alias("content"))


def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Calls from each module to the definition that is meant, through as many modules as it takes."""
    return resolve.resolved_calls(written(python_source.parsed(_linked(spark, d)), "parsed"))


QUERIES = {f.__name__: f for f in (damaged_sources, resolved_names)}

SQL = {
    "damaged_sources": r"""
WITH l AS (SELECT doc_id, unnest(string_split(translate(coalesce(text, ''), '"\' || chr(13) || chr(12), '''/  '), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT 'corpus.d' || doc_id::VARCHAR || '.C' AS c, i, c || '.m' || i::VARCHAR AS symbol, line FROM l)
SELECT 'Class' AS label, c AS symbol, NULL AS target, 2 AS start_line, (2 + 3 * count(*))::INTEGER AS end_line, '' AS doc FROM m GROUP BY c
UNION ALL SELECT 'Function', symbol, NULL, (3 + 3 * i)::INTEGER, (5 + 3 * i)::INTEGER, trim(regexp_replace(substr(trim(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), 1, 200), '[^\x21-\x7E]+', ' ', 'g')) FROM m WHERE i % 3 <> 1
UNION ALL SELECT 'CALLS', symbol, 'lib.helper', NULL, NULL, NULL FROM m WHERE i % 3 = 0""",
    "resolved_names": """
WITH RECURSIVE p AS (SELECT p_partkey::BIGINT AS k, k % 5 = 0 AS defines, k % 7 = 3 AND k % 5 <> 0 AS star, k % 11 = 4 AND NOT (k % 7 = 3) AND k % 5 <> 0 AS hides FROM part),
walk(k, j) AS (
  SELECT k, k - 1 FROM p WHERE NOT defines AND NOT hides
  UNION ALL SELECT walk.k, walk.j - 1 FROM walk JOIN p ON p.k = walk.j WHERE NOT p.defines AND NOT p.hides)
SELECT 'pkg.m' || walk.k::VARCHAR || '.c' || walk.k::VARCHAR AS source, 'pkg.m' || walk.j::VARCHAR || '.g' || walk.j::VARCHAR AS target FROM walk JOIN p ON p.k = walk.j WHERE p.defines""",
}
