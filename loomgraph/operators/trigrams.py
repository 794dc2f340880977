"""Substrings and patterns in names by postings of trigrams.

Every three characters of a lower-cased name are a gram, and the index holds, by gram, the
numbers of the names with it, in folders of gram hashes and sorted by gram within.  A search
reads the postings of a few of its grams, the rarest, and checks the names that have all of
these.  What is too short or too free to require a gram is checked against all names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.expr import contains_ci, matches
from loomgraph.sources.shared import written

#: Folders of grams, and grams of a search that are read.
FOLDERS, READ = 64, 4
_QUANTIFIER = re.compile(r"[*+?]|\{(\d*),?(\d*)\}")


def grams(text: str) -> list[str]:
    """The distinct grams of a text."""
    low = text.lower()
    return sorted({low[k : k + 3] for k in range(len(low) - 2)})


def required_runs(pattern: str) -> list[str]:
    """Literal runs that whatever matches the pattern holds; none where that isn't plain to see.
    Groups, classes and escapes of kinds end a run; what may be absent is no part of one."""
    runs, run, depth, k = [], "", 0, 0
    if "(?" in pattern.replace("(?:", "").replace("(?i)", "") or "\\Q" in pattern:
        return []
    while k < len(pattern):
        c, literal = pattern[k], None
        k += 1
        if c == "\\" and k < len(pattern):
            literal = pattern[k] if not pattern[k].isalnum() else None
            k += 1
        elif c == "[":
            k += 1 if pattern[k : k + 1] == "^" else 0
            k += 1 if pattern[k : k + 1] == "]" else 0
            nested = 1
            while k < len(pattern) and nested:
                nested += {"[": 1, "]": -1}.get(pattern[k], 0)
                k += 2 if pattern[k] == "\\" else 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            return []
        elif c not in ".^$*+?{}|" and depth == 0:
            literal = c
        quantified = _QUANTIFIER.match(pattern, k)
        if literal is not None and depth == 0 and literal.isascii():
            absent = quantified and (quantified[0] in "*?" or quantified[0].startswith(("{0", "{,")))
            if not absent:
                run += literal
            if quantified:
                runs.append(run)
                # what is repeated begins the next run as well, where it comes last
                run = "" if absent else literal
        else:
            runs.append(run)
            run = ""
        if quantified and c not in "({":
            k = quantified.end()
            if pattern[k : k + 1] in ("?", "+"):
                k += 1
    return [r for r in [*runs, run] if len(r) >= 3]


class TrigramIndex:
    """Postings of the names of a table, in a folder that build() has written to."""

    def __init__(self, spark: SparkSession, place: str, column: str):
        self.spark, self.place, self.column = spark, place, column
        self.names = spark.read.parquet(f"{place}/names")
        self.postings = spark.read.parquet(f"{place}/postings")
        self.counts = spark.read.parquet(f"{place}/counts")

    @classmethod
    def build(cls, rows: DataFrame, place: str, column: str) -> TrigramIndex:
        """Indexes the rows by a string column. Rows with a null there match nothing and are kept out."""
        rows.where(F.col(column).isNotNull()).withColumn("row_number", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{place}/names")
        names = rows.sparkSession.read.parquet(f"{place}/names")
        low = F.lower(column)
        each = F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda k: F.substring(low, k, F.lit(3)))
        pairs = names.where(F.char_length(low) >= 3).select("row_number", F.explode(F.array_distinct(each)).alias("gram"))
        pairs = pairs.withColumn("folder", F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int"))
        # a gram that very many names have is dealt to several tasks
        pairs.repartition(F.col("folder"), F.pmod("row_number", F.lit(8))).sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{place}/postings")
        rows.sparkSession.read.parquet(f"{place}/postings").groupBy("folder", "gram").agg(F.count("*").alias("n")).repartition("folder").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{place}/counts")
        return cls(rows.sparkSession, place, column)

    def _of(self, table: DataFrame, wanted: list[str]) -> DataFrame:
        folders = [r["f"] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int").alias("f")).distinct().collect()]
        return table.where(F.col("folder").isin(folders) & F.col("gram").isin(wanted))

    def having(self, wanted: list[str]) -> DataFrame | None:
        """The rows whose names have all grams that are read; None if there is none to read."""
        if not wanted:
            return None
        found = {r["gram"]: r["n"] for r in self._of(self.counts, wanted).select("gram", "n").collect()}  # a row a gram
        if any(g not in found for g in wanted):
            return self.names.limit(0)
        rarest = sorted(wanted, key=lambda g: (found[g], g))[:READ]
        hits = self._of(self.postings, rarest).groupBy("row_number").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest))
        return self.names.join(hits.select("row_number"), "row_number", "left_semi")

    def containing(self, literal: str) -> DataFrame:
        """The rows whose name contains the literal, in any case."""
        found = self.having(grams(literal) if literal.isascii() else [])
        found = self.names if found is None else found
        return found.where(contains_ci(F.col(self.column), literal)).drop("row_number")

    def matching(self, pattern: str) -> DataFrame:
        """The rows whose name matches the pattern somewhere."""
        found = self.having(sorted({g for r in required_runs(pattern) for g in grams(r)}))
        found = self.names if found is None else found
        return found.where(matches(F.col(self.column), pattern)).drop("row_number")


def index_of(rows: DataFrame, place: str, column: str) -> TrigramIndex:
    return TrigramIndex.build(written(rows, "named"), place, column)
