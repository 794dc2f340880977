"""Quality rules: cross-document line frequency, in DataFrame functions only.

One pass over the texts yields, for each document, its counts and an array of
(hash of the normalised line, words in it).  Everything after works on that
narrow table:

1. documents with equal texts in a host count once;
2. (host, line) pairs are counted with map-side combining, so a line that a third
   of all documents hold costs one row a task;
3. lines above the limits are joined back; Spark broadcasts them if they are few
   and splits skewed partitions if they aren't;
4. a document that loses too large a part of its words is depleted: rejected.

A line above the limits stays in the document with the smallest id that holds it:
of all documents in the verdicts of op1_quality, as its SQL has it; of those that are
kept in `clean`, where a rejected holder hands its lines on to the next one, so the
content of a group of copies never vanishes as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE, own_names, plain_columns, sized, tagged, words, written


@dataclass(frozen=True)
class LineLimits:
    """min_docs: lines in fewer distinct documents of a host are never removed. max_percent:
    of the host's distinct documents; lines in more are removed, so that a line's fate is the
    same in small hosts and large ones. depleted_percent: a document that loses more of its
    words than this is rejected."""

    min_docs: int = 5
    max_percent: float = 1.0
    depleted_percent: int = 30
    min_words: int = 20
    repeat_percent: int = 30


def _normalised(line):
    """Lower case, digits to 0, single spaces, no space at the ends."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"[0-9]+", "0"), SPACE, " ")))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts of each document and its lines as (h, w): hash and words.

    Null and empty texts have no words and no lines.
    """
    has_word = r"[^\x20\x09-\x0D]"
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(
        F.col(id_col).alias("doc_id"), tagged(F.col(host_col)).alias("host"), F.xxhash64(text).alias("text_hash"), text.alias("text"), words(F.col(text_col)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(has_word)).alias("lines"),
    )
    step = step.select(
        "doc_id", "host", "text_hash",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(_normalised(x)).alias("h"), F.size(F.array_remove(F.split(x, SPACE), "")).alias("w"))).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("word_hash"),
    )
    # an array that a lambda indexes is a column of its own, used twice, so that it is computed once a row
    step = step.withColumn("windows", F.when(F.size("word_hash") >= 8, F.transform(F.slice("word_hash", F.lit(1), F.size("word_hash") - 7), lambda x, i: F.xxhash64(F.slice(F.col("word_hash"), i + 1, 8)))).otherwise(F.array().cast("array<bigint>"))).drop("word_hash")
    step = step.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    again = F.filter("sorted", lambda x, i: (F.get(F.col("sorted"), i - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), i + 1)["h"] == x["h"]))
    at = F.array_sort(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(8), p - a["last"])).alias("n")), lambda a: a["n"],
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("sorted")


def common_lines(feats: DataFrame, limits: LineLimits) -> DataFrame:
    """Lines above the limits: host, h, docs, first_doc (who keeps it)."""
    texts = feats.groupBy("host", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.any_value("lines").alias("lines"))
    sizes = feats.groupBy("host").agg(F.count_distinct("text_hash").alias("host_docs"))
    lines = (
        texts.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        .groupBy("host", "h").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
        .where(F.col("docs") >= limits.min_docs)
    )
    above = F.col("docs") * 100 > F.col("host_docs") * limits.max_percent
    return lines.join(sizes, "host").where(above).select("host", "h", "docs", "first_doc")


def _failed(limits: LineLimits):
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))


def handed_on(hits: DataFrame, limits: LineLimits) -> DataFrame:
    """host, h, first_doc: the smallest id among the kept documents that hold the line.

    hits: doc_id, host, text_hash, n_words, h, w of the lines above the limits in documents
    that pass the base rules. In the order of ids a document is kept unless it loses too
    many words to lines that kept ones before it hold. That is settled in rounds for all
    documents at once: kept is who stays even if all open documents before it are kept,
    rejected who goes by those that are kept for certain; the first open one always is
    settled, and only open ones come back."""
    key = ["doc_id", "host", "text_hash"]
    lines = None
    while True:
        mins = hits.groupBy("host", "h").agg(F.min("doc_id").alias("p"))
        mins = mins.withColumn("k", F.lit(None).cast(hits.schema["doc_id"].dataType)) if lines is None else mins.join(lines.withColumnRenamed("first_doc", "k"), ["host", "h"], "left")
        first = F.least("p", "k")
        losable = F.when(first.isNotNull() & ~first.eqNullSafe(F.col("doc_id")), F.col("w")).otherwise(0)
        gone = F.when(F.col("k").isNotNull() & (F.col("doc_id").isNull() | (F.col("k") < F.col("doc_id"))), F.col("w")).otherwise(0)
        sums = hits.join(mins, ["host", "h"]).groupBy(*key, "n_words").agg(F.sum(losable).alias("losable"), F.sum(gone).alias("gone"))
        bound = limits.depleted_percent * F.col("n_words")
        state = F.when(100 * F.col("losable") <= bound, "kept").when(100 * F.col("gone") > bound, "rejected").otherwise("open")
        states = written(sums.select(*[F.col(c).alias(f"_{c}") for c in key], state.alias("state")).where("state <> 'rejected'"), "states")
        rest = hits.join(states, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).select(*hits.columns, "state")
        new = rest.where("state = 'kept'").groupBy("host", "h").agg(F.min("doc_id").alias("first_doc"))
        lines = written(new if lines is None else lines.unionByName(new).groupBy("host", "h").agg(F.min("first_doc").alias("first_doc")), "holders")
        if states.where("state = 'open'").isEmpty():
            return lines
        hits = written(rest.where("state = 'open'").drop("state"), "open")


def line_frequency_rules(docs: DataFrame, limits: LineLimits = LineLimits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", hand_on: bool = False) -> DataFrame:
    """Verdict of each document: counts, removed_words, removed_lines (hashes),
    base_failed, depleted, kept.

    Host: host_col; null is a host of its own. Each input row gives one row: equal
    rows get equal verdicts, rows that share an id but not a text are judged apart. A
    document without words fails the base rule. A null id is an id like others, except
    that it never is the first holder. hand_on: the first holder of a line is the first
    kept one instead of the first of all. Columns of docs other than the three named play
    no part, so their names can't clash.
    """
    feats = written(features(docs, id_col, text_col, host_col), "quality")
    hot = written(common_lines(feats, limits), "lines")
    key = ["doc_id", "host", "text_hash"]
    each = feats.groupBy(*key).agg(F.any_value("lines").alias("lines"))
    if hand_on:
        passing = feats.where(~_failed(limits)).groupBy(*key, "n_words").agg(F.any_value("lines").alias("lines"))
        passing = passing.select(*key, "n_words", F.explode("lines").alias("line")).select(*key, "n_words", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
        hot = handed_on(written(passing.join(hot.select("host", "h"), ["host", "h"]).select(*key, "n_words", "h", "w"), "hits"), limits)
    hits = each.select(*key, F.explode("lines").alias("line")).select(*key, F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    lost = (
        hits.join(hot.select("host", "h", "first_doc"), ["host", "h"])
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.sum("w").alias("removed_words"), F.collect_set("h").alias("removed_lines"))
    )
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    out = feats.drop("lines").join(lost, on, "left").select(
        *key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
    )
    failed = _failed(limits)
    depleted = 100 * F.col("removed_words") > limits.depleted_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("depleted", depleted).withColumn("kept", ~failed & ~depleted)


@plain_columns
def clean(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that stay, without their removed lines; the columns of docs, of which a
    column n_chars follows the new text.

    Documents without words (null, empty and white texts) fail the base rule and go. Repeated
    rows stay or go together. A null source is a host of its own. Columns of docs may have any
    names. An empty table gives no rows."""
    verdict = line_frequency_rules(docs, limits, hand_on=True)
    # only documents that go or change are looked up; the others need no verdict
    acts = verdict.where(~F.col("kept") | (F.size("removed_lines") > 0)).select("doc_id", "host", "text_hash", "kept", "removed_lines").distinct()
    names = dict(zip(acts.columns, own_names(docs, *[f"act_{c}" for c in acts.columns]), strict=True))
    acts = written(acts.select(*[F.col(c).alias(n) for c, n in names.items()]), "acts")
    acts = sized(acts, 200_000, 1 + F.size(names["removed_lines"]) / 4)
    doc_id, host, text_hash, kept, removed = (acts[n] for n in names.values())
    mine = docs["doc_id"].eqNullSafe(doc_id) & (tagged(docs["source"]) == host) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == text_hash)
    both = docs.join(acts, mine, "left").where(F.coalesce(kept, F.lit(True)))
    left = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x: ~F.array_contains(removed, F.xxhash64(_normalised(x)))), "\n")
    text = F.when(F.size(removed) > 0, left).otherwise(docs["text"])
    put = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.char_length(text).cast("long").alias("n_chars")
    return both.select(*[put.get(c, docs[c]) for c in docs.columns])
