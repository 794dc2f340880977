"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets: a source's share is level * weight, but no more than its cap (epochs times
its size).  The level is found by clamping: sources above their caps are set to the
caps, what they leave is shared among the others by weight, until none is above.
Each round is one aggregation over a row a source; the driver gets three numbers.

Repetitions: target / size gives whole epochs and a fraction.  The fraction is a
prefix of the source's documents in a seeded order, cut where it comes nearest to
the words still due.  The order is that of a hash's leading bits, and buckets are equal
ranges of it: with about sqrt(n) buckets in a source of n documents, the running sums
are windows over sqrt(n) buckets and over the sqrt(n) documents of the one bucket that
is cut, so a source that holds a third of all rows needs no task that holds a third of
all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import own_names, plain_columns, sized, tagged, words, written


#: Bits of the hash that orders a source's documents.
ORDER_BITS = 52


@dataclass(frozen=True)
class Mix:
    """weights: dealt to the sources in code point order, repeating. epochs: how often
    a document may be taken at most. share: of all words, what the mix takes."""

    weights: tuple[float, ...] = (1, 2, 3)
    epochs: int = 3
    share: float = 1.0
    seed: int = 20240


def ranked(df: DataFrame, by: Column, name: str) -> DataFrame:
    """df with a 0-based rank in the order of `by`, null last, without one task for all:
    sorted ranges are written, then numbered by the ranges' counts."""
    parts = written(df.orderBy(by.asc_nulls_last()).withColumn("_part", F.spark_partition_id()), name)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by.asc_nulls_last())) - 1
    return parts.withColumn("_in", inside).join(before, "_part").withColumn("rank", (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def water_fill(sources: DataFrame, total: float, epochs: int) -> DataFrame:
    """sources (weight, source_size) with target: min(level * weight, cap)."""
    cap, weight = F.col("source_size") * float(epochs), F.col("weight")
    level = 0.0
    while True:
        # caps at or below the level are clamped; what they leave goes to the others
        full = cap <= weight * level if level else F.lit(False)
        row = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(weight)).alias("free")).first()
        if not row["free"]:
            break
        up = (total - row["used"]) / row["free"]
        if up <= level * (1 + 1e-12):  # sums of doubles may differ in the last place
            break
        level = up
    return sources.withColumn("target", F.least(cap, weight * level) if level else F.lit(0.0))


def mix(docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, source, text_hash, size, source_size, target, repeats, taken.

    Size: the words of the text; null and empty texts have 0 and are never worth a
    repetition of more than 0 words. A null source is a source, the last one. Equal rows
    are documents of their own; which of them the fraction takes makes no difference.
    An empty table gives no rows. Other columns of docs are not read.
    """
    # ORDER_BITS of a hash that any database has, so that the mix can be checked by SQL
    name = F.concat_ws("/", F.lit(str(how.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    order = F.conv(F.substring(F.md5(name), 1, ORDER_BITS // 4), 16, 10).cast("long")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    sizes = written(sizes.withColumn("order", order), "sizes")
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), F.col("source"), "sources")
    weights = F.array(*[F.lit(float(w)) for w in how.weights])
    sources = written(sources.withColumn("weight", F.get(weights, (F.col("rank") % len(how.weights)).cast("int"))), "weights")
    total = (sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * how.share
    sources = water_fill(sources, total, how.epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = written(
        sources.withColumn("whole", F.least(whole, F.lit(how.epochs)))
        .withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.sqrt("docs")).cast("long"))
        .select(tagged(F.col("source")).alias("key"), "source_size", "target", "whole", "due", "buckets"), "targets",
    )
    rows = sizes.withColumn("key", tagged(F.col("source"))).join(sources, "key").withColumn("bucket", F.floor(F.col("order") / (1 << ORDER_BITS) * F.col("buckets")).cast("long"))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", "words", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"))
    at = rows.join(sums, ["key", "bucket"])
    inside = (F.col("before") + F.col("words") > F.col("due")) & (F.col("before") < F.col("due"))
    cut = at.where(inside)
    run = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("extra", (F.col("before") + F.sum("size").over(run) - F.col("size") / 2 <= F.col("due")).cast("long"))
    rest = at.where(~inside).withColumn("extra", (F.col("before") + F.col("words") <= F.col("due")).cast("long"))
    return (
        rest.unionByName(cut)
        .withColumn("repeats", F.least(F.col("whole") + F.when(F.col("due") > 0, F.col("extra")).otherwise(0), F.lit(how.epochs).cast("long")))
        .withColumn("taken", F.col("size") * F.col("repeats"))
        .select("doc_id", "source", "text_hash", "size", "source_size", "target", "repeats", "taken")
    )


@plain_columns
def mixed(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, columns unchanged.

    Null and empty texts have size 0; they are taken as their order falls and add no words.
    Equal rows share what the mix takes of them. A null source is a source. Columns of docs may
    have any names. An empty table gives no rows."""
    doc_id, key, text, least, total, n, times, each = own_names(docs, *[f"mix_{c}" for c in ("doc_id", "key", "text", "least", "sum", "n", "times", "each")])
    plan = mix(docs, how).groupBy(F.col("doc_id").alias(doc_id), tagged(F.col("source")).alias(key), F.col("text_hash").alias(text)).agg(F.min("repeats").alias(least), F.sum("repeats").alias(total), F.count("*").alias(n))
    plan = sized(written(plan, "repeats"))
    mine = docs["doc_id"].eqNullSafe(plan[doc_id]) & (tagged(docs["source"]) == plan[key]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == plan[text])
    both = docs.join(plan, mine)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # equal rows share what the mix takes of them: the first few of them one more than the others
    one = both.where(F.col(n) == 1).select(*columns, F.col(total).alias(times))
    same = Window.partitionBy(doc_id, key, text).orderBy(F.lit(1))
    extra = (F.row_number().over(same) <= F.col(total) - F.col(least) * F.col(n)).cast("long")
    many = both.where(F.col(n) > 1).select(*columns, (F.col(least) + extra).alias(times))
    out = one.unionByName(many).where(F.col(times) > 0)
    return out.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*columns)
