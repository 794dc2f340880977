"""As-of join: for each row the last row of the other side that isn't later.

Rows of both sides are dealt by ranges of key and time, so that a key with very many rows
lies in many ranges.  Each range is filled forward by itself; what a range begins with, the
last row of its key in the ranges before, comes from a table of one row a range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.shared import written


def asof_join(left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], at: tuple[Column, Column], tie: list[Column] | None = None, parts: int | None = None) -> DataFrame:
    """left with a column `match`: the whole row of right (a struct) with equal keys and the greatest
    time that isn't beyond the left one's, null without one.

    keys: for each a name and its expression on both sides. at: the times, of any type that
    orders, structs too. tie: of right rows with equal times the last in this order counts;
    without it one of them. A null key or time matches nothing. parts: ranges; None: as many as
    shuffle partitions."""
    spark = left.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = tie or [F.lit(0)]
    names, ties = [f"key_{k}" for k in keys], [f"tie_{k}" for k in range(len(tie))]
    mine = left.select(*[a.alias(n) for n, (a, _) in zip(names, keys.values(), strict=True)], at[0].alias("at"), F.lit(1).alias("side"), F.struct("*").alias("own"))
    theirs = right.select(*[b.alias(n) for n, (_, b) in zip(names, keys.values(), strict=True)], at[1].alias("at"), F.lit(0).alias("side"), *[t.alias(n) for t, n in zip(tie, ties, strict=True)], F.struct("*").alias("match"))
    theirs = theirs.dropna(subset=[*names, "at"])
    # rows with equal keys and times can lie in several ranges: of the left side all are alike
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranges = both.repartitionByRange(parts, *names, "at", "side", *ties, "salt")
    dealt = written(ranges.drop("salt").withColumn("part", F.spark_partition_id()), "ranges")
    time = F.struct("at", *ties)
    ends = dealt.groupBy("part", *names).agg(F.max_by(F.when(F.col("side") == 0, F.col("match")), F.when(F.col("side") == 0, time)).alias("end"))
    upto = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(upto)).where("carried IS NOT NULL").select(F.col("part").alias("of_part"), *[F.col(n).alias(f"of_{n}") for n in names], "carried")
    here = Window.partitionBy("part", *names).orderBy("at", "side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("filled", F.last("match", ignorenulls=True).over(here)).where("side = 1")
    same = F.col("part") == F.col("of_part")
    for n in names:
        same = same & (F.col(n) == F.col(f"of_{n}"))
    known = F.col("at").isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    return filled.join(carried, same, "left").select("own.*", F.when(known, F.coalesce("filled", "carried")).alias("match"))
