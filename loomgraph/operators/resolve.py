"""Names across files: which definition a call through imports means.

A place is a name of a module.  A place that is no definition leads on to the place that
an import binds it to, or, where the module doesn't bind it, to the same name of each module
that it imports all of.  Calls ask for places; the places that they lead to are found by
joins of those new in the round before, so that only what is asked for is looked at.  Then
definitions are handed back along the same steps until nothing changes.  A place where two
definitions arrive is ambiguous and resolves to none, as does one on a cycle that no
definition is on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import written

PLACE = ["module", "name"]


def _places(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select(F.col("qualified_name").alias("module"), "name").distinct()


def definitions(rows: DataFrame) -> DataFrame:
    """module, name, qualified_name of what modules define themselves; of several of one name in one
    module, all are one."""
    module = F.substring_index("qualified_name", ".", -1)
    own = F.expr("left(qualified_name, length(qualified_name) - length(name) - 1)")
    file_module = F.replace(F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))
    found = rows.where("kind = 'node' AND label <> 'File'").where(module == F.col("name")).where(own == file_module)
    return found.select(own.alias("module"), "name", "qualified_name").distinct()


def steps(rows: DataFrame, asked: DataFrame, defined: DataFrame) -> DataFrame:
    """module, name, to_module, to_name: where the asked places, and those they lead to, lead on."""
    aliases = rows.where("kind = 'alias' AND name <> '*'").select(F.col("qualified_name").alias("module"), "name", F.col("label").alias("to_module"), F.col("target").alias("to_name"))
    stars = rows.where("kind = 'alias' AND name = '*'").select(F.col("qualified_name").alias("module"), F.col("label").alias("to_module")).distinct()
    public, bound = _places(rows, "all"), _places(rows, "bound")
    lists = public.select(F.col("module").alias("to_module"), F.lit(True).alias("listed")).distinct()
    named = public.select(F.col("module").alias("to_module"), F.col("name"), F.lit(True).alias("public"))
    aliases, stars, bound = written(aliases, "aliases"), written(stars, "stars"), written(bound, "bound")
    seen = new = written(asked.select(*PLACE).distinct(), "places")
    out = None
    while not new.isEmpty():
        open_ = new.join(defined, PLACE, "left_anti").join(bound, PLACE, "left_anti")
        by_name = open_.join(aliases, PLACE)
        rest = open_.join(aliases, PLACE, "left_anti").join(stars, "module")
        # a list of public names says what a star takes; without one it is the names without an underscore
        rest = rest.join(lists, "to_module", "left").join(named, ["to_module", "name"], "left")
        rest = rest.where(F.when(F.col("listed"), F.coalesce("public", F.lit(False))).otherwise(~F.startswith("name", F.lit("_"))))
        found = written(by_name.select(*PLACE, "to_module", "to_name").union(rest.select(*PLACE, "to_module", F.col("name").alias("to_name"))), "steps")
        out = found if out is None else out.union(found)
        new = written(found.select(F.col("to_module").alias("module"), F.col("to_name").alias("name")).distinct().join(seen, PLACE, "left_anti"), "places")
        seen = seen.union(new)
    return out if out is not None else written(asked.select(*PLACE, F.col("module").alias("to_module"), F.col("name").alias("to_name")).limit(0), "steps")


def resolved(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """module, name, qualified_name of the asked places (module, name) that one definition is meant by.
    rows: of the parser. A null module or name is no place."""
    asked = asked.where("module IS NOT NULL AND name IS NOT NULL")
    defined = written(definitions(rows), "definitions")
    step = written(steps(rows, asked, defined), "steps")
    # least and greatest of the definitions that arrive: equal where there is one
    value = written(defined.select(*PLACE, F.col("qualified_name").alias("least"), F.col("qualified_name").alias("most")), "values")
    while True:
        ahead = value.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), "least", "most")
        back = step.join(ahead, ["to_module", "to_name"]).select(*PLACE, "least", "most").union(value)
        now = written(back.groupBy(*PLACE).agg(F.min("least").alias("least"), F.max("most").alias("most")), "values")
        # values only spread, so equal numbers of places and of ambiguous ones are not enough: compare them
        changed = now.join(value, [*PLACE, "least", "most"], "left_anti").limit(1).count()
        value = now
        if not changed:
            break
    return asked.select(*PLACE).distinct().join(value.where("least = most"), PLACE).select(*PLACE, F.col("least").alias("qualified_name"))


def resolved_calls(rows: DataFrame) -> DataFrame:
    """source, target: calls through imports, from the caller to the definition that is meant. Calls
    that resolve to none, or to one of several, are left out."""
    uses = rows.where("kind = 'use'").select("source", F.col("label").alias("module"), "name").distinct()
    return uses.join(resolved(rows, uses), PLACE).select("source", F.col("qualified_name").alias("target")).distinct()
