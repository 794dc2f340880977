"""Helpers shared by the operators: sizes, words, keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import bucketed, drop_path, fresh_path, scratch, shared_dir, shuffles_dropped, written

__all__ = ["SPACE", "ascii_lower", "bucketed", "bytes_in_parts", "drop_path", "fresh_path", "lower_bytes", "own_names", "plain_columns", "scratch", "shared_dir", "shuffles_dropped", "sized", "tagged", "words", "written"]

#: ASCII white space that separates words; words are runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def sized(df: DataFrame, rows: int = 500_000, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if its rows (narrow ones of a written table) are counted to be
    `rows` at most; else as it is, for a join by shuffle. weight: what a row counts for, where
    rows hold arrays."""
    n = df.count() if weight is None else df.agg(F.sum(weight).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= rows else df


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of df: the given ones, lengthened while df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_columns(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of documents that return their columns: within, columns that play no part have
    plain names, and outside, all have their own, whatever characters these hold."""

    @wraps(run)
    def renamed(docs: DataFrame, *args, **more) -> DataFrame:
        parts = {"doc_id", "text", "source", "n_chars", *(x for x in (*args, *more.values()) if isinstance(x, str))}
        return run(docs.toDF(*[c if c in parts else f"column_{k}" for k, c in enumerate(docs.columns)]), *args, **more).toDF(*docs.columns)

    return renamed


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tagged(key: Column) -> Column:
    """A string key that keeps null apart from every string, for joins and groups."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_bytes(text: bytes) -> bytes:
    """Lower-cases A-Z alone, in UTF-8."""
    return text.translate(_LOWER)


def bytes_in_parts(text: bytes, word: re.Pattern, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about `size` bytes; none ends within a run that the pattern matches."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text) and (rest := word.match(text, end)):
            end = rest.end()
        yield text[at:end]
        at = end
