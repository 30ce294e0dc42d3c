"""Matching inside pages: all matches with positions, first matches, tokens.

Built-in functions give match values or positions of nothing; here each match is put
between two sentinel characters and the text is split at them, so odd segments are
matches and positions are sums of segment lengths.  The sums are taken inside the row
(by blocks, so that a page with very many matches stays linear): no shuffle, no UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SNIPPET_RADIUS

OPEN, CLOSE = "\ue000", "\ue001"
_BLOCK = 64


def without_sentinels(content: Column) -> Column:
    """Ingestion takes the two private-use sentinels out of texts."""
    return F.regexp_replace(content, f"[{OPEN}{CLOSE}]", "")


def segments_of(content: Column, pattern: str) -> Column:
    """Text before the first match, the match, text up to the next, ... (odd ones, from 0, are matches)."""
    return F.split(F.regexp_replace(content, pattern, OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]", -1)


def find_all(pages: DataFrame, pattern: str, content: str = "content", keep: Callable[[Column], Column] | None = None, radius: int | None = None) -> DataFrame:
    """One row a match: all columns of ``pages``, matched_term, match_position (from 0).

    keep: which terms are wanted; the others go before rows are made.
    radius: adds context_snippet and leaves out the text, so that rows do not carry it.
    """
    df = pages.where(F.col(content).rlike(pattern)).withColumn("__seg", segments_of(F.col(content), pattern))
    df = df.withColumn("__len", F.expr("transform(__seg, s -> length(s))"))
    df = df.withColumn(
        "__sum",
        F.expr(
            f"""aggregate(sequence(0, cast(size(__len) / {_BLOCK} as int)), array(0), (acc, b) -> concat(acc, array(
                element_at(acc, -1) + aggregate(slice(__len, b * {_BLOCK} + 1, {_BLOCK}), 0, (s, x) -> s + x))))"""
        ),
    )
    # Rows without a match are gone by here; for texts that are constants Spark evaluates it all the same.
    odd = F.sequence(F.lit(1), F.greatest(F.size("__seg") - 1, F.lit(1)), F.lit(2))
    places = F.when(F.size("__seg") > 1, odd).otherwise(F.array().cast("array<int>"))
    if keep:
        places = F.filter(places, lambda i: keep(F.element_at("__seg", i + 1)))

    def span(i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        inside = F.aggregate(F.slice("__len", block * _BLOCK + 1, i % _BLOCK), F.lit(0), lambda s, x: s + x)
        return F.struct(F.element_at("__seg", i + 1).alias("term"), (F.element_at("__sum", block + 1) + inside).alias("pos"))

    spans = F.transform(places, span)
    rest = [c for c in pages.columns if c != content]
    if radius is None:
        df = df.withColumn("__m", F.explode(spans))
        return df.select(*pages.columns, F.col("__m.term").alias("matched_term"), F.col("__m.pos").alias("match_position"))
    around = lambda m: F.struct(m["term"].alias("term"), m["pos"].alias("pos"), snippet(F.col(content), m["pos"], m["pos"] + F.length(m["term"]), radius).alias("around"))
    df = df.select(*rest, F.explode(F.transform(spans, around)).alias("__m"))
    return df.select(*rest, F.col("__m.term").alias("matched_term"), F.col("__m.pos").alias("match_position"), F.col("__m.around").alias("context_snippet"))


def first_position(content: Column, pattern: str) -> Column:
    """Position of the first match from 0, or null."""
    return F.when(content.rlike(pattern), F.length(F.element_at(segments_of(content, pattern), 1)))


def first_match(content: Column, pattern: str) -> Column:
    return F.when(content.rlike(pattern), F.regexp_extract(content, pattern, 0))


def first_match_per_page(pages: DataFrame, pattern: str) -> DataFrame:
    c = F.col("content")
    return pages.where(c.rlike(pattern)).withColumns({"matched_term": first_match(c, pattern), "match_position": first_position(c, pattern)})


def all_on_page(pages: DataFrame, patterns: list[str]) -> DataFrame:
    """Pages where every pattern occurs, with the earliest of the first matches (ties: order of the patterns)."""
    c = F.col("content")
    for p in patterns:
        pages = pages.where(c.rlike(p))
    firsts = [F.struct(first_position(c, p).alias("pos"), F.lit(i).alias("k"), first_match(c, p).alias("term")) for i, p in enumerate(patterns)]
    df = pages.withColumn("__m", F.array_min(F.array(*firsts)))
    return df.select(*pages.columns, F.col("__m.term").alias("matched_term"), F.col("__m.pos").alias("match_position"))


def snippet(content: Column, start: Column, end: Column, radius: int = SNIPPET_RADIUS) -> Column:
    low = F.greatest(start - radius, F.lit(0))
    return F.substring(content, low + 1, end + radius - low)


def tokens(pages: DataFrame, keep: Callable[[Column], Column] | None = None, radius: int | None = None) -> DataFrame:
    """White-space tokens with their positions, as matches."""
    return find_all(pages, r"\S+", keep=keep, radius=radius)
