"""Search in four modes over the page table, with metadata filters.

A query becomes one lazy DataFrame: cheap metadata predicates first (they reach the
Parquet scan), then a necessary ``contains`` where a column without diacritics is
stored, then the expression, then the canonical order and the limit.
"""

from __future__ import annotations

import enum
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prepare_for_regex, strip_diacritics
from ..plans import patterns
from ..schema import DEFAULT_LIMIT, RESULT_COLUMNS, SNIPPET_RADIUS, UNCLASSIFIED_NAMES
from . import match


class SearchMode(enum.Enum):
    WORD = "word"
    PATTERN = "pattern"
    DERIVATIVES = "derivatives"
    REGEX = "regex"


class TimeMode(enum.Enum):
    DEATH_YEAR = "death_year"
    USAGE_DATE = "year"


@dataclass(frozen=True)
class SearchOptions:
    respect_diacritics: bool = False
    whole_letters: bool = False
    categories: tuple[str, ...] | None = None
    subcategories: tuple[str, ...] | None = None
    years: tuple[str, ...] | None = None
    countries: tuple[str, ...] | None = None
    book_ids: tuple[int, ...] | None = None
    limit: int | None = DEFAULT_LIMIT
    time_mode: TimeMode = TimeMode.DEATH_YEAR


def metadata_filter(pages: DataFrame, options: SearchOptions) -> DataFrame:
    """Any of the values inside a dimension, all dimensions; None or empty is no filter."""
    c, terms = F.col, []
    if options.categories:
        term = c("category").isin(*options.categories)
        if set(options.categories) & set(UNCLASSIFIED_NAMES):
            term = term | c("category").isNull()
        terms.append(term)
    if options.subcategories:  # pages carry none unless the table has the column
        terms.append(c("subcategory").isin(*options.subcategories) if "subcategory" in pages.columns else F.lit(False))
    if options.book_ids:
        terms.append(c("book_id").isin(*options.book_ids))
    if options.years:
        terms.append(c(options.time_mode.value).isin(*options.years))
    if options.countries:
        terms.append(c("country").isin(*options.countries))
    return pages.where(reduce(and_, terms)) if terms else pages


def _results(found: DataFrame, options: SearchOptions, more: tuple[str, ...] = ()) -> DataFrame:
    """Result rows of matches, whose snippet is made here unless they have one; ``more`` columns are kept."""
    pos, end = F.col("match_position"), F.col("match_position") + F.length("matched_term")
    around = F.col("context_snippet") if "context_snippet" in found.columns else match.snippet(F.col("content"), pos, end)
    rows = found.select(
        F.coalesce("book_id", F.lit(0)).cast("long").alias("book_id"), F.coalesce("page_num", F.lit(0)).cast("int").alias("page_number"),
        "original_page_number", "matched_term", pos.cast("long").alias("match_position"), around.alias("context_snippet"),
        "book_title", F.col("author").alias("book_author"), F.col("category").alias("book_category"), F.col("year").alias("book_year"),
        F.lit(1.0).alias("relevance"), *more,
    )
    return limited(rows, options)


def _matches(pages: DataFrame, pattern: str, keep=None) -> DataFrame:
    """Matches with what results show of their page; the text itself stays behind."""
    return match.find_all(pages.select(*_SHOWN), pattern, keep=keep, radius=SNIPPET_RADIUS)


_SHOWN = ["book_id", "page_num", "original_page_number", "content", "book_title", "author", "category", "year"]


def limited(rows: DataFrame, options: SearchOptions) -> DataFrame:
    """Canonical order and limit; without a limit the rows stay unordered (no sort of everything)."""
    return rows if options.limit is None else rows.orderBy("book_id", "page_number", "match_position").limit(options.limit)


def _nothing(pages: DataFrame) -> DataFrame:
    empty = pages.limit(0).withColumns({"matched_term": F.lit(None).cast("string"), "match_position": F.lit(None).cast("int")})
    return _results(empty, SearchOptions(limit=None))


def _needed(pages: DataFrame, words: list[str], options: SearchOptions) -> DataFrame:
    """Where the table stores content_nodiac, each word must be in it."""
    if options.respect_diacritics or "content_nodiac" not in pages.columns:
        return pages
    for w in words:
        pages = pages.where(F.col("content_nodiac").contains(patterns.strip_harakat(w)))
    return pages


def search_word(pages: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    spark, flags = pages.sparkSession, (options.respect_diacritics, options.whole_letters)
    pages_ = metadata_filter(pages, options)
    if "+" in query:
        parts = patterns.same_page(query, *flags)
        if len(parts) < 2 or not all(patterns.compiles(spark, p) for p in parts):
            return _nothing(pages)
        return _results(match.all_on_page(_needed(pages_, [p.strip() for p in query.split("+") if p.strip()], options), parts), options)
    pattern = patterns.phrase(query, *flags)
    if not pattern or not patterns.compiles(spark, pattern):
        return _nothing(pages)
    words = [p.strip() for p in query.split("|") if p.strip()][:2] if "|" in query else query.split()
    return _results(_matches(_needed(pages_, words, options), pattern), options)


def search_pattern(pages: DataFrame, wazn: str, options: SearchOptions = SearchOptions(), symbols: dict[str, str] | None = None) -> DataFrame:
    pattern = patterns.wazn(wazn, options.respect_diacritics, options.whole_letters, symbols)
    if not wazn.strip() or not patterns.compiles(pages.sparkSession, pattern):
        return _nothing(pages)
    return _results(_matches(metadata_filter(pages, options), pattern), options)


def search_regex(pages: DataFrame, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """A user's expression on the prepared text; positions are in that text."""
    full = patterns.user_regex(pattern)
    if full is None or not patterns.compiles(pages.sparkSession, full):
        return _nothing(pages)
    ready = metadata_filter(pages, options).withColumn("content", prepare_for_regex(F.col("content")))
    return _results(_matches(ready, full), options)


def is_derivative(root: str, vowels: bool = True, min_length: int = 3, max_length: int = 20):
    """A test of a token: made of the root's letters and letters of increase, the root's in order."""
    allowed, order = patterns.allowed_letters(root, vowels), patterns.root(root, vowels)
    # In an array of one, so that marks are taken out once and not for each condition.
    return lambda token: F.exists(F.array(strip_diacritics(token)), lambda t: F.length(t).between(min_length, max_length) & t.rlike(allowed) & t.rlike(order))


def search_derivatives(pages: DataFrame, root: str, options: SearchOptions = SearchOptions(), vowels: bool = True, min_length: int = 3, max_length: int = 20) -> DataFrame:
    """Distinct words of a root at their first place, most frequent first; adds match_count."""
    if not root.strip() or not patterns.compiles(pages.sparkSession, patterns.root(root, vowels)):
        return _nothing(pages).withColumn("match_count", F.lit(0).cast("long"))
    # Tokens of other letters are passed over by the expression, the rest is judged inside the page: only words of the root become rows.
    found = _matches(metadata_filter(pages, options), patterns.allowed_tokens(root, vowels), is_derivative(root, vowels, min_length, max_length))
    rows = _results(found, SearchOptions(limit=None))
    # Words are few beside their occurrences: count and first place are partial aggregates.
    first = F.min(F.struct("book_id", "page_number", "match_position", *[c for c in RESULT_COLUMNS if c not in ("book_id", "page_number", "match_position", "matched_term")]))
    words = rows.groupBy("matched_term").agg(F.count(F.lit(1)).alias("match_count"), first.alias("f"))
    words = words.select(*[F.col("matched_term") if c == "matched_term" else F.col(f"f.{c}") for c in RESULT_COLUMNS], "match_count")
    if options.limit is None:
        return words
    return words.orderBy(F.desc("match_count"), "book_id", "page_number", "match_position").limit(options.limit)


def search(pages: DataFrame, query: str, mode: SearchMode = SearchMode.WORD, options: SearchOptions = SearchOptions()) -> DataFrame:
    run = {SearchMode.WORD: search_word, SearchMode.PATTERN: search_pattern, SearchMode.DERIVATIVES: search_derivatives, SearchMode.REGEX: search_regex}
    return run[mode](pages, query, options)


def find_literal(pages: DataFrame, text: str) -> DataFrame:
    """Case-insensitive literal matches inside the given pages, in reading order, with a running number."""
    from pyspark.sql import Window

    quoted = "(?iu)" + "".join(map(patterns.escape, text))
    order = Window.partitionBy("book_id").orderBy("page_num", "match_position")
    return match.find_all(pages, quoted).withColumn("ordinal", F.row_number().over(order))
