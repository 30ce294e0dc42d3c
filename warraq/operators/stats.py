"""Library statistics over the page table: distinct books by category, period and region."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, nonblank
from ..schema import ALL_BOOKS, UNCLASSIFIED, UNKNOWN_YEAR, UNTITLED
from ..work import stage, work_dir
from .search import TimeMode


_META = ["book_title", "author", "category", "year", "death_year", "country"]


def _first_page() -> Column:
    return F.min_by(F.struct(*_META), F.struct("page_num", *[F.coalesce(c, F.lit("")) for c in _META]))


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page's metadata of each book: one struct minimum, no window."""
    first = pages.groupBy("book_id").agg(_first_page().alias("f"))
    return first.where("book_id is not null").select("book_id", "f.*")


def _counts(pages: DataFrame, key: Column, named: str) -> DataFrame:
    """Distinct books of each value; a book counts under each value that its pages carry."""
    pairs = pages.where("book_id is not null").select(F.coalesce(key, F.lit(UNCLASSIFIED)).alias(named), "book_id").distinct()
    return pairs.groupBy(named).agg(F.count(F.lit(1)).alias("books"))


def by_category(pages: DataFrame) -> DataFrame:
    """All books, the unclassified (if any), then each category; ``rank`` 0, 1, 2 keeps that order."""
    rows = _counts(pages, nonblank(F.col("category")), "category")
    total = pages.agg(F.count_distinct("book_id").alias("books")).select(F.lit(ALL_BOOKS).alias("category"), "books")
    return total.unionByName(rows).withColumn("rank", F.when(F.col("category") == ALL_BOOKS, 0).when(F.col("category") == UNCLASSIFIED, 1).otherwise(2))


def by_year(pages: DataFrame, time_mode: TimeMode = TimeMode.DEATH_YEAR) -> DataFrame:
    value = F.col(time_mode.value)
    rows = _counts(pages, F.when(value != UNKNOWN_YEAR, nonblank(value)), "year")
    return rows.withColumn("rank", F.when(F.col("year") == UNCLASSIFIED, 1).otherwise(2))


def by_region(pages: DataFrame) -> DataFrame:
    rows = _counts(pages, nonblank(F.col("country")), "region")
    return rows.withColumn("rank", F.when(F.col("region") == UNCLASSIFIED, 1).otherwise(2))


def in_display_order(stats: DataFrame, key: str) -> DataFrame:
    return stats.orderBy("rank", key)


def totals(pages: DataFrame) -> DataFrame:
    """One row: books, pages, estimated words (characters by 5), authors of first pages; one scan, added up by book first."""
    first = F.min_by("author", F.struct("page_num", *[F.coalesce(c, F.lit("")) for c in _META])).alias("author")
    own = pages.groupBy("book_id").agg(first, F.count(F.lit(1)).alias("pages"), F.sum(F.length("content")).alias("chars"))
    return _totals(own, F.col("author"))


def _totals(books: DataFrame, author: Column) -> DataFrame:
    known = F.col("book_id").isNotNull()
    return books.agg(
        F.count("book_id").alias("total_books"), F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"),
        F.floor(F.coalesce(F.sum(F.when(known, F.col("chars"))), F.lit(0)) / 5).cast("long").alias("total_words_estimate"),
        F.count_distinct(F.when(known & ~blank(author), author)).alias("author_count"),
    )


def books(pages: DataFrame) -> DataFrame:
    return first_pages(pages).withColumn("book_title", F.coalesce("book_title", F.lit(UNTITLED)))


def books_by_title(pages: DataFrame) -> DataFrame:
    return books(pages).orderBy("book_title", "book_id")


@dataclass(frozen=True)
class Aggregate:
    """What the library's overview shows; all from one table of books."""

    totals: DataFrame  # one row
    by_category: DataFrame
    by_year: DataFrame
    by_region: DataFrame
    books: DataFrame  # in order of title


def aggregate_all(pages: DataFrame, time_mode: TimeMode = TimeMode.DEATH_YEAR) -> Aggregate:
    """All statistics from one scan of the pages.

    The scan makes one row a book: its first page's metadata, the distinct values that its
    pages carry, its pages and characters.  That table is written, and counts are sums over it.
    """
    year = F.col(time_mode.value)
    keys = {"category": nonblank(F.col("category")), "year": F.when(year != UNKNOWN_YEAR, nonblank(year)), "region": nonblank(F.col("country"))}
    first = _first_page()
    named = [F.collect_set(F.coalesce(value, F.lit(UNCLASSIFIED))).alias(f"in_{k}") for k, value in keys.items()]
    own = pages.groupBy("book_id").agg(first.alias("f"), *named, F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))
    own = stage(own, work_dir(pages.sparkSession, "library-statistics"))
    known = own.where("book_id is not null")
    totals_ = _totals(own, F.col("f.author"))

    def counts(key: str) -> DataFrame:
        rows = known.select(F.explode(f"in_{key}").alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("books"))
        return rows.withColumn("rank", F.when(F.col(key) == UNCLASSIFIED, 1).otherwise(2))

    every = known.agg(F.count(F.lit(1)).alias("books")).select(F.lit(ALL_BOOKS).alias("category"), "books", F.lit(0).alias("rank"))
    shown = known.select("book_id", "f.*").withColumn("book_title", F.coalesce("book_title", F.lit(UNTITLED)))
    return Aggregate(totals_, every.unionByName(counts("category")), counts("year"), counts("region"), shown.orderBy("book_title", "book_id"))


def total_books(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_distinct("book_id").alias("total_books"))


def max_book_id(pages: DataFrame) -> DataFrame:
    return pages.agg(F.coalesce(F.max("book_id"), F.lit(0)).cast("long").alias("max_book_id"))


def distinct_years(pages: DataFrame) -> DataFrame:
    """Always the year of use, whatever the time mode; unknown ones are left out."""
    return _counts(pages.where(~blank(F.col("year")) & (F.col("year") != UNKNOWN_YEAR)), F.col("year"), "year")


def distinct_regions(pages: DataFrame) -> DataFrame:
    return _counts(pages.where(~blank(F.col("country"))), F.col("country"), "region")


def book_summary(pages: DataFrame, book_id: int | None = None) -> DataFrame:
    """First page's metadata and number of pages, of one book or of all."""
    own = pages if book_id is None else pages.where(F.col("book_id") == book_id)
    meta = F.min_by(F.struct("book_title", "author", "category", "year"), "page_num").alias("m")
    return own.groupBy("book_id").agg(meta, F.count(F.lit(1)).alias("pages_count")).select("book_id", "m.*", "pages_count")


def counters(events: DataFrame, key: str) -> DataFrame:
    """Usage counters as one map (few keys)."""
    rows = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counters"), F.sum("n").alias("total"))
