"""Reading and navigation: pages of a book, neighbours, jumps, groups of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DISPLAY_GROUP
from ..work import stage, work_dir
from .order import serials

_RESULTS = ("book_id", "page_number", "match_position")


def get_page(pages: DataFrame, book_id: int, page_num: int) -> DataFrame:
    return pages.where((F.col("book_id") == book_id) & (F.col("page_num") == page_num)).limit(1)


def get_book_pages(pages: DataFrame, book_id: int) -> DataFrame:
    return pages.where(F.col("book_id") == book_id).orderBy("page_num")


def jump_to(pages: DataFrame, book_id: int, number: int) -> DataFrame:
    """First page whose original or own number is ``number``."""
    original = F.col("original_page_number").try_cast("int")
    hit = F.coalesce(original == number, F.lit(False)) | (F.col("page_num") == number)
    return pages.where((F.col("book_id") == book_id) & hit).orderBy("page_num").limit(1)


def with_neighbours(pages: DataFrame) -> DataFrame:
    """Numbers of the page before and after, inside the book (null at the ends)."""
    order = Window.partitionBy("book_id").orderBy("page_num")
    return pages.withColumns({"previous_page": F.lag("page_num").over(order), "next_page": F.lead("page_num").over(order)})


def numbered(results: DataFrame) -> DataFrame:
    """Serial numbers from 1 over all results, in their order; no task holds more than a range of them."""
    return serials(results, *_RESULTS)[0]


def grouped(results: DataFrame, size: int = DISPLAY_GROUP) -> DataFrame:
    """Display groups of ``size``, from 1."""
    return numbered(results).withColumn("display_group", F.ceil(F.col("serial") / size).cast("int"))


def with_neighbour_results(results: DataFrame, wrap: bool = False) -> DataFrame:
    """Serial of the result before and after; at the ends itself, or the other end with ``wrap``."""
    df, last = serials(results, *_RESULTS)
    s = F.col("serial")
    previous = F.when(s > 1, s - 1).otherwise(F.lit(last) if wrap else s)
    following = F.when(s < last, s + 1).otherwise(F.lit(1) if wrap else s)
    return df.withColumns({"previous_serial": previous, "next_serial": following})


#: Keys of pages (16 bytes each) up to this number are broadcast to pick the pages' texts.
BROADCAST_KEYS = 1_000_000


#: Characters of a page whose hits are one array; a page with hits all over has several.
SALT_CHARS = 1 << 16


def beside_pages(results: DataFrame, pages: DataFrame, make: Callable[[Column, Column], Column], name: str, written: bool = False) -> DataFrame:
    """Results with a column ``name`` that ``make(page's text, result)`` gives where the text is; a missing page's text is null.

    The results of a page (of a stretch of it) are one array, so that a page meets its text once for each
    and not once a result.  Results are written first (unless they are read from a table anyway), and only the pages
    that they name are shuffled.
    """
    spark = results.sparkSession
    found = results if written else stage(results, work_dir(spark, "results"))
    keys = stage(found.select("book_id", "page_number").distinct(), work_dir(spark, "result-pages"))
    few = keys.count() <= BROADCAST_KEYS
    page = pages.select("book_id", F.col("page_num").alias("page_number"), F.col("content").alias("__text"))
    page = page.join(F.broadcast(keys) if few else keys, ["book_id", "page_number"], "left_semi").dropDuplicates(["book_id", "page_number"])
    rest = [c for c in results.columns if c not in ("book_id", "page_number")]
    salt = F.floor(F.coalesce("match_position", F.lit(0)) / SALT_CHARS)
    hits = found.groupBy("book_id", "page_number", salt.alias("__salt")).agg(F.collect_list(F.struct(*rest)).alias("__hits"))
    order = lambda a, b: F.when(a["match_position"] < b["match_position"], -1).when(a["match_position"] > b["match_position"], 1).otherwise(0)
    made = lambda h: F.struct(h.alias("h"), make(F.col("__text"), h).alias("made"))
    met = hits.join(page, ["book_id", "page_number"], "left").select("book_id", "page_number", F.explode(F.transform(F.array_sort("__hits", order), made)).alias("x"))
    return met.select(*[F.col(c) if c in ("book_id", "page_number") else F.col(f"x.h.{c}").alias(c) for c in results.columns], F.col("x.made").alias(name))


def page_of_result(results: DataFrame, pages: DataFrame, written: bool = False) -> DataFrame:
    """Results, each with the whole text of its page; where less will do, ``beside_pages`` is cheaper."""
    return beside_pages(results, pages, lambda text, _: text, "page_content", written)
