"""Queries over a stored library: found by postings, by the dictionary and in rounds; changed by several writers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from .. import aids
from ..operators import search
from ..operators.search import SearchMode, SearchOptions
from ..operators.stored import search_library
from ..store import Library
from ..work import work_dir
from .catalog import _LIB, _OF, _OF_THE, ALL, _found, _hits, corpus, query
from .catalog_more import _ADDED, _ARLIB, _STORED, _derived, _stored, arabic


def indexed(spark, pages, **options) -> Library:
    """A library with aids, filled in two parts."""
    lib = Library(spark, work_dir(spark, "indexed"), **options)
    lib.append(pages.where("book_id % 3 = 0"))
    lib.index()  # of what is there; the second part's come with it
    lib.append(pages.where("book_id % 3 <> 0"))
    return lib


def _indexed(name: str, sql: str, text: str, mode: SearchMode = SearchMode.WORD, options: SearchOptions = ALL) -> None:
    query(name, sql)(lambda spark, d: search_library(indexed(spark, corpus(spark, d)), text, mode, options))


_indexed("mat_indexed_word", _found("trash"), "trash")
_indexed("mat_indexed_phrase", _found(_OF_THE), "of the")
_indexed("mat_indexed_regex", _found("trash"), "trash", SearchMode.REGEX)
_indexed("mat_indexed_filtered", _found("trash", where="category = 'en'"), "trash", SearchMode.WORD, SearchOptions(limit=None, categories=("en",)))
# No group of three is sure to stand beside "of": buckets are searched in order until the limit is met.
_indexed("srt_stored_limit", _found(_OF, tail="ORDER BY book_id, page_num, pos LIMIT 1000"), _OF, SearchMode.WORD, SearchOptions())


@query("mat_indexed_arabic", _found("ن" + "[ً-ٰٟۖ-ۭ]*" + "ه" + "[ً-ٰٟۖ-ۭ]*" + "ع" + "[ً-ٰٟۖ-ۭ]*", _ARLIB))
def _(spark, d):
    """Marks stand between the letters of a group in the text, not in the postings."""
    return search_library(indexed(spark, arabic(spark, d)), "نهع", SearchMode.WORD, ALL)


@query(
    "idx_candidates",
    """SELECT count(*) AS pages, count_if(contains(text, 'tra') AND contains(text, 'ras') AND contains(text, 'ash')) AS candidates,
        count_if(contains(text, 'trash')) AS pages_found FROM documents""",
)
def _(spark, d):
    """How many pages the postings leave of all, and how many of these hold the word."""
    lib = indexed(spark, corpus(spark, d))
    keys, _ = aids.candidates(lib, aids.sure_groups(["trash"]))
    found = aids.pages_at(lib, keys)
    left = found.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.contains("content", F.lit("trash"))).alias("pages_found"))
    return lib.pages().agg(F.count(F.lit(1)).alias("pages")).join(left)


_GONE = (5, 17, 18, 200)


def _changed(spark, pages) -> Library:
    """With books deleted, one of them added again, and one bucket's deletions folded in."""
    lib = indexed(spark, pages)
    lib.delete_books(_GONE[:2])
    lib.append(pages.where(f"book_id = {_GONE[1]}"))
    lib.compact()
    lib.delete_books(_GONE[2:])
    return lib


_LEFT = f"book_id NOT IN ({_GONE[0]}, {_GONE[2]}, {_GONE[3]})"


@query(
    "idx_dictionary",
    _hits(r"\S+", where=_LEFT) + """, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY book_id, page_num, pos) AS k, count(*) OVER (PARTITION BY term) AS n FROM hit)
        SELECT term AS token, n, book_id, page_num::INT AS page_num, pos::INT AS position FROM r WHERE k = 1""",
)
def _(spark, d):
    """Every token of what is left after an append, deletions and a compaction, with its number and first place."""
    return aids.dictionary(_changed(spark, corpus(spark, d)))


@query("mat_stored_derivatives", _derived(_ADDED + "عن", ".*ع.*ن.*", _ARLIB.removesuffix(")") + f" WHERE doc_id NOT IN ({_GONE[0]}, {_GONE[2]}, {_GONE[3]}))"))
def _(spark, d):
    return search_library(_changed(spark, arabic(spark, d)), "عن", SearchMode.DERIVATIVES, ALL)


@query("set_delete_and_add", f"WITH {_LIB} {_STORED} WHERE {_LEFT}")
def _(spark, d):
    """Deletions by identifiers alone, before and after a compaction; a deleted book that came again stays."""
    return _stored(_changed(spark, corpus(spark, d)))


@query("snk_two_writers", f"WITH {_LIB} {_STORED} WHERE book_id <> 7")
def _(spark, d):
    """Four appends and a deletion that commit at the same time: none is lost."""
    path, pages = work_dir(spark, "writers"), corpus(spark, d)
    Library(spark, path).append(pages.where("book_id % 5 = 2"))
    with ThreadPoolExecutor(5) as pool:
        jobs = [pool.submit(Library(spark, path).append, pages.where(f"book_id % 5 = {k}")) for k in (0, 1, 3, 4)]
        jobs.append(pool.submit(Library(spark, path).delete_book, 7))
        for j in jobs:
            j.result()
    return _stored(Library(spark, path))
