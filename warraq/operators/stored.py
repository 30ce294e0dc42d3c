"""Search in a stored library: by its postings, by its dictionary, and in rounds that stop at the limit."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import aids
from ..plans import patterns
from ..schema import RESULT_COLUMNS, SNIPPET_RADIUS
from ..store import Library
from ..work import stage, work_dir
from . import match, search
from .search import SearchMode, SearchOptions


def search_library(
    library: Library, query: str, mode: SearchMode = SearchMode.WORD, options: SearchOptions = SearchOptions(),
    symbols: dict[str, str] | None = None, report: dict | None = None,
) -> DataFrame:
    """The rows of ``search`` over the library's pages.

    Where strings are sure to stand in every page found, only pages that the postings name for
    them are read; derivatives come from the dictionary, unless metadata narrow the search.  With a limit and
    no such strings, buckets are searched in order of their books until the limit is met.  report: is told
    the groups looked up, the candidates, and how many parts of the library were read.
    """
    if mode is SearchMode.DERIVATIVES:
        return _derivatives(library, query, options, report)
    groups = aids.sure_groups(aids.sure_words(query, mode.value, symbols))
    run = lambda pages, o: search.search_pattern(pages, query, o, symbols) if mode is SearchMode.PATTERN else search.search(pages, query, mode, o)
    if report is not None:
        report["groups"] = groups
    if groups and library.manifest()["aids"]:
        keys, bare = aids.candidates(library, groups)
        return run(aids.pages_at(library, keys, bare, report), options)
    if options.limit is None:
        return run(library.pages(), options)
    return in_rounds(library, lambda pages: run(pages, options), options, report)


def in_rounds(library: Library, find, options: SearchOptions, report: dict | None = None) -> DataFrame:
    """The first ``options.limit`` rows of ``find(pages)``, from buckets in order of their books.

    Rounds take one bucket, then twice as many each time, and end when the limit is met; a round
    keeps no more rows than the limit.  Results are in order over rounds, since a bucket's books are.
    """
    buckets = sorted({p["bucket"] for p in library.parts()})
    if options.book_ids:
        wanted = {library.bucket_of(i) for i in options.book_ids}
        buckets = [b for b in buckets if b in wanted]
    work, rounds, found, at, take = work_dir(library.spark, "rounds"), [], 0, 0, 1
    while at < len(buckets) and found < options.limit or not rounds:
        rows = find(library.pages(buckets[at : at + take]))
        rounds.append(stage(rows, f"{work}/{len(rounds)}"))
        found += rounds[-1].count()
        at, take = at + take, take * 2
    if report is not None:
        read = set(buckets[:at])
        report |= {"rounds": len(rounds), "files": sum(p["files"] for p in library.parts() if p["bucket"] in read), "files_of": sum(p["files"] for p in library.parts())}
    return search.limited(reduce(DataFrame.unionByName, rounds), options)


def _derivatives(library: Library, root: str, options: SearchOptions, report: dict | None) -> DataFrame:
    narrowed = replace(options, limit=None, respect_diacritics=False, whole_letters=False) != SearchOptions(limit=None, time_mode=options.time_mode)
    if narrowed or not library.manifest()["aids"] or not root.strip() or not patterns.compiles(library.spark, patterns.root(root)):
        return search.search_derivatives(library.pages(), root, options)
    words = aids.dictionary(library, search.is_derivative(root))
    order = [F.desc("n"), F.coalesce("book_id", F.lit(0)), F.coalesce("page_num", F.lit(0)), F.col("position")]
    if options.limit is not None:
        words = words.orderBy(*order).limit(options.limit)
    words = stage(words, work_dir(library.spark, "words"))
    # The few words' first places are looked at for what results show of their pages.
    places = words.select(F.col("token").alias("matched_term"), F.col("n").alias("match_count"), F.col("book_id").alias("__b"), F.col("page_num").alias("__p"), F.col("position").alias("match_position"))
    pages = aids.pages_at(library, words.select("book_id", "page_num"), report=report)
    same = F.col("book_id").eqNullSafe(F.col("__b")) & F.col("page_num").eqNullSafe(F.col("__p"))
    pos, term = F.col("match_position"), F.col("matched_term")
    found = pages.join(places, same).where(F.substring("content", pos + 1, F.length(term)) == term)
    found = found.withColumn("context_snippet", match.snippet(F.col("content"), pos, pos + F.length(term), SNIPPET_RADIUS)).dropDuplicates(["matched_term"])
    rows = search._results(found.drop("content"), SearchOptions(limit=None), ("match_count",))
    rows = rows.select(*RESULT_COLUMNS, "match_count")
    return rows if options.limit is None else rows.orderBy(F.desc("match_count"), "book_id", "page_number", "match_position").limit(options.limit)
