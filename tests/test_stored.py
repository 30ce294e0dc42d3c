"""The stored library: races, tombstones, compaction, postings, dictionary and rounds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from warraq import aids, store
from warraq.operators import search
from warraq.operators.search import SearchMode, SearchOptions
from warraq.operators.stored import in_rounds, search_library
from warraq.plans.catalog import corpus
from warraq.plans.catalog_stored import indexed
from warraq.schema import PAGES
from warraq.store import Conflict, Library

SF = "/root/testdata/sf0.001"
ALL = SearchOptions(limit=None)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return corpus(spark, SF).persist()


@pytest.fixture(scope="module")
def lib(spark, pages):
    return indexed(spark, pages, books=16)


@pytest.mark.parametrize("query,mode", [("trash", SearchMode.WORD), ("and the", SearchMode.WORD), ("trash + the", SearchMode.WORD), ("trash | and", SearchMode.WORD),
                                        ("of", SearchMode.WORD), ("trash", SearchMode.REGEX), ("[Tt]rash|of", SearchMode.REGEX), ("nosuchword", SearchMode.WORD)])
def test_found_by_postings(lib, pages, query, mode):
    report = {}
    assert rows(search_library(lib, query, mode, ALL, report=report)) == rows(search.search(pages, query, mode, ALL))
    if query in ("trash", "nosuchword"):
        assert report["candidates"] < 0.2 * pages.count() and report["groups"]


def test_postings_of_marked_and_invisible_text(spark, tmp_path):
    data = [(1, 1, "قَالَ رسُو​ل"), (1, 2, "قال"), (None, 3, "xقـالx قال"), (-5, None, "﻿abc قا لabcd"), (2, 1, None), (3, 1, "")]
    pages = spark.createDataFrame([(b, p, None, c, "t", None, None, None, None, None) for b, p, c in data], PAGES)
    lib = Library(spark, str(tmp_path / "marks"))
    lib.index()
    lib.append(pages)
    for query in ("قال", "رسول", "abc", "رسُول", "قَال"):
        for mode in (SearchMode.WORD, SearchMode.REGEX, SearchMode.PATTERN):
            for respect in (False, True):
                o = SearchOptions(limit=None, respect_diacritics=respect)
                assert rows(search_library(lib, query, mode, o)) == rows(search.search(lib.pages(), query, mode, o)), (query, mode, respect)


def test_sure_words():
    assert aids.sure_words("a b", "word") == ["a", "b"] and aids.sure_words("a | b | c", "word") == ["a", "b"] and aids.sure_words("a b + c", "word") == ["a b", "c"]
    assert aids.sure_words("ab+", "regex") == [] and aids.sure_words("abc", "regex") == ["abc"] and aids.sure_words("مف.ول", "pattern") == []
    assert aids.sure_groups(["abcd e"]) == ["abc", "bcd"] and aids.sure_groups(["قَال"]) == ["قال"] and aids.sure_groups(["ab"]) == []


def test_parts_without_postings_are_read(spark, pages, tmp_path):
    lib = Library(spark, str(tmp_path / "half"), books=16)
    lib.append(pages.where("book_id < 100"))
    lib.index()
    lib._commit(lambda m: m | {"indexed": False})
    lib.append(pages.where("book_id >= 100"))
    assert rows(search_library(lib, "trash", SearchMode.WORD, ALL)) == rows(search.search(pages, "trash", SearchMode.WORD, ALL))
    assert rows(aids.dictionary(lib)) == rows(aids.token_counts(pages))


def test_dictionary_follows_changes(spark, pages, tmp_path):
    lib = indexed(spark, pages, books=16)
    same = lambda: rows(aids.dictionary(lib)) == rows(aids.token_counts(lib.pages()))
    assert same()
    lib.delete_books([1, 5, 90])
    lib.append(pages.where("book_id = 5"))
    assert same() and lib.pages().count() == pages.count() - 2
    lib.compact()
    assert same() and not lib.manifest()["gone"]
    first = search_library(lib, "ere", SearchMode.DERIVATIVES, ALL)
    assert rows(first) == rows(search.search(lib.pages(), "ere", SearchMode.DERIVATIVES, ALL)) and first.count() > 10
    few = search_library(lib, "ere", SearchMode.DERIVATIVES, SearchOptions(limit=7))
    assert [tuple(r) for r in few.collect()] == [tuple(r) for r in search.search(lib.pages(), "ere", SearchMode.DERIVATIVES, SearchOptions(limit=7)).collect()]


def test_rounds_stop_at_the_limit(lib, pages):
    for limit, all_files in ((5, False), (10**6, True)):
        report, o = {}, SearchOptions(limit=limit)
        got = search_library(lib, "of", SearchMode.WORD, o, report=report)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in search.search(pages, "of", SearchMode.WORD, o).collect()]
        assert (report["files"] == report["files_of"]) == all_files
    assert in_rounds(lib, lambda p: search.search(p, "of", SearchMode.WORD, SearchOptions(limit=5)), SearchOptions(limit=5), report).count() == 5
    assert report["rounds"] == 1 and report["files"] <= 2


def test_two_writers(spark, pages, tmp_path, monkeypatch):
    """The second commits between the first's reading of the manifest and its writing."""
    first, second = Library(spark, str(tmp_path / "race")), Library(spark, str(tmp_path / "race"))
    make, raced = Library._make, []

    def slow(self, path, text):
        if self is first and not raced:
            raced.append(True)
            second.append(pages.where("book_id % 2 = 1"), mark=("b", 0))
        return make(self, path, text)

    monkeypatch.setattr(Library, "_make", slow)
    first.append(pages.where("book_id % 2 = 0"), mark=("a", 0))
    assert first.pages().count() == pages.count() and first.manifest()["marks"] == {"a": 0, "b": 0} and len(first.versions()) == 2
    # A mark that another writer has set meanwhile: nothing is added twice.
    raced.clear()
    assert not [first.append(pages.limit(3), mark=("b", 0))][0]
    monkeypatch.setattr(store, "ATTEMPTS", 1)
    monkeypatch.setattr(Library, "_make", lambda *a: False)
    with pytest.raises(Conflict):
        first.append(pages.limit(3))


def test_compaction_and_deletion_at_the_same_time(spark, pages, tmp_path, monkeypatch):
    lib = Library(spark, str(tmp_path / "both"), books=64)
    for k in range(5):
        lib.append(pages.where(f"book_id % 5 = {k}"))
    made, once = Library._store, []

    def slow(self, *a):
        out = made(self, *a)
        if not once:
            once.append(True)
            lib.delete_book(9)
        return out

    monkeypatch.setattr(Library, "_store", slow)
    assert lib.compact() > 0 and lib.pages().where("book_id = 9").count() == 0 and lib.pages().count() == pages.count() - 1
    lib.compact()
    assert not lib.manifest()["gone"] and lib.pages().count() == pages.count() - 1


def test_tiers(spark, pages, tmp_path, monkeypatch):
    lib = Library(spark, str(tmp_path / "tiers"), books=64)
    lib.append(pages)
    untouched = {p["folder"] for p in lib.parts() if p["bucket"] > 0}
    for k in range(6):
        lib.append(pages.where(f"book_id = {k + 1}").withColumn("page_num", F.lit(k + 2)))
    before = rows(lib.pages().select("book_id", "page_num", "content"))
    assert set(lib.merges()) == {0} and lib.compact() == 1 and not lib.merges()
    assert untouched <= {p["folder"] for p in lib.parts()} and rows(lib.pages().select("book_id", "page_num", "content")) == before
    assert sum(p["files"] for p in lib.parts([0])) <= store.COMPACT_FILES + 1
    lib.drop_old_versions()
    assert rows(lib.pages().select("book_id", "page_num", "content")) == before
    # A bound of bytes: what is over it is left alone, and what is merged is the work of several tasks.
    monkeypatch.setattr(store, "TASK_BYTES", max(p["bytes"] for p in lib.parts([1])) - 1)
    lib.delete_book(70)
    assert lib.compact() == 1 and sum(p["files"] for p in lib.parts([1])) > 1 and lib.pages().where("book_id = 70").count() == 0


def test_deleting_writes_identifiers_only(spark, pages, tmp_path):
    lib = Library(spark, str(tmp_path / "gone"))
    lib.append(pages)
    data = sorted(p.name for p in (tmp_path / "gone" / "data").iterdir())
    assert lib.delete_books([3, 4, 4, 10**9]) == 2 and lib.delete_books([3]) == 0 and lib.delete_books([]) == 0
    assert sorted(p.name for p in (tmp_path / "gone" / "data").iterdir()) == data and lib.pages_of(3).count() == 0
    assert lib.healthy() and lib.pages().count() == pages.count() - 2
