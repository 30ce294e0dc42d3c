"""What a library keeps beside its data folders to find pages: postings of letter groups, and a dictionary of tokens.

Postings: each group of three letters or digits with the pages that hold it, in arrays of neighbouring
pages, written by slices of the groups' checksums.  They are of the text without marks and
invisible characters, from which characters are only taken away: where a word stands in a text, its groups
stand in what is left of that.  So pages without one of them need not be read.  A page
that was moved or deleted can still be named; candidates are always looked at.

Dictionary: each token of a data folder's bucket with its number and first place.  Where books
of a bucket were deleted, tokens are counted from its pages until compaction has folded that in.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans.patterns import HARAKAT, META, strip_harakat, substitute_symbols
from .session import ship
from .work import stage, work_dir

if TYPE_CHECKING:
    from .store import Library

# Characters that groups are made of, and those that are taken out first.
_CHAR = "[A-Za-z0-9À-ɏء-ي٠-٩ٱ-ۓ]"
_INVISIBLE = "﻿​-‏"
#: Bytes of stored pages whose postings, or whose counts of tokens, one task sorts and writes; in memory they take several times as many.
SLICE_BYTES = 8 << 20
#: Slices of a data folder; beyond them a slice is of several files, each one task's.
SLICES = 256
#: Files of a bucket's tokens; of one that has more stored pages, as many as it takes tasks.
WORD_FILES = 4
#: Characters whose groups, and whose tokens, a task looks at together.
GROUP_CHARS, TOKEN_CHARS = 2 << 20, 8 << 20
#: Neighbouring books and pages in one array, as bits: until it is written, a page is one int, its place in the block.
BOOK_BITS, PAGE_BITS = 6, 12
#: Books up to this number are named to the scan, so that it skips the rest of their buckets.
NAMED_BOOKS = 200
#: Candidates up to this number are broadcast to pick the pages; else they meet them in tasks of so many bytes of stored pages.
BROADCAST_KEYS, JOIN_BYTES = 1_000_000, 32 << 20


# -- groups ---------------------------------------------------------------------


def _numbers() -> np.ndarray:
    """The number of each character that groups are made of, from 1; 0 for others, of which the last stands for all beyond the table."""
    out = np.zeros(0x10000, np.int64)
    own = [i for i in range(0xD800) if re.fullmatch(_CHAR, chr(i))]
    out[own] = np.arange(1, len(own) + 1)
    return out


_NUMBER = _numbers()
_LETTERS = np.flatnonzero(_NUMBER).astype(np.uint32)
_BITS = int(_NUMBER.max()).bit_length()


def _groups(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(group, place of the text) of the distinct groups of each text, in order; a group is its letters' numbers."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
    n = _NUMBER[np.minimum(codes, 0xFFFF)]
    at = np.flatnonzero((n[:-2] > 0) & (n[1:-1] > 0) & (n[2:] > 0))
    ends = np.cumsum([len(t) + 1 for t in texts])
    group = (n[at] << 2 * _BITS) | (n[at + 1] << _BITS) | n[at + 2]
    both = np.sort((group << 32) | np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, ends), prepend=0)))
    both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
    return both >> 32, both & 0xFFFFFFFF


def _spelt(groups: np.ndarray) -> list[str]:
    letters = [_LETTERS[((groups >> k * _BITS) & ((1 << _BITS) - 1)) - 1] for k in (2, 1, 0)]
    flat = np.stack(letters, 1).astype("<u4").tobytes().decode("utf-32-le")
    return [flat[i : i + 3] for i in range(0, len(flat), 3)]


def _chunks(texts: pa.Array, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, texts) of about so many characters; long texts come in pieces that share two characters."""
    rows, out, size = [], [], 0
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        for at in range(0, max(len(text) - 2, 1), limit):
            piece = text[at : at + limit + 2]
            rows.append(i)
            out.append(piece)
            size += len(piece)
            if size >= limit:
                yield rows, out
                rows, out, size = [], [], 0
    if rows:
        yield rows, out


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, block, places in the block of pages that stand beside each other; from places, block and the clean text."""
    for batch in batches:
        places, block, texts = batch.columns
        places = places.to_numpy()
        # Equal numbers for neighbouring rows of one block.
        seen = [b.as_py() for b in block]
        run = np.cumsum([0] + [int(a != b) for a, b in zip(seen, seen[1:])]) if seen else []
        for rows, part in _chunks(texts, GROUP_CHARS):
            group, place = _groups(part)
            if not len(group):
                continue
            row = np.asarray(rows)[place]
            own = np.asarray(run)[row]
            first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (own[1:] != own[:-1])])
            names, which = np.unique(group[first], return_inverse=True)
            pages = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(places[row]))
            yield pa.RecordBatch.from_arrays([pa.array(_spelt(names)).take(pa.array(which)), block.take(pa.array(row[first])), pages], ["gram", "block", "places"])


def _block() -> Column:
    """The block of a page; what is missing is so there, too."""
    return F.struct(F.shiftright("book_id", BOOK_BITS).alias("books"), F.shiftright(F.col("page_num").cast("long"), PAGE_BITS).alias("pages"))


def _place() -> Column:
    """The place of a page in its block."""
    book, page = F.coalesce("book_id", F.lit(0)), F.coalesce("page_num", F.lit(0))
    book = book.bitwiseAND((1 << BOOK_BITS) - 1).cast("int")
    return F.shiftleft(book, PAGE_BITS).bitwiseOR(page.cast("int").bitwiseAND((1 << PAGE_BITS) - 1))


def _pages(places: str) -> Column:
    """The pages at places of the block."""
    book = lambda at: F.shiftleft("block.books", BOOK_BITS).bitwiseOR(F.shiftright(at, PAGE_BITS).cast("long"))
    page = lambda at: F.shiftleft("block.pages", PAGE_BITS).cast("int").bitwiseOR(at.bitwiseAND((1 << PAGE_BITS) - 1))
    return F.transform(places, lambda at: F.struct(book(at).alias("book_id"), page(at).alias("page_num")))


def sure_groups(words: list[str]) -> list[str]:
    """The groups that any text with all the words has."""
    out = set()
    for w in words:
        w = re.sub(f"[{_INVISIBLE}]", "", strip_harakat(w))
        out |= {g for g in (w[i : i + 3] for i in range(len(w) - 2)) if re.fullmatch(f"{_CHAR}{{3}}", g)}
    return sorted(out)


def sure_words(query: str, mode: str, symbols: dict[str, str] | None = None) -> list[str]:
    """Strings that stand in every page that a query finds; none where that is not sure."""
    if mode == "word":
        if "+" in query:
            return [p.strip() for p in query.split("+") if p.strip()]
        if "|" in query:
            return [p.strip() for p in query.split("|") if p.strip()][:2]
        return query.split()
    if mode == "pattern":
        parts = re.split(r"\[[^\]]*\]", substitute_symbols(query, symbols))
        return parts if not any(c in META for p in parts for c in p) else []
    if mode == "regex":
        return [] if any(c in META or c == "#" for c in query) else [query]
    return []


def _slice(group: str, slices: int) -> int:
    return zlib.crc32(group.encode()) % slices


# -- writing ----------------------------------------------------------------------


def tasks_of(size: int, each: int | None = None) -> int:
    """Tasks for so many bytes of stored pages."""
    return max(1, -(-size // (each or SLICE_BYTES)))


def write(library: Library, pages: DataFrame, name: str, size: int, largest: int = 0) -> dict:
    """Postings and dictionary of a data folder of ``size`` bytes, ``largest`` of them in one bucket; what the manifest keeps of them."""
    tasks = tasks_of(size)
    slices = min(tasks, SLICES)
    files = -(-tasks // slices)
    # Neighbouring pages stand beside each other in the folder's files, so their arrays are made where they are read.
    clean = F.regexp_replace(F.make_valid_utf8("content"), f"[{HARAKAT}{_INVISIBLE}]", "")
    ship(library.spark)
    postings = pages.select(_place().alias("place"), _block().alias("block"), clean.alias("text")).mapInArrow(_postings, f"gram string, {_BLOCK}, places array<int>")
    postings = postings.withColumn("slice", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(slices)).cast("int"))
    task = F.col("slice") * files + F.pmod(F.xxhash64("block"), F.lit(files)).cast("int")
    postings = postings.repartitionById(slices * files, task).sortWithinPartitions("slice", "gram", "block")
    postings = postings.select("gram", "block", _pages("places").alias("pages"), "slice")
    postings.write.option("parquet.page.row.count.limit", 1000).partitionBy("slice").parquet(f"{library.path}/grams/{name}")
    words = token_counts(pages, library._bucket(), tasks, max(WORD_FILES, tasks_of(largest))).sortWithinPartitions("bucket", "token")
    words.write.partitionBy("bucket").parquet(f"{library.path}/words/{name}")
    return {"slices": slices}


_TOKEN = "token string, n long, book_id long, page_num int, position int"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, token, n and first place of the tokens of some pages; from bucket, book_id, page_num and the text."""
    for batch in batches:
        bucket, book, page = (c.to_pylist() for c in batch.columns[:3])
        # In order of their places, as the least struct of _added has it, so that what comes first in the rows comes first.
        place = lambda i: (bucket[i], book[i] or 0, page[i] is not None, page[i] or 0)
        rows = sorted(range(batch.num_rows), key=place)
        at, size = 0, 0
        for k, i in enumerate(rows):
            size += batch.column(3)[i].as_buffer().size if batch.column(3)[i].is_valid else 0
            if k + 1 == len(rows) or size >= TOKEN_CHARS or bucket[rows[k + 1]] != bucket[i]:
                yield _tokens_of(batch.take(pa.array(rows[at : k + 1])))
                at, size = k + 1, 0


def _tokens_of(pages: pa.RecordBatch) -> pa.RecordBatch:
    """The tokens of pages of one bucket in order of their places."""
    texts = [t.as_py() or "" for t in pages.column(3)]
    text = "\n".join(texts)
    for space in " \t\v\f\r":
        text = text.replace(space, "\n")
    words = pc.split_pattern(pa.array([text], pa.large_string()), "\n").values
    start = np.cumsum(np.r_[0, pc.utf8_length(words).to_numpy(zero_copy_only=False) + 1])[:-1]
    coded = words.dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    n = np.bincount(codes, minlength=len(names))
    first = np.empty(len(names), np.int64)
    first[codes[::-1]] = start[::-1]  # the last assignment holds
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    row = np.searchsorted(begins, first, "right") - 1
    some = np.flatnonzero(pc.not_equal(names, "").to_numpy(zero_copy_only=False))
    own, page = row[some], pages.select([0, 1, 2]).take(pa.array(row[some]))
    position = pa.array((first[some] - begins[own]).astype(np.int32))
    names = names.take(pa.array(some)).cast(pa.string())
    return pa.RecordBatch.from_arrays([page.column(0), names, pa.array(n[some], pa.int64()), page.column(1), page.column(2), position], ["bucket", "token", "n", "book_id", "page_num", "position"])


def token_counts(pages: DataFrame, bucket: Column | None = None, tasks: int | None = None, files: int = WORD_FILES) -> DataFrame:
    """token, n and first place (book_id, page_num, position) of each token, by bucket if one is given, on so many tasks.

    Tasks that read pages add up what they see of a token; a bucket's tokens are dealt over ``files`` tasks.
    """
    ship(pages.sparkSession)
    own = F.lit(0).cast("long") if bucket is None else bucket
    texts = pages.select(own.alias("bucket"), "book_id", F.col("page_num").cast("int").alias("page_num"), F.make_valid_utf8("content").alias("text"))
    rows = texts.mapInArrow(_counted, f"bucket long, {_TOKEN}")
    return _added(rows.drop("bucket"), [], tasks) if bucket is None else _added(rows, ["bucket"], tasks, files)


def _added(rows: DataFrame, keys: list[str], tasks: int | None, files: int = WORD_FILES) -> DataFrame:
    """Counts of a token added up, with the least place (no identifier counts as 0)."""
    place = F.struct(F.coalesce("book_id", F.lit(0)).alias("order"), "page_num", "position", "book_id")
    # The least struct is found by sorting, so rows are dealt out before and not sorted twice; a task's share is bounded.
    parts = [*keys, "file"] if keys else ["token"]
    rows = rows.withColumn("file", F.pmod(F.xxhash64("token"), F.lit(files)))
    rows = rows.repartition(*([tasks] if tasks else []), *parts)
    sums = rows.groupBy(*keys, "file", "token").agg(F.sum("n").alias("n"), F.min(place).alias("p"))
    return sums.select(*keys, "token", "n", "p.book_id", "p.page_num", "p.position")


# -- reading ----------------------------------------------------------------------

_BLOCK = "block struct<books:bigint,pages:bigint>"
_ARRAYS = f"{_BLOCK}, pages array<struct<book_id:bigint,page_num:int>>"


def candidates(library: Library, groups: list[str]) -> tuple[DataFrame, list[dict]]:
    """(book_id, page_num of pages that the postings name for all the groups; parts without postings, which must be read)."""
    now = library.manifest()
    bare = [p for p in now["parts"] if p["folder"].split("/")[1] not in now["aids"]]
    found = []
    by_slices: dict[int, list[str]] = {}
    for name, aid in now["aids"].items():
        by_slices.setdefault(aid["slices"], []).append(name)
    for slices, names in by_slices.items():
        paths = [f"{library.path}/grams/{n}/slice={s}" for n in names for s in {_slice(g, slices) for g in groups}]
        paths = [p for p in paths if library.exists(p)]  # a slice without a group has no folder
        if paths:
            found.append(library.spark.read.schema(f"gram string, {_ARRAYS}").parquet(*paths).where(F.col("gram").isin(groups)))
    if not found:
        return library.spark.createDataFrame([], "book_id long, page_num int"), bare
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # The arrays of a block under one group (of several folders), then what all groups share.
    own = rows.groupBy("block", "gram").agg(F.array_distinct(F.flatten(F.collect_list("pages"))).alias("pages"))
    shared = own.groupBy("block").agg(F.collect_list("pages").alias("all")).where(F.size("all") == len(groups))
    common = F.aggregate(F.slice("all", 2, len(groups)), F.element_at("all", 1), lambda a, b: F.array_intersect(a, b))
    return shared.select(F.explode(common).alias("k")).select("k.book_id", "k.page_num"), bare


def pages_at(library: Library, keys: DataFrame, also: list[dict] | None = None, report: dict | None = None) -> DataFrame:
    """The library's pages under the given keys (book_id, page_num), and all pages of the parts ``also``."""
    now = library.manifest()
    keys = stage(keys.select(F.col("book_id").alias("__b"), F.col("page_num").alias("__p")).distinct(), work_dir(library.spark, "keys"))
    n = keys.count()
    books = [r[0] for r in keys.select("__b").distinct().limit(NAMED_BOOKS + 1).collect()]
    buckets = {r[0] for r in keys.select(F.floor(F.coalesce("__b", F.lit(0)) / library.books).alias("b")).distinct().collect()}
    whole = {p["folder"] for p in also or []}
    parts = [p for p in now["parts"] if p["bucket"] in buckets and p["folder"] not in whole]
    rows = library._live(parts, now)
    if len(books) <= NAMED_BOOKS and books:
        rows = rows.where(_any([F.col("book_id").eqNullSafe(F.lit(b)) for b in books]))
    if n <= BROADCAST_KEYS:
        same = F.col("book_id").eqNullSafe(F.col("__b")) & F.col("page_num").eqNullSafe(F.col("__p"))
        rows = rows.join(F.broadcast(keys), same, "left_semi")
    else:
        rows = _met(rows, keys, tasks_of(sum(p["bytes"] for p in parts), JOIN_BYTES))
    if report is not None:
        report |= {"candidates": n, "parts": len(parts) + len(whole), "parts_of": len(now["parts"])}
    return rows.unionByName(library._live(also, now)) if also else rows


def _met(rows: DataFrame, keys: DataFrame, tasks: int) -> DataFrame:
    """Pages whose key (null is one like others) is among the keys, all different; both are dealt over so many tasks, so that what one sorts is bounded.

    Keys differ, so the join is an inner one: one for existence alone would be moved before the dealing.
    """
    def dealt(table: DataFrame, book: str, page: str) -> DataFrame:
        own = [F.coalesce(book, F.lit(0)).alias("__k0"), F.coalesce(page, F.lit(0)).cast("long").alias("__k1"), F.isnull(book).alias("__k2"), F.isnull(page).alias("__k3")]
        return table.select("*", *own).repartition(tasks, *on)

    on = [f"__k{i}" for i in range(4)]
    return dealt(rows, "book_id", "page_num").join(dealt(keys, "__b", "__p").select(*on).hint("merge"), on).select(*rows.columns)


def _any(terms: list[Column]) -> Column:
    """Alternatives as a balanced tree."""
    while len(terms) > 1:
        terms = [terms[i] | terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def dictionary(library: Library, keep=None) -> DataFrame:
    """token, n, book_id, page_num, position of every token of the library; ``keep`` (of a token) chooses."""
    now = library.manifest()
    keep = keep or (lambda token: F.lit(True))
    sound = [p for p in now["parts"] if p["folder"].split("/")[1] in now["aids"] and not library.gone_of(p, now)]
    rest = [p for p in now["parts"] if p not in sound]
    tasks = tasks_of(sum(p["bytes"] for p in now["parts"]))
    rows = library.spark.createDataFrame([], _TOKEN)
    if sound:
        paths = [f"{library.path}/words/{p['folder'].removeprefix('data/')}" for p in sound]
        paths = [p for p in paths if library.exists(p)]  # pages without a token have no folder
        rows = library.spark.read.schema(_TOKEN).parquet(*paths) if paths else rows
        rows = rows.where(keep(F.col("token")))
    if rest:
        rows = rows.unionByName(token_counts(library._live(rest, now), tasks=tasks_of(sum(p["bytes"] for p in rest))).where(keep(F.col("token"))).select(rows.columns))
    return _added(rows, [], tasks)
