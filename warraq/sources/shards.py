"""Legacy libraries in SQLite shards, read by a Python data source: ranges of rows of a shard are a task each.

Driver and executors must both see the shard files under the same path (a shared
folder), as SQLite opens files by path.
"""

from __future__ import annotations

import os
import re
import sqlite3
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import nonblank
from ..operators.match import without_sentinels
from ..schema import PAGES
from ..work import stage, work_dir

ID_STEP = 10**12
_BOOK_COLUMNS = [
    "id", "title", "author", "category", "year", "death_year", "country", "word_count", "pages_count", "publisher", "edition", "volumes_count", "investigator", "translator",
]
_PAGE_COLUMNS = ["book_id", "page_num", "content", "content_path", "original_page_number"]
#: Rows of a shard that one task reads.
ROWS_A_TASK = 200_000
#: Filters that SQLite can take.
_SIGNS = {"EqualTo": "=", "In": "IN", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"
_TYPES = {"id": "bigint", "book_id": "bigint", "page_num": "int", "word_count": "int", "pages_count": "int"}


def shard_number(path: str) -> int:
    return int(re.search(r"shard_(\d+)\.db$", path)[1])


def find_shards(folder: str) -> list[str]:
    names = sorted(n for n in os.listdir(folder) if re.fullmatch(r"shard_\d+\.db", n))
    if not names:
        raise FileNotFoundError(f"no shard_<number>.db in {folder}")
    return [os.path.join(folder, n) for n in names]


class ShardSource(DataSource):
    """Options: folder; table (books or pages); shards (file names, comma-separated; all without it); rows (a task); push (take filters)."""

    @classmethod
    def name(cls):
        return "warraq_shards"

    def _columns(self):
        return _BOOK_COLUMNS if self.options["table"] == "books" else _PAGE_COLUMNS

    def schema(self):
        return ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in ["shard", *self._columns()]).replace("shard string", "shard int")

    def reader(self, schema):
        only = self.options.get("shards")
        kind = _PushingReader if self.options.get("push") == "true" else _ShardReader
        return kind(self.options["folder"], self.options["table"], self._columns(), only.split(",") if only else None, int(self.options.get("rows", ROWS_A_TASK)))


@dataclass
class _Range(InputPartition):
    """Rows of one shard by their number in the file; without bounds all."""

    path: str
    low: int | None = None
    high: int | None = None


class _ShardReader(DataSourceReader):
    def __init__(self, folder, table, columns, only=None, rows=None):
        self.table, self.columns, self.rows = table, columns, rows or ROWS_A_TASK
        self.paths = [p for p in find_shards(folder) if only is None or os.path.basename(p) in only]
        #: Conditions for SQLite's statement, and their values.
        self.tests: list[str] = []
        self.values: list = []

    def partitions(self):
        out = []
        for path in self.paths:
            try:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            except sqlite3.DatabaseError:  # no row numbers, or no database: what it is shows when it is read
                out.append(_Range(path))
                continue
            out += [_Range(path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)] if low is not None else []
        return out or [_Range("")]

    def statement(self, there: set[str], part: _Range) -> tuple[str, list]:
        """SQLite's statement for a range of rows, and its values."""
        columns = [c if c in there else f"NULL AS {c}" for c in self.columns]
        tests, values = [f"({t})" for t in self.tests], list(self.values)
        if self.table == "pages":
            tests.append("(" + " OR ".join(["length(content) > 0"] + (["length(content_path) > 0"] if "content_path" in there else [])) + ")")
        if part.low is not None:
            tests.append("rowid BETWEEN ? AND ?")
            values += [part.low, part.high]
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        return f"SELECT {', '.join(columns)} FROM {self.table}{where}", values

    def read(self, part):
        if not part.path:
            return
        with sqlite3.connect(f"file:{part.path}?mode=ro", uri=True) as db:
            there = {row[1] for row in db.execute(f"PRAGMA table_info({self.table})")}
            for row in db.execute(*self.statement(there, part)):
                row = list(row)
                if self.table == "pages" and row[3] and row[3].strip():
                    row[2] = _external(os.path.dirname(part.path), row[3].strip()) or row[2]
                texts = [x if x is None or self.columns[i] in _TYPES else str(x) for i, x in enumerate(row)]
                yield (shard_number(part.path), *texts)


class _PushingReader(_ShardReader):
    """For sessions that push filters down; Spark refuses the method where it does not."""

    def pushFilters(self, filters):
        """Comparisons of a column with values go into SQLite's statement, those of ``shard`` choose files; the rest is Spark's."""
        for f in filters:
            column = ".".join(f.attribute) if isinstance(getattr(f, "attribute", None), tuple) else None
            sign = _SIGNS.get(type(f).__name__)
            if column == "shard" and sign in ("=", "IN"):
                wanted = set(f.value) if sign == "IN" else {f.value}
                self.paths = [p for p in self.paths if shard_number(p) in wanted]
            elif column in _TYPES and sign == "IN":
                self.tests.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif column in _TYPES and sign:
                self.tests.append(f"{column} {sign} ?")
                self.values.append(f.value)
            else:
                yield f


def _external(folder: str, name: str) -> str | None:
    """Text of an outside file, absolute or under content/ or the shard's folder; None if blank or missing."""
    for path in ([name] if os.path.isabs(name) else [os.path.join(folder, "content", name), os.path.join(folder, name)]):
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                text = f.read()
            return text if text.strip() else None
    return None


def read_shards(spark: SparkSession, folder: str, only: list[str] | None = None, book_ids: list[int] | None = None, rows: int = ROWS_A_TASK) -> tuple[DataFrame, DataFrame]:
    """(books, pages) with global identifiers: shard * 10^12 + local identifier; of some shards or books only, if asked for.

    rows: how many of a shard one task reads.  Where the session has PUSH_DOWN on, conditions on shards, books and pages reach SQLite.
    """
    spark.dataSource.register(ShardSource)
    names = ",".join(map(os.path.basename, only)) if only is not None else ""
    push = spark.conf.get(PUSH_DOWN, "false")
    read = lambda t: spark.read.format("warraq_shards").option("folder", folder).option("table", t).option("shards", names).option("rows", rows).option("push", push).load()
    books, pages = read("books"), read("pages")
    if book_ids is not None:
        # Of the local identifiers, as the source has them; what is left too many is taken out by the global ones.
        local, numbers = sorted({i % ID_STEP for i in book_ids}), sorted({i // ID_STEP for i in book_ids})
        books = books.where(F.col("shard").isin(numbers) & F.col("id").isin(local))
        pages = pages.where(F.col("shard").isin(numbers) & F.col("book_id").isin(local))
    books = books.withColumn("book_id", F.col("shard").cast("long") * ID_STEP + F.col("id"))
    pages = pages.withColumn("book_id", F.col("shard").cast("long") * ID_STEP + F.col("book_id"))
    if book_ids is not None:
        books, pages = (t.where(F.col("book_id").isin(book_ids)) for t in (books, pages))
    return books, pages


def page_rows(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with their book's metadata; pages without a book or without text go.

    The books are the small side; Spark broadcasts them while their size allows.
    """
    meta = books.select("book_id", F.col("title").alias("book_title"), "author", "category", "year", "death_year", nonblank(F.col("country")).alias("country"))
    text = without_sentinels(F.col("content"))
    df = pages.where(nonblank(F.col("content")).isNotNull()).withColumn("content", text).join(meta, "book_id")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in PAGES.fields])


def migration_totals(books: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: shards, books, pages."""
    left = books.agg(F.count_distinct("shard").alias("shards"), F.count(F.lit(1)).alias("books"))
    return left.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("pages"))))


@dataclass(frozen=True)
class Migration:
    shard_count: int
    total_books: int
    total_pages: int
    total_errors: int
    on_disk: int


#: Shards that are read side by side and committed together.
SHARDS_A_COMMIT = 64


def migrate(spark: SparkSession, folder: str, library, shards_a_commit: int = SHARDS_A_COMMIT, on_commit=None) -> Migration:
    """Replace a library by the shards of a folder, and count what is there in the end.

    A shard that cannot be read counts as an error and is left out.
    """
    paths = find_shards(folder)
    readable = [p for p in paths if _opens(p)]
    library.overwrite(spark.createDataFrame([], PAGES))
    n_books = n_pages = 0
    for a in range(0, len(readable), shards_a_commit):
        numbers = [shard_number(p) for p in readable[a : a + shards_a_commit]]
        own_books, own_pages = read_shards(spark, folder, readable[a : a + shards_a_commit])
        rows = stage(page_rows(own_books, own_pages), work_dir(spark, "migration"))
        library.append(rows)
        n_books, n_pages = n_books + own_books.count(), n_pages + rows.count()
        if on_commit:
            on_commit(numbers, n_books, n_pages)
    library.drop_old_versions()
    on_disk = library.pages().count()
    if on_disk < n_pages:
        raise RuntimeError(f"{n_pages} pages were written and {on_disk} are there")
    return Migration(len(paths), n_books, n_pages, len(paths) - len(readable), on_disk)


def _opens(path: str) -> bool:
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            return {"books", "pages"} <= {r[0] for r in db.execute("SELECT name FROM sqlite_master")}
    except sqlite3.DatabaseError:
        return False


def load_symbols(path: str) -> dict[str, str]:
    """Pattern symbols from map_data(key, value); the last of a key wins, nulls are left out."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return {k: v for k, v in db.execute("SELECT key, value FROM map_data") if k is not None and v is not None}
