"""The stored library: Parquet pages in buckets of neighbouring books, with deletion by tombstones and tiered compaction.

A library is a folder of data folders and of numbered manifests.  A manifest names the
data folders of each bucket, and tables of deleted books.  A change writes new folders and then one manifest
under the next number, which can be made once only: who comes second reads the newest manifest and applies
its change to that one.  So a change is there as a whole or not at all, two changes at the same
time are both kept, and a failed write leaves the last manifest readable.

A bucket holds ``books`` neighbouring identifiers, so a range of books is a range of buckets,
an append touches the last ones, and point lookups one.  Each data folder has the number of the
change that added it.  Deleting writes identifiers only: a table of them counts for folders added before it, at reading, and
is folded in by compaction, which merges a bucket's small folders and bounds what a task writes.

Paths go through Hadoop's file system, wherever Spark can write and an existing file is not replaced by a rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import nonblank, strip_diacritics
from .schema import PAGES

#: Identifiers a bucket: a folder each, which costs the driver a listing.
BOOKS = 8192
#: Neighbouring books of a bucket that one task writes, as one file.
BOOKS_A_TASK = 256
#: Folders of about one size (within a factor of TIER) that a bucket may have before they are merged.
COMPACT_FILES, TIER = 4, 4
#: Bytes that one task of a compaction reads, about; folders of more are left alone.
TASK_BYTES = 256 << 20
#: Pages of one book that a task writes, so that a very long book is the work of several.
PAGES_A_TASK = 1 << 16
#: Rows of a Parquet page: readers skip pages without a wanted book.
_ROWS = 64
#: Deleted identifiers up to this number are broadcast at reading.
BROADCAST_GONE = 1_000_000
#: Attempts to commit while others do.
ATTEMPTS = 50
# Fixed value: the name of the file with the last identifier.
MAX_ID_FILE = "bookid.max"
# What Spark and Hadoop say of files that are gone or no Parquet.
_DAMAGE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "FileNotFoundException")


class Conflict(RuntimeError):
    """Another change took what this one rests on."""


class Library:
    def __init__(self, spark: SparkSession, path: str, books: int = BOOKS):
        self.spark, self.path, self.books = spark, path.rstrip("/"), books

    # -- files --------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def make_folder(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.mkdirs(p)

    def _status(self, folder: str) -> list:
        fs, p = self._fs(folder)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._status(folder))

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _new(self, path: str, text: str):
        """(file system, file) with the text under a name of its own beside ``path``."""
        fs, new = self._fs(f"{path}.{uuid.uuid4().hex[:8]}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return fs, new

    def _replace(self, path: str, text: str) -> None:
        fs, new = self._new(path, text)
        _, target = self._fs(path)
        fs.delete(target, False)
        fs.rename(new, target)

    def _make(self, path: str, text: str) -> bool:
        """The whole file appears at once, unless there is one of the name already; did it?"""
        jvm = self.spark.sparkContext._jvm
        fs, new = self._new(path, text)
        _, target = self._fs(path)
        try:
            if fs.getUri().getScheme() == "file":
                # A rename replaces a local file; a second name for one does not.
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(new))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(new, target, options)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            fs.delete(new, False)

    def names_in(self, folder: str) -> list[str]:
        """Names in a folder; none where it is not there."""
        return self._names(folder)

    def write_note(self, name: str, text: str) -> None:
        """A small file beside the data."""
        self._replace(f"{self.path}/{name}", text)

    def read_note(self, name: str) -> str | None:
        path = f"{self.path}/{name}"
        return self._read(path) if self.exists(path) else None

    # -- manifests ------------------------------------------------------------
    def versions(self) -> list[str]:
        return [n for n in self._names(f"{self.path}/_manifests") if n.endswith(".json")]

    def manifest(self) -> dict:
        """parts: data folders with their bucket, number, files and bytes; gone: tables of deleted books; aids: what is
        kept beside data folders to find pages; indexed: are aids to be kept; marks: what imports have added; schema: of the pages."""
        names = self.versions()
        if names:
            return json.loads(self._read(f"{self.path}/_manifests/{names[-1]}"))
        return {"number": 0, "parts": [], "gone": [], "aids": {}, "indexed": False, "marks": {}, "schema": PAGES.jsonValue()}

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Apply a change to the newest manifest, again if another was made meanwhile; None changes nothing."""
        for _ in range(ATTEMPTS):
            old = self.manifest()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return False
            new["number"] = old["number"] + 1
            live = {p["folder"].split("/")[1] for p in new["parts"]}
            new["aids"] = {n: a for n, a in new["aids"].items() if n in live}
            if self._make(f"{self.path}/_manifests/{new['number']:08d}.json", json.dumps(new)):
                return True
        raise Conflict(f"others kept changing {self.path}")

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(self.manifest()["schema"])

    # -- buckets ----------------------------------------------------------------
    def bucket_of(self, book_id: int | None) -> int:
        return (book_id or 0) // self.books

    def _bucket(self) -> Column:
        return F.floor(F.coalesce(F.col("book_id"), F.lit(0)) / self.books).cast("long")

    def _store(self, pages: DataFrame, pieces: dict[int, int] | None = None) -> list[dict]:
        """Write rows as a new data folder; its part in each bucket.  pieces: the number of tasks for each bucket, if they are to be bounded."""
        name = uuid.uuid4().hex[:12]
        rows = pages.withColumn("bucket", self._bucket())
        # Rows of neighbouring books in one place, sorted by book: ranges of row groups and pages serve lookups.
        if pieces is None:
            # However few partitions the session's shuffles have, one that is large is split: what a task sorts does not grow with the input.
            rows = rows.withColumns({"__books": F.floor(F.col("book_id") / BOOKS_A_TASK), "__pages": F.floor(F.col("page_num") / PAGES_A_TASK)})
            rows = rows.hint("rebalance", "bucket", "__books", "__pages").drop("__books", "__pages")
        else:
            ends = list(accumulate(pieces.values()))
            own = [(b, end - n, n) for (b, n), end in zip(pieces.items(), ends, strict=True)]
            own = self.spark.createDataFrame(own, "bucket long, __first int, __n int")  # one row a bucket that is written
            task = F.col("__first") + F.pmod(F.xxhash64("book_id", F.floor(F.col("page_num") / 64)), F.col("__n")).cast("int")
            rows = rows.join(F.broadcast(own), "bucket").repartitionById(ends[-1], task).drop("__first", "__n")
        rows = rows.sortWithinPartitions("bucket", "book_id", "page_num")
        rows.write.option("parquet.page.row.count.limit", _ROWS).partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        return [self._part(f"data/{name}/{n}") for n in self._names(f"{self.path}/data/{name}") if n.startswith("bucket=")]

    def _part(self, folder: str) -> dict:
        fs, p = self._fs(f"{self.path}/{folder}")
        all_of = fs.getContentSummary(p)  # one answer a folder, however many files
        return {"bucket": int(folder.rsplit("=", 1)[1]), "folder": folder, "files": all_of.getFileCount(), "bytes": all_of.getLength()}

    def drop_old_versions(self) -> None:
        """Delete manifests but the last, and folders that it does not name."""
        now = self.manifest()
        keep = {p["folder"].split("/")[1] for p in now["parts"]} | {g["folder"].split("/")[1] for g in now["gone"]}
        doomed = [f"_manifests/{n}" for n in self.versions()[:-1]]
        doomed += [f"{kind}/{n}" for kind in ("data", "gone", "grams", "words") for n in self._names(f"{self.path}/{kind}") if n not in keep]
        for n in doomed:
            fs, p = self._fs(f"{self.path}/{n}")
            fs.delete(p, True)

    # -- reading ------------------------------------------------------------
    def _table(self, folders: Iterable[str]) -> DataFrame:
        """Rows of data folders as they were written."""
        paths = [f"{self.path}/{f}" for f in folders]
        if not paths:
            return self.spark.createDataFrame([], self._schema())
        # The schema is known and the bucket in a folder's name no part of it: no file is opened for planning.
        return self.spark.read.schema(self._schema()).parquet(*paths)

    def gone_of(self, part: dict, manifest: dict) -> tuple[int, ...]:
        """Places in ``gone`` of the tables that count for a data folder."""
        return tuple(i for i, g in enumerate(manifest["gone"]) if g["number"] > part["number"] and part["bucket"] in g["buckets"])

    def _live(self, parts: list[dict], manifest: dict) -> DataFrame:
        """Rows of parts without deleted books."""
        groups: dict[tuple[int, ...], list[str]] = {}
        for p in parts:
            groups.setdefault(self.gone_of(p, manifest), []).append(p["folder"])
        tables = []
        for gone, folders in groups.items():
            rows = self._table(folders)
            if gone:
                tombs = [manifest["gone"][i] for i in gone]
                ids = self.spark.read.schema("__gone long").parquet(*[f"{self.path}/{g['folder']}" for g in tombs])
                few = sum(g["n"] for g in tombs) <= BROADCAST_GONE
                rows = rows.join(F.broadcast(ids) if few else ids, F.col("book_id").eqNullSafe(F.col("__gone")), "left_anti")
            tables.append(rows)
        return reduce(DataFrame.unionByName, tables) if tables else self._table([])

    def parts(self, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> list[dict]:
        wanted = None if buckets is None else set(buckets)
        return [p for p in (manifest or self.manifest())["parts"] if wanted is None or p["bucket"] in wanted]

    def pages(self, buckets: Iterable[int] | None = None) -> DataFrame:
        now = self.manifest()
        return self._live(self.parts(buckets, now), now)

    def pages_of(self, book_id: int) -> DataFrame:
        """Pages of one book, from its bucket alone."""
        return self.pages([self.bucket_of(book_id)]).where(F.col("book_id") == book_id)

    def healthy(self) -> bool:
        """Is there a manifest whose files can be opened?  Errors that say nothing of the files are raised."""
        if not self.versions():
            return False
        try:
            now = self.manifest()
            folders = [x["folder"] for x in now["parts"] + now["gone"]]
        except (json.JSONDecodeError, KeyError):
            return False
        if not all(self.exists(f"{self.path}/{f}") for f in folders):
            return False
        try:
            self.pages().limit(1).collect()
        except (AnalysisException, PySparkException, Py4JJavaError) as e:
            if any(x in str(e) for x in _DAMAGE):
                return False
            raise
        return True

    def ensure(self, rebuild) -> bool:
        """Rebuild from ``rebuild()`` (page rows) unless healthy; was it rebuilt?"""
        if self.healthy():
            return False
        self.overwrite(rebuild())
        return True

    # -- identifiers ------------------------------------------------------------
    def last_book_id(self) -> int:
        """From the file beside the pages; where there is none, from a scan, which writes it."""
        path = f"{self.path}/{MAX_ID_FILE}"
        if self.exists(path):
            text = self._read(path).strip()
            if text.isascii() and text.isdigit():
                return int(text)
        return self._persist_last_id(self.pages())

    def _persist_last_id(self, pages: DataFrame, least: int = 0) -> int:
        last = max(least, int(pages.agg(F.coalesce(F.max("book_id"), F.lit(0)).alias("m")).first()["m"]))
        self._replace(f"{self.path}/{MAX_ID_FILE}", str(last))
        return last

    # -- changes ------------------------------------------------------------
    def append(self, pages: DataFrame, nodiac: bool = True, mark: tuple[str, int] | None = None) -> bool:
        """Add page rows; blank countries are missing ones.

        mark: (name, number) of an import's batch, kept by the same manifest that adds the rows; a
        number that is there already adds nothing.  Were rows added?
        """
        known = lambda m: bool(mark) and m["marks"].get(mark[0], -1) >= mark[1]
        if known(self.manifest()):
            return False
        rows = pages.withColumn("country", nonblank(F.col("country")))
        if nodiac:
            rows = rows.withColumn("content_nodiac", strip_diacritics(F.col("content")))
        parts = self._store(rows)
        last = self.last_book_id()
        aids = self._make_aids(parts, rows.schema) if self.manifest()["indexed"] else {}

        def change(m: dict) -> dict | None:
            if known(m):
                return None
            old = T.StructType.fromJson(m["schema"])
            fields = old.fields + [f for f in rows.schema.fields if f.name not in old.names]
            added = [p | {"number": m["number"] + 1} for p in parts]
            marks = m["marks"] | ({mark[0]: mark[1]} if mark else {})
            return m | {"parts": m["parts"] + added, "marks": marks, "aids": m["aids"] | aids, "schema": T.StructType(fields).jsonValue()}

        if not self._commit(change):
            return False
        self._persist_last_id(self._table([p["folder"] for p in parts]), last)
        return True

    def delete_books(self, book_ids: Iterable[int]) -> int:
        """Pages removed; only the identifiers are written."""
        wanted = sorted(set(book_ids))
        buckets = sorted({self.bucket_of(i) for i in wanted})
        ids = self.spark.createDataFrame([(i,) for i in wanted], "__gone long")
        here = self.pages(buckets).join(F.broadcast(ids), F.col("book_id") == F.col("__gone"), "left_semi").select("book_id")
        gone = here.count() if wanted else 0
        if gone:
            folder = f"gone/{uuid.uuid4().hex[:12]}"
            ids.coalesce(1).write.parquet(f"{self.path}/{folder}")
            self._commit(lambda m: m | {"gone": m["gone"] + [{"folder": folder, "number": m["number"] + 1, "n": len(wanted), "buckets": buckets}]})
        return gone

    def delete_book(self, book_id: int) -> int:
        return self.delete_books([book_id])

    def clear(self) -> None:
        self._commit(lambda m: m | {"parts": [], "gone": []})

    def overwrite(self, pages: DataFrame) -> int:
        """Replace everything and count what was written."""
        parts = self._store(pages)
        aids = self._make_aids(parts, pages.schema) if self.manifest()["indexed"] else {}
        self._commit(
            lambda m: m | {"parts": [p | {"number": m["number"] + 1} for p in parts], "gone": [], "marks": {}, "aids": aids, "schema": pages.schema.jsonValue()}
        )
        self._persist_last_id(self.pages())
        return self.pages().count()

    # -- compaction -------------------------------------------------------------
    def merges(self) -> dict[int, list[dict]]:
        """The parts of each bucket that a compaction would merge.

        Parts with deleted books are written again; of the others those of one size tier, once there are
        more than COMPACT_FILES of these folders, and parts over TASK_BYTES never.
        """
        now, own = self.manifest(), {}
        for p in now["parts"]:
            own.setdefault(p["bucket"], []).append(p)
        plan = {}
        for bucket, parts in own.items():
            chosen = [p for p in parts if self.gone_of(p, now)]
            tiers: dict[int, list[dict]] = {}
            for p in parts:
                if p not in chosen and p["bytes"] <= TASK_BYTES:
                    tiers.setdefault(p["bytes"].bit_length() // (TIER.bit_length() - 1), []).append(p)
            small: list[dict] = []
            for _, tier in sorted(tiers.items()):
                small += tier  # what smaller tiers merge to may fill this one
                if len(small) > COMPACT_FILES:
                    chosen, small = chosen + small, []
            if chosen:
                plan[bucket] = chosen
        return plan

    def compact(self) -> int:
        """Merge what ``merges`` names; other buckets are not read.  How many buckets were written again?"""
        plan = self.merges()
        before = self.manifest()
        if plan:
            old = {p["folder"] for parts in plan.values() for p in parts}
            rows = self._live([p for p in before["parts"] if p["folder"] in old], before)
            parts = self._store(rows, {b: max(1, -(-sum(p["bytes"] for p in parts) // TASK_BYTES)) for b, parts in plan.items()})
            aids = self._make_aids(parts, self._schema()) if before["indexed"] else {}

            def change(m: dict) -> dict:
                if not old <= {p["folder"] for p in m["parts"]}:
                    raise Conflict("parts were merged or removed meanwhile")
                rest = [p for p in m["parts"] if p["folder"] not in old]
                # Rows keep the number of what they were read under: a deletion made meanwhile counts for them.
                return m | {"parts": rest + [p | {"number": before["number"]} for p in parts], "aids": m["aids"] | aids}

            self._commit(change)
        self._commit(self._without_done_tombs)
        return len(plan)

    def _without_done_tombs(self, m: dict) -> dict | None:
        used = {i for p in m["parts"] for i in self.gone_of(p, m)}
        return None if len(used) == len(m["gone"]) else m | {"gone": [g for i, g in enumerate(m["gone"]) if i in used]}

    # -- aids to find pages -------------------------------------------------------
    def _make_aids(self, parts: list[dict], schema: T.StructType) -> dict:
        from . import aids

        if not parts:
            return {}
        pages = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p['folder']}" for p in parts])
        name = parts[0]["folder"].split("/")[1]
        return {name: aids.write(self, pages, name, sum(p["bytes"] for p in parts), max(p["bytes"] for p in parts))}

    def index(self) -> None:
        """Keep aids from now on, and make those of what is there."""
        now = self.manifest()
        own: dict[str, list[dict]] = {}
        for p in now["parts"]:
            own.setdefault(p["folder"].split("/")[1], []).append(p)
        made = {}
        for name, parts in own.items():
            if name not in now["aids"]:
                made |= self._make_aids(parts, self._schema())
        self._commit(lambda m: m | {"aids": m["aids"] | made, "indexed": True})
