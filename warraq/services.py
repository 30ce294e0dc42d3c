"""Services around the library: saved searches, bookmarks, counters, backups, translations."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
from dataclasses import dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Library

SAVED_CAP, CRASH_LOG_CAP, BACKUP_DAYS, STALE_DAYS = 50, 20, 7, 7
SUMMARY_HITS, SUMMARY_CHARS = 10, 140

SAVED_SEARCH = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("query", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("respect_diacritics", T.BooleanType()),
    T.StructField("whole_letters", T.BooleanType()), T.StructField("limit", T.IntegerType()),
    T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("years", T.ArrayType(T.StringType())),
    T.StructField("countries", T.ArrayType(T.StringType())), T.StructField("book_ids", T.ArrayType(T.LongType())),
    T.StructField("view_mode", T.StringType()), T.StructField("time_mode", T.StringType()),
])
_SAVED_DEFAULTS = {"name": "", "query": "", "mode": "WORD", "respect_diacritics": False, "whole_letters": False, "limit": 1000, "view_mode": "CATEGORIES", "time_mode": "DEATH_YEAR"}


def newest(df: DataFrame, by: str, keep: int) -> DataFrame:
    return df.orderBy(F.desc(by)).limit(keep)


def read_saved(raw: DataFrame) -> DataFrame:
    """Saved searches, newest first; rows without id or time go, missing fields take defaults."""
    df = raw.where("id is not null and timestamp is not null").fillna({k: v for k, v in _SAVED_DEFAULTS.items() if k in raw.columns})
    for c in ("categories", "years", "countries", "book_ids"):
        if c in raw.columns:
            df = df.withColumn(c, F.coalesce(c, F.array().cast(raw.schema[c].dataType)))
    return df.orderBy(F.desc("timestamp"))


def add_saved(saved: DataFrame, new: DataFrame) -> DataFrame:
    """With the new ones, the newest of each id, capped."""
    both = saved.unionByName(new, allowMissingColumns=True)
    latest = both.groupBy("id").agg(F.max_by(F.struct(*both.columns), "timestamp").alias("r")).select("r.*")
    return newest(latest, "timestamp", SAVED_CAP)


def delete_saved(saved: DataFrame, id_: str) -> DataFrame:
    return saved.where(F.col("id") != id_)


def clear_saved(saved: DataFrame) -> DataFrame:
    return saved.limit(0)


def saved_results(raw: DataFrame) -> DataFrame:
    """Stored results of saved searches, one row each; those without a book or a term go, missing fields take defaults.

    raw: id and results (array of structs with book_id, page_number, matched_term, match_position, context_snippet).
    """
    rows = raw.where("id is not null").select(F.col("id").alias("search_id"), F.posexplode("results").alias("__i", "r"))
    r = F.col("r")
    return rows.where(r["book_id"].isNotNull() & r["matched_term"].isNotNull()).select(
        "search_id", (F.col("__i") + 1).alias("serial"), r["book_id"].alias("book_id"), F.coalesce(r["page_number"], F.lit(0)).alias("page_number"),
        r["matched_term"].alias("matched_term"), F.coalesce(r["match_position"], F.lit(-1)).alias("match_position"),
        F.coalesce(r["context_snippet"], F.lit("")).alias("context_snippet"),
    )


def summaries(hits: DataFrame, search: str = "search_id") -> DataFrame:
    """The first hits of each saved search with short snippets."""
    order = Window.partitionBy(search).orderBy("serial")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SUMMARY_HITS).withColumn("context_snippet", F.left("context_snippet", F.lit(SUMMARY_CHARS)))


def bookmarks(marks: DataFrame) -> DataFrame:
    """The latest page of each book."""
    return marks.groupBy("book_id").agg(F.max_by("page", F.struct("ts", "page")).alias("page"), F.max("ts").alias("ts"))


def newest_of_each(df: DataFrame, key: str, by: str, keep: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(by))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def telemetry(events: DataFrame, mode: str, day: Column) -> DataFrame:
    """One JSON snapshot: first and last day, searches in all and by mode."""
    by = events.groupBy(mode).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("a"), F.max(day).alias("b"))
    counters = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(mode).isNotNull(), F.struct(mode, "n")))))
    row = by.agg(F.min("a").alias("first_date"), F.max("b").alias("last_date"), F.sum("n").alias("total_searches"), counters.alias("searches_by_mode"))
    return row.select("*", F.to_json(F.struct(*row.columns)).alias("json"))


def backup_due(last: Column, now: Column, days: int = BACKUP_DAYS) -> Column:
    return F.when(last.isNull(), True).otherwise(F.date_diff(now, last) >= days)


def backup_status(enabled: Column, last: Column, now: Column, made: Column | None = None, days: int = BACKUP_DAYS) -> Column:
    """Disabled, NotDue, Created or Failed; made: did the backup that was due succeed?"""
    due = F.when(F.lit(True) if made is None else F.coalesce(made, F.lit(False)), "Created").otherwise("Failed")
    return F.when(~enabled, "Disabled").when(~backup_due(last, now, days), "NotDue").otherwise(due)


def translations(keys: DataFrame, table: DataFrame, locale: str, base: str = "ar") -> DataFrame:
    """Text of each key: the locale's, else the base language's, else the key itself."""
    one = lambda lang, name: table.where(F.col("locale") == lang).select("key", F.col("text").alias(name))
    df = keys.join(one(locale, "__own"), "key", "left").join(one(base, "__base"), "key", "left")
    return df.select("key", F.coalesce("__own", "__base", "key").alias("text"))


def translation_chain(keys: DataFrame, manual: DataFrame, known: DataFrame) -> DataFrame:
    """Build-time texts: by hand, else known for the key, else for the key without marks, else the key."""
    from .functions.text import strip_marks_and_tatweel

    bare = known.groupBy(strip_marks_and_tatweel(F.col("key")).alias("__bare")).agg(F.min("text").alias("__loose"))
    df = keys.join(manual.select("key", F.col("text").alias("__hand")), "key", "left").join(known.select("key", F.col("text").alias("__exact")), "key", "left")
    df = df.join(bare, strip_marks_and_tatweel(F.col("key")) == F.col("__bare"), "left")
    return df.select("key", F.coalesce("__hand", "__exact", "__loose", "key").alias("text"))


def coverage(table: DataFrame, base: str = "ar") -> DataFrame:
    """Share of the base language's keys that each locale has, at most 1."""
    total = table.where(F.col("locale") == base).agg(F.count(F.lit(1)).alias("total"))
    own = table.groupBy("locale").agg(F.count(F.lit(1)).alias("n"))
    return own.join(F.broadcast(total)).select("locale", F.least(F.col("n") / F.nullif("total", F.lit(0)), F.lit(1.0)).alias("coverage"))


# -- plain files on the driver ------------------------------------------------


def run_backup_if_due(library: Library, folder: str, name: str, enabled: bool, last: dt.datetime | None, now: dt.datetime, days: int = BACKUP_DAYS) -> tuple[str, str | None]:
    """(status, path or error): makes the backup when it is due."""
    if not enabled:
        return "Disabled", None
    if last is not None and (now - last).days < days:
        return "NotDue", None
    try:
        return "Created", create_backup(library, folder, name)
    except (OSError, ValueError, PySparkException, Py4JJavaError) as e:
        return "Failed", str(e)


def flush_telemetry(snapshot: DataFrame, path: str, enabled: bool = True) -> bool:
    """Write the one-row snapshot of ``telemetry`` as JSON; nothing where counting is switched off."""
    if not enabled:
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(snapshot.first()["json"])
    return True


def reset_telemetry(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)


def write_import_log(lines: DataFrame, path: str) -> None:
    """The log of an import (see ``importer.log_lines``), a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(r["value"] + "\n" for r in lines.toLocalIterator())


@dataclass
class Preferences:
    """Typed settings with defaults, kept as text; what is no number falls back, numbers are kept in their ranges."""

    results_limit: int = 1000
    parallel_ocr_workers: int = 2
    parallel_text_workers: int = min(max(os.cpu_count() or 2, 2), 8)
    time_mode: str = "death_year"
    locale: str = "ar"
    theme: str = "earthy"
    font_size: str = "M"
    font_family: str = "Sakkal Majalla"
    telemetry_enabled: bool = False
    bundle_imported: bool = False
    auto_backup_enabled: bool = False
    last_backup_at_epoch: int = 0
    last_import_folder_txt: str = ""
    last_import_folder_pdf: str = ""
    split_categories: float = 0.18
    split_books: float = 0.33
    split_display_vertical: float = 0.6

    def __post_init__(self):
        for f in fields(self):
            setattr(self, f.name, _typed(getattr(self, f.name), f.default))
        for name, (low, high) in _RANGES.items():
            setattr(self, name, min(max(getattr(self, name), low), high))
        self.time_mode = self.time_mode if self.time_mode == "usage_date" else "death_year"

    @classmethod
    def of(cls, values: dict) -> Preferences:
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})

    @classmethod
    def load(cls, path: str) -> Preferences:
        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            return cls.of(dict(line.rstrip("\n").split("=", 1) for line in f if "=" in line))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(f"{x.name}={str(getattr(self, x.name)).lower() if isinstance(x.default, bool) else getattr(self, x.name)}\n" for x in fields(self))


_RANGES = {"parallel_ocr_workers": (1, 4), "parallel_text_workers": (1, 16), "split_categories": (0.05, 0.5), "split_books": (0.1, 0.7), "split_display_vertical": (0.2, 0.85)}


def _typed(value, default):
    """The value in the default's type, or the default."""
    if isinstance(default, bool):
        return str(value).lower() == "true"
    try:
        return type(default)(value)
    except (TypeError, ValueError):
        return default


def locale_of(code: str, known: tuple[str, ...] = ("ar", "en", "fr")) -> str:
    return code if code in known else "ar"


# -- backups: libraries of their own, copied by Spark ---------------------------

# Fixed value: data folders as a library names them; a backup that names others is refused.
_OWN_FOLDER = r"(data|gone)/[0-9a-f]+(/bucket=-?[0-9]+)?"
_CHECK_FILE = "backup.json"


def fingerprint(pages: DataFrame) -> dict:
    """Number of rows, and two sums over their hashes that do not depend on their order."""
    hashed = pages.select(F.xxhash64(*sorted(pages.columns)).alias("h"))
    row = hashed.agg(F.count(F.lit(1)).alias("rows"), F.expr("bit_xor(h)").alias("xor"), F.sum(F.col("h").cast("decimal(20, 0)")).cast("string").alias("sum")).first()
    return {k: str(v) for k, v in row.asDict().items()}


def _backup(library: Library, folder: str, name: str) -> Library:
    if not name or name.startswith((".", "_")) or "/" in name:
        raise ValueError(f"no name of a backup: {name!r}")
    return Library(library.spark, f"{folder.rstrip('/')}/{name}", library.books)


def create_backup(library: Library, folder: str, name: str) -> str:
    """A copy of what the library holds now, without deleted books, as a library under ``folder``; its path.

    Tasks copy the pages; what they must add up to is written last, so a backup that broke off is none.
    """
    copy, now = _backup(library, folder, name), library.pages()
    copy.overwrite(now)
    copy.write_note(_CHECK_FILE, json.dumps(fingerprint(now) | {"last": library.last_book_id()}))
    return copy.path


def restore_backup(library: Library, folder: str, name: str) -> None:
    """Replace what the library holds by a backup, in one change.

    Before anything is touched: a backup without a library or a check, one that names folders outside
    itself, and one whose pages do not add up are refused.
    """
    copy = _backup(library, folder, name)
    note = copy.read_note(_CHECK_FILE)
    if note is None or not copy.versions():
        raise ValueError("the backup holds no library")
    now, told = copy.manifest(), json.loads(note)
    for x in now["parts"] + now["gone"]:
        if not re.fullmatch(_OWN_FOLDER, x["folder"]):
            raise ValueError(f"unsafe entry {x['folder']!r}")
    if not copy.healthy() or fingerprint(copy.pages()) != {k: v for k, v in told.items() if k != "last"}:
        raise ValueError("the backup is damaged")
    library.overwrite(copy.pages())


def list_backups(library: Library, folder: str) -> list[str]:
    """Names of whole backups, the last first."""
    return sorted((n for n in library.names_in(folder) if not n.startswith((".", "_")) and _backup(library, folder, n).read_note(_CHECK_FILE) is not None), reverse=True)


def write_crash_log(folder: str, text: str, now: dt.datetime | None = None) -> str:
    """Write one log and keep the newest."""
    os.makedirs(folder, exist_ok=True)
    name = f"crash-{(now or dt.datetime.now()):%Y%m%d-%H%M%S-%f}.log"
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)
    _rotate(folder)
    return name


def _rotate(folder: str) -> None:
    for old in sorted((n for n in os.listdir(folder) if n.startswith("crash-")), reverse=True)[CRASH_LOG_CAP:]:
        os.remove(os.path.join(folder, old))


def crash_logs(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of the logs in a folder, the last first."""
    logs = spark.read.format("binaryFile").option("pathGlobFilter", "crash-*.log").load(folder)
    return logs.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("text")).orderBy(F.desc("name"))


def write_crash_logs(logs: DataFrame, folder: str) -> None:
    """Write a table of logs (columns at, text) as files, and keep the newest of the folder's; of one moment one stays.

    Those that would go at once are not written, so no more than CRASH_LOG_CAP files are made.
    """
    from .sources.text_files import write_text_files

    name = F.concat(F.lit("crash-"), F.date_format("at", "yyyyMMdd-HHmmss-SSSSSS"), F.lit(".log"))
    named = logs.groupBy(name.alias("name")).agg(F.max("text").alias("text"))
    write_text_files(newest(named, "name", CRASH_LOG_CAP), folder)
    _rotate(folder.removeprefix("file://"))


def save_progress(path: str, started: int, pending: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines([f"started={started}\n", *(f"pending={p}\n" for p in pending)])


def load_progress(path: str, now: int) -> list[str] | None:
    """Files left of an interrupted import; None if there is none or it is stale (times in ms)."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        pairs = [line.rstrip("\n").split("=", 1) for line in f if "=" in line]
    started = next((int(v) for k, v in pairs if k == "started"), 0)
    return None if now - started > STALE_DAYS * 86_400_000 else [v for k, v in pairs if k == "pending"]
