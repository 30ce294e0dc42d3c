"""Ranges and predicates of shards, files written by tasks, states of recognition, progress of imports, encodings."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from warraq.sources import files, ocr, shards, text_files
from warraq.store import Library
from warraq.streaming.ingest import ImportControl, ImportListener, import_stream


@pytest.fixture
def shard_folder(tmp_path):
    for number in (1, 2):
        with sqlite3.connect(tmp_path / f"shard_{number:04d}.db") as db:
            db.execute("CREATE TABLE books(id INTEGER PRIMARY KEY, title TEXT)")
            db.execute("CREATE TABLE pages(id INTEGER PRIMARY KEY, book_id INTEGER, page_num INTEGER, content TEXT)")
            db.executemany("INSERT INTO books VALUES (?, ?)", [(b, f"b{b}") for b in range(1, 6)])
            db.executemany("INSERT INTO pages(book_id, page_num, content) VALUES (?, ?, ?)", [(b, p, f"{b}/{p}") for b in range(1, 6) for p in range(1, 41)])
    return str(tmp_path)


def test_a_shard_is_read_by_many_tasks(spark, shard_folder):
    whole = shards.read_shards(spark, shard_folder)[1]
    parts = shards.read_shards(spark, shard_folder, rows=30)[1]
    assert whole.rdd.getNumPartitions() == 2 and parts.rdd.getNumPartitions() == 14
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, parts.collect()), key=repr) and parts.count() == 400


def test_predicates_reach_sqlite(spark, shard_folder):
    reader = shards._PushingReader(shard_folder, "pages", shards._PAGE_COLUMNS, rows=1000)

    class EqualTo:
        def __init__(self, column, value):
            self.attribute, self.value = (column,), value

    class In(EqualTo):
        pass

    class LessThan(EqualTo):
        pass

    class Other(EqualTo):
        pass

    given = [EqualTo("shard", 2), In("book_id", (1, 3)), LessThan("page_num", 5), Other("page_num", 1), EqualTo("content", "x")]
    assert list(reader.pushFilters(given)) == given[3:]
    (part,) = reader.partitions()
    text, values = reader.statement({"book_id", "page_num", "content"}, part)
    assert "book_id IN (?, ?)" in text and "page_num < ?" in text and values == [1, 3, 5, 1, 200]
    assert [r[1:3] for r in reader.read(part)] == [(b, p) for b in (1, 3) for p in (1, 2, 3, 4)]


@pytest.mark.parametrize("push", ["true", "false"])
def test_some_books_of_shards(spark, shard_folder, push):
    before = spark.conf.get(shards.PUSH_DOWN, None)
    spark.conf.set(shards.PUSH_DOWN, push)
    try:
        wanted = [shards.ID_STEP + 2, 2 * shards.ID_STEP + 4]
        books, pages = shards.read_shards(spark, shard_folder, book_ids=wanted)
        assert sorted(r.book_id for r in books.collect()) == wanted
        assert {(r.book_id, r.n) for r in pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(w, 40) for w in wanted}
        assert pages.where("page_num between 3 and 4").count() == 4
    finally:
        spark.conf.unset(shards.PUSH_DOWN) if before is None else spark.conf.set(shards.PUSH_DOWN, before)


def test_files_of_a_job_appear_together(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([(f"{i}.txt", f"نص {i}" if i else None) for i in range(20)], "name string, text string").repartition(4)
    text_files.write_text_files(rows, f"file://{out}")
    assert sorted(p.name for p in out.iterdir()) == sorted(f"{i}.txt" for i in range(20))
    assert (out / "7.txt").read_text(encoding="utf-8") == "نص 7" and (out / "0.txt").read_text() == ""
    # A job that fails, by a name or by a row, leaves nothing; what was there stays.
    for bad in ([("a.txt", "new"), ("../x", "y")], [("a.txt", "1"), ("a.txt", "2")]):
        with pytest.raises(Exception):  # noqa: B017
            text_files.write_text_files(spark.createDataFrame(bad, "name string, text string"), str(out))
        assert sorted(p.name for p in out.iterdir()) == sorted(f"{i}.txt" for i in range(20))


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """Two attempts of one task have written; only one reports."""
    writer, rows = text_files._Writer(str(tmp_path)), [("a", "one"), ("b", "two")]
    attempts = []
    for k in range(2):
        own = tmp_path / "w" / str(k)
        own.mkdir(parents=True)
        for n, t in rows:
            (own / n).write_text(f"{t} {k}")
        attempts.append(text_files._Written(str(own), ["a", "b"]))
    writer.commit([attempts[1], None])
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_file()) == ["a", "b"] and (tmp_path / "a").read_text() == "one 1"


def test_states_of_files(spark):
    lines = [
        (9, '{"event": "done", "file": "a", "txt": "a.txt", "pages": 7}'), (1, '{"event": "start", "file": "a"}'), (3, ' {"event": "progress", "file": "a", "message": "m", "fraction": 0.5} '),
        (2, '{"event": "progress", "file": "a", "message": "l", "fraction": 0.2}'), (4, "noise"), (5, '{"event": "start", "file": "b"}'), (6, '{"event": "error", "file": "b", "error": "x"}'),
        (8, '{"event": "start", "file": "b"}'), (7, '{"event": "warning", "message": "w"}'), (10, '{"event": "other", "file": "a"}'), (11, '{"event": "start", "file": "c"}'),
    ]
    got = {r.file: r for r in ocr.file_states(ocr.parse_events(spark.createDataFrame(lines, "seq long, value string"), keep=("seq",))).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.state, a.fraction, a.message, a.pages, a.txt, a.error, a.starts, a.failures, a.last_seq) == ("done", 1.0, "m", 7, "a.txt", None, 1, 0, 9)
    assert (b.state, b.fraction, b.error, b.starts, b.failures, b.last_seq) == ("running", 0.0, "x", 2, 1, 8) and (c.state, c.starts, c.pages) == ("running", 1, None)


def test_import_is_observed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        (folder / f"{i}.txt").write_text("نص عربي طويل " * (i + 1) if i else "\x00\x01", encoding="utf-8")
    listener, calls = ImportListener(), []
    spark.streams.addListener(listener)
    try:
        lib = Library(spark, str(tmp_path / "lib"))
        control = ImportControl(lambda: import_stream(spark, str(folder), lib, str(tmp_path / "check"), files_per_batch=3, on_batch=lambda *x: (calls.append(x), control.on_batch(*x))))
        control.resume().awaitTermination()
        for _ in range(100):
            if "ended" in listener.states:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (control.done, control.failed, len(calls)) == (6, 1, 3) and [c[0] for c in calls] == [0, 1, 2]
    # Each file was read once, a batch's counts included.
    assert (listener.files, listener.batches, listener.bytes) == (7, 3, sum(p.stat().st_size for p in folder.iterdir())) and listener.states == ["started", "ended"]
    assert lib.pages().select("book_id").distinct().count() == 6


def test_encodings(spark):
    settings = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = [spark.conf.get(k, None) for k in settings]
    text = "نص عربي"
    raw = {"utf-8": text.encode(), "utf-8-sig": text.encode("utf-8-sig"), "cp1256": text.encode("cp1256"), "iso-8859-6": text.encode("iso-8859-6"),
           "utf-16-le": (text + "\U0001f600").encode("utf-16-le"), "utf-16-be": (text + "\U0001f600").encode("utf-16-be")}
    rows = [(e, bytearray(b)) for e, b in raw.items()]
    bad = [("utf-8", b"\xff"), ("iso-8859-6", b"\xa1"), ("utf-16-le", b"a"), ("utf-16-le", b"\x00\xd8a\x00"), ("utf-16-be", b"\xdc\x00"), ("latin-9", b"a"), ("utf-8", None)]
    df = spark.createDataFrame(rows + [(e, None if b is None else bytearray(b)) for e, b in bad], "encoding string, content binary").coalesce(1)
    got = [r.t for r in df.select(files.decode_named(F.col("content"), F.col("encoding")).alias("t")).collect()]
    assert got == [b.decode(e) for e, b in raw.items()] + [None] * len(bad)
    every = bytes(range(256))
    one = spark.createDataFrame([(bytearray(every),)], "c binary").select(files.decode_eight_bit(F.col("c"), "cp1256").alias("a"), files.decode_eight_bit(F.col("c"), "iso-8859-6").alias("b")).first()
    assert one.a == every.decode("cp1256") and one.b == every.decode("iso-8859-6", "replace")
    back = spark.createDataFrame([(every.decode("cp1256") + "漢",)], "t string").select(files.encode_eight_bit(F.col("t"), "cp1256").alias("c")).first().c
    assert bytes(back) == every + b"?"
    assert [spark.conf.get(k, None) for k in settings] == before
