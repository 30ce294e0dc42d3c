"""Rendering, statistics, selections and services."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from warraq import services
from warraq.functions import text as T
from warraq.operators import library, render, stats
from warraq.plans.samples import sample_pages
from warraq.schema import PAGES, UNCLASSIFIED
from warraq.sources import ocr


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def test_highlighting(spark):
    t = F.col("t")
    assert [(s.text, s.is_match) for s in one(spark, "بسم الله الرحمن", render.highlight_segments(t, "الله"))] == [("بسم ", False), ("الله", True), (" الرحمن", False)]
    assert one(spark, "<script>alert(1)</script>", render.to_html(t, "alert")) == "&lt;script&gt;<mark>alert</mark>(1)&lt;/script&gt;"
    assert len(one(spark, "a " * 150, render.highlight_segments(t, "a"))) == 200
    s = one(spark, "x" * 200 + "HIT" + "y" * 200, render.snippet_around(t, "HIT"))
    assert s == "…" + "x" * 80 + "HIT" + "y" * 80 + "…" and one(spark, "none", render.snippet_around(t, "HIT")) is None
    assert one(spark, "a b c\nd HIT e f", render.context_window(t, F.lit("HIT"), 2, 1)) == "c d HIT e"


def test_export_snippet(spark):
    words = [f"w{i}" for i in range(100)]
    page = " ".join(words)
    got = one(spark, page, render.export_snippet(F.col("t"), F.lit("w50"), F.lit("fall")))
    assert got == "… " + " ".join(words[20:81]) + " …"
    assert one(spark, "abc", render.export_snippet(F.col("t"), F.lit("zz"), F.lit("fall"))) == "fall"


def test_statistics(spark):
    p = sample_pages(spark)
    assert {(r.category, r.books) for r in stats.by_category(p).collect()} == {("__ALL_BOOKS__", 4), ("اللغة", 3), ("الحديث", 1)}
    assert {(r.year, r.books) for r in stats.by_year(p).collect()} == {(UNCLASSIFIED, 4)}
    total = stats.totals(p).first()
    assert (total.total_books, total.total_pages, total.author_count) == (4, 4, 0)
    empty = p.limit(0)
    assert stats.totals(empty).first().total_books == 0 and stats.max_book_id(empty).first().max_book_id == 0


def test_statistics_from_one_scan(spark):
    from warraq.plans.samples import sample_library_pages

    p = sample_library_pages(spark)
    found = stats.aggregate_all(p)
    total = found.totals.first()
    assert (total.total_books, total.total_pages, total.author_count) == (6, 8, 4) and total == stats.totals(p).first()
    for one_scan, own in ((found.by_category, stats.by_category(p)), (found.by_year, stats.by_year(p)), (found.by_region, stats.by_region(p))):
        assert sorted(map(tuple, one_scan.collect())) == sorted(map(tuple, own.collect()))
    titles = [r.book_title for r in found.books.collect()]
    assert titles == sorted(titles) == [r.book_title for r in stats.books_by_title(p).collect()] and len(titles) == 6
    assert stats.aggregate_all(p.limit(0)).totals.first().total_books == 0


def test_telemetry_files(spark, tmp_path):
    events = spark.createDataFrame([("word", "2026-01-01"), ("word", "2026-01-03")], "mode string, day string")
    path = str(tmp_path / "t" / "telemetry.json")
    snapshot = services.telemetry(events, "mode", F.col("day"))
    assert not services.flush_telemetry(snapshot, path, enabled=False) and services.flush_telemetry(snapshot, path)
    assert '"total_searches":2' in open(path, encoding="utf-8").read()
    services.reset_telemetry(path)
    assert not os.path.exists(path)


def test_selections(spark):
    b = stats.books(sample_pages(spark))
    pick = lambda view, *chosen: library.Selection(view, frozenset(chosen), frozenset({"a", "b"}))
    assert library.visible_books(b, pick("category")).count() == 0
    assert library.visible_books(b, pick("category", "__ALL_BOOKS__")).count() == 4
    assert library.visible_books(b, pick("year", UNCLASSIFIED)).count() == 4
    assert library.effective_filter(pick("category", "a", "b")) is None
    assert library.effective_filter(pick("category", UNCLASSIFIED)) == ("غير مصنّف",)
    assert library.effective_filter(pick("year", UNCLASSIFIED)) is None


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, 'a,"b"', T.csv_escape(t)) == '"a,""b"""'
    assert one(spark, "/x/y.z/book.one.txt", T.base_name(t)) == "book.one"
    for a, b, c in (("v1.2", "1.2.1", -1), ("1.2.3-4", "1.2.3-5", -1), ("1.2-1", "1.2", 1), ("1.0.1-beta", "1.0.1", 0), ("1.0-beta", "1.0", 0)):
        assert one(spark, a, T.compare_versions(t, F.lit(b))) == c
    assert [one(spark, n, T.human_size(t.cast("long"))) for n in ("5", "2047", "5000000", "1610612736")] == ["5 B", "1 KB", "4 MB", "1.5 GB"]
    b = one(spark, "كِتـاب😀x", T.bare_with_places(t))
    assert b.text == "كتاب😀x" and b.places == [0, 2, 4, 5, 6, 7]
    assert one(spark, "2000-01-01", T.hijri_date(t.cast("date"))) in ("1420-09-24", "1420-09-25")
    assert one(spark, "", T.looks_valid(t)) is False and one(spark, "plain ascii", T.looks_valid(t)) is True


def test_backups(spark, tmp_path):
    from warraq.store import Library

    page = lambda i, text: (i, 1, None, text, f"b{i}", "", "c", "1", "1", None)
    rows = lambda *own: spark.createDataFrame([page(*r) for r in own], PAGES)
    held = lambda lib: sorted((r.book_id, r.content) for r in lib.pages().collect())
    lib, folder = Library(spark, f"file://{tmp_path}/lib"), f"file://{tmp_path}/backups"
    assert services.list_backups(lib, folder) == []
    lib.append(rows((1, "a"), (300, "b"), (2, "c")))
    lib.delete_book(2)
    assert services.create_backup(lib, folder, "b1") == f"{folder}/b1"
    lib.append(rows((4, "d")))
    services.create_backup(lib, folder, "b2")
    lib.clear()
    services.restore_backup(lib, folder, "b1")
    assert held(lib) == [(1, "a"), (300, "b")] and services.list_backups(lib, folder) == ["b2", "b1"]
    # Nothing of the library changes where a backup is missing, damaged or leads elsewhere.
    backup = Library(spark, f"{folder}/b2")
    newest = tmp_path / "backups" / "b2" / "_manifests" / backup.versions()[-1]
    good = newest.read_text()
    (tmp_path / "backups" / "b2" / "_manifests" / f".{newest.name}.crc").unlink(missing_ok=True)
    newest.write_text(good.replace('"data/', '"../lib/data/'))
    with pytest.raises(ValueError, match="unsafe entry"):
        services.restore_backup(lib, folder, "b2")
    newest.write_text(json.dumps(json.loads(good) | {"parts": json.loads(good)["parts"][:1]}))
    with pytest.raises(ValueError, match="damaged"):
        services.restore_backup(lib, folder, "b2")
    for name, said in (("none", "holds no library"), ("../lib", "no name of a backup"), ("", "no name of a backup")):
        with pytest.raises(ValueError, match=said):
            services.restore_backup(lib, folder, name)
    assert held(lib) == [(1, "a"), (300, "b")]
    now_ = dt.datetime(2026, 1, 10)
    due = lambda last, enabled=True, name="auto": services.run_backup_if_due(lib, folder, name, enabled, last, now_)[0]
    assert [due(None, False), due(dt.datetime(2026, 1, 5)), due(dt.datetime(2026, 1, 1)), due(None), due(None, name="a/b")] == ["Disabled", "NotDue", "Created", "Created", "Failed"]
    empty = Library(spark, f"file://{tmp_path}/empty")
    services.create_backup(empty, folder, "b3")
    services.restore_backup(lib, folder, "b3")
    assert held(lib) == []


def test_logs_of_a_table(spark, tmp_path):
    logs = lambda a, b: spark.range(a, b).selectExpr("timestamp_seconds(id) as at", "string(id) as text")
    folder = f"file://{tmp_path}/many"
    for a, b in ((0, 30), (25, 40), (3, 4)):
        services.write_crash_logs(logs(a, b), folder)
    assert [int(r.text) for r in services.crash_logs(spark, folder).collect()] == list(range(39, 19, -1))


def test_services(spark, tmp_path):
    for i in range(25):
        services.write_crash_log(str(tmp_path / "logs"), "x", dt.datetime(2026, 1, 1, 0, 0, i))
    assert len(os.listdir(tmp_path / "logs")) == 20
    services.save_progress(str(tmp_path / "p"), 1000, ["a", "b"])
    assert services.load_progress(str(tmp_path / "p"), 2000) == ["a", "b"] and services.load_progress(str(tmp_path / "p"), 10**12) is None
    p = services.Preferences.of({"parallel_ocr_workers": "9", "results_limit": "many", "time_mode": "usage_date", "auto_backup_enabled": "TRUE", "split_books": "0.01"})
    assert (p.parallel_ocr_workers, p.results_limit, p.time_mode, p.auto_backup_enabled, p.split_books) == (4, 1000, "usage_date", True, 0.1)
    p.save(str(tmp_path / "prefs"))
    assert services.Preferences.load(str(tmp_path / "prefs")) == p and services.Preferences.load(str(tmp_path / "none")) == services.Preferences()
    now = F.lit("2026-01-08").cast("date")
    assert one(spark, "2026-01-01", services.backup_due(F.col("t").cast("date"), now)) is True


def test_ocr_stage(spark):
    df = spark.createDataFrame([("/x/book.pdf", bytearray(b"p" * 2000))], "path string, content binary")
    row = ocr.recognize(df, lambda data: len(data), lambda data, a, b: f"{a}-{b}", wait=lambda s: None).first()
    assert (row.output, row.text, row.chunks, row.failed) == ("book_ocr.txt", "0-950\n950-1900\n1900-2000", 3, 0)


def test_entry_without_the_training_operators(tmp_path):
    """On a copy without both folders the entry imports and has the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "warraq"), tmp_path / "warraq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mat_word' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


@pytest.mark.parametrize("name", ["mat_word", "agg_by_year", "sca_export30", "joi_migrate"])
def test_queries_run(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
