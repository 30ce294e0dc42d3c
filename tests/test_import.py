"""Headers, pages, page numbers, files, shards and the stored library."""

import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from warraq import exports
from warraq.sources import files, headers, importer, page_numbers, pages, shards, text_files
from warraq.store import Library
from warraq.streaming.ingest import import_stream


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def test_header_stops_at_category(spark):
    text = "[الكتاب]: س\n[عدد الصفحات]: ١٬٢\n[المترجم]: ا\n[المترجم]: ب\n[التصنيف]: فقه\n[المؤلف]: لا"
    h = one(spark, text, headers.header(F.col("t"), F.lit("name")))
    assert (h.title, h.author, h.category, h.year) == ("س", "مؤلف غير معروف", "فقه", "0000")
    assert h.dynamic == {"المترجم": "ب"} and h.word_count > 0


def test_pages_by_words(spark):
    word = "كلمة "
    lines = [word * n for n in (120, 150, 60, 10, 400, 5)]
    got = one(spark, "\n".join(lines), pages.split_pages(F.col("t")))
    assert [p.content.count("كلمة") for p in got] == [270, 70, 400, 5]
    assert [p.content for p in one(spark, "", pages.split_pages(F.col("t")))] == [""]


def test_pages_by_markers(spark):
    got = one(spark, "قبل\n==== ١٢ ====\nا\n==== 13 ====\n \n==== 14 ====\nب", pages.split_pages(F.col("t")))
    assert [(p.content, p.original_page_number) for p in got] == [("قبل", None), ("ا", "12"), ("ب", "14")]
    assert len(one(spark, "==== 1 ====", pages.split_pages(F.col("t")))) == 1


def test_page_number_chains(spark):
    text = "1\nنص\n2\n\n3\n(5)\n٢ - نص\n7 عنوان\nآخر"
    m = one(spark, text, page_numbers.marked(F.col("t")))
    assert (m.marked, m.strict, m.first, m.last) == (5, 4, 1, 7)
    assert f"{page_numbers.BAR} 7 {page_numbers.BAR}\n7 عنوان" in m.text and "\n2\n" not in m.text
    again = one(spark, m.text, page_numbers.marked(F.col("t")))
    assert again.marked == 0 and again.text == m.text


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes("[الكتاب]: الأول\n[التصنيف]: فقه\nنص عربي طويل".encode("utf-8-sig"))
    (tmp_path / "sub" / "b.txt").write_bytes("نص عربي بترميز قديم".encode("cp1256"))
    exports.write_document(str(tmp_path / "c.docx"), [[("فقرة أولى", False)], [("فقرة ثانية", True)]])
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "skip.pdf").write_bytes(b"x")
    return tmp_path


def test_read_folder(spark, folder):
    rows, status = importer.import_folder(spark, str(folder), last_id=5)
    got = {r.book_title: r for r in rows.collect()}
    assert set(got) == {"الأول", "b", "c"} and got["b"].content == "نص عربي بترميز قديم"
    assert got["c"].content == "فقرة أولى\nفقرة ثانية" and sorted(r.book_id for r in got.values()) == [6, 7, 8]
    assert {(r.title, r.ok) for r in status.collect()} == {("a", True), ("b", True), ("c", True), ("bad", False)}


def test_named_files_have_error_rows(spark, folder):
    rows, status = importer.import_files(spark, [str(folder / "a.TXT"), str(folder / "skip.pdf"), str(folder / "bad.docx")])
    assert {(r.title, r.ok, r.error) for r in status.collect()} == {("a", True, None), ("skip", False, "نوع غير مدعوم: pdf"), ("bad", False, "فشل قراءة الملف")}
    assert [r.book_title for r in rows.collect()] == ["الأول"]
    lines = [r.value for r in importer.log_lines(status).collect()]
    assert len(lines) == 3 and sum(x.startswith("ERROR ") for x in lines) == 2


def test_marked_rule_on_three_lines(spark):
    """A rule, a number and a rule on lines of their own are text, which is split by words."""
    word = "كلمة "
    text = "\n".join(["====", "12", "====", word * 200, word * 200, word * 200])
    got = one(spark, text, pages.split_pages(F.col("t")))
    assert [p.original_page_number for p in got] == [None] * 3 and [p.content.count("كلمة") for p in got] == [200] * 3


def test_chains_by_definition():
    """The longest chains over random numbers, by every pair."""
    import random

    def brute(numbers):
        length = [1] * len(numbers)
        for i, x in enumerate(numbers):
            length[i] = max([1] + [length[j] + 1 for j in range(i) if 1 <= x - numbers[j] <= 4])
        if max(length, default=0) < 3:
            return []
        out = [length.index(max(length))]
        while length[at := out[-1]] > 1:
            out.append(min((-numbers[j], j) for j in range(at) if length[j] == length[at] - 1 and 1 <= numbers[at] - numbers[j] <= 4)[1])
        return out[::-1]

    rng = random.Random(1)
    for _ in range(3000):
        numbers = [rng.randint(1, 12) for _ in range(rng.randint(0, 14))]
        assert page_numbers.longest_chain(numbers) == brute(numbers)
    # Two chains before and after the main one are kept, one inside it is not.
    assert page_numbers.accepted([1, 2, 3, 9, 10, 11, 5], list(range(7))) == [0, 1, 2, 6]
    assert page_numbers.accepted([70, 71, 72, 1, 2, 3, 4], list(range(7))) == list(range(7))


def test_marked_files_and_unknown_encodings(spark, tmp_path):
    texts = spark.createDataFrame([("/in/a.txt", "1\nنص\n2\nنص\n3"), ("/in/b.txt", "بلا أرقام")], "path string, text string")
    report = page_numbers.mark_files(texts, str(tmp_path / "out")).first()
    assert (report.files_marked, report.files_without, report.numbers) == (1, 1, 3)
    assert page_numbers.BAR in (tmp_path / "out" / "a.txt").read_text(encoding="utf-8")
    raw = spark.createDataFrame([("a", bytearray("نص".encode("cp1256"))), ("b", bytearray("نص".encode("utf-8-sig")))], "path string, content binary")
    assert {(r.path, r.text, r.encoding) for r in files.read_any(raw).collect()} == {("a", "نص", "cp1256"), ("b", "نص", "utf-8-sig")}


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path, monkeypatch):
    """Rows and mark enter by one rename: a crash before it leaves neither, one after it both."""
    from warraq.plans.samples import sample_pages

    library = Library(spark, str(tmp_path / "crash"))
    real = Library._commit
    monkeypatch.setattr(Library, "_commit", lambda *a: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        library.append(sample_pages(spark), mark=("job", 0))
    assert library.pages().count() == 0
    monkeypatch.setattr(Library, "_commit", real)
    assert library.append(sample_pages(spark), mark=("job", 0)) and not library.append(sample_pages(spark), mark=("job", 0))
    assert library.pages().count() == 4 and library.append(sample_pages(spark), mark=("job", 1))
    # The file of the last identifier is read, and made again where it is missing.
    assert library.last_book_id() == 4
    (tmp_path / "crash" / "bookid.max").unlink()
    (tmp_path / "crash" / ".bookid.max.crc").unlink(missing_ok=True)
    assert library.last_book_id() == 4 and (tmp_path / "crash" / "bookid.max").read_text() == "4"


def test_health_of_a_library(spark, tmp_path):
    from warraq.plans.samples import sample_pages

    library = Library(spark, str(tmp_path / "sick"), books=2)
    library.append(sample_pages(spark))
    data = next((tmp_path / "sick" / "data").glob("*/bucket=*/*.parquet"))
    for f in (tmp_path / "sick" / "data").glob("*/bucket=*/*.parquet"):
        f.write_bytes(b"no parquet")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert data.exists() and not library.healthy()
    assert library.ensure(lambda: sample_pages(spark)) and library.healthy() and library.pages().count() == 4


def test_import_can_stop_and_go_on(spark, folder, tmp_path):
    from warraq.streaming.ingest import ImportControl, progress

    library = Library(spark, str(tmp_path / "lib3"))
    control = ImportControl(lambda: import_stream(spark, str(folder), library, str(tmp_path / "check3"), on_batch=control.on_batch))
    control.resume().awaitTermination()
    control.pause()
    (folder / "later.txt").write_bytes("نص عربي جديد للتجربة".encode())
    control.resume().awaitTermination()
    assert library.pages().count() == 4 and (control.done, control.failed) == (4, 1)
    assert progress(30, 10, 100, 60.0) == {"imported": 30, "failed": 10, "per_minute": 40.0, "seconds_left": 90.0}


def test_stream_imports_once(spark, folder, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    for _ in range(2):
        import_stream(spark, str(folder), library, str(tmp_path / "check")).awaitTermination()
    assert library.pages().count() == 3


def test_library_changes(spark, tmp_path):
    from warraq.plans.samples import sample_pages

    library = Library(spark, str(tmp_path / "lib2"))
    assert not library.healthy() and library.pages().count() == 0
    library.append(sample_pages(spark))
    assert library.healthy() and not library.ensure(lambda: sample_pages(spark))
    assert library.delete_book(2) == 1 and library.delete_book(2) == 0
    library.compact()
    library.drop_old_versions()
    assert len(library.versions()) == 1 and library.pages().count() == 3
    library.clear()
    assert library.pages().count() == 0 and "content_nodiac" in library.pages().columns


def test_shards(spark, tmp_path):
    for number, start in ((1, 1), (2, 1)):
        with sqlite3.connect(tmp_path / f"shard_{number:04d}.db") as db:
            db.execute("CREATE TABLE books(id INTEGER PRIMARY KEY, title TEXT, author TEXT, category TEXT, year TEXT, death_year TEXT, country TEXT)")
            db.execute("CREATE TABLE pages(id INTEGER PRIMARY KEY, book_id INTEGER, page_num INTEGER, content TEXT" + (", content_path TEXT)" if number == 1 else ")"))
            for b in (start, start + 1):
                db.execute("INSERT INTO books(id, title, category) VALUES (?, ?, 'اللغة')", (b, f"كتاب {b}"))
                for p in (1, 2):
                    db.execute("INSERT INTO pages(book_id, page_num, content) VALUES (?, ?, ?)", (b, p, f"صفحة {p}"))
            db.execute("INSERT INTO pages(book_id, page_num, content) VALUES (99, 1, 'orphan')")
    (tmp_path / "content").mkdir()
    (tmp_path / "content" / "p.txt").write_text("خارجي", encoding="utf-8")
    with sqlite3.connect(tmp_path / "shard_0001.db") as db:
        db.execute("UPDATE pages SET content_path = 'p.txt' WHERE book_id = 1 AND page_num = 1")
    books, rows = shards.read_shards(spark, str(tmp_path))
    out = shards.page_rows(books, rows)
    totals = shards.migration_totals(books, out).first()
    assert (totals.shards, totals.books, totals.pages) == (2, 4, 8)
    assert out.where(F.col("book_id") == shards.ID_STEP + 1).orderBy("page_num").first().content == "خارجي"
    # Migration replaces what was there, commits in groups, leaves out what is no shard and counts in the end.
    library, seen = Library(spark, str(tmp_path / "index")), []
    library.append(out)
    (tmp_path / "shard_0003.db").write_bytes(b"no database at all, only bytes")
    stats = shards.migrate(spark, str(tmp_path), library, shards_a_commit=1, on_commit=lambda *x: seen.append(x))
    assert stats == shards.Migration(shard_count=3, total_books=4, total_pages=8, total_errors=1, on_disk=8)
    assert seen == [([1], 2, 4), ([2], 4, 8)] and library.pages().select("book_id").distinct().count() == 4
    with pytest.raises(FileNotFoundError):
        shards.find_shards(str(tmp_path / "content"))


def test_exports(spark, tmp_path):
    from warraq.operators.search import search
    from warraq.plans.samples import sample_pages

    p = sample_pages(spark)
    found = search(p, "رسول الله")
    out = lambda name: str(tmp_path / name)
    exports.write_csv(found, p, out("csv"))
    lines = (tmp_path / "csv" / "results-000000.csv").read_bytes().decode("utf-8-sig").splitlines()
    assert len(lines) == 2 and lines[1].startswith("1,الحديث,,الحديث,,1,رسول الله,قال رسول")
    exports.write_docx(found, p, out("docx"), "رسول الله")
    document = tmp_path / "docx" / "results-000000.docx"
    assert "رسول الله" in files.docx_paragraphs(document.read_bytes()) and zipfile.is_zipfile(document)
    assert b'<w:color w:val="FF0000"/>' in zipfile.ZipFile(document).read("word/document.xml")
    assert exports.hits_in("قال كِتَاب الله", ["كتاب", "الله"]) == [("قال ", False), ("كِتَاب", True), (" ", False), ("الله", True)]
    assert exports.hits_in("abcd", ["ab", "bc", "zz"]) == [("abc", True), ("d", False)]
    exports.write_text(found, p, out("txt"), "رسول الله", "2026")
    assert "[1] الحديث — صفحة 1" in (tmp_path / "txt" / "results-000000.txt").read_text(encoding="utf-8")
    exports.write_book(p, 3, out("book"))
    assert (tmp_path / "book" / "3.txt").read_text(encoding="utf-8").startswith("قال") and os.listdir(tmp_path / "book") == ["3.txt"]


def test_exports_of_several_files_and_of_nothing(spark, tmp_path):
    from warraq.operators.search import SearchOptions, search

    docs = spark.range(10).selectExpr("id as book_id", "1 as page_num", "string(null) as original_page_number", "'a trash, \"b\"' as content", "'t' as book_title", "'' as author",
                                      "'c' as category", "'1' as year", "'1' as death_year", "'x' as country")
    found = search(docs, "trash", options=SearchOptions(limit=None))
    exports.write_csv(found, docs, str(tmp_path / "csv"), per_file=4)
    assert sorted(os.listdir(tmp_path / "csv")) == [f"results-00000{i}.csv" for i in range(3)]
    for i, n in enumerate((4, 4, 2)):
        lines = (tmp_path / "csv" / f"results-00000{i}.csv").read_bytes().decode("utf-8-sig").splitlines()
        assert len(lines) == n + 1 and lines[1].startswith(f"{4 * i + 1},t,") and lines[1].endswith(',"a trash, ""b"')  # a snippet ends with a word
    exports.write_text(found, docs, str(tmp_path / "txt"), "trash", "now", per_file=9)
    first, second = (open(tmp_path / "txt" / f"results-00000{i}.txt", encoding="utf-8").read() for i in range(2))
    assert first.startswith("نتائج البحث عن: trash\nعدد النتائج: 10\n") and second.startswith("[10] t")
    none = search(docs, "nothing", options=SearchOptions(limit=None))
    exports.write_csv(none, docs, str(tmp_path / "none"))
    exports.write_docx(none, docs, str(tmp_path / "none"), "nothing")
    assert (tmp_path / "none" / "results-000000.csv").read_bytes().decode("utf-8-sig").count("\n") == 1
    assert files.docx_paragraphs((tmp_path / "none" / "results-000000.docx").read_bytes()) == "نتائج البحث عن: nothing"


def test_books_as_documents(spark, tmp_path):
    rows = [(1, 2, "d\ne"), (1, 1, "a\n\nb"), (2, 1, None), (None, 1, "z")]
    pages_ = spark.createDataFrame(rows, "book_id long, page_num int, content string")
    exports.write_books(pages_, str(tmp_path / "docx"), ".docx")
    assert files.docx_paragraphs((tmp_path / "docx" / "1.docx").read_bytes()) == "a\n\nb\nd\ne"
    exports.write_books(pages_, str(tmp_path / "txt"))
    assert (tmp_path / "txt" / "1.txt").read_text() == "a\n\nb\n\nd\ne" and sorted(os.listdir(tmp_path / "txt")) == ["1.txt", "2.txt"]
    with pytest.raises(Exception, match="no name of a file"):
        text_files.write_text_files(spark.createDataFrame([("../x.txt", "a")], "name string, text string"), str(tmp_path / "txt"))


def test_csv_export_has_every_result(spark, tmp_path):
    import __spark_entry__ as e

    docs = spark.range(4500).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "repeat('a trash ', 23) as text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    got = e.queries()["snk_csv_lines"](spark, str(tmp_path)).selectExpr("count(*) as n", "count(distinct serial) as d", "max(serial) as last").first()
    assert tuple(got) == (103_500, 103_500, 103_500)
