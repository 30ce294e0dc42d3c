"""Exports of results and books: text, CSV and DOCX.

Results go to a folder of numbered files with ``FILE_RESULTS`` results each, books to a file each.  Tasks write the
files, a row at a time, and they appear when the whole job has ended (see ``sources/text_files.py``).
"""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import blank, display_page, trim
from .operators.reader import beside_pages, numbered
from .operators.render import CSV_HEADER, csv_line, export_snippet
from .sources.text_files import write_long_files

_RULE, _THIN = "=" * 60, "-" * 60


def export_rows(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results with a serial, the page shown and the export snippet."""
    return _shown(numbered(results), pages)


def _shown(rows: DataFrame, pages: DataFrame) -> DataFrame:
    cut = lambda text, hit: export_snippet(text, hit["matched_term"], hit["context_snippet"])
    return beside_pages(rows, pages, cut, "snippet", written=True).withColumn("page", display_page(F.col("original_page_number"), F.col("page_number")))


def csv_lines(results: DataFrame, pages: DataFrame) -> DataFrame:
    c = F.col
    line = csv_line(c("serial"), c("book_title"), c("book_author"), c("book_category"), c("book_year"), c("page"), c("matched_term"), c("snippet"))
    return export_rows(results, pages).select("serial", line.alias("value"))


def text_blocks(results: DataFrame, pages: DataFrame) -> DataFrame:
    return _blocks(export_rows(results, pages))


def _blocks(df: DataFrame) -> DataFrame:
    author = F.when(~blank(F.col("book_author")), F.concat(F.lit("\n    المؤلّف: "), F.col("book_author"))).otherwise("")
    year = F.when(~blank(F.col("book_year")), F.concat(F.lit("\n    السنة: "), F.col("book_year"))).otherwise("")
    head = F.concat(F.lit("["), F.col("serial").cast("string"), F.lit("] "), F.coalesce("book_title", F.lit("—")), F.lit(" — صفحة "), F.col("page"))
    return df.select("serial", F.concat(head, author, year, F.lit("\n\n"), F.col("snippet"), F.lit(f"\n\n{_THIN}")).alias("value"))


#: Results in one file of an export.
FILE_RESULTS = 100_000


def _in_files(rows: DataFrame, ending: str, per_file: int) -> DataFrame:
    """With the name of the file that each serial belongs to."""
    number = F.floor((F.col("serial") - 1) / per_file).cast("long")
    return rows.withColumn("name", F.concat(F.lit("results-"), F.lpad(number.cast("string"), 6, "0"), F.lit(ending)))


def _with_head(rows: DataFrame, ending: str, head: str) -> DataFrame:
    """A first row (serial 0) in the first file, which so is there without any results."""
    first = rows.sparkSession.createDataFrame([(f"results-000000{ending}", 0, head)], "name string, serial int, value string")
    return first.unionByName(rows, allowMissingColumns=True)


def write_csv(results: DataFrame, pages: DataFrame, folder: str, per_file: int = FILE_RESULTS) -> None:
    """Each file has its byte order mark and header."""
    mark = f"\ufeff{CSV_HEADER}\n"
    rows = _in_files(csv_lines(results, pages), ".csv", per_file)
    begins = (F.col("serial") > 1) & ((F.col("serial") - 1) % per_file == 0)
    rows = rows.withColumn("value", F.concat(F.when(begins, mark).otherwise(""), "value", F.lit("\n")))
    write_long_files(_with_head(rows, ".csv", mark), folder, "serial")


def write_text(results: DataFrame, pages: DataFrame, folder: str, query: str, when: str, per_file: int = FILE_RESULTS) -> None:
    """The first file begins with the query, the number of results and the time."""
    rows = numbered(results)  # written once, so the search runs once
    head = f"نتائج البحث عن: {query}\nعدد النتائج: {rows.count()}\nتاريخ التصدير: {when}\n{_RULE}\n\n"
    blocks = _in_files(_blocks(_shown(rows, pages)), ".txt", per_file).withColumn("value", F.concat("value", F.lit("\n")))
    write_long_files(_with_head(blocks, ".txt", head), folder, "serial")


def _run(text: str, hit: bool) -> str:
    look = '<w:b/><w:color w:val="FF0000"/>' if hit else ""
    return f'<w:r><w:rPr><w:rtl/>{look}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def write_document(path, paragraphs) -> None:
    """A right-to-left document in a file (or file object), written as its paragraphs (lists of (text, is it a hit)) come."""
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
        'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/word/document.xml" ContentType="{main}"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="r1" Type="{relation}" Target="word/document.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, head + text)
        with z.open("word/document.xml", "w") as body:
            body.write(f'{head}<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'.encode())
            for p in paragraphs:
                body.write(f"<w:p><w:pPr><w:bidi/></w:pPr>{''.join(_run(t, h) for t, h in p)}</w:p>".encode())
            body.write(b"</w:body></w:document>")


def highlight_terms(term: Column) -> Column:
    """The distinct words of a query that a snippet shows as hits."""
    return F.array_distinct(F.filter(F.transform(F.split(term, r"[|+ ]", -1), trim), lambda x: x != ""))


_MARK = "[\u064b-\u0652\u0670\u0640]"


def hits_in(text: str, terms: list[str]) -> list[tuple[str, bool]]:
    """The text in runs, those of the terms marked; vowel marks and tatweel do not count, touching hits are one."""
    bare = [re.sub(_MARK, "", t) for t in terms or []]
    spans = sorted(m.span() for t in bare if t for m in re.finditer(f"{_MARK}*".join(map(re.escape, t)), text))
    out, at = [], 0
    for a, b in spans:
        if out and out[-1][1] and a <= at:
            out[-1] = (out[-1][0] + text[at:b], True)
        else:
            out += [(text[at:a], False), (text[a:b], True)]
        at = max(at, b)
    return [x for x in [*out, (text[at:], False)] if x[0]]


def write_docx(results: DataFrame, pages: DataFrame, folder: str, query: str, per_file: int = FILE_RESULTS) -> None:
    """Documents of a heading and a snippet with its hits marked for each result; the first begins with the query."""
    rows = export_rows(results, pages)
    heading = F.concat(F.lit("["), F.col("serial").cast("string"), F.lit("] "), F.coalesce("book_title", F.lit("—")), F.lit(" — صفحة "), F.col("page"))
    none = F.lit(None).cast("array<string>")
    both = F.array(F.struct(heading.alias("value"), none.alias("terms")), F.struct(F.col("snippet").alias("value"), highlight_terms(F.col("matched_term")).alias("terms")))
    rows = _in_files(rows.select("serial", F.posexplode(both).alias("line", "p")).select("serial", "line", "p.*"), ".docx", per_file)
    write_long_files(_with_head(rows, ".docx", f"نتائج البحث عن: {query}"), folder, "serial", "line", kind="docx")


def write_books(pages: DataFrame, folder: str, ending: str = ".txt") -> None:
    """Every book of a table of pages as text, or as DOCX if the ending says so, named by its identifier; pages without a book have none."""
    rows = pages.where("book_id is not null").select(F.concat(F.col("book_id").cast("string"), F.lit(ending)).alias("name"), "page_num", F.coalesce("content", F.lit("")).alias("value"))
    if ending == ".docx":
        rows = rows.select("name", "page_num", F.posexplode(F.split("value", "\n", -1)).alias("line", "value"))
        write_long_files(rows, folder, "page_num", "line", kind="docx")
    else:
        write_long_files(rows, folder, "page_num", between="\n\n")


def write_book(pages: DataFrame, book_id: int, folder: str, ending: str = ".txt") -> None:
    """One book of a table of pages (see ``write_books``)."""
    write_books(pages.where(F.col("book_id") == book_id), folder, ending)


def write_favourites(saved: DataFrame, hits: DataFrame, path: str) -> None:
    """Saved searches as a DOCX summary: a heading each, and its first hits with short snippets (both are capped, so it is a small file)."""
    from .services import summaries

    rows = summaries(hits).join(saved.select(F.col("id").alias("search_id"), "name", "query", "timestamp"), "search_id")

    def paragraphs():
        last = None
        for r in rows.orderBy(F.desc("timestamp"), "search_id", "serial").toLocalIterator():
            if r["search_id"] != last:
                last = r["search_id"]
                yield [(f"{r['name']} — {r['query']}", True)]
            yield [(f"[{r['serial']}] {r['context_snippet']}", False)]

    write_document(path, paragraphs())
