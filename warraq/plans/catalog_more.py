"""More queries over the driver's tables: Arabic text, import, the stored library, services.

The documents are Latin; ``arabic`` spells them in Arabic letters, marks and digits by a
fixed translation, on both sides, so operators for Arabic run over whole texts.  Expected
expressions are written out and do not come from the builders under test.
"""

from __future__ import annotations

import io
import os
import sqlite3
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import exports, services
from ..functions import text as T
from ..operators import library, render, search, stats
from ..operators.search import SearchMode, SearchOptions
from ..schema import ALL_BOOKS, UNCLASSIFIED
from ..session import ship
from ..sources import files, headers, importer, ocr, page_numbers, pages, shards, text_files
from ..store import Library
from ..streaming import ingest
from ..work import spread, work_dir
from .catalog import _LIB, _RESULT, ALL, _found, _hits, corpus, query, table
from .samples import SAMPLE_LIBRARY, sample_library_pages, values

# Latin letters (both cases) and digits, and what stands for them: u, q are vowel marks, x is tatweel.
_LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_ARABIC = "ابتدعفجهيخكلمنوصّرسطُقحـةزابتدعفجهيخكلمنوصّرسطُقحـةز٠١٢٣٤٥٦٧٨٩"
_MARKS = "ً-ٰٟۖ-ۭ"
_TO_ARABIC = f"translate(text, '{_LATIN}', '{_ARABIC}')"
_ARLIB = _LIB.replace("text AS content", f"{_TO_ARABIC} AS content")


def arabic(spark, d):
    return corpus(spark, d).withColumn("content", F.translate("content", _LATIN, _ARABIC))


def customers(spark, d):
    """Over all tasks: the table is a small file, of which a text is made for each row."""
    return spread(table(spark, d, "customer"), "c_custkey")


def arabic_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.translate("text", _LATIN, _ARABIC).alias("a"))


def _ar_search(name: str, sql: str, words: str, mode: SearchMode, options: SearchOptions = ALL) -> None:
    query(name, sql)(lambda spark, d: search.search(arabic(spark, d), words, mode, options))


_H = f"[{_MARKS}]*"
_ar_search("mat_word_arabic", _found(f"ع{_H}ن{_H}", _ARLIB), "عن", SearchMode.WORD)
_ar_search("mat_respect_diacritics", _found("وُ", _ARLIB), "وُ", SearchMode.WORD, SearchOptions(respect_diacritics=True, limit=None))
# Whole letters: runs of letters and marks that are the word as a whole.
_ar_search(
    "mat_whole_letters", _found(f"[ء-ي{_MARKS}]+", _ARLIB, tail=f"WHERE regexp_full_match(term, 'و{_H}ف{_H}')"), "وف", SearchMode.WORD,
    SearchOptions(whole_letters=True, limit=None),
)
_R, _V = "[آؤءئأا-ي]", "[ً-ْ]*"
_ar_search("mat_wazn", _found(f"[م]{_V}{_R}{_V}{_R}{_V}[و]{_V}{_R}{_V}", _ARLIB), "مفعول", SearchMode.PATTERN)
_ar_search("mat_wazn_plain_letters", _found(f"[ت]{_V}{_R}{_V}[ا]{_V}{_R}{_V}خ{_V}", _ARLIB), "تفاعخ", SearchMode.PATTERN)


def _derived(allowed: str, root: str, lib: str = _ARLIB, tail: str = "") -> str:
    bare = f"regexp_replace(term, '[{_MARKS}]', '', 'g')"
    keep = f"length({bare}) BETWEEN 3 AND 20 AND regexp_matches({bare}, '^[{allowed}]*$') AND regexp_matches({bare}, '{root}')"
    return f"""{_hits(r'\S+', lib)}, r AS (SELECT *, count(*) OVER (PARTITION BY term) AS match_count,
        row_number() OVER (PARTITION BY term ORDER BY book_id, page_num, pos) AS k FROM hit WHERE {keep})
        SELECT {_RESULT}, match_count FROM r WHERE k = 1 {tail}"""


# Letters of increase, written out, with the root's own.
_ADDED = "أإءئآؤسلتمونيهاةكًٌٍَُِّْ"
_ar_search("mat_derivatives", _derived(_ADDED + "عن", ".*ع.*ن.*"), "عن", SearchMode.DERIVATIVES)
_ar_search("mat_derivatives_weak", _derived(_ADDED + "رويا", ".*ر.*[ويا].*"), "رو", SearchMode.DERIVATIVES)
_ar_search("srt_derivatives", _derived(_ADDED + "عن", ".*ع.*ن.*", tail="ORDER BY match_count DESC, book_id, page_num, pos LIMIT 1000"), "عن", SearchMode.DERIVATIVES, SearchOptions())


@query("mat_derivatives_latin", _derived(_ADDED + "er", ".*e.*r.*e.*", _LIB))
def _(spark, d):
    return search.search(corpus(spark, d), "ere", SearchMode.DERIVATIVES, ALL)


@query("mat_sample_library", "WITH lib AS (SELECT * FROM " + values(SAMPLE_LIBRARY, "book_id, page_num, original_page_number, content, book_title, author, category, year, death_year, country") + f"), {_hits(f'ع{_H}ل{_H}م{_H}', 'x AS (SELECT 1)').removeprefix('WITH x AS (SELECT 1), ')} SELECT {_RESULT} FROM hit")
def _(spark, d):
    return search.search(sample_library_pages(spark), "علم", SearchMode.WORD, ALL)


# -- filters -----------------------------------------------------------------------


@query("flt_subcategories", _found("of", where="author IN ('src0', 'src1')"))
def _(spark, d):
    p = corpus(spark, d).withColumn("subcategory", F.col("author"))
    return search.search(p, "of", SearchMode.WORD, SearchOptions(subcategories=("src0", "src1"), limit=None))


@query("flt_effective", _found("of", where="category IN ('de', 'en') OR category IS NULL"))
def _(spark, d):
    """What is ticked in the list of categories becomes the search's filter."""
    ticked = library.Selection("category", frozenset({"en", "de", UNCLASSIFIED}), frozenset({"en", "de", "fr", UNCLASSIFIED}))
    return search.search(corpus(spark, d), "of", SearchMode.WORD, SearchOptions(categories=library.effective_filter(ticked), limit=None))


@query("flt_effective_all", _found("of"))
def _(spark, d):
    ticked = library.Selection("category", frozenset({"en", ALL_BOOKS}))
    return search.search(corpus(spark, d), "of", SearchMode.WORD, SearchOptions(categories=library.effective_filter(ticked), limit=None))


# -- statistics --------------------------------------------------------------------


def _kind(kind: str, key: str, all_row: bool = False) -> str:
    top = f"SELECT '{kind}' AS kind, '{ALL_BOOKS}' AS name, count(DISTINCT book_id) AS n, 0::INT AS rank FROM lib UNION ALL " if all_row else ""
    return f"""{top}SELECT '{kind}' AS kind, coalesce({key}, '{UNCLASSIFIED}') AS name, count(DISTINCT book_id) AS n, (CASE WHEN {key} IS NULL THEN 1 ELSE 2 END)::INT AS rank FROM lib GROUP BY 1, 2, 4"""


@query("agg_all", f"""WITH {_LIB} {_kind("category", "nullif(trim(category), '')", True)} UNION ALL {_kind("year", "nullif(death_year, '0000')")}
    UNION ALL {_kind("region", "nullif(trim(country), '')")}
    UNION ALL SELECT 'totals', unnest(['total_books', 'total_pages', 'total_words_estimate', 'author_count']),
        unnest([count(DISTINCT book_id), count(*), (sum(length(content)) // 5)::BIGINT, count(DISTINCT author)]), 3 FROM lib""")  # fmt: skip
def _(spark, d):
    """All statistics from one scan."""
    found = stats.aggregate_all(corpus(spark, d))
    rows = None
    for kind, df in (("category", found.by_category), ("year", found.by_year), ("region", found.by_region)):
        own = df.select(F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.col("books").alias("n"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    names = ["total_books", "total_pages", "total_words_estimate", "author_count"]
    totals = found.totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in names])).alias("r"))
    return rows.unionByName(totals.select(F.lit("totals").alias("kind"), "r.name", "r.n", F.lit(3).alias("rank")))


@query("srt_books_by_title", f"WITH {_LIB} SELECT book_id, book_title FROM lib ORDER BY book_title, book_id")
def _(spark, d):
    return stats.books_by_title(corpus(spark, d)).select("book_id", "book_title")


@query("agg_word_count", f"SELECT doc_id, len(regexp_extract_all({_TO_ARABIC}, '[؀-ۿݐ-ݿࢠ-ࣿ]+'))::BIGINT AS words FROM documents")
def _(spark, d):
    return arabic_texts(spark, d).select("doc_id", T.arabic_word_count(F.col("a")).cast("long").alias("words"))


@query("agg_import_summary", "SELECT count(*) FILTER (length(text) >= 300) AS imported, count(*) FILTER (length(text) < 300) AS failed FROM documents")
def _(spark, d):
    return importer.import_summary(table(spark, d, "documents").select((F.length("text") >= 300).alias("ok")))


@query("agg_coverage", """WITH t AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'en' ELSE 'fr' END AS locale FROM customer)
    SELECT locale, least(count(*) / (SELECT count(*) FROM t WHERE locale = 'ar')::DOUBLE, 1.0) AS coverage FROM t GROUP BY 1""")  # fmt: skip
def _(spark, d):
    n = F.col("c_nationkey") % 3
    return services.coverage(table(spark, d, "customer").select(F.when(n == 0, "ar").when(n == 1, "en").otherwise("fr").alias("locale")))


@query("agg_migration_totals", "SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS shards, (SELECT count(*) FROM customer) AS books, (SELECT count(*) FROM orders) AS pages")
def _(spark, d):
    return shards.migration_totals(table(spark, d, "customer").withColumnRenamed("c_nationkey", "shard"), table(spark, d, "orders"))


# -- text functions ------------------------------------------------------------------


@query("sca_strip_diacritics", f"SELECT doc_id, regexp_replace({_TO_ARABIC}, '[{_MARKS}]', '', 'g') AS bare FROM documents")
def _(spark, d):
    return arabic_texts(spark, d).select("doc_id", T.strip_diacritics(F.col("a")).alias("bare"))


@query("sca_bare_places", f"""WITH t AS (SELECT doc_id, {_TO_ARABIC} AS a FROM documents)
    SELECT doc_id, regexp_replace(a, '[ً-ْٰـ]', '', 'g') AS bare, list_filter(range(0, length(a)), lambda i: NOT regexp_matches(substr(a, i::INT + 1, 1), '[ً-ْٰـ]'))::INT[] AS places FROM t""")  # fmt: skip
def _(spark, d):
    return arabic_texts(spark, d).select("doc_id", T.bare_with_places(F.col("a")).alias("b")).select("doc_id", F.col("b.text").alias("bare"), "b.places")


@query("sca_latin_digits", f"SELECT doc_id, translate({_TO_ARABIC}, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS b FROM documents")
def _(spark, d):
    return arabic_texts(spark, d).select("doc_id", T.latin_digits(F.col("a")).alias("b"))


_BROKEN = "replace(translate(text, 'qxzw', chr(13) || chr(160) || chr(8203) || chr(8232)), ', ', chr(13) || chr(10))"


def _broken(spark, d):
    """Documents with carriage returns, hard and zero-width spaces and line separators."""
    return table(spark, d, "documents").select("doc_id", F.replace(F.translate("text", "qxzw", "\r ​ "), F.lit(", "), F.lit("\r\n")).alias("t"))


@query("sca_prepare", f"""SELECT doc_id, replace(replace(replace(replace(replace({_BROKEN}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8232), chr(10)), chr(8203), ''), chr(160), ' ') AS b FROM documents""")
def _(spark, d):
    return _broken(spark, d).select("doc_id", T.prepare_for_regex(F.col("t")).alias("b"))


@query("sca_trim", f"SELECT doc_id, regexp_replace(chr(160) || {_BROKEN} || chr(8232) || ' ', '^[\\s\\x0b\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x{{85}}\\p{{Z}}]+$', '', 'g') AS b FROM documents")
def _(spark, d):
    return _broken(spark, d).select("doc_id", T.trim(F.concat(F.lit(" "), F.col("t"), F.lit("  "))).alias("b"))


@query("sca_newline_of", f"""SELECT doc_id, CASE WHEN contains(t, chr(13) || chr(10)) THEN 2 WHEN contains(t, chr(13)) AND NOT contains(t, chr(10)) THEN 1 ELSE 0 END AS kind FROM (SELECT doc_id, {_BROKEN} AS t FROM documents)""")
def _(spark, d):
    eol = page_numbers.newline_of(F.col("t"))
    return _broken(spark, d).select("doc_id", F.when(eol == "\r\n", 2).when(eol == "\r", 1).otherwise(0).alias("kind"))


@query("sca_looks_valid", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_TO_ARABIC} WHEN doc_id % 3 = 1 THEN text ELSE regexp_replace(text, '[^ -~]', '', 'g') END AS t FROM documents)
    SELECT doc_id, length(trim(t, E' \\n\\t\\r')) > 0 AND (len(regexp_extract_all(substr(t, 1, 2000), '[؀-ۿ]')) > 5 OR regexp_full_match(substr(t, 1, 2000), '[\\x20-\\x7E\\s]*')) AS valid FROM t""")  # fmt: skip
def _(spark, d):
    """A third spelt in Arabic, a third as it is, a third without what is not ASCII."""
    i = F.col("doc_id") % 3
    t = F.when(i == 0, F.translate("text", _LATIN, _ARABIC)).when(i == 1, F.col("text")).otherwise(F.regexp_replace("text", "[^ -~]", ""))
    return table(spark, d, "documents").select("doc_id", T.looks_valid(t).alias("valid"))


# Versions as text, with their numbers; parts that are no number drop out.
_V1 = "'v' || (o_orderkey % 3) || '.' || (o_orderkey % 7) || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.' || (o_orderkey % 5) WHEN 2 THEN '-' || (o_orderkey % 5) ELSE '-beta' END"
_V2 = "(o_custkey % 3) || '.' || (o_custkey % 7) || CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.' || (o_custkey % 5) ELSE '-' || (o_custkey % 5) END"
_N1 = "[o_orderkey % 3, o_orderkey % 7, CASE WHEN o_orderkey % 4 IN (1, 2) THEN o_orderkey % 5 ELSE 0 END]"
_N2 = "[o_custkey % 3, o_custkey % 7, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 5 END]"
_VERSIONS = [("v1.2.3", "1.2.4", -1), ("2.0", "1.9.9", 1), ("1.0", "1.0.0", 0), ("1.0-beta", "1.0", 0), ("3", "v3.0.1", -1), ("1.2.3-4", "1.2.3-5", -1), ("1.2-1", "1.2", 1), ("1.0.1-beta", "1.0.1", 0)]


@query("sca_semver", f"SELECT {_V1} AS a, {_V2} AS b, (CASE WHEN {_N1} < {_N2} THEN -1 WHEN {_N1} > {_N2} THEN 1 ELSE 0 END)::INT AS c FROM orders UNION ALL SELECT a, b, c::INT FROM " + values(_VERSIONS, "a, b, c"))
def _(spark, d):
    rows = table(spark, d, "orders").select(F.expr(_V1).alias("a"), F.expr(_V2).alias("b"))
    rows = rows.unionByName(spark.createDataFrame([(a, b) for a, b, _ in _VERSIONS], "a string, b string"))
    return rows.select("a", "b", T.compare_versions(F.col("a"), F.col("b")).alias("c"))


@query("sca_human_size_whole", """SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN (n // 1073741824) || ' GB' WHEN n >= 1048576 THEN (n // 1048576) || ' MB'
    WHEN n >= 1024 THEN (n // 1024) || ' KB' ELSE n || ' B' END AS s FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS n FROM orders)""")  # fmt: skip
def _(spark, d):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return table(spark, d, "orders").select("o_orderkey", T.human_size(n, decimal=False).alias("s"))


# The tabular calendar by the whole-number method on Julian days.
@query("sca_hijri", """WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS d, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440588 - 1948440 + 10632 AS l FROM orders),
    b AS (SELECT *, (l - 1) // 10631 AS n FROM a), c AS (SELECT *, l - 10631 * n + 354 AS l2 FROM b),
    e AS (SELECT *, ((10985 - l2) // 5316) * ((50 * l2) // 17719) + (l2 // 5670) * ((43 * l2) // 15238) AS j FROM c),
    f AS (SELECT *, l2 - ((30 - j) // 15) * ((17719 * j) // 50) - (j // 16) * ((15238 * j) // 43) + 29 AS l3 FROM e),
    g AS (SELECT *, (24 * l3) // 709 AS m FROM f)
    SELECT o_orderkey, printf('%04d-%02d-%02d', (30 * n + j - 30)::INT, m::INT, (l3 - (709 * m) // 24)::INT) AS hijri, strftime(d, '%Y-%m-%d') AS gregorian FROM g""")  # fmt: skip
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.hijri_date(F.to_date("o_orderdate")).alias("hijri"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("gregorian"))


@query("sca_highlight_terms", """SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_split_to_array(p_name || ' | ' || p_type || '+' || p_name, '[|+ ]'), lambda x: x <> ''))) AS terms FROM part""")
def _(spark, d):
    term = F.concat_ws("", F.col("p_name"), F.lit(" | "), F.col("p_type"), F.lit("+"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_sort(exports.highlight_terms(term)).alias("terms"))


# Covered characters of both terms, in runs; neither term overlaps itself.
@query("sca_merged_ranges", """WITH t AS (SELECT doc_id, text FROM documents WHERE contains(text, 'the') OR contains(text, 'her')),
    p AS (SELECT doc_id, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i::INT, 3) IN ('the', 'her'))) AS i FROM t),
    c AS (SELECT DISTINCT doc_id, i + k AS i FROM p, range(0, 3) AS r(k)), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c)
    SELECT doc_id, (min(i) - 1)::INT AS a, max(i)::INT AS b FROM g GROUP BY doc_id, run""")  # fmt: skip
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.explode(render.merged_ranges(F.col("text"), ["the", "her"])).alias("r"))
    return df.select("doc_id", F.col("r.start").alias("a"), F.col("r.end").alias("b"))


# -- headers and pages ---------------------------------------------------------------

_DATE = """CASE o_orderkey % 6 WHEN 0 THEN 'سنة ' || (o_orderkey % 3000) WHEN 1 THEN (o_orderkey % 3000) || 'هـ' WHEN 2 THEN (o_orderkey % 3000) || ' م' WHEN 3 THEN ' ' || (o_custkey % 1500) || 'هـ / ' || (o_orderkey % 3000) || 'م '
    WHEN 4 THEN 'بلا' ELSE '0000' END"""


@query("sca_parse_year", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 3 THEN trim(v) WHEN o_orderkey % 6 >= 4 OR o_orderkey % 3000 = 0 THEN NULL
    ELSE (o_orderkey % 3000) || CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'ه' ELSE 'م' END END AS y FROM (SELECT o_orderkey, {_DATE} AS v FROM orders)""")  # fmt: skip
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", headers.parse_year(F.expr(_DATE)).alias("y"))


def _headed(spark, d):
    """Texts with a header: of every sixth the category is missing, of every seventh the author unknown."""
    i = F.col("c_custkey")
    lines = [
        F.concat(F.lit("[الكتاب]: "), F.col("c_name")), F.concat(F.lit("[المؤلف]: "), F.when(i % 7 == 0, "غير محدد").otherwise(F.col("c_mktsegment"))),
        F.concat(F.lit("[السنة]: "), F.translate((i % 1500).cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.lit("هـ")), F.lit("[عدد الصفحات]: 1,200"), F.lit("[المترجم]: فلان"),
        F.when(i % 6 != 0, F.concat(F.lit("[التصنيف]: "), F.col("c_nationkey").cast("string"))), F.lit("[الجنسية]: مصر"), F.lit("نص الكتاب هنا"),
    ]
    return customers(spark, d).select("c_custkey", F.concat_ws("\n", *lines).alias("text"))


@query("sca_header", """SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 7 = 0 THEN 'مؤلف غير معروف' ELSE c_mktsegment END AS author,
    CASE WHEN c_custkey % 6 = 0 THEN 'غير مصنّف' ELSE c_nationkey::VARCHAR END AS category, CASE WHEN c_custkey % 1500 = 0 THEN '0000' ELSE (c_custkey % 1500) || 'ه' END AS year,
    1200::INT AS pages_count, CASE WHEN c_custkey % 6 = 0 THEN 'مصر' ELSE 'غير مصنّف' END AS country, 'فلان' AS translator FROM customer""")  # fmt: skip
def _(spark, d):
    """Reading stops at the category, so the nationality after it counts only where there is none."""
    h = _headed(spark, d).select("c_custkey", headers.header(F.col("text"), F.lit("name")).alias("h"))
    return h.select("c_custkey", "h.title", "h.author", "h.category", "h.year", "h.pages_count", headers.nationality(F.col("h.dynamic")).alias("country"), F.col("h.dynamic")["المترجم"].alias("translator"))


_MARKED = "replace(replace(text, '? ', chr(10) || '====' || chr(10) || '12' || chr(10) || '====' || chr(10)), '. ', chr(10) || ' ==== ' || translate(doc_id::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' =====' || chr(10))"


# Marker lines between sentences; a rule, a number and a rule on three lines are text.
@query("sca_page_markers", """WITH s AS (SELECT doc_id, string_split(replace(text, '? ', chr(10) || '====' || chr(10) || '12' || chr(10) || '====' || chr(10)), '. ') AS s FROM documents WHERE contains(text, '. ')),
    p AS (SELECT doc_id, i, regexp_replace(s[i], '^[\\s\\x0b\\x{85}\\p{Z}]+|[\\s\\x0b\\x{85}\\p{Z}]+$', '', 'g') AS content FROM s, unnest(range(1, len(s) + 1)) AS u(i))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INT AS page_num, content, CASE WHEN i > 1 THEN doc_id::VARCHAR END AS original_page_number FROM p WHERE content <> ''""")  # fmt: skip
def _(spark, d):
    rule = F.replace(F.col("text"), F.lit("? "), F.lit("\n====\n12\n====\n"))
    digits = F.translate(F.col("doc_id").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    text = F.replace(rule, F.lit(". "), F.concat(F.lit("\n ==== "), digits, F.lit(" =====\n")))
    return pages.paged(table(spark, d, "documents").where(F.col("text").contains(". ")).select("doc_id", text.alias("text")))


# Lines one after another, a new page where the words would pass 100.
@query("sca_page_words", r"""WITH RECURSIVE c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g') AS t, text FROM documents),
    l AS (SELECT doc_id, text, t, string_split(t, chr(10)) AS s FROM c),
    n AS (SELECT doc_id, i, s[i] AS line, len(regexp_extract_all(s[i], '[A-Za-z]+')) AS n FROM l, unnest(range(1, len(s) + 1)) AS u(i) WHERE t <> ''),
    f AS (SELECT doc_id, i, line, n AS words, 1 AS page FROM n WHERE i = 1
      UNION ALL SELECT n.doc_id, n.i, n.line, CASE WHEN f.words + n.n > 100 THEN n.n ELSE f.words + n.n END, CASE WHEN f.words + n.n > 100 THEN f.page + 1 ELSE f.page END
      FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
    SELECT doc_id, page::INT AS page_num, string_agg(line, chr(10) ORDER BY i) AS content, NULL::VARCHAR AS original_page_number FROM f GROUP BY doc_id, page
    UNION ALL SELECT doc_id, 1, text, NULL FROM l WHERE t = ''""")  # fmt: skip
def _(spark, d):
    return pages.paged(table(spark, d, "documents").select("doc_id", "text"), words=100, word="[A-Za-z]+")


@query("snk_import", "SELECT (10 + row_number() OVER (ORDER BY '/in/' || doc_id || '.txt'))::BIGINT AS book_id, 1::INT AS page_num, 'doc ' || doc_id AS book_title FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    i = F.col("doc_id").cast("string")
    texts = table(spark, d, "documents").select(F.concat(F.lit("/in/"), i, F.lit(".txt")).alias("path"), F.concat(F.lit("doc "), i).alias("title"), "text")
    return importer.import_texts(texts, last_id=10).select("book_id", "page_num", "book_title")


@query("win_file_ids", "SELECT url AS path, (row_number() OVER (ORDER BY url))::BIGINT + 41 AS book_id FROM (SELECT DISTINCT url FROM pages)")
def _(spark, d):
    return pages.with_book_ids(table(spark, d, "pages").select(F.col("url").alias("path")).distinct(), 41).select("path", "book_id")


@query("srt_path_order", "SELECT url AS path FROM pages ORDER BY url")
def _(spark, d):
    return files.in_path_order(table(spark, d, "pages").select(F.col("url").alias("path")))


def _numbered_text(spark, d):
    """Lines of text with page numbers 1 .. n (n differs by customer) between them."""
    n = (F.col("c_custkey") % 40).cast("int")
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("نص بلا رقم\n"), i.cast("string")))).otherwise(F.array(F.lit("نص")))
    return customers(spark, d).select("c_custkey", F.array_join(lines, "\n").alias("text"))


_PAGE_NUMBERS = "SELECT c_custkey, CASE WHEN n >= 3 THEN n ELSE 0 END::INT AS marked, CASE WHEN n >= 3 THEN n ELSE 0 END::INT AS strict, CASE WHEN n >= 3 THEN 1 END::BIGINT AS first, CASE WHEN n >= 3 THEN n END::BIGINT AS last FROM (SELECT c_custkey, c_custkey % 40 AS n FROM customer)"


@query("win_page_chain", _PAGE_NUMBERS)
def _(spark, d):
    df = _numbered_text(spark, d).select("c_custkey", page_numbers.marked(F.col("text")).alias("m"))
    return df.select("c_custkey", "m.marked", "m.strict", "m.first", "m.last")


@query("sca_marked_text", """SELECT c_custkey, CASE WHEN n < 3 THEN CASE WHEN n = 0 THEN 'نص' ELSE array_to_string(list_transform(range(1, n + 1), lambda i: 'نص بلا رقم' || chr(10) || i), chr(10)) END
    ELSE array_to_string(list_transform(range(1, n + 1), lambda i: 'نص بلا رقم' || chr(10) || repeat('=', 25) || ' ' || i || ' ' || repeat('=', 25)), chr(10)) END AS text,
    n >= 3 AS already FROM (SELECT c_custkey, c_custkey % 40 AS n FROM customer)""")  # fmt: skip
def _(spark, d):
    df = _numbered_text(spark, d).select("c_custkey", page_numbers.marked(F.col("text"))["text"].alias("text"))
    return df.withColumn("already", page_numbers.already_marked(F.col("text")))


@query("agg_page_report", f"""WITH m AS ({_PAGE_NUMBERS}) SELECT count(*) FILTER (marked > 0) AS files_marked, count(*) FILTER (marked = 0) AS files_without, 0::BIGINT AS files_already,
    sum(marked)::BIGINT AS numbers, sum(strict)::BIGINT AS strict, 0::BIGINT AS loose, min(first) AS first, max(last) AS last FROM m""")  # fmt: skip
def _(spark, d):
    return page_numbers.report(_numbered_text(spark, d).withColumn("m", page_numbers.marked(F.col("text"))))


# Numbers on decorated lines (in Arabic digits), before and after other words, among items of lists; in a tenth of the texts markers that are there already.
_MIXED = """c AS (SELECT c_custkey, c_custkey % 20 + 4 AS n, c_custkey % 10 = 9 AS old, CASE WHEN c_custkey % 4 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS nl, repeat('=', 25) AS bar FROM customer),
    l AS (SELECT *, CASE i % 3 WHEN 0 THEN '- ' || translate(i::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' -' WHEN 1 THEN i || ' نص' ELSE 'نص ' || i END AS line FROM c, unnest(generate_series(1, n)) AS s(i)),
    p AS (SELECT *, CASE WHEN old THEN line WHEN i % 3 = 0 THEN bar || ' ' || i || ' ' || bar ELSE bar || ' ' || i || ' ' || bar || nl || line END || nl || '(99) بند' || nl || 'نص' AS part FROM l),
    m AS (SELECT c_custkey, any_value(old) AS old, CASE WHEN any_value(old) THEN any_value(bar || ' 7 ' || bar || nl) ELSE '' END || string_agg(CASE WHEN i > 1 THEN nl ELSE '' END || part, '' ORDER BY i) AS text,
        (count(*) FILTER (NOT old))::INT AS marked, (count(*) FILTER (NOT old AND i % 3 = 0))::INT AS strict FROM p GROUP BY c_custkey)"""


def _mixed_text(spark, d):
    k = F.col("c_custkey")
    nl, bar = F.when(k % 4 == 0, "\r\n").otherwise("\n"), F.lit("=" * 25)

    def lines(i):
        number = i.cast("string")
        line = F.when(i % 3 == 0, F.concat(F.lit("- "), F.translate(number, "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.lit(" -"))).when(i % 3 == 1, F.concat(number, F.lit(" نص"))).otherwise(F.concat(F.lit("نص "), number))
        return F.concat(line, nl, F.lit("(99) بند"), nl, F.lit("نص"))

    body = F.array_join(F.transform(F.sequence(F.lit(1), (k % 20 + 4).cast("int")), lines), "\0")
    text = F.concat(F.when(k % 10 == 9, F.concat(bar, F.lit(" 7 "), bar, nl)).otherwise(""), F.replace(body, F.lit("\0"), nl))
    return customers(spark, d).select("c_custkey", text.alias("text"))


@query("sca_mixed_numbers", f"WITH {_MIXED} SELECT c_custkey, text, marked, strict FROM m")
def _(spark, d):
    m = _mixed_text(spark, d).select("c_custkey", page_numbers.marked(F.col("text")).alias("m"))
    return m.select("c_custkey", "m.text", "m.marked", "m.strict")


@query("agg_mixed_report", f"""WITH {_MIXED} SELECT count(*) FILTER (marked > 0) AS files_marked, 0::BIGINT AS files_without, count(*) FILTER (old) AS files_already, sum(marked)::BIGINT AS numbers,
    sum(strict)::BIGINT AS strict, sum(marked - strict)::BIGINT AS loose, 1::BIGINT AS first, max(marked)::BIGINT AS last FROM m""")  # fmt: skip
def _(spark, d):
    return page_numbers.report(_mixed_text(spark, d).withColumn("m", page_numbers.marked(F.col("text"))))


# -- the stored library ----------------------------------------------------------------

_STORED = "SELECT book_id, page_num::INT AS page_num, content, nullif(trim(country), '') AS country FROM lib"


def _library(spark) -> Library:
    return Library(spark, work_dir(spark, "library"))


def _stored(lib: Library):
    return lib.pages().select("book_id", "page_num", "content", "country")


@query("snk_append", f"WITH {_LIB} {_STORED} UNION ALL {_STORED.replace('book_id,', 'book_id + 1000000000000,', 1)}")
def _(spark, d):
    """Two shards' pages appended to one library."""
    lib = _library(spark)
    lib.append(corpus(spark, d))
    lib.append(corpus(spark, d).withColumn("book_id", F.col("book_id") + shards.ID_STEP))
    return _stored(lib)


@query("set_delete_book", f"WITH {_LIB} {_STORED} WHERE book_id NOT IN (5, 17)")
def _(spark, d):
    lib = _library(spark)
    lib.append(corpus(spark, d))
    lib.delete_book(5)
    lib.delete_book(17)
    return _stored(lib)


@query("snk_compact", f"WITH {_LIB} {_STORED}")
def _(spark, d):
    lib = _library(spark)
    lib.append(corpus(spark, d).where("book_id % 2 = 0"))
    lib.append(corpus(spark, d).where("book_id % 2 = 1"))
    lib.compact()
    lib.drop_old_versions()
    return _stored(lib)


@query("snk_overwrite", f"WITH {_LIB} SELECT count(*) AS pages, max(book_id) AS last_id FROM lib WHERE category = 'en'")
def _(spark, d):
    lib = _library(spark)
    lib.append(corpus(spark, d))
    n = lib.overwrite(corpus(spark, d).where("category = 'en'"))
    return spark.range(1).select(F.lit(n).cast("long").alias("pages"), F.lit(lib.last_book_id()).cast("long").alias("last_id"))


@query("snk_clear", f"WITH {_LIB} SELECT count(*) AS before, 0::BIGINT AS after, max(book_id) AS last_id FROM lib")
def _(spark, d):
    """An empty library that can be read; identifiers go on where they were."""
    lib = _library(spark)
    lib.append(corpus(spark, d))
    before = lib.pages().count()
    lib.clear()
    return spark.range(1).select(F.lit(before).cast("long").alias("before"), F.lit(lib.pages().count()).cast("long").alias("after"), F.lit(lib.last_book_id()).cast("long").alias("last_id"))


@query("src_ensure", f"WITH {_LIB} SELECT false AS healthy_before, true AS rebuilt, false AS rebuilt_again, count(*) AS pages FROM lib")
def _(spark, d):
    lib = _library(spark)
    before = lib.healthy()
    first = lib.ensure(lambda: corpus(spark, d))
    again = lib.ensure(lambda: corpus(spark, d).limit(0))
    row = [F.lit(x).alias(c) for x, c in ((before, "healthy_before"), (first, "rebuilt"), (again, "rebuilt_again"))]
    return spark.range(1).select(*row, F.lit(lib.pages().count()).cast("long").alias("pages"))


@query("src_stored_pages", f"WITH {_LIB} {_STORED} WHERE book_id = 42")
def _(spark, d):
    """One book, from its bucket alone."""
    lib = _library(spark)
    lib.append(corpus(spark, d))
    return lib.pages_of(42).select("book_id", "page_num", "content", "country")


# A word inside a stored text narrows the pages before the expression runs.
@query("mat_stored_word", f"WITH {_LIB}, {_hits('trash', 'x AS (SELECT 1)').removeprefix('WITH x AS (SELECT 1), ')} SELECT book_id, pos::BIGINT AS match_position, term AS matched_term FROM hit")
def _(spark, d):
    lib = _library(spark)
    lib.append(corpus(spark, d))
    return search.search(lib.pages(), "trash", SearchMode.WORD, ALL).select("book_id", "match_position", "matched_term")


# -- exports and services ------------------------------------------------------------------

_SNIP = r"""s AS (SELECT *, row_number() OVER (ORDER BY book_id, page_num, pos) AS serial, strpos(content, 'trash') AS p FROM hit),
    c AS (SELECT *, length(regexp_extract(substr(content, 1, p - 1), '[\p{L}\p{Nd}]+$')) AS h FROM s),
    x AS (SELECT *, substr(content, 1, p - 1 - h) AS l, substr(content, p - h) AS r FROM c),
    e AS (SELECT *, CASE WHEN len(regexp_extract_all(l, '[\p{L}\p{Nd}]+')) > 30 THEN '… ' ELSE '' END || trim(regexp_extract(l, '(?:[\p{L}\p{Nd}]+[^\p{L}\p{Nd}]*){0,30}$')
      || regexp_extract(r, '^((?:[\p{L}\p{Nd}]+[^\p{L}\p{Nd}]*){0,30}[\p{L}\p{Nd}]+)', 1), E' \n\t') || CASE WHEN len(regexp_extract_all(r, '[\p{L}\p{Nd}]+')) > 31 THEN ' …' ELSE '' END AS v FROM x)"""


@query("snk_text_blocks", f"""{_hits('trash')}, {_SNIP} SELECT serial::INT AS serial, '[' || serial || '] ' || book_title || ' — صفحة 1' || chr(10) || '    المؤلّف: ' || author || chr(10) || '    السنة: ' || year
    || chr(10) || chr(10) || v || chr(10) || chr(10) || repeat('-', 60) AS value FROM e""")  # fmt: skip
def _(spark, d):
    p = corpus(spark, d)
    return exports.text_blocks(search.search(p, "trash", SearchMode.WORD, ALL), p)


@query("srt_saved", """SELECT event_id::VARCHAR AS id, event_id * 10 AS timestamp, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, '') AS name, 'WORD' AS mode FROM events WHERE event_id % 5 <> 0""")
def _(spark, d):
    """Rows without an identifier go, missing fields take defaults."""
    i = F.col("event_id")
    raw = table(spark, d, "events").select(
        F.when(i % 5 != 0, i.cast("string")).alias("id"), (i * 10).alias("timestamp"), F.when(i % 3 != 0, F.col("event_type")).alias("name"), F.lit(None).cast("string").alias("mode")
    )
    return services.read_saved(raw)


@query("src_saved_results", """SELECT o_custkey::VARCHAR AS search_id, k::INT AS serial, o_orderkey AS book_id, 0::INT AS page_number, o_orderpriority AS matched_term, -1::INT AS match_position, '' AS context_snippet
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE o_orderstatus <> 'F'""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders")
    item = F.struct(
        F.col("o_orderkey").alias("at"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("book_id"), F.lit(None).cast("int").alias("page_number"),
        F.col("o_orderpriority").alias("matched_term"), F.lit(None).cast("int").alias("match_position"), F.lit(None).cast("string").alias("context_snippet"),
    )
    return services.saved_results(o.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("results")))


@query("snk_saved_cleared", "SELECT event_id::VARCHAR AS id, event_id AS timestamp FROM events ORDER BY 2 DESC LIMIT 50")
def _(spark, d):
    """Cleared, then filled again up to the cap, the newest kept."""
    saved = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("timestamp"))
    return services.add_saved(services.clear_saved(saved), saved)


@query("snk_saved_deleted", "SELECT event_id::VARCHAR AS id FROM events WHERE event_id <> 7")
def _(spark, d):
    return services.delete_saved(table(spark, d, "events").select(F.col("event_id").cast("string").alias("id")), "7")


@query("snk_backup_status", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Disabled' WHEN o_orderkey % 5 > 0 AND date_diff('day', o_orderdate::DATE, DATE '1998-01-05') < 7 THEN 'NotDue'
    WHEN o_orderkey % 3 = 0 THEN 'Failed' ELSE 'Created' END AS status FROM orders""")  # fmt: skip
def _(spark, d):
    i = F.col("o_orderkey")
    last = F.when(i % 5 > 0, F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", services.backup_status(i % 4 != 0, last, F.lit("1998-01-05").cast("date"), i % 3 != 0).alias("status"))


@query("agg_telemetry_json", """WITH m AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT '{"first_date":"' || (SELECT strftime(min(ts), '%Y-%m-%d') FROM events) || '","last_date":"' || (SELECT strftime(max(ts), '%Y-%m-%d') FROM events) || '","total_searches":' || sum(n)
    || ',"searches_by_mode":{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}}' AS json FROM m""")  # fmt: skip
def _(spark, d):
    return services.telemetry(table(spark, d, "events"), "event_type", F.to_date("ts")).select("json")


@query("src_ocr_events", """SELECT CASE WHEN event_id % 4 = 0 THEN 'progress' ELSE event_type END AS event, (event_id % 1000)::INT AS index, (CASE WHEN event_id % 2 = 0 THEN event_id % 50 ELSE 0 END)::INT AS ok
    FROM events WHERE event_id % 7 <> 0""")  # fmt: skip
def _(spark, d):
    """Events as JSON lines, with a field missing in half of them, among lines that are none."""
    i = F.col("event_id")
    fields = F.concat_ws(
        ", ", F.concat(F.lit('"event": "'), F.when(i % 4 == 0, "progress").otherwise(F.col("event_type")), F.lit('"')), F.concat(F.lit('"index": '), (i % 1000).cast("string")),
        F.when(i % 2 == 0, F.concat(F.lit('"ok": '), (i % 50).cast("string"))),
    )
    line = F.when(i % 7 == 0, F.concat(F.lit("noise "), i.cast("string"))).otherwise(F.concat(F.lit(" {"), fields, F.lit("} ")))
    return ocr.parse_events(table(spark, d, "events").select(line.alias("value"))).select("event", "index", "ok")


@query("joi_i18n", """SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'en ' || c_name WHEN c_custkey % 3 = 0 THEN 'ar ' || c_name ELSE 'k' || c_custkey END AS text FROM customer""")
def _(spark, d):
    c, i = table(spark, d, "customer"), F.col("c_custkey")
    key = F.concat(F.lit("k"), i.cast("string")).alias("key")
    own = lambda locale, n: c.where(i % n == 0).select(F.lit(locale).alias("locale"), key, F.concat(F.lit(f"{locale} "), F.col("c_name")).alias("text"))
    return services.translations(c.select(key), own("en", 2).unionByName(own("ar", 3)), "en")


@query("sca_translation_chain", """SELECT 'كَ' || c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'hand ' || c_name WHEN c_custkey % 3 = 0 THEN 'exact ' || c_name WHEN c_custkey % 2 = 0 THEN 'loose ' || c_name
    ELSE 'كَ' || c_custkey END AS text FROM customer""")  # fmt: skip
def _(spark, d):
    """By hand, else known for the key, else for the key without marks, else the key."""
    c, i = table(spark, d, "customer"), F.col("c_custkey")
    own = lambda n, letter, word: c.where(i % n == 0).select(F.concat(F.lit(letter), i.cast("string")).alias("key"), F.concat(F.lit(f"{word} "), F.col("c_name")).alias("text"))
    known = own(3, "كَ", "exact").unionByName(own(2, "ك", "loose"))
    return services.translation_chain(c.select(F.concat(F.lit("كَ"), i.cast("string")).alias("key")), own(5, "كَ", "hand"), known)


# -- files -----------------------------------------------------------------------------------

_LETTERS, _AR_LETTERS = _LATIN[:52], _ARABIC[:52]
_PLAIN = f"translate(regexp_replace(text, '[^ -~\\n]', '', 'g'), '{_LETTERS}', '{_AR_LETTERS}')"


# Texts spelt in Arabic letters; signs that one of the encodings lacks are taken out on both sides.
_SPELT = f"translate(regexp_replace(text, '[^ -~\\néèàçâêîôûäöüßñóíáú]', '', 'g'), '{_LETTERS}', '{_AR_LETTERS}')"


def _spelt():
    return F.translate(F.regexp_replace("text", "[^ -~\\néèàçâêîôûäöüßñóíáú]", ""), _LETTERS, _AR_LETTERS)


_HAS = {"cp1256": "éèàçâêîôûü", "iso-8859-6": ""}


def _reduced(a: str, encoding: str) -> str:
    lost = "".join(c for c in "éèàçâêîôûäöüßñóíáú" if c not in _HAS[encoding])
    return f"translate({a}, '{lost}', '{'?' * len(lost)}')"


@query("src_read_texts", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN {_reduced(_SPELT, 'cp1256')} ELSE {_SPELT} END AS a, CASE doc_id % 4 WHEN 3 THEN 'PDF' WHEN 2 THEN 'Txt' ELSE 'txt' END AS ext FROM documents),
    v AS (SELECT *, len(regexp_extract_all(substr(a, 1, 2000), '[؀-ۿ]')) > 5 OR (regexp_full_match(substr(a, 1, 2000), '[\\x20-\\x7E\\s]*') AND regexp_matches(a, '[^\\s]')) AS ok FROM t)
    SELECT '/in/' || doc_id || '.' || ext AS path, doc_id::VARCHAR AS title, CASE WHEN ok AND ext <> 'PDF' THEN a END AS text,
        CASE WHEN ext = 'PDF' THEN 'نوع غير مدعوم: pdf' WHEN NOT ok THEN 'فشل قراءة الملف' END AS error FROM v""")  # fmt: skip
def _(spark, d):
    """Texts as files: with a byte order mark, in an old encoding, of another kind."""
    i, a = F.col("doc_id"), _spelt()
    content = F.when(i % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(a, "UTF-8"))).when(i % 4 == 1, files.encode_eight_bit(a, "cp1256")).otherwise(F.encode(a, "UTF-8"))
    ext = F.when(i % 4 == 3, "PDF").when(i % 4 == 2, "Txt").otherwise("txt")
    return files.read_texts(table(spark, d, "documents").select(F.concat(F.lit("/in/"), i.cast("string"), F.lit("."), ext).alias("path"), content.alias("content")))


@query(
    "src_named_encodings",
    f"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN {_SPELT} WHEN 1 THEN {_SPELT} WHEN 2 THEN {_reduced(_SPELT, 'cp1256')} WHEN 3 THEN {_reduced(_SPELT, 'iso-8859-6')}
        WHEN 4 THEN {_SPELT} WHEN 5 THEN {_SPELT} END AS text FROM documents""",
)
def _(spark, d):
    """Every encoding in one table, each row's named; of a row whose bytes are no text of it, null."""
    i, a = F.col("doc_id") % 7, _spelt()
    content = (
        F.when(i == 0, F.encode(a, "UTF-8")).when(i == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(a, "UTF-8"))).when(i == 2, files.encode_eight_bit(a, "cp1256"))
        .when(i == 3, files.encode_eight_bit(a, "iso-8859-6")).when(i == 4, F.encode(a, "UTF-16LE")).when(i == 5, F.encode(a, "UTF-16BE")).otherwise(F.concat(F.encode(a, "UTF-8"), F.unhex(F.lit("FF"))))
    )
    names = F.array(*map(F.lit, ("utf-8", "utf-8-sig", "cp1256", "iso-8859-6", "utf-16-le", "utf-16-be", "utf-8")))
    rows = table(spark, d, "documents").select("doc_id", content.alias("content"), F.element_at(names, (i + 1).cast("int")).alias("encoding"))
    return rows.select("doc_id", files.decode_named(F.col("content"), F.col("encoding")).alias("text"))


@query("sca_parse_int", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 1003)::INT END AS n FROM orders""")
def _(spark, d):
    """Counts with thousands separators and a word after them."""
    i = F.col("o_orderkey")
    text = F.when(i % 5 == 0, "كثير").otherwise(F.concat(F.lit(" "), F.format_number((i * 1003).cast("long"), 0), F.lit(" كلمة 99")))
    return table(spark, d, "orders").select("o_orderkey", headers.parse_int(text).alias("n"))


@query("set_chain_acceptance", """SELECT c_custkey, (c_custkey % 20 + 6 + CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END)::INT AS marked, 1::BIGINT AS first,
    (CASE WHEN c_custkey % 2 = 0 THEN 502 ELSE c_custkey % 20 + 6 END)::BIGINT AS last FROM customer""")  # fmt: skip
def _(spark, d):
    """A second chain is kept after the main one, and not inside its lines."""
    n = (F.col("c_custkey") % 20 + 6).cast("int")
    own = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(i.cast("string"), F.lit("\nنص")))
    other = F.array(*[F.lit(f"{i}\nنص") for i in (500, 501, 502)])
    lines = F.when(F.col("c_custkey") % 2 == 0, F.concat(own, other)).otherwise(F.concat(F.slice(own, 1, 3), other, F.slice(own, F.lit(4), F.size(own))))
    m = page_numbers.marked(F.array_join(lines, "\n"))
    return customers(spark, d).select("c_custkey", m.alias("m")).select("c_custkey", "m.marked", "m.first", "m.last")


@query("src_any_encoding", f"""SELECT '/in/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN p ELSE a END AS text, CASE WHEN doc_id % 2 = 0 AND NOT regexp_full_match(p, '[\\x00-\\x7F]*') THEN 'cp1256' ELSE 'utf-8-sig' END AS encoding
    FROM (SELECT doc_id, {_SPELT} AS a, {_reduced(_SPELT, 'cp1256')} AS p FROM documents)""")  # fmt: skip
def _(spark, d):
    """OCR output in an encoding that nobody tells; ASCII is UTF-8."""
    content = F.when(F.col("doc_id") % 2 == 0, files.encode_eight_bit(_spelt(), "cp1256")).otherwise(F.encode(_spelt(), "UTF-8"))
    return files.read_any(table(spark, d, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")))


@query("str_import", f"""WITH t AS (SELECT doc_id, {_SPELT} AS a FROM documents)
    SELECT doc_id::VARCHAR AS book_title, len(regexp_extract_all(a, '[؀-ۿݐ-ݿࢠ-ࣿ]+'))::BIGINT AS words, TRUE AS numbered FROM t
    WHERE len(regexp_extract_all(substr(a, 1, 2000), '[؀-ۿ]')) > 5 OR (regexp_full_match(substr(a, 1, 2000), '[\\x20-\\x7E\\s]*') AND regexp_matches(a, '[^\\s]'))""")  # fmt: skip
def _(spark, d):
    """The texts as a folder of files, imported by the stream; a second run of it finds nothing new.  Each book's words, and whether its pages are numbered from 1 on."""
    folder, lib, state = work_dir(spark, "import-folder"), _library(spark), work_dir(spark, "import-state")
    text_files.write_text_files(table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), _spelt().alias("text")), folder)
    for _run in range(2):
        ingest.import_stream(spark, folder, lib, state).awaitTermination()
    books = lib.pages().groupBy("book_id", "book_title").agg(F.sum(T.arabic_word_count(F.col("content"))).cast("long").alias("words"), (F.max("page_num") == F.count(F.lit(1))).alias("numbered"))
    return books.drop("book_id")


_OCR_STATE = """WITH e AS (SELECT event_id AS seq, 'f' || user_id AS file, CASE event_id % 10 WHEN 0 THEN 'start' WHEN 8 THEN 'done' WHEN 9 THEN 'error' ELSE 'progress' END AS event,
        (event_id % 7) / 8.0::DOUBLE AS fraction, event_id::VARCHAR AS text FROM events WHERE event_id % 11 <> 0),
    s AS (SELECT file, arg_max(event, seq) AS e, arg_max(fraction, seq) FILTER (event = 'progress') AS f, arg_max(text, seq) FILTER (event = 'progress') AS message, arg_max(text, seq) FILTER (event = 'done') AS txt,
        arg_max(text, seq) FILTER (event = 'error') AS error, count(*) FILTER (event = 'start') AS starts, count(*) FILTER (event = 'error') AS failures, max(seq) AS last_seq FROM e GROUP BY file)
    SELECT file, CASE e WHEN 'done' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, CASE WHEN e = 'done' THEN 1.0::DOUBLE ELSE coalesce(f, 0)::DOUBLE END AS fraction, message,
        CASE WHEN txt IS NOT NULL THEN 3 END::INT AS pages, txt, error, starts, failures, last_seq FROM s"""


def _ocr_lines(spark, d):
    """A log of recognition over the events, a file for each user, among lines that are no events."""
    i = F.col("event_id")
    kind = F.when(i % 10 == 0, "start").when(i % 10 == 8, "done").when(i % 10 == 9, "error").otherwise("progress")
    said = F.when(kind == "done", "txt").when(kind == "error", "error").otherwise("message")
    number = F.when(kind == "done", F.lit(', "pages": 3')).when(kind == "progress", F.concat(F.lit(', "fraction": '), (i % 7 / 8.0).cast("string"))).otherwise("")
    line = F.concat(F.lit('{"event": "'), kind, F.lit('", "file": "f'), F.col("user_id").cast("string"), F.lit('", "'), said, F.lit('": "'), i.cast("string"), F.lit('"'), number, F.lit("}"))
    return table(spark, d, "events").select(i.alias("seq"), F.when(i % 11 == 0, "noise").otherwise(line).alias("value"))


@query("agg_ocr_states", _OCR_STATE)
def _(spark, d):
    lines = _ocr_lines(spark, d)
    return ocr.file_states(ocr.parse_events(lines, keep=("seq",)))


@query("str_ocr_states", _OCR_STATE)
def _(spark, d):
    """The log in pieces that come out of order, followed by a stream that ends after half of them and starts again."""
    log, out, state, lines = work_dir(spark, "ocr-log"), work_dir(spark, "ocr-states"), work_dir(spark, "ocr-checkpoint"), _ocr_lines(spark, d)
    for late in (True, False):
        lines.where((F.col("seq") % 3 == 0) == late).repartition(3, "seq").write.mode("append").parquet(log)
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(log)
        ocr.follow_events(stream, out, state).awaitTermination()
    return ocr.followed(spark, out)


@query("snk_marked_files", "SELECT c_custkey || '.txt' AS name, CASE WHEN c_custkey % 40 >= 3 THEN c_custkey % 40 ELSE 0 END::BIGINT AS marks FROM customer")
def _(spark, d):
    """Numbered texts marked by tasks into files, and read back."""
    folder = work_dir(spark, "marked")
    texts = _numbered_text(spark, d).select(F.concat(F.lit("/in/"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("path"), "text")
    page_numbers.mark_files(texts, folder)
    back = files.scan(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("text"))
    return back.select("name", F.regexp_count("text", F.lit(f"{page_numbers.BAR} [0-9]+ {page_numbers.BAR}")).cast("long").alias("marks"))


def _docx(batches):
    for batch in batches:
        files_ = []
        for text in batch["text"]:
            out = io.BytesIO()
            exports.write_document(out, ([(line, False)] for line in (text or "").split("\n")))
            files_.append(out.getvalue())
        yield batch[["path"]].assign(content=files_)


@query("src_docx", "SELECT '/in/' || doc_id || '.DOCX' AS path, doc_id::VARCHAR AS title, CASE WHEN NOT b THEN text END AS text, CASE WHEN b THEN 'فشل قراءة الملف' END AS error FROM (SELECT *, coalesce(regexp_full_match(text, '[\\s\\x0b\\x{85}\\p{Z}]*'), TRUE) AS b FROM documents)")
def _(spark, d):
    """Texts as documents, a paragraph a line, and read back."""
    ship(spark)
    rows = table(spark, d, "documents")
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".DOCX"))
    return files.read_texts(rows.select(path.alias("path"), "text").mapInPandas(_docx, "path string, content binary"))


def _write_shards(folder: str):
    def run(batches):
        """Rows of one shard after another, its books first; a batch at a time goes into its file."""
        now, db, new = None, None, None

        def close():
            if db is not None:
                db.commit()
                db.close()
                os.replace(new, os.path.join(folder, f"shard_{now:04d}.db"))

        for batch in batches:
            for shard, rows in batch.groupby("shard", sort=True):
                if shard != now:
                    close()
                    now, new = int(shard), os.path.join(folder, f"_{int(shard)}-{uuid.uuid4().hex}.new")
                    db = sqlite3.connect(new)
                    db.execute("CREATE TABLE books(id INTEGER PRIMARY KEY, title TEXT, category TEXT)")
                    db.execute("CREATE TABLE pages(book_id INTEGER, page_num INTEGER, content TEXT)")
                    yield rows[["shard"]].head(1)
                books, texts = rows[rows.page_num.isna()], rows[rows.page_num.notna()]
                db.executemany("INSERT INTO books VALUES (?, ?, ?)", [(int(i), t, c) for i, t, c in zip(books.id, books.title, books.text, strict=True)])
                db.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(int(i), int(p), t) for i, p, t in zip(texts.id, texts.page_num, texts.text, strict=True)])
        close()

    return run


@query("src_shards", """SELECT (c_nationkey % 4)::BIGINT * 1000000000000 + c_custkey AS book_id, o_orderkey::INT AS page_num, o_orderpriority AS content, c_name AS book_title, c_mktsegment AS category,
    (SELECT count(*) FROM customer) AS books FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'""")  # fmt: skip
def _(spark, d):
    """Customers and orders as four SQLite shards in the shared folder, migrated into a library."""
    ship(spark)
    folder = work_dir(spark, "shards").removeprefix("file://")
    os.makedirs(folder)
    c = table(spark, d, "customer").withColumn("shard", F.col("c_nationkey") % 4)
    books = c.select("shard", F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("page_num"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    text = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).otherwise("")
    rows = books.unionByName(o.select("shard", F.col("c_custkey").alias("id"), F.col("o_orderkey").alias("page_num"), F.lit("").alias("title"), text.alias("text")))
    rows.repartition("shard").sortWithinPartitions("shard", F.col("page_num").isNotNull()).mapInPandas(_write_shards(folder), "shard int").count()
    lib = _library(spark)
    done = shards.migrate(spark, folder, lib)
    return lib.pages().select("book_id", "page_num", "content", "book_title", "category", F.lit(done.total_books).cast("long").alias("books"))


# -- files in the shared folder ------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    path = work_dir(spark, name).removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


@query("src_symbols", _found(f"[نمس]{_V}[اي]{_V}[تط]{_V}", _ARLIB))
def _(spark, d):
    """A pattern under symbols from a SQLite map; the last row of a key holds."""
    path = os.path.join(_folder(spark, "symbols"), "map.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE map_data(key TEXT, value TEXT)")
        db.executemany("INSERT INTO map_data VALUES (?, ?)", [("ف", "x"), ("ف", "[نمس]"), ("ع", "[اي]"), ("ل", "[تط]"), ("ل", None)])
    return search.search_pattern(arabic(spark, d), "فعل", ALL, shards.load_symbols(path))


@query("snk_backup_restore", f"WITH {_LIB} {_STORED} WHERE book_id <> 5")
def _(spark, d):
    """A library put back from its last backup after it was emptied; a deleted book is in neither."""
    lib, folder = _library(spark), work_dir(spark, "backups")
    lib.append(corpus(spark, d).where("book_id % 2 = 0"))
    services.create_backup(lib, folder, "backup-1")
    lib.append(corpus(spark, d).where("book_id % 2 = 1"))
    lib.delete_book(5)
    services.create_backup(lib, folder, "backup-2")
    lib.clear()
    services.restore_backup(lib, folder, services.list_backups(lib, folder)[0])
    return _stored(lib)


@query("snk_book_text", "SELECT doc_id || '.txt' AS name, text || chr(10) || chr(10) || lang AS value FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    """Every book of the library as a file, of two pages each."""
    folder, p = work_dir(spark, "books"), corpus(spark, d).where("content is not null")
    second = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("book_id"), F.lit(2).alias("page_num"), F.col("lang").alias("content"))
    exports.write_books(second.unionByName(p, allowMissingColumns=True), folder)
    back = files.scan(spark, folder)
    return back.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("value"))


@query("snk_docx", f"""{_hits('trash')}, {_SNIP} SELECT (serial - 1) // 20 AS file, CASE WHEN min(serial) = 1 THEN 'نتائج البحث عن: trash' || chr(10) ELSE '' END
    || string_agg('[' || serial || '] ' || book_title || ' — صفحة 1' || chr(10) || v, chr(10) ORDER BY serial) AS text FROM e GROUP BY 1""")  # fmt: skip
def _(spark, d):
    """All results as documents of 20 each, and read back."""
    folder, p = work_dir(spark, "docx"), corpus(spark, d)
    exports.write_docx(search.search(p, "trash", SearchMode.WORD, ALL), p, folder, "trash", per_file=20)
    number = F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long")
    return files.read_texts(files.scan(spark, folder)).select(number.alias("file"), "text")


@query("snk_csv_file", f"""{_hits('trash')}, {_SNIP} SELECT (serial - 1) // 20 AS file, serial::VARCHAR AS serial, book_title, author, year, term, v AS snippet FROM e""")
def _(spark, d):
    """Files of 20 results, each with its mark and header; lines inside quotes belong to their record."""
    folder, p = work_dir(spark, "csv"), corpus(spark, d)
    exports.write_csv(search.search(p, "trash", SearchMode.WORD, ALL), p, folder, per_file=20)
    names = ["serial", "book_title", "author", "category", "year", "page", "term", "snippet"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(folder, multiLine=True, escape='"', header=True, enforceSchema=True)
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.csv$", 1).cast("long")
    return rows.select(number.alias("file"), *(n for n in names if n not in ("category", "page")))


@query("snk_crash_logs", "SELECT 'crash-' || strftime(TIMESTAMP '2026-01-01' + INTERVAL (o_orderkey) SECOND, '%Y%m%d-%H%M%S-000000.log') AS name, o_orderpriority AS text FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def _(spark, d):
    """A log for each order, in two goes, of which the newest stay."""
    folder, o = work_dir(spark, "logs"), table(spark, d, "orders")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01").cast("timestamp")) + F.col("o_orderkey"))
    for odd in (0, 1):
        services.write_crash_logs(o.where(F.col("o_orderkey") % 2 == odd).select(at.alias("at"), F.col("o_orderpriority").alias("text")), folder)
    return services.crash_logs(spark, folder)


@query("snk_import_log", """SELECT CASE WHEN length(text) >= 300 THEN 'OK /in/' || doc_id ELSE 'ERROR /in/' || doc_id || ' فشل قراءة الملف' END AS value FROM documents""")
def _(spark, d):
    ok = F.length("text") >= 300
    status = table(spark, d, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), ok.alias("ok"), F.when(~ok, files.UNREADABLE).alias("error"))
    return importer.log_lines(status)


# Two chains, the second after the first; where they touch, the numbers are put in order.
_BAR = "repeat('=', 25)"
_MARK = lambda x: f"{_BAR} || ' ' || ({x}) || ' ' || {_BAR}"


@query("sca_facing_pages", f"""SELECT c_custkey, {_MARK('n')} || chr(10) || 'نص' || chr(10) || {_MARK('n + 1')} || chr(10) || 'نص' || chr(10) || {_MARK('n + 2')} || chr(10) || 'نص' || chr(10) || {_MARK('3')} || chr(10) || chr(10)
    || {_MARK('n + 3')} || chr(10) || 'نص' || chr(10) || {_MARK('4')} || chr(10) || 'نص' || chr(10) || {_MARK('5')} AS text FROM (SELECT c_custkey, c_custkey % 50 + 20 AS n FROM customer)""")  # fmt: skip
def _(spark, d):
    n = F.col("c_custkey") % 50 + 20
    lines = [n, "نص", n + 1, "نص", n + 2, "نص", n + 3, "", 3, "نص", 4, "نص", 5]
    text = F.concat_ws("\n", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in lines])
    return customers(spark, d).select("c_custkey", page_numbers.marked(text)["text"].alias("text"))


@query("src_scan", """SELECT c_name || CASE c_custkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' ELSE '.Docx' END AS name, length(c_name)::BIGINT AS length FROM customer WHERE c_custkey % 5 < 3""")
def _(spark, d):
    """Files of the kinds that can be read, whatever the case, in folders of folders."""
    folder, i = work_dir(spark, "scan"), F.col("c_custkey")
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".TXT", ".Docx", ".pdf", ""))), (i % 5 + 1).cast("int"))
    name = F.concat((i % 2).cast("string"), F.lit("/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_name"), ending)
    text_files.write_text_files(customers(spark, d).select(name.alias("name"), F.col("c_name").alias("text")), folder)
    return files.scan(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
