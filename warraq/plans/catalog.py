"""Queries over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import exports, services
from ..functions import text as T
from ..operators import library, match, reader, render, search, stats
from ..operators.search import SearchMode, SearchOptions, TimeMode
from ..schema import ALL_BOOKS, UNCLASSIFIED
from ..sources import files, shards
from ..sources.corpus import documents_as_pages
from .samples import quote

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_pages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "nation"))


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_LIB = """lib AS (SELECT doc_id AS book_id, 1 AS page_num, NULL::VARCHAR AS original_page_number, text AS content, 'doc-' || doc_id AS book_title,
    source AS author, CASE WHEN doc_id % 10 <> 3 THEN lang END AS category,
    CASE WHEN doc_id % 10 = 0 THEN '0000' ELSE lpad((1000 + doc_id % 50)::VARCHAR, 4, '0') END AS year,
    CASE WHEN doc_id % 10 = 0 THEN '0000' ELSE lpad((1000 + doc_id % 50)::VARCHAR, 4, '0') END AS death_year, n_name AS country
    FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 25)"""
_RESULT = """book_id::BIGINT AS book_id, page_num::INT AS page_number, original_page_number::VARCHAR AS original_page_number, term AS matched_term, pos::BIGINT AS match_position,
    substr(content, greatest(pos - 100, 0) + 1, pos + length(term) + 100 - greatest(pos - 100, 0)) AS context_snippet,
    book_title, author::VARCHAR AS book_author, category AS book_category, year::VARCHAR AS book_year, 1.0::DOUBLE AS relevance"""


def _hits(pattern: str, lib: str = _LIB, where: str = "TRUE") -> str:
    p = quote(pattern)
    return f"""WITH {lib}, seg AS (SELECT *, string_split_regex(regexp_replace(content, {p}, chr(57344) || '\\0' || chr(57345), 'g'), '[' || chr(57344) || chr(57345) || ']') AS s
        FROM lib WHERE {where}),
    hit AS (SELECT seg.* EXCLUDE (s), s[i] AS term, coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0)::BIGINT AS pos
        FROM seg, unnest(generate_series(2, len(s), 2)) AS u(i))"""


def _found(pattern: str, lib: str = _LIB, where: str = "TRUE", tail: str = "") -> str:
    return f"{_hits(pattern, lib, where)} SELECT {_RESULT} FROM hit {tail}"


ALL = SearchOptions(limit=None)

# Expected expressions, written out: what a search means on Latin text, which has no Arabic marks.
_THE, _OF = "the", "of"
_BETWEEN = r"""[،,؛;:.!؟?\-–—()\[\]{}«»"'`]*\s+[،,؛;:.!؟?\-–—()\[\]{}«»"'`]*"""
_OF_THE = f"of{_BETWEEN}the"
_OF_NEAR_THE = rf"of(?:{_BETWEEN}\S+){{0,5}}{_BETWEEN}the|the(?:{_BETWEEN}\S+){{0,5}}{_BETWEEN}of"


@query("mat_word", _found(_THE))
def mat_word(spark, d):
    return search.search(corpus(spark, d), "the", SearchMode.WORD, ALL)


@query("mat_phrase", _found(_OF_THE))
def _(spark, d):
    return search.search(corpus(spark, d), "of the", SearchMode.WORD, ALL)


@query("mat_proximity", _found(_OF_NEAR_THE))
def _(spark, d):
    return search.search(corpus(spark, d), "of | the", SearchMode.WORD, ALL)


_FIRST = "length(string_split_regex(content, {p})[1])"


@query(
    "mat_page_and",
    f"""WITH {_LIB}, m AS (SELECT *, {_FIRST.format(p=quote(_THE))} AS a, {_FIRST.format(p=quote('and'))} AS b FROM lib
        WHERE regexp_matches(content, {quote(_THE)}) AND regexp_matches(content, {quote('and')})),
    hit AS (SELECT *, least(a, b) AS pos, CASE WHEN a <= b THEN regexp_extract(content, {quote(_THE)}) ELSE regexp_extract(content, {quote('and')}) END AS term FROM m)
    SELECT {_RESULT} FROM hit""",
)
def _(spark, d):
    return search.search(corpus(spark, d), "the + and", SearchMode.WORD, ALL)


@query("mat_regex_prepared", _found(r"(?m)^[A-Z]\w+"))
def _(spark, d):
    return search.search(corpus(spark, d), r"^[A-Z]\w+", SearchMode.REGEX, ALL)


@query("mat_regex_rejected", f"WITH {_LIB}, hit AS (SELECT *, '' AS term, 0 AS pos FROM lib WHERE FALSE) SELECT {_RESULT} FROM hit")
def _(spark, d):
    return search.search(corpus(spark, d), "(?s:the.*)", SearchMode.REGEX, ALL)


@query(
    "mat_first_match",
    f"""WITH {_LIB} SELECT book_id, regexp_extract(content, {quote(_THE)}) AS matched_term, {_FIRST.format(p=quote(_THE))}::BIGINT AS match_position
        FROM lib WHERE regexp_matches(content, {quote(_THE)})""",
)
def _(spark, d):
    df = match.first_match_per_page(corpus(spark, d), _THE)
    return df.select("book_id", "matched_term", F.col("match_position").cast("long").alias("match_position"))


@query("mat_find_literal", f"""{_hits('(?i)the')} SELECT book_id, page_num::INT AS page_num, term AS matched_term, pos AS match_position,
    row_number() OVER (PARTITION BY book_id ORDER BY page_num, pos) AS ordinal FROM hit""")  # fmt: skip
def _(spark, d):
    df = search.find_literal(corpus(spark, d), "THE")
    return df.select("book_id", "page_num", "matched_term", F.col("match_position").cast("long").alias("match_position"), F.col("ordinal").cast("long").alias("ordinal"))


def _filtered(name: str, options: dict, where: str) -> None:
    query(name, _found(_OF, where=where))(lambda spark, d: search.search(corpus(spark, d), "of", SearchMode.WORD, SearchOptions(limit=None, **options)))


_filtered("flt_categories", {"categories": ("en", "de")}, "category IN ('en', 'de')")
_filtered("flt_categories_unclassified", {"categories": ("fr", "غير مصنّف")}, "(category IN ('fr') OR category IS NULL)")
_filtered("flt_years_time_mode", {"years": ("1007", "1021"), "time_mode": TimeMode.USAGE_DATE}, "year IN ('1007', '1021')")
_filtered("flt_death_years", {"years": ("1007", "0000")}, "death_year IN ('1007', '0000')")
_filtered("flt_countries", {"countries": ("NATION_7", "NATION_11")}, "country IN ('NATION_7', 'NATION_11')")
_filtered("flt_book_ids", {"book_ids": (3, 7, 11, 42)}, "book_id IN (3, 7, 11, 42)")
_filtered("flt_combined", {"categories": ("en",), "countries": ("NATION_7", "NATION_2", "NATION_18"), "years": ("1007", "1002", "1018")},
          "category = 'en' AND country IN ('NATION_7', 'NATION_2', 'NATION_18') AND death_year IN ('1007', '1002', '1018')")


@query("srt_limit", _found(_THE, tail="ORDER BY book_id, page_num, pos LIMIT 1000"))
def _(spark, d):
    return search.search(corpus(spark, d), "the", SearchMode.WORD, SearchOptions())


# -- statistics -----------------------------------------------------------------


def _stat_sql(key: str, named: str, all_row: bool = False) -> str:
    top = f"SELECT '{ALL_BOOKS}' AS {named}, count(DISTINCT book_id) AS books, 0::INT AS rank FROM lib UNION ALL " if all_row else ""
    return f"""WITH {_LIB} {top}SELECT coalesce({key}, '{UNCLASSIFIED}') AS {named}, count(DISTINCT book_id) AS books,
        (CASE WHEN {key} IS NULL THEN 1 ELSE 2 END)::INT AS rank FROM lib GROUP BY 1, 3"""


@query("agg_by_category", _stat_sql("nullif(trim(category), '')", "category", True))
def _(spark, d):
    return stats.by_category(corpus(spark, d))


@query("agg_by_year", _stat_sql("nullif(death_year, '0000')", "year"))
def _(spark, d):
    return stats.by_year(corpus(spark, d))


@query("agg_by_region", _stat_sql("nullif(trim(country), '')", "region"))
def _(spark, d):
    return stats.by_region(corpus(spark, d))


@query("agg_totals", f"""WITH {_LIB} SELECT count(DISTINCT book_id) AS total_books, count(*) AS total_pages, (sum(length(content)) // 5)::BIGINT AS total_words_estimate,
    count(DISTINCT author) AS author_count FROM lib""")  # fmt: skip
def _(spark, d):
    return stats.totals(corpus(spark, d))


@query("agg_books", f"WITH {_LIB} SELECT book_id, book_title, author, category, year, death_year, country FROM lib")
def _(spark, d):
    return stats.books(corpus(spark, d))


@query("agg_total_books", "SELECT count(DISTINCT doc_id) AS total_books FROM documents")
def _(spark, d):
    return stats.total_books(corpus(spark, d))


@query("agg_max_book_id", "SELECT coalesce(max(doc_id), 0) AS max_book_id FROM documents")
def _(spark, d):
    return stats.max_book_id(corpus(spark, d))


@query("agg_distinct_years", f"WITH {_LIB} SELECT year, count(DISTINCT book_id) AS books FROM lib WHERE year <> '0000' GROUP BY 1")
def _(spark, d):
    return stats.distinct_years(corpus(spark, d))


@query("agg_distinct_regions", f"WITH {_LIB} SELECT country AS region, count(DISTINCT book_id) AS books FROM lib WHERE country IS NOT NULL GROUP BY 1")
def _(spark, d):
    return stats.distinct_regions(corpus(spark, d))


@query("agg_book_summary", f"WITH {_LIB} SELECT book_id, book_title, author, category, year, 1::BIGINT AS pages_count FROM lib WHERE book_id = 42")
def _(spark, d):
    return stats.book_summary(corpus(spark, d), 42)


@query("agg_telemetry", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    counters = stats.counters(table(spark, d, "events"), "event_type")
    return counters.select(F.explode("counters").alias("event_type", "n"))


@query("agg_telemetry_span", "SELECT min(ts)::DATE AS first_date, max(ts)::DATE AS last_date, count(*) AS total_searches FROM events")
def _(spark, d):
    return services.telemetry(table(spark, d, "events"), "event_type", F.to_date("ts")).select("first_date", "last_date", F.col("total_searches").cast("long").alias("total_searches"))


# -- filters on lists -------------------------------------------------------------


@query("flt_visible_books", f"WITH {_LIB} SELECT book_id, book_title FROM lib WHERE country IN ('NATION_7', 'NATION_11')")
def _(spark, d):
    chosen = library.Selection("region", frozenset({"NATION_7", "NATION_11"}))
    return library.visible_books(stats.books(corpus(spark, d)), chosen).select("book_id", "book_title")


@query("flt_visible_unclassified", f"WITH {_LIB} SELECT book_id, book_title FROM lib WHERE death_year = '0000' OR death_year = '1007'")
def _(spark, d):
    chosen = library.Selection("year", frozenset({UNCLASSIFIED, "1007"}))
    return library.visible_books(stats.books(corpus(spark, d)), chosen).select("book_id", "book_title")


@query("flt_needle", f"WITH {_LIB} SELECT book_id, book_title FROM lib WHERE contains(book_title, '-4')")
def _(spark, d):
    return library.containing(corpus(spark, d), "book_title", " -4 ").select("book_id", "book_title")


@query("flt_selection_membership", f"WITH {_LIB} SELECT DISTINCT country, country IN ('NATION_7', 'NATION_11') AS selected FROM lib")
def _(spark, d):
    return library.reapplied(corpus(spark, d).select("country").distinct(), "country", ["NATION_7", "NATION_11"])


@query("flt_preflight", """SELECT count(*) AS files, count(*) FILTER (text IS NULL OR doc_id % 97 = 0) AS unreadable, count(*) FILTER (strlen(text) < 300 AND doc_id % 97 <> 0) AS empty, count(*) FILTER (doc_id % 97 <> 0 AND strlen(text) * 10000 > 104857600) AS large,
    (sum(CASE WHEN doc_id % 97 = 0 OR strlen(text) < 300 THEN 0 ELSE strlen(text) END) * 10000)::BIGINT AS bytes,
    (2 * sum(CASE WHEN doc_id % 97 = 0 OR strlen(text) < 300 THEN 0 ELSE strlen(text) END) * 10000)::BIGINT AS disk_needed FROM documents""")
def _(spark, d):
    """Sizes from the texts: some unreadable, short ones empty, the longest over the limit."""
    n = F.octet_length("text").cast("long")
    size = F.when(F.col("doc_id") % 97 != 0, F.when(n < 300, 0).otherwise(n * 10000))
    return files.preflight(table(spark, d, "documents").select(size.alias("length")))


# -- reading and windows -----------------------------------------------------------


@query("srt_book_pages", "SELECT o_custkey AS book_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS page_num, o_orderkey AS content FROM orders WHERE o_custkey = 7")
def _(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page_num"), F.col("o_orderkey").alias("content"))
    return reader.get_book_pages(rows, 7)


@query("src_get_page", f"WITH {_LIB} SELECT book_id, page_num::INT AS page_num, content FROM lib WHERE book_id = 42 AND page_num = 1")
def _(spark, d):
    return reader.get_page(corpus(spark, d), 42, 1).select("book_id", "page_num", "content")


@query("win_jump", "SELECT l_orderkey AS book_id, l_linenumber::INT AS page_num, l_partkey::VARCHAR AS original_page_number FROM lineitem WHERE l_orderkey = 7 AND (l_partkey = 2 OR l_linenumber = 2) ORDER BY l_linenumber LIMIT 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("page_num"), F.col("l_partkey").cast("string").alias("original_page_number"))
    return reader.jump_to(rows, 7, 2)


@query("win_page_neighbours", """SELECT book_id, page_num, lag(page_num) OVER w AS previous_page, lead(page_num) OVER w AS next_page
    FROM (SELECT DISTINCT l_suppkey AS book_id, l_orderkey AS page_num FROM lineitem) WINDOW w AS (PARTITION BY book_id ORDER BY page_num)""")  # fmt: skip
def _(spark, d):
    return reader.with_neighbours(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_orderkey").alias("page_num")).distinct())


_EVERY = _hits(_THE) + ", n AS (SELECT book_id, pos::BIGINT AS match_position, (row_number() OVER (ORDER BY book_id, page_num, pos))::INT AS serial FROM hit)"


def _every(spark, d):
    return search.search(corpus(spark, d), "the", SearchMode.WORD, ALL).select("book_id", "page_number", "match_position")


@query("win_serial", _EVERY + " SELECT serial, book_id, match_position FROM n")
def _(spark, d):
    return reader.numbered(_every(spark, d)).select("serial", "book_id", "match_position")


@query("win_groups500", _EVERY + " SELECT serial, ceil(serial / 500.0)::INT AS display_group FROM n")
def _(spark, d):
    return reader.grouped(_every(spark, d)).select("serial", "display_group")


@query("win_next_prev", _EVERY + " SELECT serial, greatest(serial - 1, 1) AS previous_serial, least(serial + 1, max(serial) OVER ()) AS next_serial FROM n")
def _(spark, d):
    return reader.with_neighbour_results(_every(spark, d)).select("serial", "previous_serial", "next_serial")


@query("win_next_prev_wrapped", _EVERY + """ SELECT serial, CASE WHEN serial = 1 THEN max(serial) OVER () ELSE serial - 1 END AS previous_serial,
    CASE WHEN serial = max(serial) OVER () THEN 1 ELSE serial + 1 END AS next_serial FROM n""")  # fmt: skip
def _(spark, d):
    return reader.with_neighbour_results(_every(spark, d), wrap=True).select("serial", "previous_serial", "next_serial")


@query("win_saved_cap50", "SELECT event_id::VARCHAR AS id, event_type AS name, event_id * 1000 AS timestamp FROM events ORDER BY 3 DESC LIMIT 50")
def _(spark, d):
    e = table(spark, d, "events")
    saved = e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), (F.col("event_id") * 1000).alias("timestamp"))
    return services.add_saved(saved.limit(0), saved)


@query("win_newest_of_each", "SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC))::INT AS rank FROM events) WHERE rank <= 20")
def _(spark, d):
    return services.newest_of_each(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 20)


@query("agg_bookmarks", "SELECT user_id AS book_id, arg_max(event_id, (ts, event_id)) AS page, max(ts) AS ts FROM events GROUP BY 1")
def _(spark, d):
    return services.bookmarks(table(spark, d, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("page"), "ts"))


@query("srt_top20_categories", _stat_sql("nullif(death_year, '0000')", "year") + " ORDER BY rank, year LIMIT 20")
def _(spark, d):
    return stats.in_display_order(stats.by_year(corpus(spark, d)), "year").limit(20)


# -- rendering ---------------------------------------------------------------------

_TRASH = "trash"
_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


_PARTS = """p AS (SELECT doc_id, string_split(text, 'the') AS s FROM documents), q AS (SELECT doc_id, len(s) - 1 AS n, s[1:101] AS head, array_to_string(s[102:], 'the') AS rest, len(s) > 101 AS more FROM p),
    t AS (SELECT doc_id, n, CASE WHEN more THEN list_concat(head[1:100], [head[101] || 'the' || rest]) ELSE head END AS gaps FROM q)"""


@query("sca_html", f"WITH {_PARTS} SELECT doc_id, array_to_string(list_transform(gaps, lambda text: {_ESC}), '<mark>the</mark>') AS html FROM t")
def _(spark, d):
    """Each text, at most 100 hits marked."""
    return table(spark, d, "documents").select("doc_id", render.to_html(F.col("text"), "the").alias("html"))


@query("sca_segments", f"""WITH {_PARTS} SELECT doc_id, (len(list_filter(gaps, lambda x: x <> '')) + len(gaps) - 1)::BIGINT AS segments, (len(gaps) - 1)::BIGINT AS matches FROM t""")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", render.highlight_segments(F.col("text"), "the").alias("s"))
    return df.select("doc_id", F.size("s").cast("long").alias("segments"), F.size(F.filter("s", lambda x: x["is_match"])).cast("long").alias("matches"))


_AROUND = """CASE WHEN p > 81 THEN '…' ELSE '' END || substr(text, greatest(p - 80, 1), p + 5 + 80 - greatest(p - 80, 1)) ||
    CASE WHEN p + 84 < length(text) THEN '…' ELSE '' END"""


@query("sca_snippet_around", f"SELECT doc_id, CASE WHEN p > 0 THEN {_AROUND} END AS snippet FROM (SELECT *, strpos(text, 'trash') AS p FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", render.snippet_around(F.col("text"), _TRASH).alias("snippet"))


@query("sca_snippet_html", f"""SELECT doc_id, regexp_replace({_ESC.replace('text', 'snip')}, 'trash', '<b>\\0</b>', 'g') AS html
    FROM (SELECT doc_id, CASE WHEN p > 0 THEN {_AROUND} END AS snip FROM (SELECT *, strpos(text, 'trash') AS p FROM documents))""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", render.snippet_html(F.col("text"), _TRASH, open_tag="<b>", close_tag="</b>").alias("html"))


@query("sca_highlight_literal", "SELECT doc_id, replace(text, 'trash', '<mark>trash</mark>') AS html FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", render.highlight_literal(F.col("text"), _TRASH).alias("html"))


@query("sca_kwic7", _hits(_TRASH) + r""", f AS (SELECT book_id, pos, trim(replace(substr(content, greatest(pos - 100, 0) + 1, pos + length(term) + 100 - greatest(pos - 100, 0)), chr(10), ' ')) AS flat FROM hit),
    w AS (SELECT *, list_filter(string_split_regex(substr(flat, 1, strpos(flat, 'trash') - 1), '\s+'), lambda x: x <> '') AS l,
                 list_filter(string_split_regex(substr(flat, strpos(flat, 'trash') + 5), '\s+'), lambda x: x <> '') AS r FROM f)
    SELECT book_id, pos AS match_position, array_to_string(list_concat(list_concat(l[greatest(len(l) - 6, 1):], ['trash']), r[1:7]), ' ') AS kwic FROM w""")  # fmt: skip
def _(spark, d):
    found = search.search(corpus(spark, d), _TRASH, SearchMode.WORD, ALL)
    return found.select("book_id", "match_position", render.context_window(F.col("context_snippet"), F.col("matched_term")).alias("kwic"))


@query("sca_export30", r"""WITH d AS (SELECT doc_id, text, strpos(text, 'trash') AS p FROM documents),
    c AS (SELECT *, length(regexp_extract(substr(text, 1, p - 1), '[\p{L}\p{Nd}]+$')) AS h FROM d),
    s AS (SELECT doc_id, p, substr(text, 1, p - 1 - h) AS l, substr(text, p - h) AS r FROM c),
    n AS (SELECT *, len(regexp_extract_all(l, '[\p{L}\p{Nd}]+')) AS nl, len(regexp_extract_all(r, '[\p{L}\p{Nd}]+')) AS nr FROM s)
    SELECT doc_id, CASE WHEN coalesce(p, 0) = 0 THEN 'no hit' ELSE CASE WHEN nl > 30 THEN '… ' ELSE '' END || trim(regexp_extract(l, '(?:[\p{L}\p{Nd}]+[^\p{L}\p{Nd}]*){0,30}$')
      || regexp_extract(r, '^((?:[\p{L}\p{Nd}]+[^\p{L}\p{Nd}]*){0,30}[\p{L}\p{Nd}]+)', 1), E' \n\t') || CASE WHEN nr > 31 THEN ' …' ELSE '' END END AS snippet FROM n""")  # fmt: skip
def _(spark, d):
    """What the result showed stays where the page has no hit."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", render.export_snippet(F.col("text"), F.lit(_TRASH), F.lit("no hit")).alias("snippet"))


def _cite(name: str, sql: str) -> None:
    def run(spark, d):
        p = corpus(spark, d)
        text = T.citation(name, F.col("author"), F.col("book_title"), F.col("year"), T.display_page(F.col("original_page_number"), F.col("page_num")), F.lit(2026))
        return p.select("book_id", text.alias("citation"))

    query(f"sca_citation_{name}", f"WITH {_LIB} SELECT book_id, {sql} AS citation FROM lib")(run)


_cite("apa", "author || ' (' || year || '). ' || book_title || '. p. 1.'")
_cite("mla", "author || '. ' || book_title || '. ' || year || ', p. 1.'")
_cite("chicago", "author || ', ' || book_title || ' (' || year || '), 1.'")
_cite("arabic", "author || '. ' || book_title || '. (' || year || '). صفحة 1. (مكتبة بحثيّة، استُرجع 2026).'")


@query("sca_csv_escape", """SELECT doc_id, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS v FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.csv_escape(F.col("text")).alias("v"))


@query("snk_csv_lines", _hits(_TRASH) + r""", s AS (SELECT *, row_number() OVER (ORDER BY book_id, page_num, pos) AS serial, strpos(content, 'trash') AS p FROM hit),
    c AS (SELECT *, length(regexp_extract(substr(content, 1, p - 1), '[\p{L}\p{Nd}]+$')) AS h FROM s),
    x AS (SELECT *, substr(content, 1, p - 1 - h) AS l, substr(content, p - h) AS r FROM c),
    e AS (SELECT *, CASE WHEN len(regexp_extract_all(l, '[\p{L}\p{Nd}]+')) > 30 THEN '… ' ELSE '' END || trim(regexp_extract(l, '(?:[\p{L}\p{Nd}]+[^\p{L}\p{Nd}]*){0,30}$')
      || regexp_extract(r, '^((?:[\p{L}\p{Nd}]+[^\p{L}\p{Nd}]*){0,30}[\p{L}\p{Nd}]+)', 1), E' \n\t') || CASE WHEN len(regexp_extract_all(r, '[\p{L}\p{Nd}]+')) > 31 THEN ' …' ELSE '' END AS v FROM x)
    SELECT serial::INT AS serial, serial || ',' || book_title || ',' || author || ',' || coalesce(category, '') || ',' || year || ',1,' || term || ',' ||
      CASE WHEN contains(v, ',') OR contains(v, '"') OR contains(v, chr(10)) THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS value FROM e""")  # fmt: skip
def _(spark, d):
    p = corpus(spark, d)
    return exports.csv_lines(search.search(p, _TRASH, SearchMode.WORD, ALL), p)


# -- text functions -----------------------------------------------------------------


@query("sca_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@query("sca_human_size", """SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', floor(n / 1073741824.0 * 10 + 0.5) / 10) WHEN n >= 1048576 THEN (n // 1048576) || ' MB'
    WHEN n >= 1024 THEN (n // 1024) || ' KB' ELSE n || ' B' END AS s FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS n FROM orders)""")  # fmt: skip
def _(spark, d):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return table(spark, d, "orders").select("o_orderkey", T.human_size(n).alias("s"))


@query("sca_safe_name", """SELECT page_id, substr(regexp_replace(url, '[\\\\/:*?"<>|]', '_', 'g'), 1, 40) AS s FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("s"))


@query("sca_abbreviated", r"""SELECT doc_id, CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') || ' ...' ELSE text END AS s
    FROM (SELECT doc_id, text, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS w FROM documents)""")  # fmt: skip
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.abbreviated(F.col("text")).alias("s"))


@query("sca_set_codec", "SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1")
def _(spark, d):
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    return sets.select("o_custkey", T.decode_set(T.encode_set(F.col("s"))).alias("s"))


@query("sca_display_names", f"WITH {_LIB} SELECT DISTINCT coalesce(category, 'none') AS name FROM lib")
def _(spark, d):
    c = F.coalesce("category", F.lit(UNCLASSIFIED))
    return corpus(spark, d).select(T.display_category(c, "all", "none").alias("name")).distinct()


@query("snk_backup_due", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-01-05') >= 7 AS due FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", services.backup_due(F.to_date("o_orderdate"), F.lit("1998-01-05").cast("date")).alias("due"))


@query("src_json", """SELECT event_id, CASE WHEN json_type(props, '$.k') NOT IN ('OBJECT', 'ARRAY') THEN props ->> '$.k' END AS k FROM events""")
def _(spark, d):
    from ..sources.ocr import flat_json

    return table(spark, d, "events").select("event_id", *flat_json(F.col("props"), "k"))


@query("joi_migrate", """SELECT c_nationkey::BIGINT * 1000000000000 + c_custkey AS book_id, o_orderkey::INT AS page_num, c_name AS book_title
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'""")  # fmt: skip
def _(spark, d):
    gid = F.col("c_nationkey").cast("long") * shards.ID_STEP + F.col("c_custkey")
    none = F.lit(None).cast("string")
    c = table(spark, d, "customer")
    books = c.select(gid.alias("book_id"), F.col("c_name").alias("title"), none.alias("author"), F.col("c_mktsegment").alias("category"), none.alias("year"), none.alias("death_year"), none.alias("country"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(gid.alias("book_id"), F.col("o_orderkey").cast("int").alias("page_num"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise("").alias("content"), none.alias("original_page_number"))
    return shards.page_rows(books, rows).select("book_id", "page_num", "book_title")


@query("joi_result_pages", _hits(_TRASH) + " SELECT book_id, pos AS match_position, length(content)::BIGINT AS page_length FROM hit")
def _(spark, d):
    p = corpus(spark, d)
    found = reader.beside_pages(search.search(p, _TRASH, SearchMode.WORD, ALL), p, lambda text, _: F.length(text).cast("long"), "page_length")
    return found.select("book_id", "match_position", "page_length")


@query("joi_duplicates", "SELECT '/in/' || doc_id || '/DOC-' || doc_id || '.txt' AS path FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    paths = docs.select(F.concat(F.lit("/in/"), i, F.lit("/DOC-"), i, F.lit(".txt")).alias("path"))
    return files.duplicates(paths.unionByName(spark.createDataFrame([("/in/other.txt",)], "path string")), stats.books(corpus(spark, d)))


@query("joi_pending", "SELECT url AS path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE strlen(html) < 4096)")
def _(spark, d):
    p = table(spark, d, "pages").select("html", F.col("url").alias("path"))
    return files.pending(p.select("path"), p.where(F.octet_length("html") < 4096))


@query("snk_favourites", _hits(_THE) + f""", r AS (SELECT {_RESULT} FROM hit), n AS (SELECT *, row_number() OVER (PARTITION BY book_category ORDER BY book_id, page_number, match_position) AS k FROM r)
    SELECT book_category, k::INT AS rank, substr(context_snippet, 1, 140) AS context_snippet FROM n WHERE k <= 10""")  # fmt: skip
def _(spark, d):
    """The first hits of each category's search."""
    hits = reader.numbered(search.search(corpus(spark, d), "the", SearchMode.WORD, ALL)).withColumn("search_id", F.coalesce("book_category", F.lit("")))
    return services.summaries(hits).select("book_category", "rank", "context_snippet")
