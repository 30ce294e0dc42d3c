"""The page table and the result rows, with their defaults and sentinels."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("book_id", T.LongType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("original_page_number", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("book_title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("death_year", T.StringType()),
    T.StructField("country", T.StringType()),
])

RESULT_COLUMNS = [
    "book_id", "page_number", "original_page_number", "matched_term", "match_position", "context_snippet",
    "book_title", "book_author", "book_category", "book_year", "relevance",
]

# Fixed values
ALL_BOOKS = "__ALL_BOOKS__"
UNCLASSIFIED = "__UNCLASSIFIED__"
UNCLASSIFIED_NAMES = ("غير مصنّف", "غير مصنف")
UNTITLED = "بلا عنوان"
UNKNOWN_AUTHOR = "مؤلف غير معروف"
UNKNOWN_YEAR = "0000"
DEFAULT_LIMIT = 1000
DISPLAY_GROUP = 500
SNIPPET_RADIUS = 100
