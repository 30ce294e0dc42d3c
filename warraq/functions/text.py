"""Text functions, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.patterns import HARAKAT
from ..schema import ALL_BOOKS, UNCLASSIFIED

ARABIC_WORD = "[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff]+"
_ARABIC_DIGITS, _DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
_SEPARATOR = "\u001f"
_MARKS_AND_TATWEEL = [*map(chr, range(0x64B, 0x653)), "\u0670", "\u0640"]


def once(value: Column, use) -> Column:
    """``use(value)``, with the value taken once a row however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim(c: Column) -> Column:
    """Trim all Unicode white space, where Spark's own trim takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def nonblank(c: Column) -> Column:
    return F.when(~blank(c), c)


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, f"[{HARAKAT}]", "")


def strip_marks_and_tatweel(c: Column) -> Column:
    return F.regexp_replace(c, "[\u064b-\u0652\u0670\u0640]", "")


def bare_with_places(c: Column) -> Column:
    """struct<text, places>: the text without marks and tatweel, and for each of its characters where it was (from 0)."""
    chars = F.when(c != "", F.split(c, "")).otherwise(F.array().cast("array<string>"))
    places = F.array_compact(F.transform(chars, lambda x, i: F.when(~x.isin(*_MARKS_AND_TATWEEL), i)))
    return F.struct(strip_marks_and_tatweel(c).alias("text"), F.when(c.isNotNull(), places).alias("places"))


def normalize_eols(c: Column) -> Column:
    return F.regexp_replace(c, "\\r\\n|[\\r\u2028\u2029]", "\n")


def clean_invisible(c: Column, nbsp_to_space: bool = True) -> Column:
    c = F.regexp_replace(c, "[\ufeff\u200b-\u200f]", "")
    return F.replace(c, F.lit("\u00a0"), F.lit(" ")) if nbsp_to_space else c


def prepare_for_regex(c: Column) -> Column:
    return clean_invisible(normalize_eols(c))


def latin_digits(c: Column) -> Column:
    return F.translate(c, _ARABIC_DIGITS, _DIGITS)


def arabic_word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ARABIC_WORD))


def looks_valid(c: Column) -> Column:
    """Not blank, and in its first 2000 characters more than 5 Arabic ones or only printable ASCII."""
    head = F.substring(c, 1, 2000)
    arabic = F.regexp_count(head, F.lit("[\u0600-\u06ff]")) > 5
    return ~blank(c) & (arabic | head.rlike(r"\A[\x20-\x7E\s]*\z"))


def base_name(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def csv_escape(c: Column) -> Column:
    v = F.coalesce(c, F.lit(""))
    return F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def html_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def safe_name(c: Column, length: int = 40) -> Column:
    return F.left(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"), F.lit(length))


def safe_title(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]+", "_")


def display_page(original: Column, number: Column) -> Column:
    return F.coalesce(original, number.cast("string"))


def abbreviated(c: Column, words: int = 5) -> Column:
    parts = F.split(trim(c), r"\s+")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit(" ..."))).otherwise(c)


def display_category(c: Column, all_name: str, unclassified_name: str) -> Column:
    return F.when(c == ALL_BOOKS, all_name).when(c == UNCLASSIFIED, unclassified_name).otherwise(c)


def encode_set(c: Column) -> Column:
    return F.array_join(c, _SEPARATOR)


def decode_set(c: Column) -> Column:
    return F.filter(F.split(c, _SEPARATOR), lambda x: x != "")


def version_parts(c: Column) -> Column:
    """Numbers of a version between dots and hyphens, without a leading v; parts that are no number are left out."""
    parts = F.split(F.regexp_replace(trim(c), "^v", ""), "[.-]", -1)
    return F.filter(F.transform(F.filter(parts, lambda x: x.rlike(r"^[+]?[0-9]+$")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; missing parts are 0."""
    pairs = F.zip_with(version_parts(a), version_parts(b), lambda x, y: F.sign(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    return F.coalesce(F.try_element_at(F.filter(pairs, lambda s: s != 0), F.lit(1)), F.lit(0))


def human_size(c: Column, decimal: bool = True) -> Column:
    """Bytes in the largest unit that fits, whole; gigabytes with one decimal unless that is switched off."""
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    whole = lambda unit, name: F.format_string(f"%d {name}", F.floor(c / unit).cast("long"))
    giga = F.format_string("%.1f GB", c / float(gb)) if decimal else whole(gb, "GB")
    return F.when(c >= gb, giga).when(c >= mb, whole(mb, "MB")).when(c >= kb, whole(kb, "KB")).otherwise(F.format_string("%d B", c.cast("long")))


def citation(style: str, author: Column, title: Column, year: Column, page: Column, accessed: Column | None = None) -> Column:
    """A citation in the style arabic, apa, mla or chicago, with stand-ins for what is missing."""
    author = F.coalesce(nonblank(author), F.lit("[مؤلّف غير معروف]"))
    title = F.coalesce(nonblank(title), F.lit("[بدون عنوان]"))
    year = F.coalesce(nonblank(year), F.lit("د.ت"))
    if style == "apa":
        return F.format_string("%s (%s). %s. p. %s.", author, year, title, page)
    if style == "mla":
        return F.format_string("%s. %s. %s, p. %s.", author, title, year, page)
    if style == "chicago":
        return F.format_string("%s, %s (%s), %s.", author, title, year, page)
    if style != "arabic":
        raise ValueError(f"no citation style {style!r}")
    accessed = F.year(F.current_date()) if accessed is None else accessed
    text = "%s. %s. (%s). صفحة %s. (مكتبة بحثيّة، استُرجع %s)."
    return F.format_string(text, author, title, year, page, accessed.cast("string"))


def hijri_date(day: Column) -> Column:
    """Year-month-day of the tabular Islamic calendar (arithmetic; observed dates can differ by a day)."""
    n = F.date_diff(day, F.lit("0622-07-19").cast("date"))  # proleptic Gregorian date of 1 Muharram 1
    year = F.floor((30 * n + 10646) / 10631)
    first = F.floor((11 * year + 3) / 30) + 354 * (year - 1)
    month = F.least(F.lit(12), F.ceil((n - first - 29 + 29.5) / 29.5).cast("int"))
    dom = n - first - F.ceil(29.5 * (month - 1)) + 1
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), dom.cast("int"))
