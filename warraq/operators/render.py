"""Rendering of results: highlighting, snippets, context windows, export lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import csv_escape, html_escape, strip_marks_and_tatweel, trim
from . import match

MAX_HIGHLIGHTS = 100
EXPORT_WORDS = 30
_DIACRITICS_CLASS = "[ً-ْٰـ]"


def highlight_segments(text: Column, pattern: str, limit: int = MAX_HIGHLIGHTS) -> Column:
    """array<struct<text, is_match>>; after ``limit`` matches the tail is one segment; empty ones are left out."""
    seg = match.segments_of(text, pattern)
    shown = F.slice(seg, 1, 2 * limit)
    tail = F.array_join(F.slice(seg, 2 * limit + 1, F.greatest(F.size(seg) - 2 * limit, F.lit(0))), "")
    parts = F.transform(shown, lambda s, i: F.struct(s.alias("text"), (i % 2 == 1).alias("is_match")))
    parts = F.concat(parts, F.array(F.struct(tail.alias("text"), F.lit(False).alias("is_match"))))
    return F.filter(parts, lambda p: p["is_match"] | (p["text"] != ""))


def to_html(text: Column, pattern: str, open_tag: str = "<mark>", close_tag: str = "</mark>", limit: int = MAX_HIGHLIGHTS) -> Column:
    return F.array_join(
        F.transform(
            highlight_segments(text, pattern, limit),
            lambda p: F.when(p["is_match"], F.concat(F.lit(open_tag), html_escape(p["text"]), F.lit(close_tag))).otherwise(html_escape(p["text"])),
        ),
        "",
    )


def snippet_around(text: Column, pattern: str, radius: int = 80) -> Column:
    """Text around the first match with … where it is cut; null without a match."""
    start = match.first_position(text, pattern)
    end = start + F.length(match.first_match(text, pattern))
    low, high = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    cut = F.concat(F.when(low > 0, "…").otherwise(""), F.substring(text, low + 1, high - low), F.when(high < F.length(text), "…").otherwise(""))
    return F.when(start.isNotNull(), cut)


def snippet_html(text: Column, pattern: str, radius: int = 80, open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    return to_html(snippet_around(text, pattern, radius), pattern, open_tag, close_tag)


def highlight_literal(text: Column, term: str, open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    return F.replace(text, F.lit(term), F.lit(open_tag + term + close_tag)) if term.strip() else text


def context_window(snippet: Column, term: Column, before: int = 7, after: int = 7) -> Column:
    """Keyword in context: some words before and after the term, line breaks as spaces."""
    flat = trim(F.replace(snippet, F.lit("\n"), F.lit(" ")))
    pos = F.instr(flat, term)
    words = lambda c: F.filter(F.split(trim(c), r"\s+"), lambda w: w != "")
    left = words(F.substring(flat, F.lit(1), pos - 1))
    left = F.slice(left, F.greatest(F.size(left) - before + 1, F.lit(1)), F.lit(before))
    right = F.slice(words(F.substring(flat, pos + F.length(term), F.length(flat))), 1, after)
    joined = F.array_join(F.concat(left, F.array(term), right), " ")
    return F.when((trim(term) == "") | (flat == "") | (pos == 0), flat).otherwise(joined)


def export_snippet(page: Column, term: Column, fallback: Column, words: int = EXPORT_WORDS) -> Column:
    """Letter and digit words around the first hit of the term's first word, … where cut.

    Where the word occurs only without diacritics, the place is that in the bare text.
    """
    first = F.get(F.filter(F.transform(F.split(term, r"[|+ ]"), trim), lambda x: x != ""), F.lit(0))
    direct = F.instr(page, first)
    idx = F.when(direct > 0, direct - 1).otherwise(F.instr(strip_marks_and_tatweel(page), strip_marks_and_tatweel(first)) - 1)
    # Cut the page at the hit: the word it is in or the next one is the first of the right side.
    token = r"[\p{L}\p{Nd}]+"
    left, right = F.substring(page, F.lit(1), idx), F.substring(page, idx + 1, F.length(page))
    head = F.regexp_extract(left, r"[\p{L}\p{Nd}]+\z", 0)
    joint = (head != "") & right.rlike(r"\A[\p{L}\p{Nd}]")
    left = F.when(joint, F.substring(left, F.lit(1), F.length(left) - F.length(head))).otherwise(left)
    right = F.when(joint, F.concat(head, right)).otherwise(right)
    n_left, n_right = F.regexp_count(left, F.lit(token)), F.regexp_count(right, F.lit(token))
    # Possessive: words and gaps alternate in one way only, so nothing is tried twice.
    gap, whole = r"[^\p{L}\p{Nd}]*+", r"[\p{L}\p{Nd}]++"
    before = F.regexp_extract(left, rf"(?<![\p{{L}}\p{{Nd}}])(?:{whole}{gap}){{0,{words}}}\z", 0)
    after = F.regexp_extract(right, rf"\A{gap}((?:{whole}{gap}){{0,{words}}}{whole})", 1)
    lead = F.when(before == "", "").otherwise(F.regexp_extract(right, rf"\A({gap})", 1))
    core = trim(F.concat(before, lead, after))
    cut = F.concat(F.when(n_left > words, "… ").otherwise(""), core, F.when(n_right > words + 1, " …").otherwise(""))
    usable = page.isNotNull() & (trim(page) != "") & (trim(term) != "") & first.isNotNull() & (idx >= 0) & (n_right > 0)
    return F.when(usable, cut).otherwise(fallback)


def merged_ranges(text: Column, terms: list[str]) -> Column:
    """Highlight ranges of all terms, diacritics and tatweel ignored, touching ones merged: array<struct<start, end>>."""
    from ..plans.patterns import escape

    found = []
    for term in terms:
        bare = "".join(c for c in term if not ("ً" <= c <= "ْ" or c in "ٰـ"))
        if bare:
            found.append(_ranges(text, f"{_DIACRITICS_CLASS}*".join(map(escape, bare))))
    if not found:
        return F.array().cast("array<struct<start:int,end:int>>")
    ranges = F.array_sort(F.concat(*found))
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (last["end"] >= r["start"]), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(ranges, start, step)


def _ranges(text: Column, pattern: str) -> Column:
    seg = F.transform(match.segments_of(text, pattern), F.length)

    def step(acc, n):
        odd = F.size(acc["ends"]) % 2 == 1
        end = acc["at"] + n
        out = F.when(odd, F.concat(acc["out"], F.array(F.struct(acc["at"].cast("int").alias("start"), end.cast("int").alias("end"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), F.concat(acc["ends"], F.array(n)).alias("ends"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(seg, zero, step, lambda acc: acc["out"])


# Fixed value: the columns of an exported table.
CSV_HEADER = "المسلسل,الكتاب,المؤلّف,الفنّ,السنة,الصفحة,المطابقة,السياق"


def csv_line(serial: Column, title: Column, author: Column, category: Column, year: Column, page: Column, term: Column, snippet: Column) -> Column:
    return F.concat_ws(",", serial.cast("string"), csv_escape(title), csv_escape(author), csv_escape(category), csv_escape(year), page, csv_escape(term), csv_escape(snippet))
