"""Page numbers in OCR text: candidates, increasing chains, marker lines.

Candidates are found with column expressions over lines; chaining is a sequential
dynamic programme over one text's candidates and runs in a pandas UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import latin_digits

MIN_CHAIN, MAX_GAP, BAR = 3, 4, "=" * 25

# List items are rejected; then number lines, decorated ones, numbers at an edge.
_N = "([0-9٠-٩]+)"
_LIST_ITEM = r"^\s*(?:[\(\[]\s*[0-9٠-٩]+\s*[\)\]]|[0-9٠-٩]+\s*[-–—]|[0-9٠-٩]+\s*\.|[0-9٠-٩]+\s*[:،])\s+\S"
_STRICT = rf"^\s*{_N}\s*$"
_DECORATED = rf"^\s*[-–—*\.\[\(]+\s*{_N}\s*[-–—*\.\]\)]+\s*$"
_START = rf"^\s*{_N}(?=\s+\S)"
_END = rf"(?<=\S)\s+{_N}\s*$"
MARKED = r"(?m)^=+\s*[0-9٠-٩]+\s*=+\s*$"

_RESULT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("marked", T.IntegerType()), T.StructField("strict", T.IntegerType()),
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
])


def already_marked(text: Column) -> Column:
    return text.rlike(MARKED)


def newline_in(text: str) -> str:
    return "\r\n" if "\r\n" in text else "\r" if "\r" in text and "\n" not in text else "\n"


def newline_of(text: Column) -> Column:
    return F.when(text.contains("\r\n"), "\r\n").when(text.contains("\r") & ~text.contains("\n"), "\r").otherwise("\n")


def candidates(text: Column) -> Column:
    """array<struct<line, num, strict>> (lines from 0) of lines that could carry a page number."""
    lines = F.transform(F.split(text, "\r\n|\n|\r", -1), lambda x, i: F.struct(x.alias("text"), i.alias("line")))
    # Most lines have no digit and are looked at once.
    lines = F.filter(lines, lambda x: x["text"].rlike(_N) & ~x["text"].rlike(_LIST_ITEM))

    def number(line, *patterns):
        return F.coalesce(*(F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for p in patterns))

    def judged(x):
        strict = number(x["text"], _STRICT, _DECORATED)
        digits = F.coalesce(strict, number(x["text"], _START, _END))
        return F.struct(x["line"].alias("line"), latin_digits(digits).try_cast("long").alias("num"), strict.isNotNull().alias("strict"))

    return F.filter(F.transform(lines, judged), lambda c: c["num"].isNotNull())


def chain_lengths(numbers: list[int], max_gap: int = MAX_GAP) -> list[int]:
    """For each place, how long a chain of numbers growing by 1 to ``max_gap`` can be that ends there."""
    longest: dict[int, int] = {}
    out = []
    for x in numbers:
        own = 1 + max(longest.get(x - gap, 0) for gap in range(1, max_gap + 1))
        longest[x] = max(own, longest.get(x, 0))
        out.append(own)
    return out


def longest_chain(numbers: list[int], min_length: int = MIN_CHAIN, max_gap: int = MAX_GAP) -> list[int]:
    """Places of the longest such chain; empty if under ``min_length``.

    It ends at the first place of the greatest length.  Read from there towards the front, the
    place before is one whose chain is shorter by one and whose number is in reach: the
    largest such number, and of its places the first.
    """
    lengths = chain_lengths(numbers, max_gap)
    top = max(lengths, default=0)
    if top < max(min_length, 1):
        return []
    first = {state: i for i, state in reversed([*enumerate(zip(lengths, numbers, strict=True))])}
    chain = [lengths.index(top)]
    for length in range(top - 1, 0, -1):
        at = chain[-1]
        before = (first.get((length, numbers[at] - gap), at) for gap in range(1, max_gap + 1))
        chain.append(next(i for i in before if i < at))
    return chain[::-1]


def chains(numbers: list[int]):
    """Longest chains one after another, each of the places that earlier ones left."""
    places = list(range(len(numbers)))
    while found := longest_chain([numbers[i] for i in places]):
        yield [places[i] for i in found]
        for i in reversed(found):
            del places[i]


def accepted(numbers: list[int], lines: list[int]) -> list[int]:
    """Places of the main (longest) chain and of every other chain wholly before or after its lines."""
    main, *others = [*chains(numbers)] or [[]]
    outside = (c for c in others if lines[c[-1]] < lines[main[0]] or lines[c[0]] > lines[main[-1]])
    return sorted(sum(outside, main))


def mark(text: str, found: list) -> tuple:
    """(marked text, numbers marked, strict ones, first and last number)."""
    parts = text.splitlines(keepends=True)
    places = accepted([c["num"] for c in found], [c["line"] for c in found])
    numbers = {found[i]["line"]: found[i]["num"] for i in places}
    strict = [found[i]["line"] for i in places if found[i]["strict"]]
    # Facing pages: numbers with only blank lines between them are put in order.
    run: list[int] = []
    for line in [*strict, None]:
        if run and (line is None or any(parts[k].strip() for k in range(run[-1] + 1, line))):
            for at, number in zip(run, sorted(numbers[x] for x in run), strict=True):
                numbers[at] = number
            run = []
        if line is not None:
            run.append(line)
    eol = newline_in(text)
    whole, out = set(strict), []
    for i, part in enumerate(parts):
        if i in numbers:
            ending = part[len(part.rstrip("\r\n")) :]
            out.append(f"{BAR} {numbers[i]} {BAR}" + (ending if i in whole else ending or eol))
        if i not in whole:
            out.append(part)
    in_order = [numbers[i] for i in sorted(numbers)]
    return "".join(out), len(numbers), len(strict), in_order[0] if in_order else None, in_order[-1] if in_order else None


@F.pandas_udf(_RESULT)
def _mark(text: pd.Series, found: pd.Series) -> pd.DataFrame:
    rows = [(None, 0, 0, None, None) if t is None else mark(t, list(f)) for t, f in zip(text, found, strict=True)]
    return pd.DataFrame(rows, columns=["text", "marked", "strict", "first", "last"])


def marked(text: Column) -> Column:
    """struct<text, marked, strict, first, last>; texts with markers already stay as they are."""
    same = F.struct(text.alias("text"), F.lit(0).alias("marked"), F.lit(0).alias("strict"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(text.isNull() | already_marked(text), same).otherwise(_mark(text, candidates(text)))


def report(files) -> object:
    """Counts over a table with ``text`` and ``m`` (see ``marked``): marked, none, already, strict, loose."""
    m, old = F.col("m"), already_marked(F.col("text"))
    return files.agg(
        F.count_if(m["marked"] > 0).alias("files_marked"), F.count_if((m["marked"] == 0) & ~old).alias("files_without"), F.count_if(old).alias("files_already"),
        F.sum(m["marked"]).alias("numbers"), F.sum(m["strict"]).alias("strict"), F.sum(m["marked"] - m["strict"]).alias("loose"), F.min(m["first"]).alias("first"), F.max(m["last"]).alias("last"),
    )


def mark_files(files, folder: str) -> object:
    """Write the marked texts of a table with ``path`` and ``text`` under a folder, by name; returns the report.

    The files appear when the whole job has ended; a task that fails and runs again leaves each once.
    """
    from .text_files import write_text_files

    done = files.withColumn("m", marked(F.col("text")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    write_text_files(done.select(name.alias("name"), F.coalesce("m.text", F.lit("")).alias("text")), folder)
    return report(done)
