"""Search patterns, built at plan time as Java regular expressions.

Every builder returns a string; Spark's regular expressions are Java's, so a pattern
means the same in ``rlike``, ``regexp_extract`` and ``regexp_replace``.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Character classes (inside brackets), as code points.
HARAKAT = "\u064b-\u065f\u0670\u06d6-\u06ed"
LETTERS = "\u0621-\u064a"
TASHKEEL = "\u064b-\u0652"
PUNCTUATION = "[\u060c,\u061b;:.!\u061f?\\-\u2013\u2014()\\[\\]{}\u00ab\u00bb\"'`]*"
MAX_BETWEEN = 5
META = ".^$|?*+()[]{}\\"
ADDED_LETTERS = "أإءئآؤسلتمونيهاةك\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652"
HAMZA = "ءأإآؤئ"
WEAK = "ويا"
_ANY_ROOT_LETTER = "[آؤءئأا-ي]"
#: Pattern letters: the three radicals match any letter, the letters of increase themselves.
WAZN_SYMBOLS = {c: _ANY_ROOT_LETTER for c in "فعل"} | {
    c: f"[{c}]" for c in "ءأؤئاويتسمنه"
}

_BETWEEN_WORDS = PUNCTUATION + r"\s+" + PUNCTUATION
_STRIP = re.compile(f"[{HARAKAT}]")


def strip_harakat(text: str) -> str:
    return _STRIP.sub("", text)


def escape(char: str) -> str:
    return "\\" + char if char in META else char


def word(text: str, respect_diacritics: bool = False, whole_letters: bool = False) -> str:
    """One word; unless diacritics count, any number of them may follow each letter."""
    if respect_diacritics:
        core = "".join(map(escape, text))
    else:
        core = "".join(escape(c) + f"[{HARAKAT}]*" for c in strip_harakat(text))
    if not whole_letters or not core:
        return core
    edge = LETTERS + HARAKAT
    return f"(?<![{edge}]){core}(?![{edge}])"


def phrase(query: str, respect_diacritics: bool = False, whole_letters: bool = False) -> str:
    """A word, a phrase of words with punctuation between, or ``a | b`` near each other in either order."""
    query = query.strip()
    build = lambda x: word(x, respect_diacritics, whole_letters)
    if "|" in query:
        parts = [p.strip() for p in query.split("|") if p.strip()]
        if len(parts) < 2:
            return build(parts[0]) if parts else ""
        first, second = build(parts[0]), build(parts[1])
        bridge = rf"(?:{_BETWEEN_WORDS}\S+){{0,{MAX_BETWEEN}}}{_BETWEEN_WORDS}"
        return f"(?:{first}{bridge}{second}|{second}{bridge}{first})"
    return _BETWEEN_WORDS.join(build(w) for w in query.split())


def same_page(query: str, respect_diacritics: bool = False, whole_letters: bool = False) -> list[str]:
    """The patterns of ``a + b ...``; empty without a plus sign."""
    if "+" not in query:
        return []
    return [word(p.strip(), respect_diacritics, whole_letters) for p in query.split("+") if p.strip()]


def substitute_symbols(wazn: str, symbols: dict[str, str] | None = None) -> str:
    symbols = WAZN_SYMBOLS if symbols is None else symbols
    return "".join(symbols.get(c, c) for c in wazn)


def optional_tashkeel(pattern: str, respect_diacritics: bool = False, boundary: bool = False) -> str:
    """Allow vowel marks after each Arabic letter and each bracket group."""
    if not respect_diacritics:
        bare = re.sub(f"[{TASHKEEL}]", "", pattern)
        pattern = re.sub(rf"\[[^\]]*\]|[{LETTERS}]", lambda m: m[0] + f"[{TASHKEEL}]*", bare)
    return f"(?<![{LETTERS}]){pattern}(?![{LETTERS}])" if boundary else pattern


def wazn(pattern: str, respect_diacritics: bool = False, whole_letters: bool = False, symbols: dict[str, str] | None = None) -> str:
    return optional_tashkeel(substitute_symbols(pattern, symbols), respect_diacritics, whole_letters)


def root(letters: str, vowels: bool = True) -> str:
    """Letters of a root in order, anything between; hamza and weak letters vary."""
    def one(c: str) -> str:
        if vowels and c == "ء":
            return f"[{HAMZA}]"
        if vowels and c in "وي":
            return f"[{WEAK}]"
        return c

    return "".join(".*" + one(c) for c in letters) + ".*"


def allowed_class(letters: str, vowels: bool = True) -> str:
    """Root letters, letters of increase and marks, as they stand between brackets."""
    allowed = set(letters) | set(ADDED_LETTERS)
    if vowels and "ء" in letters:
        allowed |= set(HAMZA)
    if vowels and set(letters) & set("وي"):
        allowed |= set(WEAK)
    return "".join("\\" + c if c in "\\]^-[&" else c for c in sorted(allowed))


def allowed_letters(letters: str, vowels: bool = True) -> str:
    """Pattern of words made of root letters, letters of increase and marks only."""
    return f"^[{allowed_class(letters, vowels)}]*$"


def allowed_tokens(letters: str, vowels: bool = True) -> str:
    """Pattern of whole white-space tokens that are such words with any marks; nothing is tried twice."""
    return rf"(?<!\S)[{allowed_class(letters, vowels)}{HARAKAT}]++(?!\S)"


# Fixed value: what a user's expression must not ask for.
_DOT_ALL = r"\(\?s:|(?<!\()\?-?s[:)]"


def user_regex(pattern: str) -> str | None:
    """A user's expression, multi-line and without dot-all; None if it asks for dot-all."""
    if not pattern.strip() or re.search(_DOT_ALL, pattern):
        return None
    return "(?m)(?-s)" + pattern.replace("(?s)", "").replace("(?-s)", "")


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Would Java accept the pattern?  Asked before a plan is made, not when it runs."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # Py4JJavaError: PatternSyntaxException
        return False
    return True
