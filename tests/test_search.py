"""Search modes on fixed pages, and find-all against Python's re on random texts."""

import random
import re

import pytest

from warraq.operators import match, search
from warraq.operators.search import SearchMode, SearchOptions
from warraq.plans import patterns
from warraq.plans.samples import sample_pages
from warraq.schema import PAGES, RESULT_COLUMNS

CORPUS_A = [
    (1, 1, None, "بسم الله الرحمن الرحيم الحمد لله رب العالمين", "الفاتحة", None, "القرآن", "0001", None, None),
    (1, 2, None, "إيّاك نعبد وإيّاك نستعين اهدنا الصراط المستقيم", "الفاتحة", None, "القرآن", "0001", None, None),
    (2, 1, None, "كتاب الصلاة باب وقت الفجر إذا طلع الفجر صلِّ ركعتين", "كتاب الصلاة", "الشافعي", "الفقه", "0204", None, None),
    (2, 2, None, "كتاب الزكاة من ملك نصاباً حال عليه الحول وجبت عليه الزكاة", "كتاب الزكاة", "الشافعي", "الفقه", "0204", None, None),
    (3, 1, None, "حياة الإمام النووي ولد سنة ٦٣١ هـ في نوى من قرى دمشق", "تراجم", "ابن خلكان", "التاريخ", "0681", None, None),
]


def rows(df):
    return [(r.book_id, r.page_number, r.match_position, r.matched_term) for r in df.orderBy("book_id", "page_number", "match_position").collect()]


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame(CORPUS_A, PAGES)


def test_words_with_optional_marks(a):
    find = lambda q, **o: rows(search.search(a, q, options=SearchOptions(**o)))
    assert find("الله") == find("الله", whole_letters=True) == [(1, 1, 4, "الله")]
    assert find("اياك") == find("حيات") == []
    assert find("إياك") == [(1, 2, 0, "إيّاك"), (1, 2, 12, "إيّاك")]
    assert [x[:3] for x in find("كتاب")] == [(2, 1, 0), (2, 2, 0)]
    assert [x[:3] for x in find("الفجر")] == [(2, 1, 20), (2, 1, 34)]
    assert {x[0] for x in find("كتاب", book_ids=(1,))} == set()
    assert {x[0] for x in find("من", categories=("القرآن",))} <= {1}


def test_modes_on_samples(spark):
    b = sample_pages(spark)
    find = lambda q, mode=SearchMode.WORD, **o: rows(search.search(b, q, mode, SearchOptions(**o)))
    assert find("رسول الله") == [(3, 1, 4, "رسول الله")]
    assert find("علم | النحو")[0][:3] == (2, 1, 0)
    assert [x[:3] for x in find("كاتب + مكتوبا")] == [(1, 1, 7)]
    assert find("a+") == find("|") == find("") == []
    assert [x[2] for x in find("علم", whole_letters=True)] == [0, 24]
    assert find("مفعول", SearchMode.PATTERN) == [(1, 1, 20, "مكتوب"), (4, 1, 27, "مضروب")]
    assert find("مفعول", SearchMode.PATTERN, whole_letters=True) == [(4, 1, 27, "مضروب")]
    assert [x[2] for x in find("فاعل", SearchMode.PATTERN)] == [7, 14, 35, 34, 33]
    assert find("قال", SearchMode.REGEX) == [(3, 1, 0, "قال")]
    assert find("[كم].ب", SearchMode.REGEX) == [(1, 1, 29, "كتب")]
    assert find("(?s:x)", SearchMode.REGEX) == find("(", SearchMode.REGEX) == find(" ", SearchMode.PATTERN) == []
    words = search.search(b, "علم", SearchMode.DERIVATIVES).collect()
    assert [(w.matched_term, w.match_count) for w in words] == [("علم", 2), ("العلماء", 1)]
    assert len(search.search(b, "كتب", SearchMode.DERIVATIVES).collect()) == 6


def test_result_columns_and_limit(a):
    df = search.search(a, "الفجر", options=SearchOptions(limit=1))
    assert df.columns == RESULT_COLUMNS and df.count() == 1
    assert df.first().relevance == 1.0 and df.first().book_author == "الشافعي"


def test_prefilter_changes_nothing(a):
    from pyspark.sql import functions as F

    from warraq.functions.text import strip_diacritics

    stored = a.withColumn("content_nodiac", strip_diacritics(F.col("content")))
    for q in ("إياك", "كتاب الزكاة", "الفجر | صل", "كتاب + الفجر"):
        assert rows(search.search(a, q)) == rows(search.search(stored, q))


@pytest.mark.parametrize("pattern", ["ab", "a+", "(?<!b)a", "a*", "[ab] ", "é|b"])
def test_find_all_equals_python(spark, pattern):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aab é\n") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", "ab" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, content string")
    got = {(r.i, r.match_position, r.matched_term) for r in match.find_all(df, pattern).collect()}
    assert got == {(i, m.start(), m[0]) for i, t in enumerate(texts) for m in re.finditer(pattern, t)}


def test_pattern_builders():
    assert patterns.word("a.b", respect_diacritics=True) == r"a\.b"
    assert re.search(patterns.word("كتاب"), "كِتَابٍ") and not re.search(patterns.word("علم", whole_letters=True).replace("(?<!", "(?<!"), "العلم")
    assert patterns.substitute_symbols("بحر") == "بحر" and patterns.substitute_symbols("abc123") == "abc123"
    assert patterns.user_regex("a(?s)b") == "(?m)(?-s)ab" and patterns.user_regex("(?s:a)") is None


def test_numbering_of_all_results(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    run = lambda name: sorted(map(tuple, e.queries()[name](spark, d).collect()))
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    hits = sorted((r.doc_id, m.start()) for r in texts for m in re.finditer(patterns.phrase("the"), r.text or ""))
    n = len(hits)
    assert n > 1200 and run("win_serial") == [(i + 1, *h) for i, h in enumerate(hits)]
    assert run("win_groups500") == [(i, -(-i // 500)) for i in range(1, n + 1)]
    assert run("win_next_prev") == [(i, max(i - 1, 1), min(i + 1, n)) for i in range(1, n + 1)]
    assert run("win_next_prev_wrapped") == [(i, (i - 2) % n + 1, i % n + 1) for i in range(1, n + 1)]


def test_numbering_is_dealt_out(spark):
    from warraq.operators import reader

    pages = spark.range(3000).selectExpr("id % 7 as book_id", "cast(id % 3 as int) as page_number", "id as match_position")
    df = reader.numbered(pages)
    assert "Window" not in df._jdf.queryExecution().toString() and df.rdd.getNumPartitions() > 1
    got = [tuple(r) for r in df.orderBy("serial").collect()]
    assert got == [(*k, i + 1) for i, k in enumerate(sorted((i % 7, i % 3, i) for i in range(3000)))]
    assert reader.with_neighbour_results(pages.limit(0), wrap=True).count() == 0
