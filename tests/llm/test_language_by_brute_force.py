"""The query of language identification against the definition, word by word."""

from __future__ import annotations

import zlib

import pytest
from brute_language import Brute, words_of

from warraq.llm import language_id, queries

SF = "/root/testdata/sf0.001"


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    brute = Brute([(r.text, r.lang) for r in rows if not held[r.doc_id]])
    got = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, SF).collect()}
    assert set(got) == set(held)
    for r in rows:
        lang, score = brute.predict(r.text)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (lang, held[r.doc_id]) and got[r.doc_id].score == pytest.approx(score, abs=1e-6)


def test_scripts_and_odd_texts(spark):
    """Several scripts, a language seldom in one of them, words of none, one word, ties, very long texts."""
    taught = [("привет мир " * 30, "ru"), ("hello world " * 30, "en"), ("hallo welt мир " + "welt " * 400, "de"), (None, "xx"), ("no language", None)]
    texts = [None, "", "42 ½ ²", "привет", "hello", "hello привет welt", "שלום", "שלום hello", "x" * 5000, "hello " * 70_000 + "welt " * 70_000]
    model = language_id.learn(spark.createDataFrame(taught, "text string, lang string"))
    brute = Brute(taught)
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        lang, score = brute.predict(text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-6), text and text[:30]
        assert sum(s.end_word - s.first_word for s in got[i].spans) == len(words_of(text))
