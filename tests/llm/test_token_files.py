"""Token files against plain lists of ids, and round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from warraq.llm import queries, token_files

SF = "/root/testdata/sf0.001"
ODD = [
    (5, None), (2, ""), (3, " \t\n\v\f\r"), (4, "One two  three's"), (4, "one"), (4, "one"), (None, "null id"), (None, None), (-1, "é ́ ẛ̣ İIΣ Σ"),
    (9, "a<|endoftext|>b <|startoftext|> c"), (10, "\U0001f600 42 don't it's'll x" + "‍" * 3), (11, "word " * 30_000), (12, "x1" * 50_000), (13, " " * 2_000_000 + "end"),
    (14, "\n" * 2_000_000), (15, "q" * 2_000_000),
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def expected(data, plain):
    """Rows in order, with start, length and digest."""
    out, at = [], 0
    for i, ids in data:
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_words_have_the_ids_of_whole_texts(spark, plain):
    texts = [t for _, t in ODD] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    ids, count = token_files.Encoder(token_files.default_vocabulary()).encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, count.tolist(), strict=True):
        assert ids[at : at + n].tolist() == plain(text)[:-1], (text or "")[:50]
        at += n
    whole, same = token_files.Encoder(token_files.default_vocabulary(), by_words=False).encode(pa.array(texts[:12]))
    assert same.tolist() == count[:12].tolist() and whole.tolist() == ids[: len(whole)].tolist()


def test_forgotten_words(monkeypatch, plain):
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 3)
    encoder = token_files.Encoder(token_files.default_vocabulary())
    for _ in range(3):
        text = "alpha beta gamma delta " + "long" * 40 + " alpha epsilon"
        assert encoder.encode(pa.array([text]))[0].tolist() == plain(text)[:-1]


@pytest.mark.parametrize("n,width", [(0, 3), (1, 1), (63, 2), (64, 5), (65, 16), (5000, 4), (5000, 16)])
def test_wavelet_matrix(n, width):
    rng = random.Random(n)
    ids = [rng.randrange(1 << rng.randrange(1, width + 1)) for _ in range(n)]
    m = token_files.WaveletMatrix(n, list(token_files.WaveletMatrix.planes(np.array(ids, dtype=np.uint32), width)))
    assert m.ids().tolist() == ids and m.access(np.arange(n)).tolist() == ids
    for token in {*ids[:20], 0, (1 << width) - 1, 1 << width}:
        assert m.rank(token) == ids.count(token)
        for end in (0, n // 3, n):
            assert m.rank(token, end) == ids[:end].count(token)
        if token < 1 << width:
            assert m.occurrences(token).tolist() == [i for i, x in enumerate(ids) if x == token]


@pytest.mark.parametrize("shard_bytes,shard_tokens", [(1 << 30, 1 << 30), (1 << 20, 1 << 30), (1 << 20, 1000), (1 << 30, 1)])
def test_round_trip(spark, tmp_path, plain, shard_bytes, shard_tokens):
    df = spark.createDataFrame([(i, t, 1, b"x", "y") for i, t in ODD], "doc_id long, text string, shard int, ids binary, row string").repartition(3)
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(df, path, shard_bytes=shard_bytes, shard_tokens=shard_tokens)
    rows = sorted(token_files.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    order = [(i is not None, i or 0) for i in (r.doc_id for r in rows)]
    assert order == sorted(order) and sorted(((r.doc_id, tuple(r.ids)) for r in rows), key=repr) == sorted(((i, tuple(plain(t))) for i, t in ODD), key=repr)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected([(r.doc_id, r.ids) for r in rows], plain)
    flat = [x for r in rows for x in r.ids]
    some = [0, 1, 7, len(flat) // 2, len(flat) - 1]
    assert dict(token_files.tokens_at(spark, path, [*some, len(flat) + 5]).collect()) == {p: flat[p] for p in some}
    word = plain("one")[0]
    assert dict(token_files.count_tokens(spark, path, [2, word, 49_407, 70_000]).collect()) == {t: flat.count(t) for t in (2, word, 49_407, 70_000)}
    assert sorted(r.start for r in token_files.find_token(spark, path, word).collect()) == [i for i, x in enumerate(flat) if x == word]


def test_files_are_one_a_shard(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words " * 50) for i in range(40)], "doc_id long, text string")
    token_files.write_token_files(df, f"file://{tmp_path}/t", shard_tokens=250)
    folders = sorted(tmp_path.glob("t/shard=*"))
    assert len(folders) == 20 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    with pytest.raises(Exception, match="not whole"):
        files = token_files.read_files(spark, f"file://{tmp_path}/t").where("plane < 3")
        files.mapInArrow(lambda b: (x for s in token_files.shards(b) for x in ()), "x int").collect()


def test_no_rows(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert token_files.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_query(spark, plain):
    docs = sorted((r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op13_token_files"](spark, SF).collect())
    assert got == expected(docs, plain)
