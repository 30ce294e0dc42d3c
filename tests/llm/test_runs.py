"""Periodic runs against every period of every stretch."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from warraq.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute_runs(words: list, power: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period): for each period the longest stretches, smallest periods only."""
    n, by_interval = len(words), {}
    for p in range(1, n // power + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j > i and j - (i - p) >= max(least, power * p):
                by_interval.setdefault((i - p, j), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in by_interval.items())


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(doc_id: int, words: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("few", [0, 1, 8])
def test_find_runs(monkeypatch, few):
    monkeypatch.setattr(runs, "FEW", few)
    rng = random.Random(5)
    texts = [[], [0], [0] * 6, [0] * 5, [0] * 400, [0, 1] * 50, [0, 1, 0] * 60]
    for _ in range(300):
        text = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            unit = [rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(1, 12))]
            text += (unit * 12)[: rng.randrange(1, 12 * len(unit))] + [rng.randrange(40)] * rng.randrange(3)
        texts.append(text)
    x = np.array([w for t in texts for w in t], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, period = runs.find_runs(x, first)
    got = {k: [] for k in range(len(texts))}
    for a, b, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        k = int(np.searchsorted(first, a, side="right")) - 1
        got[k].append((a - int(first[k]), b - a, p))
    for k, text in enumerate(texts):
        assert got[k] == brute_runs(text), text


def test_z_function():
    rng = random.Random(1)
    for n in (0, 1, 2, 30):
        x = [rng.randrange(2) for _ in range(n)]
        want = [next((k for k in range(n - i) if x[k] != x[i + k]), n - i) for i in range(n)]
        assert runs.z_function(np.array(x, dtype=np.int64)).tolist() == want


def test_many_equal_words_take_time_in_proportion():
    x = np.zeros(200_000, dtype=np.int64)
    start, end, period = runs.find_runs(x, np.array([0, len(x)]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [200_000], [1])


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(3, np.int64), np.array([0, 3]), power=3)


def test_odd_texts(spark):
    data = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a a a a a a"), (6, "a a a a a a"), (None, "x A a A a A a A a y"), (8, "é é é é é é\v\fé"),
        (9, "go " * 400_000 + "end"), (10, "a b c a b c a b c a b c"),
    ]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, runs int, start string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.collapsed_sha256) for r in runs.periodic_runs(df, with_text=True).collect()), key=repr)
    want = []
    for i, t in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = [(0, 400_000, 1)] if i == 9 else brute_runs(words)
        kept = " ".join(collapsed(words, found))
        want.append((i, len(words), found, kept, hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_query_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.asDict() for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        words = planted(i, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        found = brute_runs(words) if len(words) < 3000 else [tuple(map(int, x)) for x in _by_steps(words)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        assert got[i] == {
            "doc_id": i, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if found else None,
            "runs_sha256": hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(collapsed(words, found)).encode()).hexdigest(),
        }


def _by_steps(words: list) -> list[tuple[int, int, int]]:
    """As ``brute_runs``, one comparison of the whole text with itself a period."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x, by_interval = np.array([number[w] for w in words]), {}
    for p in range(1, len(x) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], x[p:] == x[:-p], [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b + p - a >= max(6, 4 * p):
                by_interval.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in by_interval.items())
