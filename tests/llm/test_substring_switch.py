"""What is sent for a passage in very many blocks; what makes a minimizer hot; what the merge settles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from warraq.llm import substring_dedup as sd

LENGTH, GRAM = 400, 200


def _block(*texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _replies(blocks: list[tuple[np.ndarray, np.ndarray]], hot: int, states: list[list[np.ndarray]]) -> list[pa.Table]:
    asked = [sd._requests(data, off, i, LENGTH, GRAM, 4, states=states[i]) for i, (data, off) in enumerate(blocks)]
    table = pa.Table.from_batches([b for b in asked if b is not None])
    return [sd._reply(hot)(table.filter(pa.compute.equal(table.column("range"), r))) for r in np.unique(table.column("range").to_numpy())]


def _states(replies: list[pa.Table], n: int) -> list[np.ndarray]:
    """The states of each block's keys, in order of the ranges."""
    out = []
    for i in range(n):
        own = pa.concat_tables([t.filter(pa.compute.equal(t.column("block"), i)) for t in replies]).sort_by("range")
        out.append(np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in own.column("body")]))
    return out


def _text(rng, n: int) -> bytes:
    return rng.integers(97, 123, n, dtype=np.uint8).tobytes()


def test_copies_are_not_different_strings():
    """One passage in 60 blocks, with other text around it, and a limit of 20 different strings: nothing is split."""
    rng = np.random.default_rng(1)
    passage = _text(rng, 5000)
    blocks = [_block(passage, passage, _text(rng, 700)) for _ in range(60)]
    replies = _replies(blocks, 20, [[]] * 60)
    assert sum(sum(t.column("n_hot").to_pylist()) for t in replies) == 0
    states = _states(replies, 60)
    assert all((s == sd._SHARED).sum() > 10 for s in states)
    for (data, off), state in zip(blocks, states, strict=True):
        found = [tuple(x[st == sd._SHARED] for x in runs) for runs, st in sd.levels(data, off, LENGTH, GRAM, [state]) if st is not None]
        strings = {data[a : a + n + LENGTH - 1].tobytes() for a, n in zip(found[0][0].tolist(), found[0][1].tolist(), strict=True)}
        assert sum(map(len, strings)) < 8 * len(passage)  # whole strings, each once: in proportion to the text


def test_different_strings_are():
    """The same gram with 60 surroundings is hot at a limit of 20, and its parts are answered a key each."""
    rng = np.random.default_rng(2)
    core = bytes(sorted(_text(rng, 260)))
    blocks = [_block(_text(rng, 300) + core + _text(rng, 300)) for _ in range(60)]
    replies = _replies(blocks, 20, [[]] * 60)
    assert sum(sum(t.column("n_hot").to_pylist()) for t in replies) > 0
    states = [[s] for s in _states(replies, 60)]
    again = [sd._requests(*b, i, LENGTH, GRAM, 4, states=states[i]) for i, b in enumerate(blocks)]
    assert any(b is not None and b.column("level")[0].as_py() == 1 for b in again)


@pytest.mark.parametrize("gram", [7, 200, 399])
def test_marks_tell_strings_apart(gram):
    rng = np.random.default_rng(3)
    data = np.frombuffer(_text(rng, 3000) * 2, np.uint8)
    start = np.concatenate([np.arange(0, 2000, 7), np.arange(0, 2000, 7) + 3000, np.arange(0, 2000, 7)])
    size = np.concatenate([np.full(286, 430), np.full(286, 430), np.full(286, 431)])
    marks = sd.string_marks(data, start, size, gram)
    assert (marks[:286] == marks[286:572]).all() and len(np.unique(marks)) == 572
    one = data.copy()
    one[215] = 0  # a byte in the middle of the first string
    assert sd.string_marks(one, start[:1], size[:1], gram)[0] != marks[0]


def test_every_repeated_window_comes_from_the_merge(monkeypatch):
    """Copies in several blocks too: one entry of the merge, marked at each of their places."""
    text = _text(np.random.default_rng(4), 500)
    one, two = np.array([7], "<u8").tobytes(), np.array([500], "<u4").tobytes()
    rows = {
        "range": [0, 0], "block": [1, 9], "key": [one, one], "n": [np.array([2], "<u4").tobytes(), np.array([1], "<u4").tobytes()], "size": [two, two],
        "body": [pa.compress(text, codec="zstd", asbytes=True)] * 2, "at": [np.array([10, 2000], "<u4").tobytes(), np.array([33], "<u4").tobytes()],
    }
    group, entered = pa.table(rows, schema=sd._SEND_ARROW), []
    merged = sd.repeated_windows

    def seen(data, *rest):
        entered.append(len(data))
        return merged(data, *rest)

    monkeypatch.setattr(sd, "repeated_windows", seen)
    out = sd._solve(LENGTH)(group)
    assert entered == [500]
    assert {(b, *np.frombuffer(x, "<u4").tolist(), *np.frombuffer(y, "<u4").tolist()) for b, x, y in zip(*(out.column(c).to_pylist() for c in ("block", "body", "ends")), strict=True)} == {
        (1, 10, 2000, 111, 2101), (9, 33, 134)
    }
    monkeypatch.setattr(sd, "repeated_windows", lambda data, *_: np.zeros(len(data), dtype=bool))
    assert sd._solve(LENGTH)(group).num_rows == 0


@pytest.mark.parametrize("bits", [1, 9, 20, 31, 44, 60])
def test_words_sort_as_lexsort(bits):
    rng = np.random.default_rng(bits)
    keys = [rng.integers(-1, (1 << k) - 1, 5000) for k in (bits, 2, bits, 1, 3)]
    for n in (1, 2, 4, 5):
        assert (sd.sorted_places(keys[:n]) == np.lexsort(keys[:n][::-1])).all()
    assert len(sd.sorted_places([keys[0][:0]])) == 0


@pytest.mark.parametrize("hashes", [lambda data, size: np.zeros(len(data) - size + 1, np.uint64), lambda data, size: data[: len(data) - size + 1].astype(np.uint64) << np.uint64(60), None])
def test_codes_are_equal_where_bytes_are(monkeypatch, hashes):
    """Whatever the hash says: with repeats that begin and break off anywhere, and gaps between the places."""
    rng = np.random.default_rng(5)
    text = rng.integers(97, 100, 400, dtype=np.uint8)
    data = np.concatenate([text, text[50:300], rng.integers(97, 100, 60, dtype=np.uint8), text[100:]])
    place = np.flatnonzero(rng.random(len(data) - 11) < 0.9)
    if hashes:
        monkeypatch.setattr(sd, "gram_hashes", hashes)
    codes = sd.exact_codes(data, place, 12)
    texts = [data[p : p + 12].tobytes() for p in place.tolist()]
    assert len(set(zip(codes.tolist(), texts, strict=True))) == len(set(codes.tolist())) == len(set(texts))


def test_marks_hash_the_bytes_once(monkeypatch):
    hashed, gram_hashes = [], sd.gram_hashes
    monkeypatch.setattr(sd, "gram_hashes", lambda data, size: hashed.append(len(data)) or gram_hashes(data, size))
    data = np.frombuffer(_text(np.random.default_rng(6), 5000), np.uint8)
    sd.string_marks(data, np.arange(0, 4000, 9), np.full(445, 600), GRAM)
    assert sum(hashed) == len(data)
