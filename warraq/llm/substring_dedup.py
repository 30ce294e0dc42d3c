"""Removal of repeated byte strings by merging Burrows-Wheeler transforms (operator 4).

Which bytes are covered by a string of ``length`` bytes that also starts elsewhere?

1. Lossless thinning.  Each window of ``length`` bytes has a minimizer: the place of
   its least ``gram``-byte hash.  Equal windows have equal minimizers at equal places,
   so a window whose minimizer's hash occurs once in the corpus is unique.  Counts come
   from requests by hash range.  A minimizer with more than ``HOT`` different strings
   (the border of a licence that half the corpus holds) is split by what its windows
   share beside it: into groups of neighbouring windows, and those that are hot again
   into single windows, so the strings that meet in one merge are bounded.
2. For each shared key the bytes of the windows that it owns go to the key's range,
   equal strings of a block once, with their number and places.
3. The corpus has ``SHARDS`` shards (blocks by number).  A range holds the section of
   each shard that begins with its keys.  Strings of a section are read in symbols of
   ``length / STEPS`` bytes, at each phase; the section's transform is built by itself,
   and the sections are merged by iterative interleave refinement: each pass stably
   deals the interleave by the preceding symbol, so after pass k it is in order of the
   first k symbols, and the pass at which two neighbours part gives their common prefix.
   Runs of neighbours with a common prefix of STEPS symbols are the repeated intervals.
   No suffix of one shard is compared with one of another.
4. Covered ranges return to their block, which cuts the texts.

Hashes only deal strings out.  Equality is decided by bytes: copies by the strings
themselves, symbols by comparing each place with the first of its code.  Each different
string of a shared key enters the merge, once, with the number of its copies: an interval
of the merged order is repeated if its suffixes, so counted, are more than one.

The texts are written once as blocks, which all later steps read, so a lost executor
costs a re-read and the order of the input's rows does not matter.  A long text is
worked on in spans; beside its bytes only what repeats grows with it.

Defined cases: null texts are empty; matches never cross documents and overlapping
occurrences count; repeated rows are copies of each other; null identifiers are kept;
texts shorter than ``length`` are kept whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, gram_hashes, id_text, joined, mix, pieces, raw_bytes, slices, stage, work_dir

LENGTH = 400
GRAM = 200
STEPS = 4
#: Different strings of one key that meet in one merge; more are split.  Copies count once, in however many blocks they stand.
HOT = 1024
RANGE_BYTES = 4 << 20
BLOCK_BYTES = 2 << 20
#: Bytes of strings merged at once; strings of one key stay together.
_MERGE_BYTES = 1 << 19
#: Windows whose minimizers are found at once.
_SPAN = 1 << 18
SHARDS = 8
#: Groups of windows that a hot minimizer is split into; hot groups are split into windows.
_GROUPS = 8
_UNIQUE, _SHARED, _HOT = 0, 1, 2


# --------------------------------------------------------------------------
# Keys of windows
# --------------------------------------------------------------------------


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i:i + w] for each i, by block-wise prefix and suffix minima."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()[w - 1 : n]
    back = rows[:, ::-1]
    np.minimum.accumulate(back, axis=1, out=back)
    return np.minimum(rows.ravel()[: n - w + 1], before)


#: start, number of windows, place of the minimizer, key.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> Runs:
    """Minimizers of a block's texts and the runs of windows that they own."""
    size = np.diff(off)
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    fits = size >= length
    np.add.at(edge, off[:-1][fits], 1)
    np.add.at(edge, off[1:][fits] - length + 1, -1)
    inside = np.cumsum(edge, dtype=np.int8)[:-1] > 0  # windows inside one text only
    del edge
    found = []
    for at in range(0, max(len(data) - length + 1, 0), _SPAN):
        part = data[at : at + _SPAN + length - 1]
        start = np.flatnonzero(inside[at : at + min(_SPAN, len(part) - length + 1)])
        if not len(start):
            continue
        grams = gram_hashes(part, gram)
        ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF))[start].astype(np.int64)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        # Least hashes are small; as keys they are mixed again, so that they spread over the ranges.
        found.append((start[first] + at, np.diff(np.append(first, len(start))), place[first] + at, mix(grams[place[first]])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def hash_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of data[at:at + size], span by span."""
    out = np.empty(len(at), dtype=np.uint64)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(0, len(data) + _SPAN, _SPAN))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            own = order[a:b]
            out[own] = gram_hashes(data[i * _SPAN : (i + 1) * _SPAN + size - 1], size)[at[own] - i * _SPAN]
    return out


def split(data: np.ndarray, runs: Runs, length: int, gram: int, group: int) -> Runs:
    """The runs in groups of ``group`` windows by their distance from the minimizer.

    The windows of a group share ``length - group + 1`` bytes around the minimizer: the new key.
    """
    start, windows, place, key = runs
    parts = []
    for low in range(0, length - gram + 1, group):
        high = low + group - 1  # bytes of a window before its minimizer, from ``low`` to ``high``
        a, b = np.maximum(start, place - high), np.minimum(start + windows - 1, place - low)
        own = np.flatnonzero(a <= b)
        parts.append((a[own], b[own] - a[own] + 1, place[own], key[own], place[own] - low, np.full(len(own), low)))
    a, n, place, key, common, low = map(np.concatenate, zip(*parts, strict=True))
    shared = hash_at(data, common, length - group + 1)
    return a, n, place, mix(shared ^ mix(key + (low * 512 + group).astype(np.uint64)))


def group_sizes(length: int, gram: int) -> list[int]:
    """Windows of one minimizer that a key of each level can own."""
    offsets = length - gram + 1
    return [offsets, -(-offsets // _GROUPS), 1]


def levels(data: np.ndarray, off: np.ndarray, length: int, gram: int, states: list[np.ndarray], hot_keys: list[np.ndarray] = ()) -> Iterator[tuple[Runs, np.ndarray | None]]:
    """Runs of each level and their states; of the first level that has no states yet, None.

    hot_keys: the hot keys of each level (sorted), where only those are known.
    """
    runs, sizes = anchors(data, off, length, gram), group_sizes(length, gram)
    for level in range(len(sizes)):
        if not len(runs[0]):
            return
        state = None
        if level < len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys[level], runs[3]), len(hot_keys[level]) - 1)
            state = np.where(hot_keys[level][at] == runs[3], _HOT, _UNIQUE)
        elif level < len(states):
            keys, at = np.unique(runs[3], return_inverse=True)
            if len(states[level]) != len(keys):
                raise RuntimeError("a block has not as many answers as it has keys")
            state = states[level][at]
        yield runs, state
        if state is None or level + 1 == len(sizes):
            return
        hot = state == _HOT
        runs = split(data, tuple(x[hot] for x in runs), length, gram, sizes[level + 1]) if hot.any() else tuple(x[:0] for x in runs)


def same_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The number of each string's class: equal keys and bytes, in order of first occurrence."""
    view, known = memoryview(np.ascontiguousarray(data)), {}
    number = (known.setdefault((k, bytes(view[a : a + n])), len(known)) for k, a, n in zip(key.tolist(), start.tolist(), size.tolist(), strict=True))
    return np.fromiter(number, dtype=np.int64, count=len(start))


# --------------------------------------------------------------------------
# Blocks, requests and replies
# --------------------------------------------------------------------------

_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def _blocks(docs: DataFrame) -> DataFrame:
    """block, n_bytes, body: compressed texts."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for number, piece in enumerate(pieces(batches, "text", BLOCK_BYTES)):
            texts = piece.column("text").cast(pa.large_string()).fill_null("")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([piece.column("doc_id"), texts], schema=_TEXTS))
            size = pc.sum(pc.binary_length(texts)).as_py() or 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([part + number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "body"]
            )

    return docs.mapInArrow(run, "block long, n_bytes long, body binary")


def _open(body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(identifiers, bytes, offsets) of a block."""
    texts = pa.ipc.open_stream(body).read_all().combine_chunks()
    ids, column = texts.column("doc_id").combine_chunks(), texts.column("text").combine_chunks()
    return ids, *raw_bytes(column)


_MEET = "block long, range long, level int, n_hot long, body binary, ends binary"
_ASK = "range long, block long, level int, keys binary, n binary, marks binary"


def _cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranges that sorted keys fall into, where each begins, and the end)."""
    ranges, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    return ranges.astype(np.int64), np.append(first, len(keys)).astype(np.int64)


def _requests(
    data: np.ndarray, off: np.ndarray, block: int, length: int, gram: int, bits: int, states: list[np.ndarray] = (), hot_keys: list[np.ndarray] = ()
) -> pa.RecordBatch | None:
    """Keys of the level after ``states`` or ``hot_keys``: an entry for each of a key's different strings, with its places."""
    start = None
    for (start, windows, _, key), state in levels(data, off, length, gram, states, hot_keys):  # noqa: B007
        pass
    if start is None or state is not None:
        return None
    level = max(len(states), len(hot_keys))
    mark = string_marks(data, start, windows + length - 1, gram)
    order = np.lexsort((mark, key))
    key, mark = key[order], mark[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]))
    n = np.diff(np.append(first, len(key)))
    ranges, cuts = _cuts(key[first], bits)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ranges), pa.array(np.full(len(ranges), block)), pa.array(np.full(len(ranges), level, dtype=np.int32)),
            slices(key[first].astype("<u8"), cuts), slices(n.astype("<u4"), cuts), slices(mark[first].astype("<u4"), cuts),
        ],
        names=["range", "block", "level", "keys", "n", "marks"],
    )


def string_marks(data: np.ndarray, start: np.ndarray, size: np.ndarray, gram: int) -> np.ndarray:
    """32 bits of a hash of data[start:start + size], from grams that cover it; tells strings of one key apart when they are counted."""
    out = mix(size.astype(np.uint64))
    last = start + size - gram
    parts = -(-int(size.max(initial=1)) // gram)
    at = np.concatenate([np.minimum(start + k * gram, last) for k in range(parts)])
    for own in np.split(hash_at(data, at, gram), parts):  # all of them in one pass over the bytes
        out = mix(out ^ own)
    return out >> np.uint64(32)


#: Hot keys (8 bytes each) up to this number are broadcast to the blocks; more meet them by a shuffle.
BROADCAST_KEYS = 1_000_000


def _ask(blocks: DataFrame, length: int, gram: int, bits: int, hot_keys: list[np.ndarray]) -> DataFrame:
    """Requests of the level after those of ``hot_keys`` (sorted; at first there are none)."""
    shared = blocks.sparkSession.sparkContext.broadcast(hot_keys)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, data, off = _open(batch.column("body")[i].as_py())
                found = _requests(data, off, batch.column("block")[i].as_py(), length, gram, bits, hot_keys=shared.value)
                if found is not None:
                    yield found
                give_back()

    return blocks.mapInArrow(run, _ASK)


def _ask_again(blocks: DataFrame, replies: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """Requests of the next level, from the blocks that have hot keys."""
    last = replies.agg(F.max("level")).first()[0]
    hot = replies.where(f"level = {last}").groupBy("block").agg(F.sum("n_hot").alias("n_hot")).where("n_hot > 0").select("block")
    met = replies.join(hot, "block", "left_semi").unionByName(_as_met(blocks.join(hot, "block", "left_semi")))

    def run(group: pa.Table) -> pa.Table:
        block, body, states = _met(group)
        _, data, off = _open(body)
        found = _requests(data, off, block, length, gram, bits, states=states)
        return pa.Table.from_batches([found]) if found is not None else _ASK_ARROW.empty_table()

    return met.groupBy("block").applyInArrow(run, _ASK)


_ASK_ARROW = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("marks", pa.binary())])


def _as_met(blocks: DataFrame) -> DataFrame:
    none = F.lit(None).cast("binary")
    return blocks.select("block", F.lit(-1).cast("long").alias("range"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("n_hot"), "body", none.alias("ends"))


def _met(group: pa.Table) -> tuple[int, bytes, list[np.ndarray]]:
    """(block, its body, states of its keys at each level)."""
    is_text = pc.equal(group.column("range"), -1)
    rest = group.filter(pc.invert(is_text)).sort_by("range")
    states = []
    while (own := rest.filter(pc.equal(rest.column("level"), len(states)))).num_rows:
        states.append(joined(own.column("body"), "u1")[0])
    return group.column("block")[0].as_py(), group.filter(is_text).column("body")[0].as_py(), states


def _reply(hot: int):
    """State of each key in the order of the requests; and the hot keys of the range, on a row of no block."""

    def run(group: pa.Table) -> pa.Table:
        keys, size = joined(group.column("keys"), "<u8")
        (n, _), (marks, _) = joined(group.column("n"), "<u4"), joined(group.column("marks"), "<u4")
        distinct, at = np.unique(keys, return_inverse=True)
        places = np.bincount(at, weights=n)[at]
        different = np.bincount((np.unique((at.astype(np.uint64) << np.uint64(32)) | marks) >> np.uint64(32)).astype(np.int64))[at]
        level = group.column("level").to_numpy()
        splits = np.repeat(level, size // 8) < 2  # single windows cannot be split
        state = np.where(places == 1, _UNIQUE, np.where(splits & (different > hot), _HOT, _SHARED)).astype(np.uint8)
        # One answer a key and request; a key's entries follow each other.
        cuts = np.concatenate([[0], np.cumsum(size // 8)])
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        head[cuts[:-1]] = True
        is_hot = np.zeros(len(distinct), dtype=bool)
        is_hot[at[state == _HOT]] = True
        state, cuts = state[head], np.concatenate([[0], np.cumsum(head)])[cuts]
        n_hot = np.add.reduceat(state == _HOT, cuts[:-1], dtype=np.int64)
        names = ["block", "range", "level", "n_hot", "body", "ends"]
        replies = pa.table([group.column("block"), group.column("range"), group.column("level"), pa.array(n_hot), slices(state, cuts), pa.nulls(len(size), pa.binary())], names=names)
        own = distinct[is_hot].astype("<u8")
        if not len(own):
            return replies
        extra = [[-1], [group.column("range")[0].as_py()], [int(level[0])], [len(own)], [own.tobytes()], [None]]
        return pa.concat_tables([replies, pa.table([pa.array(x, f.type) for x, f in zip(extra, replies.schema, strict=True)], names=names)])

    return run


_SEND = "range long, block long, key binary, n binary, size binary, body binary, at binary"
_SEND_ARROW = pa.schema([
    ("range", pa.int64()), ("block", pa.int64()), ("key", pa.binary()), ("n", pa.binary()), ("size", pa.binary()), ("body", pa.binary()), ("at", pa.binary()),
])


def _send(length: int, gram: int, bits: int):
    def run(group: pa.Table) -> pa.Table:
        """Strings of the windows of each shared key, equal ones once."""
        block, body, states = _met(group)
        _, data, off = _open(body)
        found = [tuple(x[state == _SHARED] for x in runs) for runs, state in levels(data, off, length, gram, states) if state is not None]
        start, windows, key = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1, 3))
        if not len(start):
            return _SEND_ARROW.empty_table()
        size = windows + length - 1
        same = same_strings(data, start, size, key)
        _, first, n = np.unique(same, return_index=True, return_counts=True)
        by_key = np.argsort(key[first], kind="stable")
        rank = np.empty(len(first), dtype=np.int64)
        rank[by_key] = np.arange(len(first))
        places = start[np.argsort(rank[same], kind="stable")]
        first, n = first[by_key], n[by_key]
        ranges, cuts = _cuts(key[first], bits)
        ends = np.concatenate([[0], np.cumsum(n)])[cuts]
        text = memoryview(data)
        parts = [b"".join(text[a : a + s] for a, s in zip(start[first[a:b]].tolist(), size[first[a:b]].tolist(), strict=True)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = pa.table(
            [
                pa.array(ranges), pa.array(np.full(len(ranges), block)), slices(key[first].astype("<u8"), cuts), slices(n.astype("<u4"), cuts),
                slices(size[first].astype("<u4"), cuts), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in parts], pa.binary()), slices(places.astype("<u4"), ends),
            ],
            schema=_SEND_ARROW,
        )
        give_back()
        return out

    return run


# --------------------------------------------------------------------------
# Burrows-Wheeler transforms of shards, and their merge
# --------------------------------------------------------------------------


def sorted_places(keys: list[np.ndarray]) -> np.ndarray:
    """Places in order of the keys (integers from -1, the first counts most), ties by place.

    As ``np.lexsort``, but as many keys as fit are sorted in one word with the place, which costs a fraction of it.
    """
    n = len(keys[0])
    low, bits = n.bit_length(), max(int(k.max(initial=0)) + 1 for k in keys).bit_length()
    at_once = (64 - low) // bits
    if not at_once:
        return np.lexsort(keys[::-1])
    order = None
    for end in range(len(keys), 0, -at_once):
        word = np.zeros(n, dtype=np.uint64)
        for key in keys[max(0, end - at_once) : end]:
            word <<= np.uint64(bits)
            word |= (key + 1).astype(np.uint64)
        if order is not None:
            word = word[order]
        word <<= np.uint64(low)
        word |= np.arange(n, dtype=np.uint64)
        word.sort()
        word &= np.uint64((1 << low) - 1)
        place = word.astype(np.int64)
        order = place if order is None else order[place]
    return order


class Shard:
    """Sorted suffixes and transform of a set of strings over integer symbols.

    Strings are given by chains: ``symbol[i]`` starts at place i, ``next_[i]`` is the place
    one symbol on, or -1 at an end.  Every string has a terminator of its own (symbol -1).
    """

    def __init__(self, symbol: np.ndarray, next_: np.ndarray, steps: int):
        n = len(symbol)
        last = next_ < 0
        ends = np.flatnonzero(last)
        # Places n, n+1, ... are the empty suffixes before each terminator.
        follow = next_.copy()
        follow[ends] = n + np.arange(len(ends))
        total = n + len(ends)
        sym = np.concatenate([symbol, np.full(len(ends), -1, dtype=symbol.dtype)])
        keys, at = [], np.arange(total)
        go = np.concatenate([follow, np.arange(n, total)])
        for _ in range(steps):
            keys.append(sym[at])
            at = go[at]
        self.order = sorted_places(keys)  # to ``steps`` symbols, ties by place
        before = np.full(total, -1, dtype=symbol.dtype)  # the symbol that precedes, -1 at a string's start
        before[follow] = symbol
        self.bwt = before[self.order]
        self.size, self.n = total, n


def merge(shards: list[Shard], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes in order of ``steps`` symbols.

    Returns (shard, rank in the shard, common prefix with the place before, in symbols up to ``steps``).
    """
    first = np.cumsum([0] + [s.size for s in shards])
    transform = np.concatenate([s.bwt for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [s.size for s in shards])
    group = np.zeros(len(z), dtype=np.int64)  # all share the empty prefix
    common = np.full(len(z), steps, dtype=np.int8)
    for done in range(steps):
        # The k-th entry of shard s in the interleave is the k-th entry of its transform.
        symbol = np.empty_like(transform)
        symbol[np.argsort(z, kind="stable")] = transform
        dealt = sorted_places([symbol])
        part, old = symbol[dealt], group[dealt]
        new = np.ones(len(z), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (old[1:] != old[:-1])
        # Later passes only refine, so a border stays where it first appears.
        common[new & (common == steps)] = done
        z, group = z[dealt], np.cumsum(new) - 1
    by_shard = np.argsort(z, kind="stable")
    rank = np.empty(len(z), dtype=np.int64)
    rank[by_shard] = np.arange(len(z))
    return z, rank - first[z], common


def exact_codes(data: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Numbers of data[place:place + size]: equal exactly where the bytes are."""
    if not len(place):
        return np.zeros(0, np.int32)
    # The hash's upper bits and the number of the place in one word: sorted much faster than by an index.
    low = np.uint64(len(place).bit_length())
    word = gram_hashes(data, size)[place]
    word >>= low
    word <<= low
    word |= np.arange(len(place), dtype=np.uint64)
    word.sort()
    at = (word & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    word >>= low
    new = np.concatenate([[True], word[1:] != word[:-1]])
    codes = np.empty(len(place), dtype=np.int32)
    codes[at] = np.cumsum(new, dtype=np.int32) - 1
    head = place[at[new]]
    window, known = np.lib.stride_tricks.sliding_window_view(data, size), {}
    for i in differing(data, place, head[codes], size).tolist():  # another string with the same hash
        codes[i] = known.setdefault(window[place[i]].tobytes(), len(head) + len(known))
    return codes


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Numbers i of places where data[a[i]:a[i] + size] is not data[b[i]:b[i] + size].

    Where both are one byte on from the pair before, an equal last byte is enough if that pair is equal; unless all are equal, every pair is compared whole.
    """
    window = np.lib.stride_tricks.sliding_window_view(data, size)

    def whole(pairs: np.ndarray) -> np.ndarray:
        odd = [pairs[:0]]
        for k in range(0, len(pairs), 1 << 13):
            own = pairs[k : k + (1 << 13)]
            odd.append(own[(window[a[own]] != window[b[own]]).any(axis=1)])
        return np.concatenate(odd)

    other = a != b
    on = np.concatenate([[False], (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)])
    last = np.flatnonzero(other & on)
    if (data[a[last] + size - 1] == data[b[last] + size - 1]).all() and not len(whole(np.flatnonzero(other & ~on))):
        return last[:0]
    return whole(np.flatnonzero(other))


def repeated_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray, shard: np.ndarray, length: int, steps: int = STEPS) -> np.ndarray:
    """For each place of ``data``: does a window start there that starts elsewhere too?

    start, size: the strings; n: how often each occurs; shard: the shard it belongs to.
    """
    step = length // steps
    out = np.zeros(len(data), dtype=bool)
    string = np.repeat(np.arange(len(start)), size)
    left = np.repeat(start + size, size) - np.arange(len(data))  # bytes to the string's end
    place = np.flatnonzero(left >= step)
    codes = exact_codes(data, place, step)
    numbers, of_string = np.unique(shard, return_inverse=True)
    own = of_string.astype(np.uint8)[string[place]]
    by_shard = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(numbers)))[:-1])
    shards, spots = [], []
    index = np.zeros(len(data) + step, dtype=np.int64)  # of each place among its shard's; a string is of one shard
    for own in by_shard:
        at = place[own]
        index[at] = np.arange(len(at))
        shards.append(Shard(codes[own], np.where(left[at] >= 2 * step, index[at + step], -1), steps))
        # Places by rank; empty suffixes have none.
        spots.append(np.append(at, np.full(shards[-1].size - len(at), -1))[shards[-1].order])
    z, rank, common = merge(shards, steps)
    spot = np.concatenate(spots)[np.cumsum([0] + [len(x) for x in spots])[z] + rank]
    interval = np.cumsum(common < steps)  # neighbours with ``steps`` symbols in common are one
    whole = (spot >= 0) & (left[np.maximum(spot, 0)] >= length)
    spot, interval = spot[whole], interval[whole]
    weight = np.bincount(interval, weights=n[string[spot]], minlength=int(interval.max(initial=-1)) + 1)
    out[spot[weight[interval] > 1]] = True
    return out


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shard_of(block: np.ndarray) -> np.ndarray:
    return (mix(block.astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


def _solve(length: int):
    def run(group: pa.Table) -> pa.Table:
        """Windows that repeat, for each block: first and last window start + 1 of each run."""
        blocks = group.column("block").to_numpy()
        key, number = joined(group.column("key"), "<u8")
        n, size, at = (joined(group.column(c), "<u4")[0].astype(np.int64) for c in ("n", "size", "at"))
        source = np.repeat(np.arange(len(blocks)), number // 8)
        first_at, begin = np.cumsum(n) - n, np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(number // 8)])]
        data = np.empty(int(size.sum()), dtype=np.uint8)
        for x, a, b in zip(group.column("body"), ends[:-1], ends[1:], strict=True):
            data[a:b] = np.frombuffer(pa.decompress(x.as_py(), decompressed_size=int(b - a), codec="zstd", asbytes=True), dtype=np.uint8)
        same = same_strings(data, begin, size, key)
        times = np.bincount(same, weights=n).astype(np.int64)
        # Each different string enters the merge once, with the number of its copies; what repeats in it does in each of them.
        take = np.unique(same, return_index=True)[1]
        take = take[np.argsort(key[take], kind="stable")]
        copies = np.argsort(same, kind="stable")  # requests by string
        of_string = np.concatenate([[0], np.cumsum(np.bincount(same))])
        starts, stops, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Equal windows have one key, so keys can be settled some at a time.
        first_of_key = np.flatnonzero(np.concatenate([[True], key[take][1:] != key[take][:-1]]))
        turn = (np.cumsum(size[take]) // _MERGE_BYTES)[first_of_key]
        turn = np.repeat(turn, np.diff(np.append(first_of_key, len(take))))
        text = memoryview(data)
        for part in np.split(take, np.flatnonzero(np.diff(turn)) + 1):
            own = np.frombuffer(b"".join(text[a : a + s] for a, s in zip(begin[part].tolist(), size[part].tolist(), strict=True)), dtype=np.uint8)
            own_start = np.cumsum(size[part]) - size[part]
            hit = repeated_windows(own, own_start, size[part], times[same[part]], shard_of(blocks[source[part]]), length)
            a, b = _runs(hit)  # windows of a string end `length` bytes before it does, so runs stay inside
            where = np.searchsorted(own_start, a, side="right") - 1
            a, b, string = a - own_start[where], b - own_start[where], same[part[where]]
            # From a run to the requests that hold its string, and from these to their places.
            many = of_string[string + 1] - of_string[string]
            asked = copies[np.repeat(of_string[string] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            a, b, reps = np.repeat(a, many), np.repeat(b, many), n[asked]
            place = at[np.repeat(first_at[asked] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))]
            starts.append(place + np.repeat(a, reps))
            stops.append(place + np.repeat(b, reps))
            to.append(np.repeat(source[asked], reps))
        start, stop, to = map(np.concatenate, (starts, stops, to))
        order = np.lexsort((start, to))
        sources, cuts = np.unique(to[order], return_index=True)
        cuts = np.append(cuts, len(to))
        rows = len(sources)
        out = pa.table(
            [
                pa.array(blocks[sources]), pa.array(np.full(rows, group.column("range")[0].as_py())), pa.array(np.zeros(rows, np.int32)), pa.array(np.zeros(rows, np.int64)),
                slices(start[order].astype("<u4"), cuts), slices(stop[order].astype("<u4"), cuts),
            ],
            names=["block", "range", "level", "n_hot", "body", "ends"],
        )
        give_back()
        return out

    return run


def covered(start: np.ndarray, stop: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges that windows from ``start`` to ``stop`` - 1 cover, inside texts."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], (stop + length - 1)[order]
    if not len(a):
        return a, b
    text = np.searchsorted(off, a, side="right")
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] > reach[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return a[first], reach[np.append(first[1:], len(a)) - 1]


def _cut(length: int, with_text: bool):
    def run(group: pa.Table) -> pa.Table:
        is_text = pc.equal(group.column("range"), -1)
        ids, data, off = _open(group.filter(is_text).column("body")[0].as_py())
        rest = group.filter(pc.invert(is_text))
        a, b = covered(*(joined(rest.column(c), "<u4")[0].astype(np.int64) for c in ("body", "ends")), off, length)
        text, rows = memoryview(data), []
        cuts = np.searchsorted(a, off)
        for i, doc_id in enumerate(ids.to_pylist()):
            own = list(zip(a[cuts[i] : cuts[i + 1]].tolist(), b[cuts[i] : cuts[i + 1]].tolist(), strict=True))
            digest, kept, at, low, end = hashlib.sha256(), [], int(off[i]), int(off[i]), int(off[i + 1])
            for x, y in [*own, (end, end)]:
                digest.update(text[at:x])
                if with_text:
                    kept.append(text[at:x])
                at = y
            rows.append((doc_id, end - low, sum(y - x for x, y in own), [{"start": x - low, "end": y - low} for x, y in own], digest.hexdigest(), b"".join(kept) if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, spans (byte ranges removed), kept_sha256, kept (bytes, if asked for)."""
    if length % STEPS or not 0 < gram < length:
        raise ValueError("length must be a multiple of STEPS, and gram shorter than it")
    work = work_dir(docs.sparkSession, "substring-dedup")
    blocks = stage(_blocks(id_text(docs, id_col, text_col)), f"{work}/blocks")
    n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    bits = max(4, int(np.ceil(np.log2(1 + n_bytes / RANGE_BYTES))))
    replies, asked, hot_keys = None, _ask(blocks, length, gram, bits, []), []
    for level in range(3):
        new = stage(asked.groupBy("range").applyInArrow(_reply(hot), _MEET), f"{work}/replies-{level}")
        own, hot_rows = new.where("block >= 0"), new.where("block = -1")
        replies = own if replies is None else replies.unionByName(own)
        n_hot = hot_rows.agg(F.coalesce(F.sum("n_hot"), F.lit(0)).alias("n")).first()["n"]
        if not n_hot:
            break
        if n_hot <= BROADCAST_KEYS and len(hot_keys) == level:
            hot_keys.append(np.sort(np.concatenate([np.frombuffer(r["body"], "<u8") for r in hot_rows.select("body").collect()])))
            asked = _ask(blocks, length, gram, bits, hot_keys)
        else:
            asked = _ask_again(blocks, replies, length, gram, bits)
    sent = replies.unionByName(_as_met(blocks)).groupBy("block").applyInArrow(_send(length, gram, bits), _SEND)
    # Dealt by range to as many tasks as there is text for, since small partitions would else be joined.
    tasks = max(1, min(1 << bits, 1 << 16) // 2)
    solved = stage(sent.repartition(tasks, "range").groupBy("range").applyInArrow(_solve(length), _MEET), f"{work}/solved")
    met = solved.unionByName(_as_met(blocks))
    return met.groupBy("block").applyInArrow(
        _cut(length, with_text), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    )
