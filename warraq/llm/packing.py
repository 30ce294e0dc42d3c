"""Best-fit packing after Martello-Toth dominance reduction (operator 8).

Texts become token pieces of at most ``capacity`` ids.  Pieces of one length are
interchangeable, so the whole instance is a histogram of at most ``capacity`` counts
whatever the corpus' size.  The driver reduces it: sets of up to three lengths that
dominate every other set with their largest piece are fixed for good; what remains
is packed best-fit, longest first.  The plan says which ranks of each length go to
which sequences; each piece finds its own by its rank among pieces of its length,
which is a prefix sum over blocks (a block is what one task wrote) plus its place
inside its block.  A long text is encoded in parts, cut where a token surely ends.

Memory of a task grows with a very long text by its ids (4 bytes each), and by about 100 bytes a
character of a single run of white space of more than 20,000.

Defined cases: a null or empty text is one piece holding the end id alone; texts of
more than ``capacity`` ids are cut into full pieces with the first taking what is
over; repeated rows are packed each, and equal lengths (ties) go by the order in which tasks meet them; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, give_back, id_text, pieces, stage, work_dir

CAPACITY = 1024
END_ID = 2
#: Rows (block, length, pieces before; about 30 bytes each) up to this number are broadcast to the pieces; more are shuffled.
BROADCAST_BASES = 1_000_000
#: Before a single space between other characters a byte-level token always ends, whatever is around.
_SURE_END = re.compile("(?<=[!-~])(?= [!-~])")


#: Longest text, and longest run of white space in a longer one, that the faster encoder takes: it goes one level
#: deeper with each character of such a run.
_SAFE = 20_000
_LONG_RUN = re.compile(rf"\s{{{_SAFE}}}")


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A function from a text to its ids, for a ``*.json`` of tokenizers or a rank file of byte-level BPE (``*.tiktoken``).

    Ids are those of the JSON: its control strings have their own ids wherever they stand.  Where the rank file of the same
    vocabulary lies beside it, all but texts with very long runs of white space are encoded with that, several times faster.
    A rank file alone has no control strings.
    """
    if vocabulary.endswith(".tiktoken"):
        return _ranked(vocabulary, {})
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    plain = lambda text: t.encode(text, add_special_tokens=False).ids
    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return plain
    fast = _ranked(ranks, {token.content: number for number, token in t.get_added_tokens_decoder().items()})
    return lambda text: plain(text) if len(text) > _SAFE and _LONG_RUN.search(text) else fast(text)


def _ranked(path: str, control: dict[str, int]):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=control)
    return (lambda text: t.encode(text, allowed_special="all", disallowed_special=())) if control else t.encode_ordinary


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_in_parts(encode, text: str, limit: int = PIECE_BYTES) -> np.ndarray:
    """Ids of a text; of a long one part by part, so that only ids grow with it."""
    out, at = [], 0
    while len(text) - at > limit:
        end = _SURE_END.search(text, at + limit)
        if not end:
            break
        out.append(np.array(encode(text[at : end.start()]), dtype="<u4"))
        at = end.start()
    out.append(np.array(encode(text[at:] if at else text), dtype="<u4"))
    return np.concatenate(out) if at else out[0]


def tokenize(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row a piece; ``nth`` is its place among the pieces of its length in its block."""

    def run(batches):
        encode = encoder(vocabulary)
        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)  # pieces of each length so far
        for batch in pieces(batches, "text"):
            ids_of, numbers, starts, lengths, sums, arrays = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode_in_parts(encode, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    ids_of.append(doc_id)
                    numbers.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        arrays.append(ids[a:b].astype(np.int32))
            length = np.array(lengths, dtype=np.int64)
            order = np.argsort(length, kind="stable")
            run_start = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1]) if len(length) else np.zeros(0, int)
            nth = np.empty(len(length), dtype=np.int64)
            sizes = np.diff(np.append(run_start, len(length)))
            nth[order] = np.arange(len(length)) - np.repeat(run_start, sizes)
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [
                pa.array(ids_of, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(length),
                pa.array(sums, pa.int64()), pa.array(np.full(len(length), block, dtype=np.int64)), pa.array(nth),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"]
            if with_ids:
                columns.append(pa.array(arrays, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long"
    return id_text(docs).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


# --------------------------------------------------------------------------
# The plan, on counts of lengths
# --------------------------------------------------------------------------

Pattern = tuple[int, tuple[int, ...]]  # how many sequences, and the lengths in each


def reduce_instance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix dominating sets of at most three pieces; takes them out of ``counts``."""
    fixed: list[Pattern] = []

    def fix(*lengths: int) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((counts[used] // need[used]).min())
        fixed.append((times, tuple(lengths)))
        counts[used] -= times * need[used]

    for w in range(capacity, 0, -1):
        while counts[w]:
            room = capacity - w
            own = counts.copy()
            own[w] -= 1  # what is left beside this piece
            below = np.zeros(capacity + 1, dtype=np.int64)  # largest length left that is at most x
            np.maximum.accumulate(np.where(own > 0, np.arange(capacity + 1), 0), out=below)
            a = int(below[room])
            if a == 0:  # nothing fits beside it
                times = 1 if w <= room else int(counts[w])
                fixed.append((times, (w,)))
                counts[w] -= times
                continue
            smallest = np.flatnonzero(own[: room + 1])
            least = int(smallest[0])
            second = least if own[least] > 1 else int(smallest[1]) if len(smallest) > 1 else capacity + 1
            if w + a == capacity or least + second > room:
                # The largest that fits fills the rest, or no two others fit: it dominates.
                fix(w, a)
                continue
            third = _third_smallest(own, room)
            own[a] -= 1
            rest = np.maximum.accumulate(np.where(own > 0, np.arange(capacity + 1), 0))
            b = int(rest[room - a])
            own[a] += 1
            if b == 0 or third <= room:
                break  # three more could fit; leave this length to best fit
            q = np.arange(b + 1, room // 2 + 1)
            q = q[own[q] > 0]
            p = below[room - q]
            if np.any((p >= q) & (p + q > a)) and w + a + b != capacity:
                break  # some other pair is not covered by this one
            if w + a + b == capacity and np.any((p >= q) & (p + q > a)):
                break
            fix(w, a, b)
    return fixed


def _third_smallest(own: np.ndarray, room: int) -> int:
    """Sum of the three smallest lengths left that fit, or more than any room."""
    total, left = 0, 3
    for x in np.flatnonzero(own[: room + 1]):
        take = min(left, int(own[x]))
        total, left = total + take * int(x), left - take
        if not left:
            return total
    return len(own) + 1


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first; equal bins are filled together."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for w in range(capacity, 0, -1):
        n = int(counts[w])
        while n:
            room = next((r for r in range(w, capacity) if open_.get(r)), None)
            if room is None:
                times, holds = n, ()
                room = capacity
            else:
                times, holds = open_[room].pop()
            each = room // w
            full = min(times, n // each)
            if full:
                open_.setdefault(room - each * w, []).append((full, holds + (w,) * each))
                n -= full * each
                times -= full
            if times and n and n < each:  # the last, partly filled
                open_.setdefault(room - n * w, []).append((1, holds + (w,) * n))
                n, times = 0, times - 1
            if times and holds:
                open_.setdefault(room, []).append((times, holds))
    return [x for group in open_.values() for x in group]


def plan(counts: np.ndarray, capacity: int) -> list[Pattern]:
    counts = counts.astype(np.int64).copy()
    fixed = reduce_instance(counts, capacity)
    return fixed + best_fit(counts, capacity)


class Places:
    """From (length, rank among that length) to (sequence, offset)."""

    def __init__(self, patterns: list[Pattern], capacity: int):
        rows = []
        seen = np.zeros(capacity + 1, dtype=np.int64)
        base = 0
        for times, lengths in patterns:
            at = 0
            for w in lengths:
                rows.append((w, int(seen[w]), base, at))
                seen[w] += times
                at += w
            base += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.key = (table[:, 0] << 44) + table[:, 1]
        self.rank, self.base, self.offset = table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()
        self.sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        return self.base[at] + rank - self.rank[at], self.offset[at]


def pack(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    work = work_dir(spark, "packing")
    cut = stage(tokenize(id_text(docs, id_col, text_col), vocabulary or default_vocabulary(), capacity, end_id, with_ids), f"{work}/pieces")
    blocks = stage(cut.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), f"{work}/blocks")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if blocks.count() <= BROADCAST_BASES else bases.hint("shuffle_hash")
    ranked = cut.join(bases, ["block", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])

    def place(batches):
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema)
