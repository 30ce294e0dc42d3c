"""Language-model scores by deleted interpolation (operator 1).

A bigram model: P(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 /(V+1), where the weights
depend on the frequency bucket of the context, floor(log2 c(v)), and are learned by
expectation-maximisation on a held-out fold of the training documents against the
counts of the rest.  All tables of counts cover the whole corpus and stay distributed:

1. the texts are written once as blocks of about ``BLOCK_BYTES``, long texts in parts
   cut at white space, so no step holds more than a block; blocks hold rows of one fold
   (held out while learning, scored only, or the rest);
2. a block asks, once for each distinct word and bigram, for its count; requests are
   sorted hashes, cut by hash range, and a range's part of them is one row;
3. each hash range adds up the counts of all blocks and answers every block in the
   order in which it asked;
4. a block meets its answers and scores its parts of documents, which are added up.

EM needs only how often each combination of bucket and quantised probabilities
occurs, a table whose size does not depend on the corpus; only blocks of the held-out
fold meet their answers for it.  Everything after step 1 reads the written blocks, so a
lost executor costs a re-read, and the order of the input's rows does not matter.

Words are known by a keyed 64-bit hash (SipHash).

Defined cases: a null or empty text is the end token alone; an identifier that is
null hashes as the empty string; repeated rows count each; without training tokens
all counts are 0, N is 0 and the score is that of the uniform part; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Words, cut_at_space, give_back, hash_words, id_text, joined, mix, one_text, pieces, raw_bytes, slices, split_words, stage, work_dir

BLOCK_BYTES = 4 << 20
#: Bytes of text for each hash range.
RANGE_BYTES = 16 << 20
QUANTA = 4  # of log2 probability in a cell of the EM table

_END = np.uint64(0x8F3B1C5D2A7E9641)
_START = np.uint64(0x1D4E7A9B3C6F8052)
#: Classes of blocks: counted, counted but held out while the weights are learned, scored only.
_REST, _TUNE, _TEST = 0, 1, 2
#: Bytes of a hash in a request; the first is known from the range.
_KEY = 7


@dataclass(frozen=True)
class Folds:
    folds: int = 7
    test: int = 2  # scored only
    tune: int = 3  # held out of the counts while the weights are learned


def _remainder(doc_ids: list, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds for x in doc_ids], dtype=np.int64)


# --------------------------------------------------------------------------
# Blocks
# --------------------------------------------------------------------------

_PART = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("test", pa.bool_()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("before", pa.large_string()), ("text", pa.large_string()),
])
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("class", pa.int32()), ("n_bytes", pa.int64()), ("body", pa.binary())])


def _blocks(docs: DataFrame, folds: Folds) -> DataFrame:
    """block, class, n_bytes, body: compressed parts of texts."""

    def run(batches):
        part, rows, number = TaskContext.get().partitionId(), 0, 0
        held: dict[int, list[pa.RecordBatch]] = {_REST: [], _TUNE: [], _TEST: []}
        size = dict.fromkeys(held, 0)

        def close(kind: int):
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _PART, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for x in held[kind]:
                    writer.write_batch(x)
            row = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([kind], pa.int32()), pa.array([size[kind]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                schema=_BLOCK_ARROW,
            )
            number, held[kind], size[kind] = number + 1, [], 0
            give_back()
            return row

        def add(kind: int, own: pa.RecordBatch):
            held[kind].append(own)
            size[kind] += pc.sum(pc.binary_length(own.column("text"))).as_py() or 0
            if size[kind] >= BLOCK_BYTES:
                yield close(kind)

        for piece in pieces(batches, "text"):
            rest = _remainder(piece.column("doc_id").to_pylist(), folds.folds)
            kinds = np.where(rest == folds.test, _TEST, np.where(rest == folds.tune, _TUNE, _REST))
            n, texts = piece.num_rows, piece.column("text").cast(pa.large_string()).fill_null("")
            uid = pa.array((part << 36) + rows + np.arange(n))
            rows += n
            yes, none = pa.array(np.ones(n, dtype=bool)), pa.nulls(n, pa.large_string())
            whole = pa.RecordBatch.from_arrays([uid, piece.column("doc_id"), pa.array(rest == folds.test), yes, yes, none, texts], schema=_PART)
            long = pc.binary_length(texts).to_numpy() > 2 * PIECE_BYTES
            for kind in held:
                mine = np.flatnonzero(~long & (kinds == kind))
                if len(mine):
                    yield from add(kind, whole.take(pa.array(mine)))
            for i in np.flatnonzero(long):
                for own in _parts(whole.slice(int(i), 1)):
                    yield from add(int(kinds[i]), own)
        for kind in held:
            if held[kind]:
                yield close(kind)

    return docs.mapInArrow(run, "block long, class int, n_bytes long, body binary")


def _parts(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row with a long text as parts of it, with the word before each."""
    uid, doc_id, test, yes, _, before, text = row.columns
    data, _ = raw_bytes(text)
    begins, done = yes, 0
    for part in cut_at_space(data):
        done += len(part)
        own = one_text(part)
        yield pa.RecordBatch.from_arrays([uid, doc_id, test, begins, pa.array([done == len(data)]), before, own], schema=_PART)
        words, _ = split_words(own)
        begins, before = pa.array([False]), words.slice(len(words) - 1).cast(pa.large_string()) if len(words) else before


@dataclass
class Block:
    """Tokens of a block's parts of documents, with an end token a document."""

    row: np.ndarray  # the part of each token
    n_tokens: np.ndarray
    word: np.ndarray  # hash of the token
    pair: np.ndarray  # hash of (token before, token)
    last: np.ndarray  # hash of the token before; the end token's where a document starts
    carried: np.ndarray  # hashes of words before a part, which the block need not hold itself

    @classmethod
    def of(cls, parts: pa.Table) -> Block:
        column = lambda c: parts.column(c).combine_chunks()
        words = Words(column("text"))
        begins, last = (column(c).to_numpy(zero_copy_only=False) for c in ("begins", "ends"))
        n = words.count + last
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(n) else 0
        word = np.empty(total, dtype=np.uint64)
        inner = np.ones(total, dtype=bool)
        inner[stop[last] - 1] = False
        word[inner] = words.hash
        word[~inner] = _END
        del words, inner
        some = np.flatnonzero(n)
        first = (stop - n)[some]
        ahead = np.where(begins, _START, hash_words(column("before").fill_null("")))[some]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first] = ahead
        pair = mix(mix(before) + word * np.uint64(0x9E3779B97F4A7C15))
        carried = np.unique(ahead[~begins[some]])
        before[first] = np.where(begins[some], _END, ahead)  # as many documents start as end
        return cls(np.repeat(np.arange(len(n), dtype=np.int32), n), n, word, pair, before, carried)

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes to ask for, place of each token's among them)."""
        if kind:
            return np.unique(self.pair, return_inverse=True)
        asked, at = np.unique(np.concatenate([self.word, self.carried]), return_inverse=True)
        return asked, at[: len(self.word)]


def _open(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


# --------------------------------------------------------------------------
# Requests and answers
# --------------------------------------------------------------------------

_ASK = "range long, block long, class int, keys binary, n binary"
_ANSWER = "block long, class int, range long, train binary, tune binary, tokens long, types long, tune_tokens long, core_types long"


def _requests(blocks: DataFrame, bits: int) -> DataFrame:
    shift = np.uint64(64 - bits)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.of(_open(batch.column("body")[i].as_py()))
                for kind in (0, 1):
                    keys, at = block.keys(kind)
                    n = np.bincount(at, minlength=len(keys)).astype("<u4")
                    ranges, first = np.unique(keys >> shift, return_index=True)
                    cuts = np.append(first, len(keys)).astype(np.int64)
                    low = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :_KEY]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((ranges.astype(np.int64) << 1) | kind), pa.array(np.repeat(batch.column("block")[i].as_py(), len(ranges)), pa.int64()),
                            pa.array(np.repeat(batch.column("class")[i].as_py(), len(ranges)), pa.int32()), slices(low, cuts), slices(n, cuts),
                        ],
                        names=["range", "block", "class", "keys", "n"],
                    )
                del block
                give_back()

    return blocks.mapInArrow(run, _ASK)


def _answer(group: pa.Table) -> pa.Table:
    """Counts of one hash range over all blocks, in the order each block asked."""
    low, size = joined(group.column("keys"), "u1")
    n, _ = joined(group.column("n"), "<u4")
    size //= _KEY
    keys = np.zeros((len(n), 8), dtype=np.uint8)
    keys[:, :_KEY] = low.reshape(-1, _KEY)
    _, at = np.unique(keys.view("<u8").ravel(), return_inverse=True)
    del keys, low
    class_ = group.column("class").to_numpy()
    of = np.repeat(class_, size)
    train = np.bincount(at, weights=np.where(of == _TEST, 0, n)).astype(np.int64)
    tune = np.bincount(at, weights=np.where(of == _TUNE, n, 0), minlength=len(train)).astype(np.int64)
    core = train - tune
    number = group.column("range")[0].as_py()
    # The totals of the range, once, on a row of no block.
    stats = [int(train.sum()), int((train > 0).sum()), int(tune.sum()), int((core > 0).sum())] if number % 2 == 0 else [0] * 4
    cuts = np.concatenate([[0], np.cumsum(size)])
    # Counts can pass 2**32 on a very large corpus.
    answers = slices(train[at].astype("<u8"), cuts)
    held = of == _TUNE
    held_out = slices(tune[at[held]].astype("<u8"), np.concatenate([[0], np.cumsum(np.where(class_ == _TUNE, size, 0))]))
    rows, no = len(size), pa.array([None], pa.binary())
    empty = lambda x: pa.concat_arrays([pa.array(np.zeros(rows, np.int64)), pa.array([x], pa.int64())])
    blocks = pa.concat_arrays([*group.column("block").chunks, pa.array([-1], pa.int64())])
    return pa.table(
        [
            blocks, pa.concat_arrays([*group.column("class").chunks, pa.array([-1], pa.int32())]), pa.array(np.full(rows + 1, number)),
            pa.concat_arrays([answers, no]), pa.concat_arrays([held_out, no]), *map(empty, stats),
        ],
        names=["block", "class", "range", "train", "tune", "tokens", "types", "tune_tokens", "core_types"],
    )


class _Counts:
    """Counts of a block's words, bigrams and contexts, for each token."""

    def __init__(self, block: Block, answers: pa.Table, name: str):
        found = []
        for kind in (0, 1):
            own = answers.filter(pc.equal(pc.bit_wise_and(answers.column("range"), 1), kind)).sort_by("range")
            counts, _ = joined(own.column(name), "<u8")
            keys, at = block.keys(kind)
            if len(counts) != len(keys):
                raise RuntimeError("a block has not as many answers as it has words")
            counts = counts.astype(np.int64)
            found.append(counts[at])
            if kind == 0:
                self.context = counts[np.searchsorted(keys, block.last)]
        self.word, self.pair = found


def _meet(group: pa.Table) -> tuple[pa.Table, Block, pa.Table]:
    is_text = pc.equal(group.column("range"), -1)
    parts = _open(group.filter(is_text).column("train")[0].as_py())
    return parts, Block.of(parts), group.filter(pc.invert(is_text))


def _probabilities(word, pair, context, tokens: int, types: int):
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    p1 = word / max(tokens, 1)
    return p2, p1, 1.0 / (types + 1)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2 of the count)."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1).astype(float))[1], 0)


def learn_weights(cells: np.ndarray, p0: float, rounds: int = 60, least: int = 50) -> np.ndarray:
    """EM a bucket; cells: bucket, n, mean p2, mean p1 in each row. Returns weights (l2, l1, l0) a bucket."""
    weights = np.tile([0.0, 0.9, 0.1], (65, 1))
    learned = []
    for b in np.unique(cells[:, 0]).astype(int):
        own = cells[cells[:, 0] == b]
        n = own[:, 1]
        if n.sum() < least:
            continue
        p = np.stack([own[:, 2], own[:, 3], np.full(len(own), p0)], 1)
        l = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(rounds):
            share = p * l
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            l = (share * n[:, None]).sum(0) / n.sum()
        weights[b] = np.maximum(l, 1e-7)
        learned.append(b)
    for b in range(65):  # buckets without enough held-out tokens take the nearest learned one's
        if learned and b not in learned:
            weights[b] = weights[min(learned, key=lambda x: (abs(x - b), x))]
    return weights / weights.sum(1, keepdims=True)


def score(docs: DataFrame, folds: Folds = Folds(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(one row a document, weights a bucket).

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "lm-score")
    blocks = stage(_blocks(id_text(docs, id_col, text_col), folds), f"{work}/blocks")
    n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    bits = max(8 * (8 - _KEY), int(np.ceil(np.log2(1 + n_bytes / RANGE_BYTES))))
    answers = stage(_requests(blocks, bits).groupBy("range").applyInArrow(_answer, _ANSWER), f"{work}/answers")
    stats = answers.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "tune_tokens", "core_types"))).first()
    tokens, types = stats["tokens"], stats["types"]
    core_tokens, core_types = tokens - stats["tune_tokens"], stats["core_types"]

    def met(only: str, *counts: str) -> DataFrame:
        no = F.lit(None).cast("binary")
        replies = answers.where(f"block >= 0 and {only}").select("block", "range", *(F.col(c) if c in counts else no.alias(c) for c in ("train", "tune")))
        return replies.unionByName(blocks.where(only).select("block", F.lit(-1).cast("long").alias("range"), F.col("body").alias("train"), no.alias("tune")))

    def cells(group: pa.Table) -> pa.Table:
        _, block, own = _meet(group)
        all_, tune = _Counts(block, own, "train"), _Counts(block, own, "tune")
        word, pair, context = (getattr(all_, c) - getattr(tune, c) for c in ("word", "pair", "context"))
        p2, p1, _ = _probabilities(word, pair, context, core_tokens, core_types)
        quantum = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * QUANTA), 1).astype(np.int64)
        key = (bucket_of(context).astype(np.int64) << 40) | ((quantum(p2) + 4096) << 20) | (quantum(p1) + 4096)
        keys, at = np.unique(key, return_inverse=True)
        return pa.table({
            "key": pa.array(keys, pa.int64()), "n": pa.array(np.bincount(at, minlength=len(keys)), pa.int64()),
            "s2": pa.array(np.bincount(at, weights=p2, minlength=len(keys)), pa.float64()), "s1": pa.array(np.bincount(at, weights=p1, minlength=len(keys)), pa.float64()),
        })

    def scores(group: pa.Table) -> pa.Table:
        parts, block, own = _meet(group)
        c = _Counts(block, own, "train")
        p2, p1, p0 = _probabilities(c.word, c.pair, c.context, tokens, types)
        l = weights[bucket_of(c.context)]
        log_p = np.log10(l[:, 0] * p2 + l[:, 1] * p1 + l[:, 2] * p0)
        base = np.log10((c.word + 1) / (tokens + types + 1))
        add = lambda w: pa.array(np.bincount(block.row, weights=w, minlength=parts.num_rows))
        out = pa.table({
            "uid": parts.column("uid"), "doc_id": parts.column("doc_id"), "held_out": parts.column("test"),
            "n_tokens": pa.array(block.n_tokens.astype(np.int64)), "n_known": add(c.word > 0).cast(pa.int64()), "base_score": add(base), "score": add(log_p),
        })
        give_back()
        return out

    table = met(f"class = {_TUNE}", "train", "tune").groupBy("block").applyInArrow(cells, "key long, n long, s2 double, s1 double")
    rows = table.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).collect()  # buckets x quanta x quanta
    flat = np.array([(r["key"] >> 40, r["n"], r["s2"] / r["n"], r["s1"] / r["n"]) for r in sorted(rows, key=lambda r: r["key"])]).reshape(-1, 4)
    weights = learn_weights(flat, 1.0 / (core_types + 1))
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    by_part = met("true", "train").groupBy("block").applyInArrow(scores, schema)
    # Parts of one document are added up; nearly all documents are one part.
    out = by_part.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"), weights
