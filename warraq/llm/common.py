"""Shared helpers: batches in bounded pieces, words and byte strings as hashes, arrays as columns."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..work import drop_stage, stage, work_dir  # noqa: F401  for the operators

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at once, where the session does not say: with long texts Spark's own
#: number would be hundreds of megabytes on either side.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Workers find the package and get batches of bounded size."""
    ship(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_ROWS)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only identifier and text, whatever else the table carries; workers are made ready."""
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Identifiers (8 bytes each, some 50 in a hash table) up to this number are broadcast to drop their rows; more meet them by a shuffle.
BROADCAST_GONE = 1_000_000


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose identifier is in ``gone`` (one column; null is an identifier like others)."""
    ids = stage(gone.toDF("__w_gone").distinct(), work_dir(docs.sparkSession, "gone"))
    few = ids.count() <= BROADCAST_GONE
    return docs.join(F.broadcast(ids) if few else ids, F.col(id_col).cast("long").eqNullSafe(F.col("__w_gone")), "left_anti")


# --------------------------------------------------------------------------
# Batches in pieces of bounded size
# --------------------------------------------------------------------------

#: Bytes of text that are worked on at once.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about ``limit`` bytes of text (or one row)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
        give_back()


def give_back() -> None:
    """Return freed memory to the system, which a worker would else keep until it ends."""
    pa.default_memory_pool().release_unused()
    trim = _libc_trim()
    if trim:
        trim(0)


@lru_cache(maxsize=1)
def _libc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return None


def one_text(data: np.ndarray) -> pa.Array:
    """An array of one string over the given UTF-8 bytes, which are not copied."""
    offsets = pa.py_buffer(np.array([0, len(data)], dtype=np.int64))
    return pa.Array.from_buffers(pa.large_string(), 1, [None, offsets, pa.py_buffer(data)])


def cut_at_space(data: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """A long text's bytes in parts of about ``limit``, cut at white space only."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            found = np.flatnonzero(_SPACE[data[end : end + 4096]])
            if len(found):
                end += int(found[0])
                break
            end += 4096
        yield data[at : min(end, len(data))]
        at = min(end, len(data))


# --------------------------------------------------------------------------
# Words of a batch of texts
# --------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), on uint64 arrays."""
    return mix_in_place(x.copy())


def mix_in_place(x: np.ndarray) -> np.ndarray:
    """As ``mix``, with one temporary array."""
    t = x >> np.uint64(30)
    x ^= t
    x *= _M1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= _M2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null rows are empty."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def hash_words(words: pa.Array) -> np.ndarray:
    """SipHash-2-4 (keyed, 64 bits) of each string's bytes; equal strings are hashed once."""
    coded = words.dictionary_encode()
    if len(coded.dictionary) == 0:
        return np.zeros(len(words), dtype=np.uint64)
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    return pd.util.hash_array(distinct, hash_key=_HASH_KEY, categorize=False)[coded.indices.to_numpy()]


_HASH_KEY = "warraq-llm-words"  # 16 bytes


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(words, number a text): white-space separated, A-Z lower-cased; null texts have none."""
    texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    some = pc.not_equal(pc.binary_length(flat), 0)
    offsets = lists.offsets.to_numpy()
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), np.diff(before[offsets - offsets[0]])


class Words:
    """Words of a batch of texts, as hashes.

    hash: of each word; row: the text it belongs to; count, first: words a text, and where they
    begin; digests, if asked for: a cryptographic digest of each text's sequence of words.  Texts are split ``PIECE_BYTES`` at a time, long ones in parts, so that beside the
    text itself only its hashes grow with it.
    """

    def __init__(self, col: pa.Array, limit: int | None = None, digests: bool = False):
        limit = limit or PIECE_BYTES
        self.n_rows = len(col)
        self.count = np.zeros(self.n_rows, dtype=np.int64)
        hashes = []
        open_ = [(hashlib.blake2b(digest_size=16), hashlib.blake2b(digest_size=16)) for _ in range(self.n_rows)] if digests else []
        for row, texts in text_parts(col, limit):
            words, count = split_words(texts)
            self.count[row : row + len(texts)] += count
            hashes.append(hash_words(words))
            if digests:
                data, off = raw_bytes(words)
                sizes, at = np.diff(off).astype("<u4"), 0
                for i, n in enumerate(count.tolist()):
                    letters, lengths = open_[row + i]
                    letters.update(data[off[at] : off[at + n]])
                    lengths.update(sizes[at : at + n])
                    at += n
        self.digests = [a.digest() + b.digest() for a, b in open_]
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows, dtype=np.int32), self.count)


def text_parts(col: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts): runs of rows of about ``limit`` bytes; a longer text comes in parts, cut at white space."""
    data, off = raw_bytes(col)
    size = np.diff(off)
    if int(size.max(initial=0)) <= limit and int(off[-1]) <= 2 * limit:
        yield 0, col
        return
    start = 0
    while start < len(col):
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        if size[start] > limit:
            end = start + 1
            for part in cut_at_space(data[off[start] : off[end]], limit):
                yield start, one_text(part)
        else:
            yield start, col.slice(start, end - start)
        start = end


# --------------------------------------------------------------------------
# Hashes of byte strings of one length, at every place
# --------------------------------------------------------------------------

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D | 1
#: Places that are hashed with one table of powers; it never grows.
_SPAN = 1 << 16


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step % (1 << 64)
    return out


def gram_hashes(data: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """Hash of data[i:i + size] for each i, in spans of bounded size.

    Polynomials over random byte values modulo 2**64: good for dealing, not for deciding
    equality; whatever rests on equality compares the bytes as well.
    """
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, dtype=np.uint64)
    up, down = _powers(_SPAN + size, base), _powers(_SPAN, pow(base, -1, 1 << 64))
    for at in range(0, n, _SPAN):
        take = min(_SPAN, n - at)
        total = np.zeros(take + size, dtype=np.uint64)
        np.take(_BYTE, data[at : at + take + size - 1], out=total[1:])
        total[1:] *= up[: take + size - 1]
        np.cumsum(total[1:], out=total[1:])
        part = total[size : size + take] - total[:take]
        part *= down[:take]
        out[at : at + take] = mix_in_place(part)
    return out


# --------------------------------------------------------------------------
# Arrays as binary columns
# --------------------------------------------------------------------------


def slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for values[cuts[i]:cuts[i + 1]], without a copy."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data)])


def joined(column: pa.ChunkedArray | pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of ``slices`` one after another, bytes of each)."""
    data, off = raw_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return data.view(dtype) if dtype != "u1" else data, np.diff(off)
