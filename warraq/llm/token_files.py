"""Token ids in compressed files with rank and select (operator 13).

Texts are dealt into ranges of ascending identifiers, about ``SHARD_BYTES`` of text each;
a task encodes its range and writes one file a shard, through Spark's own committed
writer, wherever Spark can write.  A shard is a wavelet matrix: one plane of bits for each
bit of an id, highest first; a plane holds that bit of every id, ids having been moved
stably, those with a 0 in the planes above before those with a 1.  So a place, a count or an occurrence costs one
step a plane, without decoding the rest.

File format: Parquet, a folder ``shard=<number>`` with one file (one row group) a shard;
numbers ascend with the identifiers.  Rows, in this order:

* ``plane`` -1: documents in order, up to ``DOCS`` a ``block``: ``doc_ids`` and ``doc_tokens`` (lengths).
* ``plane`` 0, 1, ... from the highest bit: ``bits`` of up to ``BLOCK`` places, first place in the highest
  bit of the first byte, and ``ones``, the set bits of the plane before this block.

``length`` in every row is the number of ids in the shard, ``width`` the number of planes.

A document is never split over shards.  Encoding takes each distinct word once as long as a
worker knows it (``by_words``), for vocabularies that lower-case texts, drop white space and
take letters, digits and signs apart, so that a text's ids are those of its words one after
another, and of plain letters and the signs behind them; for others the text is encoded as a whole.

Defined cases: a null, empty or blank text is its end id alone; repeated rows and rows that share an
identifier are all kept, ordered by a hash of their text; null identifiers come first; a very long text is a
shard of its own, and one task holds its ids (4 bytes each) and planes; an empty table gives no shard and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, id_text, pieces, ready, split_words, text_parts

END_ID = 2
#: Text that a task takes, about; and ids after which a shard is closed.
SHARD_BYTES, SHARD_TOKENS = 16 << 20, 1 << 23
#: Places and documents in one row of a file.
BLOCK, DOCS = 1 << 16, 1 << 14
#: After so many words (some 200 bytes each) a worker forgets them and begins anew.
KNOWN_WORDS = 400_000
#: Lower-case letters that are one character composed or not; words of them, and words followed by signs.
_LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_PLAIN = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"
_APART = r"^(?P<stem>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: One row group a file.
_ROW_GROUP = 1 << 30

_FILE = "plane int, block int, length long, width int, ones long, bits binary, doc_ids array<long>, doc_tokens array<long>"
_NAMES = ["shard", "plane", "block", "length", "width", "ones", "bits", "doc_ids", "doc_tokens"]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


class Encoder:
    """Ids of texts; see ``by_words`` above."""

    def __init__(self, vocabulary: str, by_words: bool = True):
        self.tokenizer, self.by_words = _tokenizer(vocabulary), by_words
        if by_words:
            # What the vocabulary's own steps before the merges make of each plain letter.
            before = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c))
            self.letters = {ord(c): "".join(x for x, _ in before(c)) for c in _LETTERS}
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ends, self.flat = np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype="<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids a text)."""
        count, out = np.zeros(len(texts), dtype=np.int64), [np.zeros(0, "<u4")]
        if not self.by_words:
            for i, text in enumerate(texts):
                out.append(np.array(self.tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids, dtype="<u4"))
                count[i] = len(out[-1])
            return np.concatenate(out), count
        for row, part in text_parts(texts):
            words, n = split_words(part, lower=False)
            coded = words.dictionary_encode()
            word = coded.indices.to_numpy()
            # Letters and the signs after them are taken apart: each has its own ids wherever it stands.
            apart = pc.extract_regex(coded.dictionary, _APART)
            plain = apart.is_valid()
            stems = pc.if_else(plain, pc.utf8_lower(apart.field("stem")), coded.dictionary)
            tails = pc.fill_null(pc.if_else(plain, apart.field("tail"), ""), "")
            units = pa.chunked_array([stems, tails]).combine_chunks().dictionary_encode()
            place = self._places(units.dictionary)[units.indices.to_numpy()]
            unit = np.stack([place[: len(stems)][word], place[len(stems) :][word]], axis=1).ravel()
            begin = np.where(unit > 0, self.ends[unit - 1], 0)
            size = self.ends[unit] - begin
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))])
            count[row : row + len(part)] += np.diff(np.concatenate([[0], ends])[2 * np.concatenate([[0], np.cumsum(n)])])
        return np.concatenate(out), count

    def _places(self, units: pa.Array) -> np.ndarray:
        """The number of each unit among those whose ids are known; new ones are encoded."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        letters, merges, n = self.letters, self.tokenizer.model.tokenize, len(self.known)
        # All units are looked up at once; Python sees those alone that are not known.
        places = pc.index_in(units, value_set=self.known.cast(units.type))
        new = units.filter(places.is_null())
        out = pc.fill_null(places, 0).to_numpy().astype(np.int64)
        if len(new):
            fresh, sizes = [], []
            for w, simple in zip(new.to_pylist(), pc.match_substring_regex(new, _PLAIN).to_pylist(), strict=True):
                ids = [t.id for t in merges(w.translate(letters))] if simple else self.tokenizer.encode(w, add_special_tokens=False).ids
                fresh += ids
                sizes.append(len(ids))
            self.known = pa.concat_arrays([self.known.cast(units.type), new])
            out[places.is_null().to_numpy(zero_copy_only=False)] = np.arange(n, len(self.known))
            old = int(self.ends[n - 1]) if n else 0
            ends = old + np.cumsum(sizes)
            self.ends, self.flat = _room(self.ends, len(self.known)), _room(self.flat, int(ends[-1]))
            self.ends[n : len(self.known)], self.flat[old : int(ends[-1])] = ends, fresh
        return out


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The same numbers with room for n, growing by half at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), x.dtype)])


# --------------------------------------------------------------------------
# The wavelet matrix
# --------------------------------------------------------------------------


class WaveletMatrix:
    """Ids as planes of bits, with counts of the set bits before each word of 64."""

    def __init__(self, length: int, planes: list[np.ndarray]):
        """planes: packed bits of each, highest first."""
        self.length, self.width = length, len(planes)
        self.words, self.before, self.zeros = [], [], []
        for bits in planes:
            padded = np.zeros((length // 64 + 1) * 8, dtype=np.uint8)
            padded[: len(bits)] = bits
            words = padded.view(">u8").astype(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(length - int(before[-1]))

    @staticmethod
    def planes(ids: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """Packed bits of each plane of the given ids."""
        for k in range(width - 1, -1, -1):
            one = (ids >> ids.dtype.type(k)) & ids.dtype.type(1) != 0
            yield np.packbits(one)
            ids = np.concatenate([ids[~one], ids[one]])

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.words[k][at >> 6] >> (63 - (at & 63)).astype(np.uint64)) & np.uint64(1) != 0

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Set bits of plane k before place ``at`` (up to ``length``)."""
        inside = (at & 63).astype(np.uint64)
        high = np.where(inside > 0, self.words[k][at >> 6] >> (np.uint64(64) - np.maximum(inside, np.uint64(1))), np.uint64(0))
        return self.before[k][at >> 6] + np.bitwise_count(high).astype(np.int64)

    def _place(self, k: int, rank: np.ndarray, one: bool) -> np.ndarray:
        """Place of the rank-th (from 0) set or clear bit of plane k."""
        before = self.before[k] if one else 64 * np.arange(len(self.before[k])) - self.before[k]
        word = np.searchsorted(before, rank, side="right") - 1
        value = self.words[k][word] if one else ~self.words[k][word]
        bits = np.unpackbits(value.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        return word * 64 + (np.cumsum(bits, axis=1) == (rank - before[word] + 1)[:, None]).argmax(axis=1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.asarray(at, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for k in range(self.width):
            one, ones = self._bit(k, at), self._ones(k, at)
            out = 2 * out + one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        """Where, below the last plane, the occurrences of a token before place ``end`` lie."""
        a, b = 0, end
        for k in range(self.width):
            ones = self._ones(k, np.array([a, b]))
            if token >> (self.width - 1 - k) & 1:
                a, b = (self.zeros[k] + ones).tolist()
            else:
                a, b = a - int(ones[0]), b - int(ones[1])
        return a, b

    def rank(self, token: int, end: int | None = None) -> int:
        """How often the token stands before place ``end`` (everywhere, if none is given)."""
        if token < 0 or token >> self.width:
            return 0
        a, b = self._interval(token, self.length if end is None else end)
        return b - a

    def select(self, token: int, ranks: np.ndarray) -> np.ndarray:
        """Places of the given occurrences (from 0) of a token."""
        at = self._interval(token, self.length)[0] + np.asarray(ranks, dtype=np.int64)
        for k in range(self.width - 1, -1, -1):
            one = bool(token >> (self.width - 1 - k) & 1)
            at = self._place(k, at - self.zeros[k] if one else at, one)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.rank(token)))

    def ids(self) -> np.ndarray:
        """All ids: planes from the lowest up, each putting its moved places back."""
        out = np.zeros(self.length, dtype="<u4")
        for k in range(self.width - 1, -1, -1):
            one = np.unpackbits(self.words[k].astype(">u8").view(np.uint8), count=self.length).view(bool)
            back = np.empty_like(out)
            back[~one], back[one] = out[: self.zeros[k]], out[self.zeros[k] :]
            out = back | (one.astype("<u4") << np.uint32(self.width - 1 - k))
        return out


def file_rows(shard: int, ids: np.ndarray, doc_ids: list, doc_tokens: list[int], width: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard's file."""

    def rows(plane: int, blocks: int, ones: list, bits: list, own: list, lengths: list) -> pa.RecordBatch:
        columns = [
            pa.array([shard] * blocks, pa.int64()), pa.array([plane] * blocks, pa.int32()), pa.array(range(blocks), pa.int32()),
            pa.array([len(ids)] * blocks, pa.int64()), pa.array([width] * blocks, pa.int32()), pa.array(ones, pa.int64()), pa.array(bits, pa.binary()),
            pa.array(own, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    cuts = range(0, len(doc_ids), DOCS)
    yield rows(-1, len(cuts), [None] * len(cuts), [None] * len(cuts), [doc_ids[a : a + DOCS] for a in cuts], [doc_tokens[a : a + DOCS] for a in cuts])
    for plane, bits in enumerate(WaveletMatrix.planes(ids, width)):
        blocks = [bits[a : a + BLOCK // 8] for a in range(0, len(bits), BLOCK // 8)]
        counts = [int(np.bitwise_count(b).sum()) for b in blocks]
        ones = np.concatenate([[0], np.cumsum(counts)])[:-1].tolist()
        yield rows(plane, len(blocks), ones, [b.tobytes() for b in blocks], [None] * len(blocks), [None] * len(blocks))


class Shard:
    """One file: its number, its documents and its ids as a wavelet matrix."""

    def __init__(self, number: int, length: int, width: int):
        self.number, self.length, self.width = number, length, width
        self.doc_ids: list = []
        self._tokens: list[int] = []
        self._blocks: list[list[bytes]] = [[] for _ in range(width)]

    def take(self, batch: pa.RecordBatch) -> None:
        for plane, block, ones, bits, doc_ids, doc_tokens in zip(*(batch.column(c) for c in ("plane", "block", "ones", "bits", "doc_ids", "doc_tokens")), strict=True):
            plane, block = plane.as_py(), block.as_py()
            if plane < 0:
                self.doc_ids += doc_ids.as_py()
                self._tokens += doc_tokens.as_py()
            else:
                if block != len(self._blocks[plane]):
                    raise ValueError(f"shard {self.number}: the blocks of plane {plane} are not in order")
                self._blocks[plane].append(bits.as_py())

    def close(self) -> Shard:
        planes = [np.frombuffer(b"".join(own), dtype=np.uint8) for own in self._blocks]
        self._blocks = []
        self.doc_tokens = np.array(self._tokens, dtype=np.int64)
        if any(len(p) != (self.length + 7) // 8 for p in planes) or int(self.doc_tokens.sum()) != self.length:
            raise ValueError(f"shard {self.number} is not whole")
        #: Where each document begins in the shard.
        self.first = np.cumsum(self.doc_tokens) - self.doc_tokens
        self.matrix = WaveletMatrix(self.length, planes)
        return self


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The shards whose rows follow each other in the batches."""
    now = None
    for batch in batches:
        numbers = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if now is None or now.number != int(numbers[a]):
                if now is not None:
                    yield now.close()
                now = Shard(int(numbers[a]), batch.column("length")[a].as_py(), batch.column("width")[a].as_py())
            now.take(batch.slice(a, b - a))
    if now is not None:
        yield now.close()


# --------------------------------------------------------------------------
# On Spark
# --------------------------------------------------------------------------


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, by_words: bool = True,
    id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode every text and write the shards' files under ``path``."""
    vocabulary = vocabulary or default_vocabulary()
    texts = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, by_words)
        width = max(end_id, encoder.tokenizer.get_vocab_size(with_added_tokens=True) - 1, 1).bit_length()
        kind = np.uint16 if width <= 16 else np.uint32
        number, held, parts, own, lengths = TaskContext.get().partitionId() << 24, 0, [], [], []

        def close():
            nonlocal number, held
            yield from file_rows(number, np.concatenate(parts), own, lengths, width)
            number, held = number + 1, 0
            parts.clear(), own.clear(), lengths.clear()

        for batch in pieces(batches, "text"):
            ids, count = encoder.encode(batch.column("text"))
            ends = np.cumsum(count)
            ids = np.insert(ids, ends, end_id).astype(kind)
            count = count + 1
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), count.tolist(), strict=True):
                if held and held + n > shard_tokens:
                    yield from close()
                parts.append(ids[at : at + n])
                own.append(doc_id)
                lengths.append(n)
                at, held = at + n, held + n
        if held:
            yield from close()
        give_back()

    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    keyed = texts.withColumns({"key": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "key", "row").sortWithinPartitions("doc_id", "key", "text")
    rows = dealt.select("doc_id", "text").mapInArrow(run, "shard long, " + _FILE).sortWithinPartitions("shard", "plane", "block")
    writer = rows.write.option("compression", "zstd").option("parquet.block.size", _ROW_GROUP).option("parquet.enable.dictionary", "false")
    writer.partitionBy("shard").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all files; a file is one row group, so one task reads it, in order."""
    ready(spark)
    return spark.read.schema(_FILE + ", shard long").parquet(path).select(*_NAMES)


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard: shard, start (ids in the shards before it), length; from the files' first rows, one a file to the driver."""
    heads = read_files(spark, path).where((F.col("plane") == -1) & (F.col("block") == 0)).select("shard", "length").collect()
    rows, at = [], 0
    for shard, length in sorted(heads):
        rows.append((shard, at, length))
        at += length
    return spark.createDataFrame(rows, "shard long, shard_start long, shard_length long")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document, read back: doc_id, start, n_tokens, ids_crc32 (and ids, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            ids = shard.matrix.ids()
            bounds = list(zip(shard.first.tolist(), (shard.first + shard.doc_tokens).tolist(), strict=True))
            columns = {
                "shard": pa.array(np.full(len(bounds), shard.number)), "doc_id": pa.array(shard.doc_ids, pa.int64()), "place": pa.array(shard.first),
                "n_tokens": pa.array(shard.doc_tokens), "ids_crc32": pa.array([zlib.crc32(ids[a:b].data) for a, b in bounds], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in bounds], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)
        give_back()

    schema = "shard long, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    found = read_files(spark, path).mapInArrow(run, schema).join(index(spark, path), "shard")
    return found.select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the given ids stands in all files; by ranks, nothing is decoded."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            yield pa.RecordBatch.from_pydict({"token": pa.array(wanted, pa.int64()), "n": pa.array([shard.matrix.rank(t) for t in wanted], pa.int64())})

    return read_files(spark, path).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, start (of all ids), place (in the document): every occurrence of an id, by selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            at = shard.matrix.occurrences(token)
            doc = np.searchsorted(shard.first, at, side="right") - 1
            ids = pa.array(shard.doc_ids, pa.int64()).take(pa.array(doc))
            columns = {"shard": pa.array(np.full(len(at), shard.number)), "doc_id": ids, "at": pa.array(at), "place": pa.array(at - shard.first[doc])}
            yield pa.RecordBatch.from_pydict(columns)

    found = read_files(spark, path).mapInArrow(run, "shard long, doc_id long, at long, place long").join(index(spark, path), "shard")
    return found.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "place")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """place, token: the ids at the given places among all ids; only files that hold one are read."""
    spans = [(r["shard"], r["shard_start"], r["shard_length"]) for r in index(spark, path).collect()]
    wanted = np.unique(np.array(places, dtype=np.int64))
    own = {s: wanted[(wanted >= a) & (wanted < a + n)] - a for s, a, n in spans}
    own, start = {s: at for s, at in own.items() if len(at)}, {s: a for s, a, _ in spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            at = own[shard.number]
            yield pa.RecordBatch.from_pydict({"place": pa.array(at + start[shard.number]), "token": pa.array(shard.matrix.access(at))})

    return read_files(spark, path).where(F.col("shard").isin(list(own))).mapInArrow(run, "place long, token long")
