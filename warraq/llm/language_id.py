"""Language identification with script ranges and a Viterbi pass (operator 9).

Learning counts hashed byte n-grams (orders 1 to 4, with word borders) of every
labelled word, and the scripts each language is written in.  The model has a fixed
size: ``BUCKETS`` rows a language.  Prediction scores each distinct word of a batch
once, lets the word's script narrow the candidate languages, and runs Viterbi over
the words of each text with a penalty for switching, which labels spans of mixed
text.  Texts are cut into blocks of words that advance in step, so the dynamic programme
is array work for a long text as for many short ones.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and no
spans; ties go to the language first in alphabetical order; words of a script that
no learned language uses carry no evidence; with nothing learned everything is
``und``; repeated rows are predicted alike; a very long text is split in parts, and about
eight times its bytes are held for its words; other columns are ignored or passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, mix, pieces, ready

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SWITCH_PENALTY = 6.0
#: Share of a language's words that must be in a script for that script to admit it.
SCRIPT_SHARE = 0.005
#: Words of a block that the dynamic programme steps through one by one.
_STEP = 64
#: Bytes of text whose words are scored together.
_CHUNK_BYTES = 2 << 20

_RUN = re.compile(r"[^\W\d_]+")

# First code points of script blocks (Unicode), with a name each.
_SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFF00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"),
    (0x20000, "Han"), (0x30000, "Other"),
]
_SCRIPT_NAMES = sorted({name for _, name in _SCRIPTS})
_SCRIPT_START = np.array([lo for lo, _ in _SCRIPTS])
_SCRIPT_ID = np.array([_SCRIPT_NAMES.index(name) for _, name in _SCRIPTS])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_p: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts x languages, True where the script admits the language


def _parts(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """A long text in parts cut at spaces, where no word is cut."""
    at = 0
    while len(text) - at > limit and (end := text.find(" ", at + limit)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class _Runs:
    """Letter runs of a piece: distinct words, and for each text the ids of its words."""

    def __init__(self, texts: list[str | None]):
        ids: dict[str, int] = {}
        seen: list[np.ndarray] = []
        count = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            for part in _parts(text or ""):
                found = _RUN.findall(part.lower())
                seen.append(np.fromiter((ids.setdefault(w, len(ids)) for w in found), dtype=np.int32, count=len(found)))
                count[i] += len(found)
        self.words = list(ids)
        letters = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in self.words), dtype=bool, count=len(ids))
        seen_a = np.concatenate(seen) if seen else np.zeros(0, dtype=np.int32)
        if len(ids) and not letters.all():  # such as a lone superscript digit
            keep = letters[seen_a]
            count = np.bincount(np.repeat(np.arange(len(texts)), count)[keep], minlength=len(texts))
            seen_a = seen_a[keep]
        self.ids, self.count = seen_a, count
        self.first = np.concatenate([[0], np.cumsum(count)])
        first_letter = np.fromiter((ord(w[0]) for w in self.words), dtype=np.int64, count=len(ids))
        self.script = _SCRIPT_ID[np.searchsorted(_SCRIPT_START, first_letter, side="right") - 1]
        self.length = np.fromiter(map(len, self.words), dtype=np.int64, count=len(ids))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the word of each n-gram and its bucket."""
        coded = [b"\x01" + w.encode("utf-8", "surrogatepass") + b"\x02" for w in self.words]
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint64)
        word = np.repeat(np.arange(len(coded)), size)
        end = np.repeat(np.cumsum(size), size)
        at = np.arange(len(data))
        for n in ORDERS:
            ok = at[at + n <= end]
            code = np.full(len(ok), n, dtype=np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | data[ok + k]
            yield word[ok], (mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts over every row of ``docs`` with a language; the model's size is fixed."""
    ready(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for piece in pieces(batches, "text", _CHUNK_BYTES):
            langs = np.array(piece.column("lang").to_pylist(), dtype=object)
            texts = np.array(piece.column("text").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                runs = _Runs(list(texts[langs == lang]))
                if not len(runs.ids):
                    continue
                times = np.bincount(runs.ids, minlength=len(runs.words)).astype(float)
                total = sums.setdefault(lang, np.zeros(BUCKETS))
                for word, bucket in runs.grams():
                    total += np.bincount(bucket, weights=times[word], minlength=BUCKETS)
                seen = scripts.setdefault(lang, np.zeros(len(_SCRIPT_NAMES)))
                seen += np.bincount(runs.script, weights=times, minlength=len(_SCRIPT_NAMES))
        for lang, total in sums.items():
            all_ = np.concatenate([total, scripts[lang]]).astype(np.int64)
            at = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(all_[at])], names=["lang", "bucket", "n"])

    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # at most BUCKETS + scripts rows a language, whatever the input's size
    langs = sorted(rows["lang"].unique())
    table = np.zeros((BUCKETS + len(_SCRIPT_NAMES), len(langs)))
    table[rows["bucket"].to_numpy(dtype=int), [langs.index(x) for x in rows["lang"]]] = rows["n"].to_numpy(dtype=float)
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    log_p = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)) if langs else grams
    share = scripts / np.maximum(scripts.sum(0), 1)
    return Model(langs, log_p.astype(np.float32), share >= SCRIPT_SHARE)


def _emissions(model: Model, runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
    """Score of each distinct word for each language, and whether it is evidence at all."""
    n, k = len(runs.words), len(model.langs)
    score = np.zeros((n, k), dtype=np.float64)
    for word, bucket in runs.grams():
        for j in range(k):
            score[:, j] += np.bincount(word, weights=model.log_p[bucket, j], minlength=n)
    score /= len(ORDERS)
    admits = model.scripts[runs.script]
    evidence = admits.any(1)
    score = np.where(admits, score, -1e6)
    score -= score.max(1, keepdims=True)
    score[~evidence] = 0
    return np.maximum(score, -50.0), evidence


def _viterbi(score: np.ndarray, runs: _Runs, penalty: float) -> np.ndarray:
    """Language of each word.

    Texts are cut into blocks of ``_STEP`` words, which advance together: once from each
    language that could come before (what the block adds from language to language), then
    from what the blocks before really give, and back the same way.  So the number of steps
    is that of a block's words and of a text's blocks, not of a text's words.
    """
    k, total = score.shape[1], len(runs.ids)
    label = np.zeros(total, dtype=np.int16)
    n_blocks = -(-runs.count // _STEP)
    text = np.repeat(np.arange(len(n_blocks)), n_blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    size = np.minimum(_STEP, runs.count[text] - nth * _STEP)
    order = np.argsort(-size, kind="stable")  # those still running are the first ones
    text, nth, size = text[order], nth[order], size[order]
    start = runs.first[:-1][text] + nth * _STEP
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.arange(len(order))  # row of the i-th block in reading order
    before = np.where(nth > 0, np.append(where, -1)[order - 1], -1)  # row of the block before it
    running = len(size) - np.searchsorted(size[::-1], np.arange(1, _STEP + 1))
    running = running[running > 0]
    stay = np.arange(k, dtype=np.int8 if k < 128 else np.int16)
    came = np.empty((total, k), dtype=stay.dtype)

    def forward(cur: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Best values (block, way in, language) at the end of each block; without ``rows`` for all, keeping where each came from."""
        own_start, fresh = (start, nth == 0) if rows is None else (start[rows], nth[rows] == 0)
        for t, a in enumerate(running if rows is None else [len(rows)] * _STEP):
            at, now = own_start[:a] + t, cur[:a]
            jump = now.max(axis=2, keepdims=True) - penalty
            moved = jump > now
            if t == 0:
                moved &= ~fresh[:a, None, None]
            if rows is None:
                came[at] = np.where(moved[:, 0], now[:, 0].argmax(axis=1)[:, None].astype(stay.dtype), stay)
            cur[:a] = np.where(moved, jump, now) + score[runs.ids[at]][:, None, :]
        return cur

    entry = np.zeros((len(order), k))
    inner = np.flatnonzero(np.isin(np.arange(len(order)), before[before >= 0]))  # full blocks with one after them
    by_nth = np.argsort(nth[inner], kind="stable")
    levels = np.split(inner[by_nth], np.flatnonzero(np.diff(nth[inner][by_nth])) + 1) if len(inner) else []
    after = np.full(len(order) + 1, -1)
    after[before] = np.arange(len(order))
    if len(inner):
        ways = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
        adds = np.empty((len(order), k, k))
        adds[inner] = forward(np.where((nth[inner] == 0)[:, None, None], 0.0, ways[None]), inner)
        for rows in levels:
            entry[after[rows]] = (entry[rows][:, :, None] + adds[rows]).max(axis=1)
        del adds
    last = forward(entry[:, None, :].copy())[:, 0].argmax(axis=1)

    def back(state: np.ndarray, keep: bool) -> np.ndarray:
        """State before each block, from states (block, way out) at its end."""
        for t in range(len(running) - 1, -1, -1):
            a = running[t]
            at = start[:a] + t
            if keep:
                label[at] = state[:a, 0]
            state[:a] = np.take_along_axis(came[at], state[:a], axis=1)
        return state

    if len(inner):
        ways_back = back(np.tile(np.arange(k), (len(order), 1)), keep=False)
        for rows in reversed(levels):
            last[rows] = ways_back[after[rows], last[after[rows]]]
    back(last[:, None].copy(), keep=True)
    return label


def _predict(model: Model, texts: list[str | None], penalty: float):
    """Per text: label index (-1: und), score; and the runs with a label each word."""
    runs = _Runs(texts)
    n, k = len(texts), len(model.langs)
    pick, conf = np.full(n, -1), np.zeros(n)
    if not len(runs.ids) or not k:
        return pick, conf, runs, np.zeros(len(runs.ids), dtype=np.int16)
    score, evidence = _emissions(model, runs)
    label = _viterbi(score, runs, penalty)
    row = np.repeat(np.arange(n, dtype=np.int32), runs.count)
    weight = (runs.length * evidence)[runs.ids]
    letters = np.stack([np.bincount(row, weights=weight * (label == j), minlength=n) for j in range(k)], 1)
    like = np.stack([np.bincount(row, weights=score[runs.ids, j], minlength=n) for j in range(k)], 1)
    some = runs.count > 0
    pick[some] = letters[some].argmax(1)
    share = letters.max(1) / np.maximum(letters.sum(1), 1)
    post = np.exp(like - like.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    conf[some] = (share * np.maximum(post[np.arange(n), pick], 1 - np.exp(-letters.max(1) / 50)))[some]
    return pick, np.clip(conf, 0, 1), runs, label


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans: the last says which language holds which words (start, end, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS float32 a language

    def run(batches):
        m = shared.value
        for piece in pieces(batches, "text", _CHUNK_BYTES):
            pick, conf, runs, label = _predict(m, piece.column("text").to_pylist(), penalty)
            names = [m.langs[i] if i >= 0 else "und" for i in pick]
            spans = []
            for i in range(piece.num_rows):
                own = label[runs.first[i] : runs.first[i + 1]]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else np.zeros(1, int)
                spans.append([{"first_word": int(a), "end_word": int(b), "lang": m.langs[own[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)] if m.langs else [])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(names), pa.array(conf), pa.array(spans, type=pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())])))],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>"
    )


def keep_identified(docs: DataFrame, model: Model, min_score: float, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Rows of ``docs``, unchanged, whose text has a language with at least ``min_score``."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in pieces(batches, text_col, _CHUNK_BYTES):
            pick, conf, _, _ = _predict(shared.value, piece.column(text_col).to_pylist(), penalty)
            yield piece.filter(pa.array((pick >= 0) & (conf >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
