"""Periodic runs of words, by divide and conquer (operator 11).

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends; it counts from ``power`` periods and ``least`` words on.  Words become numbers
(equal words, equal numbers); then each text is halved again and again (Main and Lorentz),
all texts of a piece level by level.  A run is found whole where a midpoint first falls
inside it.  There, one of its sides holds two periods or more, so the first words beside
the midpoint stand again one period further: one comparison over all places of a level
leaves the few periods for which that is so.  For these the Z-functions of the two halves,
read from the midpoint outwards, tell how far the period holds to the right and to the
left (few values are taken one by one, many from a whole Z-function in linear time).
What reaches its part's edge and goes on there was found whole before.  Of equal intervals
the one with the smallest period stays.  A level costs time in proportion to its words.

Collapsing keeps the first period of each run and drops the rest of it.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows are
judged each; runs that overlap are all kept, by start and then period; a word in a
repeated part of any run is dropped; a very long text is split in parts, and beside it and
its words only numbers (about 40 bytes a word) are held; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_text, pieces, raw_bytes, split_words, text_parts

POWER, LEAST = 4, 6
#: Up to this many periods of one midpoint are judged one by one; more by whole Z-functions.
FEW = 8
#: Words beside a midpoint that are compared for all periods at once.
_GRAM = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period


def z_function(x: np.ndarray) -> np.ndarray:
    """For each place, how many items from there on equal those from the beginning on."""
    items, x, n = x, x.tolist(), len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0  # the stretch known to equal the beginning that ends last
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            near = min(k + 8, n - i)
            while k < near and x[k] == x[i + k]:
                k += 1
            if k == near:  # a long stretch
                k += _agree(items, k, i + k, n - i - k)
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, dtype=np.int64)


def _agree(x: np.ndarray, a: int, b: int, limit: int) -> int:
    """How many items from a and from b on are equal, ``limit`` at most."""
    done, step = 0, 16
    while done < limit:
        take = min(step, limit - done)
        same = x[a + done : a + done + take] == x[b + done : b + done + take]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + take, step * 4
    return limit


def _around(x: np.ndarray, lo: int, mid: int, hi: int, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from ``mid`` on, and how many before it, stand again ``shift`` words away (of either sign) in x[lo:hi]."""
    if len(shift) > FEW:
        part, gap = x[lo:hi], np.array([-1], x.dtype)
        right = z_function(np.concatenate([x[mid:hi], gap, part]))
        left = z_function(np.concatenate([x[lo:mid][::-1], gap, part[::-1]]))
        return right[hi - mid + 1 + mid + shift - lo], left[mid - lo + 1 + hi - mid - shift]
    back, n = x[lo:hi][::-1], hi - mid
    right = [_agree(x, mid, mid + s, n - max(s, 0)) for s in shift.tolist()]
    left = [_agree(back, n, n - s, mid - lo + min(s, 0)) for s in shift.tolist()]
    return np.array(right, dtype=np.int64), np.array(left, dtype=np.int64)


def _level(x: np.ndarray, gram: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, shift) of each period for which the words beside a part's midpoint repeat, ordered by part."""
    mid = (lo + hi) // 2
    parts, shifts = [], []
    for side in (1, -1):
        most = (hi - mid if side > 0 else mid - lo) // 2
        for p in range(1, _GRAM):
            at = np.flatnonzero(most >= p)
            for k in range(p):
                here = mid[at] + k if side > 0 else mid[at] - 1 - k
                at = at[x[here] == x[here + side * p]]
            parts.append(at)
            shifts.append(np.full(len(at), side * p))
        count = np.maximum(most - _GRAM + 1, 0)
        total = int(count.sum())
        if total:
            # All places of the level, part after part: p is _GRAM and more.
            place = (mid if side > 0 else mid - _GRAM) + 0
            first = np.cumsum(count) - count
            step = np.arange(total, dtype=np.int64) - np.repeat(first - _GRAM, count)
            same = np.flatnonzero(gram[np.repeat(place, count) + side * step] == np.repeat(gram[place], count))
            parts.append(np.searchsorted(first + count, same, side="right"))
            shifts.append(side * step[same])
    part, shift = np.concatenate(parts, dtype=np.int64), np.concatenate(shifts, dtype=np.int64)
    order = np.argsort(part, kind="stable")
    return part[order], shift[order]


def find_runs(x: np.ndarray, first: np.ndarray, power: int = POWER, least: int = LEAST) -> Runs:
    """Runs of texts that lie one after another in x, text t at x[first[t]:first[t + 1]]; places in x, by start and period.

    power: 4 or more periods (a side of the first midpoint then holds two).
    """
    if power < 4:
        raise ValueError("runs of fewer than four periods can have less than two on either side of a midpoint")
    x = x.astype(np.int64, copy=False)
    gram = np.zeros(len(x), dtype=np.uint64)
    n = max(len(x) - _GRAM + 1, 0)
    for k in range(_GRAM):
        gram[:n] = gram[:n] * _ODD + x[k : k + n].view(np.uint64)
    changes = np.concatenate([[0], np.cumsum(x[1:] != x[:-1])]) if len(x) else x
    lo, hi = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    text_lo, text_hi = lo, hi
    found: set[tuple[int, int, int]] = set()  # a run that begins or ends at a midpoint is met again below it
    while True:
        long = hi - lo >= least
        lo, hi, text_lo, text_hi = lo[long], hi[long], text_lo[long], text_hi[long]
        if not len(lo):
            break
        # A part of one word only is at most a run by itself; it needs no halves.
        one = changes[hi - 1] == changes[lo]
        if one.any():
            a, b = lo[one], hi[one]
            alone = ((a == text_lo[one]) | (x[a - 1] != x[a])) & ((b == text_hi[one]) | (x[np.minimum(b, len(x) - 1)] != x[a]))
            found.update((i, j, 1) for i, j in zip(a[alone].tolist(), b[alone].tolist(), strict=True) if j - i >= max(power, least))
            lo, hi, text_lo, text_hi = lo[~one], hi[~one], text_lo[~one], text_hi[~one]
        mid = (lo + hi) // 2
        part, shift = _level(x, gram, lo, hi)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=len(lo)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            t = int(part[a])
            l, m, h = int(lo[t]), int(mid[t]), int(hi[t])
            s = shift[a:b][np.argsort(np.abs(shift[a:b]), kind="stable")]
            p = np.abs(s)
            right, left = _around(x, l, m, h, s)
            start, end = m - left + np.minimum(s, 0), m + right + np.maximum(s, 0)
            good = (np.where(s > 0, right, left) >= p) & (end - start >= np.maximum(power * p, least))
            own: dict[tuple[int, int], int] = {}
            for i, j, q in zip(start[good].tolist(), end[good].tolist(), p[good].tolist(), strict=True):
                if not ((i > text_lo[t] and x[i - 1] == x[i - 1 + q]) or (j < text_hi[t] and x[j] == x[j - q])):
                    own.setdefault((i, j), q)  # the smallest period comes first
            found.update((start, end, p) for (start, end), p in own.items())
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        text_lo, text_hi = np.concatenate([text_lo, text_lo]), np.concatenate([text_hi, text_hi])
    out = np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _interned(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, words a text, word of each number)."""
    count, words = np.zeros(len(texts), dtype=np.int64), []
    for row, part in text_parts(texts):
        flat, n = split_words(part, lower=False)
        count[row : row + len(part)] += n
        words.append(flat.cast(pa.large_string()).dictionary_encode())
    if not words:
        return np.zeros(0, np.int64), count, pa.array([], pa.large_string())
    coded = pa.chunked_array(words).unify_dictionaries()
    return np.concatenate([c.indices.to_numpy() for c in coded.chunks]), count, coded.chunk(0).dictionary


_RUN = "struct<start:long,length:long,period:long>"


def periodic_runs(
    docs: DataFrame, power: int = POWER, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row a text: doc_id, n_words, runs (by start, then period), collapsed_sha256 and, if asked for, the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x, count, words = _interned(batch.column("text"))
            first = np.concatenate([[0], np.cumsum(count)])
            start, end, period = find_runs(x, first, power, least)
            text_of = np.searchsorted(first, start, side="right") - 1
            # Words in a run after its first period: sums of beginnings and ends.
            edge = np.bincount(start + period, minlength=len(x) + 1) - np.bincount(end, minlength=len(x) + 1)
            keep = np.cumsum(edge)[: len(x)] == 0
            kept_before = np.concatenate([[0], np.cumsum(keep)])
            lists = pa.ListArray.from_arrays(pa.array(kept_before[first], pa.int32()), words.take(pa.array(x[keep])))
            text = pc.binary_join(lists, pa.scalar(" ", words.type))
            data, off = raw_bytes(text)
            runs = pa.StructArray.from_arrays([pa.array(start - first[text_of]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
            of_text = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(count)))]).astype(np.int32)
            columns = {
                "doc_id": batch.column("doc_id"), "n_words": pa.array(count), "runs": pa.ListArray.from_arrays(pa.array(of_text), runs),
                "collapsed_sha256": pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)], pa.string()),
            }
            if with_text:
                columns["collapsed"] = text
            yield pa.RecordBatch.from_pydict(columns)
        give_back()

    schema = f"doc_id long, n_words long, runs array<{_RUN}>, collapsed_sha256 string" + (", collapsed string" if with_text else "")
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length; of several the one that starts first, then the one of the smallest period."""
    order = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("a"), (-r["start"]).alias("b"), (-r["period"]).alias("c"))))
    return F.struct((-order["b"]).alias("start"), order["a"].alias("length"), (-order["c"]).alias("period"))


def runs_sha256(runs: Column) -> Column:
    """Digest of all runs, one line ``start,length,period`` each."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.sha2(F.array_join(F.transform(runs, line), "").cast("binary"), 256)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of all identifiers, made to repeat their last words.

    Fixed values: with h = crc32 of the identifier's digits, g = h // 10, n words, a = g % n and
    p = 1 + (n - a) // (3 + g % 8), words from a on become the p words from a on, again and again, where h % 10 = 0.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        rest = n - a
        p = F.lit(1) + F.floor(rest / (F.lit(3) + g % 8)).cast("long")
        period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / p).cast("int"))), F.lit(1), rest.cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # In an array of one, so that the words are split once and not for each use.
    planted = F.try_element_at(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), repeat), F.lit(1))
    text = F.col("text")
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, text)).otherwise(text).alias("text"))
