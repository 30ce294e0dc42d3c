"""Near-duplicate components by fast similarity sketches (operator 3).

A document's set of word shingles is hashed into ``BANDS * ROWS`` coordinates in
rounds: each round throws every element into one bin, and a bin keeps the least
(round, value).  Rounds past the number of coordinates aim all elements at one bin
each, so every coordinate fills; the work is about set size plus t log t instead of
their product, with Chernoff-like concentration.  Bands of coordinates give bucket
keys: with 45 bands of 6, a pair at 0.8 is missed with probability about 1e-6.

Documents with the same words in the same order (equal 128-bit BLAKE2 digests of all
words and of their lengths) are one class from the start; equal sets in another order
meet as candidates like any others.  A bucket's members are paired with one center
only, the member that is in the fullest buckets; pairs are verified on the full shingle
sets of the texts, and verified links joined into components.  Where members of a center's family are still in different components,
those are compared across components by intersection counts in blocks of bounded
size, so no link found by banding is left out and no pairs of a group are emitted.

Defined cases: a null, empty or blank text has an empty set and is linked with
nothing; fewer words than a shingle make one shingle of all words; repeated rows are
one class; rows that share a doc_id but not a text are linked each by its own text; a
null identifier is smaller than none, so it names a component only where all its
identifiers are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, drop_stage, id_text, mix, mix_in_place, pieces, stage, without_ids, work_dir
from .components import components

BANDS, ROWS = 45, 6
#: Members of a family that meet in one task, and the size up to which families share a task.
FAMILY_BLOCK, SMALL_FAMILY = 1024, 64
#: Bytes of text of the members that meet in one task, on either side.
FAMILY_BYTES = 8 << 20

#: Elements that are hashed at once for a sketch.
_AT_ONCE = 1 << 17
#: Candidates (about 40 bytes each) up to this number are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD)


def fast_sketch(h: np.ndarray, t: int, seeds: np.ndarray) -> np.ndarray:
    """t coordinates of the set of hashes ``h`` (not empty)."""
    out = np.full(t, _EMPTY, dtype=np.uint64)
    done, left = 0, t
    while left and done < t:
        rounds = min(t - done, max(1, int(1.2 * t * (np.log(t) + 2) / len(h)) if done == 0 else done))
        some = max(1, _AT_ONCE // rounds)
        i = np.arange(done, done + rounds, dtype=np.uint64)
        for a in range(0, len(h), some):
            g = mix(h[None, a : a + some] ^ seeds[done : done + rounds, None])
            at = ((g >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            value = (i[:, None] << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, at.ravel().astype(np.int64), value.ravel())
        done += rounds
        left = int((out == _EMPTY).sum())
    for j in np.flatnonzero(out == _EMPTY):  # the sure rounds
        g = mix(h ^ seeds[t + j])
        out[j] = (np.uint64(t + j) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF)).min()
    return out


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct shingle, rows ascending."""
    h, n = words.hash, len(words.hash)
    whole = max(n - k + 1, 0)
    acc = np.zeros(whole, dtype=np.uint64)
    for a in range(0, whole, _AT_ONCE):
        own = acc[a : a + _AT_ONCE]
        for j in range(k):
            own *= np.uint64(0x2545F4914F6CDD1D)
            own += h[a + j : a + j + len(own)]
            mix_in_place(own)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if words.n_rows == 1 and not len(short):  # one long text: nothing to tell apart
        acc.sort()
        new = np.ones(whole, dtype=bool)
        new[1:] = acc[1:] != acc[:-1]
        acc = acc[new]
        return np.zeros(len(acc), dtype=np.int32), acc
    ok = words.row[:whole] == words.row[k - 1 :] if whole else np.zeros(0, dtype=bool)
    rows, hashes = [words.row[:whole][ok]], [acc[ok]]
    for row in short:
        one = np.zeros(1, dtype=np.uint64)
        for x in h[words.first[row] : words.first[row + 1]]:
            one = mix(one * np.uint64(0x2545F4914F6CDD1D) + x)
        rows.append(np.array([row]))
        hashes.append(mix(one + words.count[row].astype(np.uint64)))
    row, hash_ = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hash_, row))
    row, hash_ = row[order], hash_[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])
    return row[new], hash_[new]


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """uid (of the row), doc_id, n_shingles, digest (of the words), keys (one a band; empty for empty sets)."""
    t = bands * rows

    def run(batches):
        seeds = _seeds(2 * t)
        band = _seeds(3 * bands)[2 * bands :]
        at = TaskContext.get().partitionId() << 36
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"), digests=True)
            row, h = shingle_hashes(words, k)
            n = np.bincount(row, minlength=piece.num_rows)
            first = np.concatenate([[0], np.cumsum(n)])
            del row
            keys = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                if a == b:
                    continue
                s = fast_sketch(h[a:b], t, seeds).reshape(bands, rows)
                acc = band.copy()
                for j in range(rows):
                    acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + s[:, j])
                keys.append(acc)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at + np.arange(piece.num_rows)), piece.column("doc_id"), pa.array(n), pa.array(words.digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["uid", "doc_id", "n_shingles", "digest", "keys"],
            )
            at += piece.num_rows
            del words, h

    return docs.mapInArrow(run, "uid long, doc_id long, n_shingles long, digest binary, keys array<long>")


def shingle_set(text: bytes | None, k: int) -> set:
    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least ``percent`` % similarity."""
    one = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(one, "b").join(two, "a")

    def run(batches):
        last, own = object(), set()
        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b"), []
            left, right = batch.column("text_a"), batch.column("text_b")
            for i, x in enumerate(a):
                if x != last:
                    last, own = x, shingle_set(left[i].as_py().encode(), k)
                other = shingle_set(right[i].as_py().encode(), k)
                same = len(own & other)
                keep.append(100 * same >= percent * (len(own) + len(other) - same) and same > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts_of(nodes: DataFrame, source: DataFrame, few: bool) -> DataFrame:
    """node, text: of the rows whose identifier and words ``nodes`` (node, doc_id, digest) tells."""
    ids = nodes.select(F.col("doc_id").alias("__id")).distinct()
    some = source.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def run(batches):
        for piece in pieces(batches, "text"):
            digests = Words(piece.column("text"), digests=True).digests
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(digests, pa.binary()), piece.column("text")], names=["__id", "__digest", "text"])

    named = some.select("doc_id", "text").mapInArrow(run, "__id long, __digest binary, text string")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    return named.join(F.broadcast(nodes) if few else nodes, same).select("node", "text").dropDuplicates(["node"])


def near_components(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    work = work_dir(docs.sparkSession, "near-dedup")
    source = id_text(docs, id_col, text_col)
    sketch = stage(sketches(source, k, bands, rows), f"{work}/sketches")
    some = sketch.where("n_shingles > 0")
    # A node of the graph is a class of equal texts, named by the least uid of its rows.
    classes = stage(some.groupBy("digest").agg(F.min("doc_id").alias("low"), F.min("uid").alias("node")), f"{work}/classes")
    reps = some.select(F.col("uid").alias("node"), "keys").join(classes.select("node"), "node", "left_semi")
    member = reps.select(F.explode("keys").alias("key"), "node")
    buckets = member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(member.join(buckets, "key"), f"{work}/buckets")
    # The member that is in the fullest buckets speaks for a bucket: the origin of a family of copies.
    central = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = stage(shared.join(central, "node").select("key", "node", "weight"), f"{work}/weighted")
    center = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("n"))).alias("m"))
    stars = weighted.select("key", F.col("node").alias("b")).join(center.select("key", (-F.col("m.n")).alias("a")), "key").where("a <> b")
    stars = stage(stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("bands")), f"{work}/stars")
    drop_stage(docs.sparkSession, f"{work}/buckets")
    drop_stage(docs.sparkSession, f"{work}/weighted")
    ids = stars.select(F.col("a").alias("uid")).unionByName(stars.select(F.col("b").alias("uid"))).distinct()
    nodes = stage(some.select("uid", "doc_id", "digest").join(ids, "uid", "left_semi").withColumnRenamed("uid", "node"), f"{work}/nodes")
    texts = stage(_texts_of(nodes, source, nodes.count() <= BROADCAST_IDS), f"{work}/texts")

    # Each document against the center it shares most bands with; families still apart are settled in blocks.
    best = stars.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("na"))).alias("m")).select((-F.col("m.na")).alias("a"), "b")
    links = stage(verify(best, texts, k, percent), f"{work}/links-0")
    labels = components(links, f"{work}/components-0")
    more = _settle(stars, labels, texts, k, percent, work)
    if not more.isEmpty():
        labels = components(links.unionByName(more), f"{work}/components-1")

    # The least identifier of each component, for the classes in it; the others are components of their own.
    linked = labels.join(classes, "node").select("digest", "low", "comp")
    named = linked.select("digest", "comp").join(linked.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("digest", "component_id")
    named = classes.select("digest", "low").join(named, "digest", "left").select("digest", F.coalesce("component_id", "low").alias("component_id"))
    out = some.select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labelled(df: DataFrame, labels: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with comp_<col> for each column: the node itself where it has no links."""
    for c in cols:
        to = labels.select(F.col("node").alias(f"node_{c}"), F.col("comp").alias(f"comp_{c}"))
        df = df.join(to, F.col(c) == F.col(f"node_{c}"), "left").drop(f"node_{c}").withColumn(f"comp_{c}", F.coalesce(f"comp_{c}", c))
    return df


def _settle(stars: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int, work: str) -> DataFrame:
    """Verified links between components of one family (a center and all that share a bucket with it).

    Members outside the center's component meet all members of other components, by
    intersection counts inside blocks of FAMILY_BLOCK members and FAMILY_BYTES; only links that join components leave a block.
    """
    family = stars.select("a", "b").unionByName(stars.select("a", F.col("a").alias("b")).distinct())
    family = _labelled(family, labels, ["a", "b"])
    family = family.join(texts.select(F.col("node").alias("b"), F.octet_length("text").cast("long").alias("bytes")), "b")
    apart = F.col("comp_a") != F.col("comp_b")
    block = lambda n, bytes_: F.greatest(F.ceil(n / FAMILY_BLOCK), F.ceil(bytes_ / FAMILY_BYTES), F.lit(1)).cast("int")
    size = family.groupBy("a").agg(
        F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("all_bytes"), F.count_if(apart).alias("asked"), block(F.count(F.lit(1)), F.sum("bytes")).alias("n"),
        block(F.count_if(apart), F.sum(F.when(apart, F.col("bytes")).otherwise(0))).alias("m"),
    ).where("asked > 0")
    whole = (F.col("size") <= SMALL_FAMILY) & (F.col("all_bytes") <= FAMILY_BYTES)
    open_ = family.join(size, "a").select("a", "b", "comp_b", "bytes", "n", "m", apart.alias("apart"), whole.alias("whole"))
    open_ = stage(open_, f"{work}/families")
    small = open_.where("whole").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    bins = max(1, -(-small["n"] // FAMILY_BLOCK), -(-small["bytes"] // FAMILY_BYTES))
    own = lambda parts: F.pmod(F.xxhash64("b"), F.col(parts)).cast("int")
    whole = F.col("whole")
    rows = open_.withColumn("g", F.when(whole, -1 - F.pmod(F.xxhash64("a"), F.lit(bins))).otherwise(F.col("a")))
    left = rows.where("apart").withColumn("i", own("m")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("asks", F.lit(True))
    right = rows.withColumn("j", own("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("asks", F.lit(False))
    both = left.unionByName(right).select("g", "i", "j", "a", "b", "comp_b", "asks")
    both = both.join(texts.select(F.col("node").alias("b"), "text"), "b")

    def run(group: pa.Table) -> pa.Table:
        words = Words(pa.concat_arrays(group.column("text").chunks))
        row, h = shingle_hashes(words, k)
        family_, doc, comp = (group.column(c).to_numpy() for c in ("a", "b", "comp_b"))
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        n = np.bincount(row, minlength=len(doc))
        first = np.concatenate([[0], np.cumsum(n)])
        feature = np.unique(h ^ mix(family_.astype(np.uint64))[row], return_inverse=True)[1]
        # Postings of the members that are asked, by feature.
        member = ~asks[row]
        order = np.argsort(feature[member], kind="stable")
        posting = row[member][order]
        begin = np.searchsorted(feature[member][order], np.arange(feature.max(initial=-1) + 2))
        up: dict[int, int] = {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        found = []
        for x in np.flatnonzero(asks):
            f = feature[first[x] : first[x + 1]]
            size_ = begin[f + 1] - begin[f]
            at = np.repeat(begin[f] - (np.cumsum(size_) - size_), size_) + np.arange(int(size_.sum()))
            same = np.bincount(posting[at], minlength=len(doc))
            for y in np.flatnonzero((100 * same >= percent * (n[x] + n - same)) & (same > 0) & (comp != comp[x])):
                s, t = root(int(comp[x])), root(int(comp[y]))
                if s != t:
                    up[max(s, t)] = min(s, t)
                    found.append((int(doc[x]), int(doc[y])))
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    found = stage(both.groupBy("g", "i", "j").applyInArrow(run, "a long, b long").distinct(), f"{work}/found")
    return stage(verify(found, texts, k, percent), f"{work}/links-1")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest identifier of each component only, all columns kept.

    Rows that share an identifier stay or go together, and stay where any of them would.
    """
    found = near_components(docs, k, percent, id_col=id_col, text_col=text_col)
    gone = found.groupBy(F.col("doc_id").alias("__w_id")).agg(F.bool_or("kept").alias("__w_kept")).where("not __w_kept").select("__w_id")
    return without_ids(docs, gone, id_col)
