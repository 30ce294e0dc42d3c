"""Benchmark decontamination with a broadcast hash set of n-grams (operator 2, native).

Each document becomes an array of words and an array of window hashes in one pass
over its text; the hashes are exploded and probed against the benchmark's windows
in generated code, so that only hits leave the task.  A hit is then compared word
by word.  The benchmark's windows are broadcast while their number stays under
``BROADCAST_WINDOWS`` (about 200 bytes each); beyond it the documents' words are written
once, hashes alone meet the benchmark's by a shuffle, and hits return to their document
to be compared.

Defined cases: null and empty texts have no words; an item with fewer words than a
window is one window, an item without words none; repeated items and windows count
once an item identifier; rows with the same doc_id are judged one by one; a word hit by
several windows (a tie) counts once; an empty table on either side gives no hits; of a very long text
the JVM holds the array of its words in one row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stage, without_ids, work_dir

WINDOW = 10
BROADCAST_WINDOWS = 1_000_000

# Fixed value: what is no word, after lower-casing A-Z.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text; only A-Z are lower-cased.

    lower() does that at once where no other character would change with it.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(plain, _GAP), "")


def windows_of_items(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """h, item_id, gram (words): one row a distinct window and item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    return items.select(
        "item_id",
        F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("gram"),
    ).distinct().withColumn("h", F.xxhash64("gram"))


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row a document: doc_id, n_words, spans (merged word ranges hit), item_ids (sorted as strings)."""
    grams = windows_of_items(benchmark, window, item_id, item_text).withColumn("len", F.size("gram"))
    grams = grams.groupBy("h", "len", "gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    stats = grams.agg(F.count(F.lit(1)).alias("n"), F.collect_set("len").alias("lens")).first()
    lens = sorted(stats["lens"])  # at most `window` different numbers
    mark = docs.sparkSession.range(1).select(
        F.xxhash64(F.lit("document")).alias("h"), F.lit(0).alias("len"),
        F.expr("cast(null as array<string>)").alias("gram"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    words = id_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("uid"), words_of(F.col("text")).alias("w"))
    probe = _by_broadcast if stats["n"] <= BROADCAST_WINDOWS else _by_shuffle
    hit = probe(words, grams.select("h", "len", "gram", "items"), lens)
    by_doc = hit.groupBy("uid", "doc_id").agg(
        F.max("n").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("len") > 0, F.struct("at", (F.col("at") + F.col("len")).alias("end"))))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    # Words hit, in order; a run begins where the word before is not hit and ends where the next is not.
    hit_words = F.array_sort(F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["at"], r["end"] - 1)))))
    by_doc = by_doc.withColumn("at", hit_words)
    first = F.filter(F.transform("at", lambda x, i: F.when((i == 0) | (F.get("at", i - 1) != x - 1), x)), lambda x: x.isNotNull())
    last = F.filter(F.transform("at", lambda x, i: F.when((i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1), x)), lambda x: x.isNotNull())
    spans = F.zip_with(first, last, lambda a, b: F.struct(a.alias("at"), (b + 1).alias("end")))
    return by_doc.select("doc_id", "uid", "n_words", spans.alias("spans"), "item_ids")


def _by_broadcast(words: DataFrame, grams: DataFrame, lens: list[int]) -> DataFrame:
    """Hits (doc_id, uid, len, at, n, items), and a row for each document with its number of words."""
    mark = words.sparkSession.range(1).select(
        F.xxhash64(F.lit("document")).alias("h"), F.lit(0).alias("len"),
        F.expr("cast(null as array<string>)").alias("gram"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    # One array a document: a mark that matches once, then the window hashes of each length.
    starts = " , ".join(["array(xxhash64('document'))"] + [_window_hashes(n) for n in lens])
    hashed = words.withColumn("hs", F.expr(f"concat({starts})"))
    flat = hashed.select("doc_id", "uid", "w", F.posexplode_outer("hs").alias("p", "hash"))
    offset, before = "case len", "1"
    for n in lens:
        offset += f" when {n} then p - ({before})"
        before += f" + greatest(size(w) - {n - 1}, 0)"
    offset += " when 0 then 0 end"
    # The condition compares the words themselves; neither it nor the projection holds a lambda,
    # so the explode, the probe and the comparison stay in one generated loop that copies hits only.
    same = (F.col("hash") == F.col("h")) & F.expr(f"len = 0 or slice(w, ({offset}) + 1, len) = gram")
    return flat.join(F.broadcast(grams.unionByName(mark)), same).select(
        "doc_id", "uid", "len", F.expr(offset).alias("at"), F.expr("if(len = 0, size(w), null)").alias("n"), "items"
    )


def _window_hashes(n: int) -> str:
    return f"if(size(w) >= {n}, transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> xxhash64(slice(w, i, {n}))), cast(array() as array<bigint>))"


def _by_shuffle(words: DataFrame, grams: DataFrame, lens: list[int]) -> DataFrame:
    """The same for any number of windows: only (uid, length, place, hash) are shuffled for the search."""
    words = stage(words, work_dir(words.sparkSession, "decontaminate-words"))
    flat = None
    for n in lens:
        own = words.select("uid", F.lit(n).alias("len"), F.posexplode(F.expr(_window_hashes(n))).alias("at", "h"))
        flat = own if flat is None else flat.unionByName(own)
    counts = words.select("doc_id", "uid", F.lit(0).alias("len"), F.lit(0).alias("at"), F.size("w").alias("n"), F.expr("cast(array() as array<string>)").alias("items"))
    if flat is None:
        return counts
    candidates = flat.join(grams, ["h", "len"]).select("uid", "len", "at", "gram", "items")
    # A document has at most as many candidates as windows; its words are read once for them.
    by_doc = candidates.groupBy("uid").agg(F.collect_list(F.struct("len", "at", "gram", "items")).alias("found"))
    confirmed = words.join(by_doc, "uid").select("doc_id", "uid", F.explode(F.expr("filter(found, c -> slice(w, c.at + 1, c.len) = c.gram)")).alias("c"))
    hits = confirmed.select("doc_id", "uid", "c.len", "c.at", F.lit(None).cast("int").alias("n"), "c.items")
    return counts.unionByName(hits)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs, benchmark, window)
    n_hit = F.expr("aggregate(spans, 0L, (s, r) -> s + (r.end - r.at))")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark window, all columns kept."""
    hit = find_hits(docs, benchmark, window, id_col, text_col).where("size(spans) > 0").select("doc_id")
    return without_ids(docs, hit, id_col)
