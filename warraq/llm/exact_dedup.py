"""Exact deduplication by a stateful stream (operator 10).

A Structured Streaming aggregation keeps one entry a digest in RocksDB state on
disk, snapshotted to the shared folder, without watermark or expiry.  An entry
holds the stable identifier of the row that stays, the locator of that row's
content and the number of rows seen.  Rows of one digest meet in map-side partial
aggregates first, so a group that holds a third of all rows costs a few state
updates.  Digest hits are then checked on their full bytes; a digest shared by
different texts is resolved by the texts themselves.

Defined cases: a null text counts as empty, and all empty texts are one group;
null identifiers sort below all others; among repeated rows with the same
identifier and text exactly one has ``kept``; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, stage, without_ids, work_dir

#: Hit digests (32 bytes each) up to this number are broadcast to filter the byte check;
#: beyond it every text goes through the check's partial aggregates.
BROADCAST_HITS = 400_000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Ship changelogs and close each store after its commit: a task's disk and memory
    # do not add up over the state partitions an executor has served.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def run_stream(spark: SparkSession, keys_path: str, state_dir: str, max_bytes_per_trigger: str | None = None) -> DataFrame:
    """Feed the key table through the keyed state; returns the state, one row a digest.

    Run again with the same ``state_dir`` after files were added, only new files are read and
    meet the state that is there.
    """
    own = spark.newSession()  # the stream's settings are those of a session of its own
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for k, v in _STATE.items():
        own.conf.set(k, v)
    reader = own.readStream.schema("doc_id long, digest binary, locator long")
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    groups = reader.parquet(keys_path).groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    state = own.read.format("statestore").load(state_dir)
    value = [f.name for f in state.schema["value"].dataType.fields]
    found = state.select(
        F.col("key.digest").alias("digest"), F.col("value")[value[0]]["doc_id"].alias("keep_id"),
        F.col("value")[value[0]]["locator"].alias("keep_locator"), F.col("value")[value[1]].alias("group_size"),
    )
    written = stage(found, state_dir + "-groups")
    return spark.read.schema(written.schema).parquet(state_dir + "-groups")


def find_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    max_bytes_per_trigger: str | None = None,
) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, digest (binary)."""
    spark = docs.sparkSession
    work = work_dir(spark, "exact-dedup")
    rows = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    keys = stage(rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("locator")), f"{work}/keys")
    groups = run_stream(spark, f"{work}/keys", f"{work}/state", max_bytes_per_trigger)

    # Full bytes: all texts of a digest are equal exactly when the smallest and the largest are.
    hits = groups.where("group_size > 1").select("digest")
    n_hits = hits.count()
    checked = rows.select("digest", "text")
    if n_hits <= BROADCAST_HITS:
        checked = checked.join(F.broadcast(hits), "digest", "left_semi")
    unequal = (
        checked.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        .where("lo <> hi").select("digest")
    )
    unequal = stage(unequal, f"{work}/unequal")
    out = keys.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))).alias("kept"),
        "digest",
    )
    if unequal.isEmpty():
        return out
    # Digests that different texts share: groups by the text itself.
    apart = rows.join(unequal, "digest", "left_semi").withColumn("locator", F.monotonically_increasing_id())
    apart = stage(apart, f"{work}/apart")
    exact = apart.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    apart = apart.join(exact, ["digest", "text"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest",
    )
    return out.join(unequal, "digest", "left_anti").select(*apart.columns).unionByName(apart)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without copies, all columns kept; the row with the largest identifier stays.

    Of repeated rows (same identifier and same text) one stays.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "exact-drop")
    marks = stage(find_copies(docs, id_col, text_col).select("doc_id", "keep_id", "kept"), f"{work}/marks")
    gone = marks.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id")
    # An identifier can be on several rows; those are settled by identifier and text below.
    repeated = stage(marks.groupBy("doc_id").count().where("count > 1").select("doc_id"), f"{work}/repeated")
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if repeated.isEmpty():
        return without_ids(docs, gone, id_col)
    many = repeated.withColumnRenamed("doc_id", "__w_id")
    single = without_ids(docs, gone.unionByName(repeated), id_col)
    rest = docs.join(many, key.eqNullSafe(F.col("__w_id")), "left_semi").withColumns(
        {"__w_text": text, "__w_digest": F.sha2(text.cast("binary"), 256)}
    )
    tagged = stage(rest.withColumn("__w_loc", F.monotonically_increasing_id()), f"{work}/rest")
    # The largest identifier of each of their texts; a digest picks the rows, the text itself decides.
    asked = tagged.select(F.col("__w_digest").alias("__w_asked")).distinct()
    same = docs.select(key.alias("__w_keep"), text.alias("__w_text"), F.sha2(text.cast("binary"), 256).alias("__w_digest"))
    same = same.join(asked, F.col("__w_digest") == F.col("__w_asked"), "left_semi")
    best = same.groupBy("__w_digest", "__w_text").agg(F.max("__w_keep").alias("__w_keep"))
    pick = tagged.groupBy("__w_digest", "__w_text", key.alias("__w_id")).agg(F.min("__w_loc").alias("__w_first"))
    pick = pick.join(best, ["__w_digest", "__w_text"]).where(F.col("__w_id").eqNullSafe(F.col("__w_keep"))).select("__w_first")
    rest = tagged.join(pick, F.col("__w_loc") == F.col("__w_first"), "left_semi")
    return single.unionByName(rest.drop("__w_text", "__w_digest", "__w_loc"))
