"""Extendible hashing into size-limited shards (operator 7, native).

The directory is indexed by the leading bits of a 60-bit hash of the identifier.
Bytes are summed once a fine cell of the directory (map-side partial sums); sums of
the shorter prefixes follow from the cells alone.  A document's shard is the shortest
prefix whose documents fit the limit, so only oversized buckets are split, each on
one more bit, and a split moves no document of any other bucket.  Cells that still
exceed the limit are refined by further bits of their own documents only.

Defined cases: a null or empty text counts no bytes; rows of one identifier have one
hash and stay together; a bucket of a single hash cannot be split and is marked
``oversize`` when it exceeds the limit; a null identifier hashes as the empty string;
an empty table gives an empty result; of a very long text only its length counts, and
one over the limit is an oversize shard; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stage, work_dir

BITS = 60
LIMIT_BYTES = 32 << 20


def hash_bits(key: Column) -> Column:
    """60 bits of the MD5 of the identifier's decimal text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def assign(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, shard (prefix bits), depth, shard_bytes, shard_docs, oversize."""
    work = work_dir(docs.sparkSession, "sharding")
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", hash_bits(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")
    )
    rows = stage(rows, f"{work}/rows")
    total = int(rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"])
    depth, low, active, out = min(BITS, 3 + math.ceil(math.log2(1 + total / limit_bytes))), 0, rows, None
    while True:
        cell = F.shiftright("h", BITS - depth)
        cells = active.groupBy(cell.alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        cells = stage(cells, f"{work}/cells-{depth}")
        # Each cell under each of its prefixes; a prefix is good when it fits or cannot be split.
        paths = cells.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
        nodes = paths.groupBy("d", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ).where((F.col("shard_bytes") <= limit_bytes) | (F.col("lo") == F.col("hi")))
        good = paths.select("cell", "d", "prefix").join(nodes.drop("lo", "hi"), ["d", "prefix"])
        directory = good.groupBy("cell").agg(F.min(F.struct("d", "prefix", "shard_bytes", "shard_docs")).alias("leaf"))
        directory = stage(directory.select("cell", "leaf.*"), f"{work}/directory-{depth}")
        found = active.join(directory, cell == F.col("cell")).select(
            "doc_id", F.when(F.col("d") == 0, "").otherwise(F.expr("lpad(bin(prefix), d, '0')")).alias("shard"),
            F.col("d").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit_bytes).alias("oversize"),
        )
        out = found if out is None else out.unionByName(found)
        over = cells.join(directory, "cell", "left_anti").select("cell")
        if depth == BITS or over.isEmpty():
            return out
        active = active.join(over, cell == F.col("cell"), "left_semi")
        low, depth = depth + 1, min(BITS, depth + 4)
