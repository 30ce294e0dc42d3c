"""The operators as driver queries, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, work_dir

Query = Callable[[SparkSession, str], DataFrame]


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import find_copies

    found = find_copies(table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(table(spark, sf_dir, "documents"))[0]


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_components

    return near_components(table(spark, sf_dir, "documents"), k=2, percent=80)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_windows, read_back

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_windows(rows.unionByName(extra)), in_order=True)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents"))


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator at a limit that splits small tables, several bits deep."""
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents"), limit_bytes=1 << 16)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fold, learn, predict

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold() != 2))
    found = predict(docs, model)
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import longest, periodic_runs, runs_sha256, with_planted_runs

    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", longest(F.col("runs")))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", milli.alias("exponent_milli"), runs_sha256(F.col("runs")).alias("runs_sha256"), "collapsed_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_documents, write_token_files

    path = f"{work_dir(spark, 'token-files')}/shards"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_lm_score": op1_lm_score,
    "op2_decontamination": op2_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_secret_scan": op6_secret_scan,
    "op7_sharding": op7_sharding,
    "sharding_small_limit": sharding_small_limit,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_files": op13_token_files,
    "pipeline": pipeline,
}

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""



def _shards(limit: int) -> str:
    return f"""
        WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
                          coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
        p AS (SELECT doc_id, h, bytes, k, h >> (60 - k) AS prefix FROM d, unnest(generate_series(0, 60)) AS s(k)),
        n AS (SELECT k, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) AS lo, max(h) AS hi FROM p GROUP BY 1, 2),
        leaf AS (SELECT p.doc_id, min(k) AS depth FROM p JOIN n USING (k, prefix)
                 WHERE shard_bytes <= {limit} OR lo = hi GROUP BY 1)
        SELECT p.doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p.prefix), depth::INT, '0') END AS shard, depth::INT AS depth,
               shard_bytes, shard_docs, shard_bytes > {limit} AS oversize
        FROM leaf JOIN p ON p.doc_id = leaf.doc_id AND p.k = leaf.depth JOIN n ON n.k = p.k AND n.prefix = p.prefix"""


SQL: dict[str, str] = {
    "op2_decontamination": f"""
        WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        gram AS (SELECT DISTINCT item_id, w[i:i + 9] AS g FROM bw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT len(g) AS n FROM gram),
        win AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM dw, lens, unnest(generate_series(1, len(w) - n + 1)) AS s(i)),
        hit AS (SELECT doc_id, i, n, item_id FROM win JOIN gram USING (g)),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""",
    # All pairs of documents that share a shingle, then everything reachable over the links.
    "op3_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
        u AS (SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM u AS a JOIN u AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT b, root FROM reach JOIN edge ON a = id)
        SELECT id AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id, id = min(root) AS kept FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id""",
    # Texts in hexadecimal digits, two a byte; every window of 400 bytes is counted.
    "op4_substring_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(list_transform(range(0, n), lambda i: md5_number(substr(h, 2 * i + 1, 800)))) AS k
              FROM (SELECT *, greatest(length(h) // 2 - 399, 0) AS n FROM d)),
        r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
        f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM f),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, span),
        t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
        c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
              FROM t JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)""",
    "op7_sharding": _shards(32 << 20),
    "sharding_small_limit": _shards(1 << 16),
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
