"""OCR of PDF files through an injected engine, and its event stream.

No engine comes with the library: ``recognize`` takes any callable from PDF bytes and
a page range to text, runs it on chunks of pages with retries, and drops chunks that
keep failing, with their number reported.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_PAGES, RETRIES, BACKOFF = 950, 3, (2, 4)
EVENT = "event string, file string, index int, total int, pages int, elapsed double, message string, output string, ok int, failed int, fraction double, txt string, error string, fail int"


def chunks(pages: int, size: int = CHUNK_PAGES) -> list[tuple[int, int]]:
    return [(a, min(a + size, pages)) for a in range(0, pages, size)]


def recognize(files: DataFrame, count_pages: Callable[[bytes], int], engine: Callable[[bytes, int, int], str], wait=time.sleep) -> DataFrame:
    """path, output (the name of the text), text, chunks, failed."""

    def one(data: bytes) -> tuple[str, int, int]:
        texts, failed, parts = [], 0, chunks(count_pages(data))
        for a, b in parts:
            for attempt in range(RETRIES):
                try:
                    texts.append(engine(data, a, b))
                    break
                except Exception:
                    if attempt == RETRIES - 1:
                        failed += 1
                    else:
                        wait(BACKOFF[attempt])
        return "\n".join(texts), len(parts), failed

    def run(batches):
        for batch in batches:
            rows = [one(x) for x in batch["content"]]
            yield pd.DataFrame({
                "path": batch["path"], "output": [p.rsplit("/", 1)[-1].rsplit(".", 1)[0] + "_ocr.txt" for p in batch["path"]],
                "text": [r[0] for r in rows], "chunks": [r[1] for r in rows], "failed": [r[2] for r in rows],
            })

    return files.select("path", "content").mapInPandas(run, "path string, output string, text string, chunks int, failed int")


def parse_events(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of JSON lines; other lines go, missing numbers are 0; ``keep`` columns of the lines stay."""
    text = F.trim(F.col(value))
    df = lines.where(text.startswith("{") & text.endswith("}")).select(F.from_json(text, EVENT).alias("e"), *keep).where("e.event is not null").select("e.*", *keep)
    return df.fillna(0, ["index", "total", "pages", "elapsed", "ok", "failed", "fraction", "fail"])


def flat_json(text: Column, *keys: str) -> list[Column]:
    """Top-level scalar values of a JSON object; nested ones are null."""
    out = []
    for k in keys:
        v = F.get_json_object(text, f"$.{k}")
        out.append(F.when(~v.rlike(r"^\s*[\[{]"), v).alias(k))
    return out


# -- the state of each file, from events as they come ------------------------------

# Events of a file.
_OF_FILE = ("start", "progress", "done", "error")


def file_states(events: DataFrame) -> DataFrame:
    """One row a file: state (running, done or failed), fraction, message, pages, txt, error, starts, failures, last_seq.

    events: those of ``parse_events`` with ``seq``, the number of the line in the whole log.  Each value is the
    one of the greatest number, so events may come in any order, an end before what led to it; a file that
    starts again after its end is running, and ``starts`` counts that.  The same on a table and on a
    stream, whose state is one row a file.
    """
    e = F.col("event")
    known = events.where(e.isin(*_OF_FILE) & F.col("file").isNotNull())

    def last(of: Column, *values: str) -> Column:
        """The values of the event of a kind with the greatest number."""
        return F.max(F.when(of, F.struct("seq", *values)))

    found = known.groupBy("file").agg(
        last(e.isNotNull(), "event", "message").alias("l"), last(e == "progress", "fraction", "message").alias("p"), last(e == "done", "txt", "pages").alias("d"),
        last(e == "error", "error").alias("x"), F.count_if(e == "start").alias("starts"), F.count_if(e == "error").alias("failures"),
    )
    state = F.when(F.col("l.event") == "done", "done").when(F.col("l.event") == "error", "failed").otherwise("running")
    return found.select(
        "file", state.alias("state"), F.when(F.col("l.event") == "done", 1.0).otherwise(F.coalesce("p.fraction", F.lit(0.0))).alias("fraction"), F.col("p.message").alias("message"),
        "d.pages", "d.txt", "x.error", "starts", "failures", F.col("l.seq").alias("last_seq"),
    )


def follow_events(lines: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Keep the states of files under ``path`` as lines (seq, value) come; a batch writes the files that it changed.

    A batch that runs again after a crash writes the same folder again.
    """
    states = file_states(parse_events(lines, keep=("seq",)))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    writer = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def followed(spark, path: str) -> DataFrame:
    """The newest state of each file that ``follow_events`` has written."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("file").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("file", "batch")]), "batch").alias("s"))
    return newest.select("file", "s.*")
