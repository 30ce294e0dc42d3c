"""Work in proportion to the input: values taken once, small files dealt over tasks, bounded tasks; and what came to light at larger sizes."""

import os
import pickle
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from warraq import aids
from warraq.functions import text
from warraq.operators import match
from warraq.plans.catalog import QUERIES, corpus
from warraq.plans import catalog_more  # noqa: F401  adds its queries
from warraq.schema import PAGES
from warraq.sources import files, headers, text_files
from warraq.store import Library
from warraq.streaming import ingest, listing
from warraq.streaming.ingest import import_stream
from warraq.work import stage

SF = "/root/testdata/sf0.001"


def test_short_utf8_is_no_other_encoding(spark):
    """five Arabic letters in UTF-8 are too few to be a text, and are not read as ten of a code page."""
    raw = [("/in/a.txt", "﻿طهيس.".encode()), ("/in/b.txt", "﻿طهيسطهيس.".encode()), ("/in/c.txt", "طهيسطهيس.".encode("cp1256"))]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in raw], "path string, content binary")
    got = {r.title: (r.text, r.error) for r in files.read_texts(df).collect()}
    assert got == {"a": (None, files.UNREADABLE), "b": ("طهيسطهيس.", None), "c": ("طهيسطهيس.", None)}


def test_bytes_of_an_old_encoding_are_read_as_it(spark):
    """accents of cp1256 are no ISO-8859-6 letters, and a head of plain digits does not make UTF-8 of what is none."""
    head, iso = "1" * 2000, "هو قوي، هي"
    raw = [("a", ("é" * 6 + "ابت").encode("cp1256")), ("b", (head + "ابé").encode("cp1256")), ("c", (head + "ابت").encode() + b"\xff"), ("d", iso.encode("iso-8859-6")), ("e", None)]
    df = spark.createDataFrame([(f"/in/{n}.txt", b and bytearray(b)) for n, b in raw], "path string, content binary")
    got = {r.title: (r.text, r.error) for r in files.read_texts(df).collect()}
    assert got == {"a": (None, files.UNREADABLE), "b": (head + "ابé", None), "c": (head + "ابت\ufffd", None), "d": (iso, None), "e": (None, None)}


def test_header_lines_are_read_once():
    """every field comes from one splitting of the head."""
    assert headers.header(F.col("t"), F.lit("name"))._jc.toString().count("split(") == 1


@pytest.mark.parametrize("name", ["sca_header", "sca_mixed_numbers", "win_page_chain", "sca_marked_text", "sca_facing_pages"])
def test_small_files_are_dealt_over_tasks(spark, name):
    """The customers are one file, whose texts are made and read by many tasks."""
    assert "REPARTITION_BY_NUM" in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_files_are_written_by_many_tasks(spark, monkeypatch):
    """a file a customer, written by as many tasks as shuffles have."""
    seen = []
    monkeypatch.setattr(text_files, "write_text_files", lambda rows, folder: seen.append(rows))
    monkeypatch.setattr(files, "scan", lambda spark, folder: spark.createDataFrame([], "path string, length long, content binary"))
    for name in ("src_scan", "snk_marked_files"):
        QUERIES[name](spark, SF)
    assert len(seen) == 2 and all("REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString() for rows in seen)


def test_places_without_structs(spark):
    """characters are looked at as they are, and empty and missing texts have none or no places."""
    c = text.bare_with_places(F.col("t"))
    assert "struct(" not in c["places"]._jc.toString().split("transform")[-1]
    rows = spark.createDataFrame([("سَ\U0001f600ـا",), ("",), (None,)], "t string").select(c.alias("b")).collect()
    assert [(r.b.text, r.b.places) for r in rows] == [("س\U0001f600ا", [0, 2, 4]), ("", []), (None, None)]


@pytest.mark.parametrize("encoding", files.EIGHT_BIT)
def test_known_characters_are_ranges(encoding):
    """a class of single characters costs a step a character and member."""
    assert files.encode_eight_bit(F.col("t"), encoding)._jc.toString().count("\\x{") <= 2 * 64
    assert files._ranges([1, 2, 3, 7, 9, 10]) == [(1, 3), (7, 7), (9, 10)]


def test_small_files_make_few_batches(spark, tmp_path):
    """a batch is so many bytes, not so many files."""
    folder, calls = tmp_path / "in", []
    folder.mkdir()
    for i in range(1010):
        (folder / f"{i}.txt").write_text("plain text", encoding="utf-8")
    lib = Library(spark, str(tmp_path / "lib"))
    import_stream(spark, str(folder), lib, str(tmp_path / "check"), on_batch=lambda *x: calls.append(x)).awaitTermination()
    assert calls == [(0, 1010, 0)] and lib.pages().count() == 1010


def test_folders_of_a_library_are_few(spark, tmp_path):
    """Two thousand books are one folder, which a compaction leaves alone."""
    pages = spark.range(2000).select(F.col("id").alias("book_id"), F.lit(1).alias("page_num"), F.lit("text").alias("content"))
    lib = Library(spark, str(tmp_path / "few"))
    lib.append(pages.select(*[F.col(f.name).cast(f.dataType) if f.name in pages.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PAGES.fields]))
    assert len(lib.parts()) == 1 and not lib.merges() and lib.compact() == 0
    assert lib.delete_book(7) == 1 and lib.compact() == 1 and lib.pages().count() == 1999


def test_slices_of_postings_are_bounded(spark, tmp_path):
    """A slice is one task's, so their number grows with the pages."""
    lib = Library(spark, str(tmp_path / "slices"))
    assert aids.write(lib, corpus(spark, SF), "a", 256 << 20)["slices"] >= 32


def test_postings_and_counts_of_tokens_are_made_where_pages_are_read(spark, tmp_path, monkeypatch):
    """No task sorts a row for each group or token of the pages it reads, and what is found is the same."""
    data = [(1, 1, " trash\tTrash  a\n"), (1, 2, "قَالَ رسُو​ل قال"), (None, 3, "x trash 😀abc abc"), (0, 3, "x trash"), (-5, None, "trash"), (70, 1, None), (71, 1, ""), (9000, 1, "abcd" * 9)]
    pages = spark.createDataFrame([(b, p, None, c, "t", None, None, None, None, None) for b, p, c in data], PAGES)
    place = F.struct(F.coalesce("book_id", F.lit(0)).alias("o"), "page_num", F.col("match_position").alias("position"), "book_id")
    for rows in (pages, corpus(spark, SF)):
        for size in (1 << 20, 16):  # long pages come in pieces
            monkeypatch.setattr(aids, "GROUP_CHARS", size)
            monkeypatch.setattr(aids, "TOKEN_CHARS", size)
            want = match.tokens(rows).groupBy(F.col("matched_term").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p")).select("token", "n", "p.book_id", "p.page_num", "p.position")
            assert sorted(map(repr, aids.token_counts(rows).collect())) == sorted(map(repr, want.collect()))
    monkeypatch.setattr(aids, "SLICES", 3)
    lib = Library(spark, str(tmp_path / "postings"))
    assert aids.write(lib, pages, "a", 64 << 20) == {"slices": 3}
    clean = F.regexp_replace("content", f"[{aids.HARAKAT}{aids._INVISIBLE}]", "")
    want = pages.select("book_id", "page_num", F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(f"(?=({aids._CHAR}{{3}}))"), 1))).alias("gram"))
    written = spark.read.parquet(str(tmp_path / "postings" / "grams" / "a"))
    got = written.select(F.explode("pages").alias("k"), "gram").select("k.book_id", "k.page_num", "gram").distinct()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    counts = aids.token_counts(pages, lib._bucket(), 5)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Sort") < plan.index("Exchange")  # nothing is sorted where pages are read
    per_bucket = sorted((r.bucket, r.token, r.n) for r in counts.collect())
    assert ("abcd" * 9 in [t for b, t, _ in per_bucket if b == 1]) and (0, "trash", 3) in per_bucket and (-1, "trash", 1) in per_bucket


def test_stored_pages_are_sorted_in_bounded_tasks(spark, tmp_path):
    """However few partitions the session's shuffles have, a task sorts about as many bytes as one is to have."""
    own = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}
    before = {k: spark.conf.get(k, None) for k in own}
    pages, lib = corpus(spark, SF).repartition(8), Library(spark, str(tmp_path / "sorted"))
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        lib.append(pages)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert lib.parts()[0]["files"] > 2
    same = lambda df: sorted(map(repr, df.select("book_id", "page_num", "content").collect()))
    assert same(lib.pages()) == same(pages)


def test_many_candidates_meet_pages_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """past the limit of a broadcast, tasks grow with the pages; missing identifiers are ones like others."""
    data = [(1, 1), (1, 2), (None, 3), (0, 3), (-5, None), (None, None), (0, 0), (70, 1)]
    pages = spark.createDataFrame([(b, p, None, f"{b} {p}", "t", None, None, None, None, None) for b, p in data], PAGES)
    lib = Library(spark, str(tmp_path / "met"))
    lib.append(pages)
    keys = pages.where("content in ('1 2', 'None 3', '-5 None', 'None None', '0 0')").select("book_id", "page_num")
    keys = keys.union(keys).union(spark.createDataFrame([(9, 9)], keys.schema))
    monkeypatch.setattr(aids, "JOIN_BYTES", 1000)
    found = []
    for limit in (100, 0):
        monkeypatch.setattr(aids, "BROADCAST_KEYS", limit)
        found.append(aids.pages_at(lib, keys))
    want, got = (sorted(r.content for r in x.collect()) for x in found)
    assert got == want == sorted(["1 2", "None 3", "-5 None", "None None", "0 0"]) and found[0].columns == found[1].columns
    tasks = aids.tasks_of(sum(p["bytes"] for p in lib.parts()), 1000)
    plan = found[1]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert tasks > 4 and plan.count(f", {tasks}), REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 2


def test_tokens_of_a_large_bucket_are_many_tasks(spark, tmp_path):
    """a bucket of long books is dealt over as many tasks as its bytes take."""
    lib, pages = Library(spark, str(tmp_path / "words")), corpus(spark, SF)
    counts = lambda name: sorted(map(repr, spark.read.parquet(str(tmp_path / "words" / "words" / name)).drop("bucket").collect()))
    files = lambda name: len(list((tmp_path / "words" / "words" / name / "bucket=0").glob("*.parquet")))
    aids.write(lib, pages, "a", 320 << 20)
    aids.write(lib, pages, "b", 320 << 20, 320 << 20)
    assert files("a") <= aids.WORD_FILES < 10 < files("b") and counts("a") == counts("b")


def test_many_small_files_are_few_tasks(spark, tmp_path, monkeypatch):
    """tasks that read files back grow with the cores, not with a file each 4 MB; the driver makes a folder once, not for each file."""
    made, make = [], os.makedirs
    for k in range(2):
        (tmp_path / "w" / str(k) / "0").mkdir(parents=True)
        for i in range(500):
            (tmp_path / "w" / str(k) / "0" / f"{k}-{i}.txt").write_text(f"{i}")
    writer = text_files._Writer(str(tmp_path / "out"))
    monkeypatch.setattr(os, "makedirs", lambda *a, **b: (made.append(a), make(*a, **b)))
    writer.commit([text_files._Written(str(tmp_path / "w" / str(k)), [f"0/{k}-{i}.txt" for i in range(500)]) for k in range(2)])
    monkeypatch.undo()
    assert len([a for a in made if a[0] == str(tmp_path / "out" / "0")]) == 1
    monkeypatch.setattr(files, "SCAN_TASKS", 2)
    back = files.scan(spark, str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and back.count() == 1000
    assert {r.content.decode() for r in back.collect()} == {str(i) for i in range(500)}
    plan = back.select("path", "length")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_known_units_are_looked_up_at_once():
    """op13: Python sees new units only; what is known stays in Arrow."""
    import pyarrow as pa

    from warraq.llm import token_files

    encoder, texts = token_files.Encoder(token_files.default_vocabulary()), pa.array(["some words, some (words).", None, "other words"])
    ids, count = encoder.encode(texts)
    known = encoder.known.to_pylist()
    assert len(set(known)) == len(known) > 3
    again, count_again = encoder.encode(texts)
    assert encoder.known.to_pylist() == known and again.tolist() == ids.tolist() and count_again.tolist() == count.tolist()
    plain = encoder.tokenizer.encode(texts[0].as_py(), add_special_tokens=False).ids
    assert ids[: count[0]].tolist() == plain and count[1] == 0


def test_postings_are_dealt_as_places_in_their_block(spark, tmp_path):
    """past 200 tasks a task that reads pages holds its rows for the shuffle, where a page of an array is 4 bytes; what is written is the same."""
    import pyarrow as pa

    block = pa.array([{"books": 0, "pages": 0}] * 3)
    (out,) = aids._postings(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int32()), block, pa.array(["trash"] * 3)], ["place", "block", "text"])]))
    assert out.column(2).type == pa.list_(pa.int32()) and out.column(2).to_pylist() == [[1, 2, 3]] * 3
    keys = [(b, p) for b in (None, 0, 1, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63), 2**53 + 1) for p in (None, 0, 1, 4095, 4096, -1, -4097, 2**31 - 1, -(2**31))]
    pages = spark.createDataFrame([(b, p, None, "trash", "t", None, None, None, None, None) for b, p in keys], PAGES)
    lib = Library(spark, str(tmp_path / "places"))
    aids.write(lib, pages, "a", 1)
    written = spark.read.parquet(str(tmp_path / "places" / "grams" / "a"))
    got = written.where("gram = 'ras'").select(F.explode("pages").alias("k")).select("k.*").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, keys))


def test_names_of_files_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    """what a task reports of its files does not grow with them, and equal names of two tasks are found all the same."""
    monkeypatch.setattr(text_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: next(number), taskAttemptId=lambda: 0)))
    number, row = iter(range(9)), lambda i: SimpleNamespace(name=f"in/{i}.txt", text="a")
    writer = text_files._Writer(str(tmp_path))
    done = [writer.write(map(row, range(1000))), writer.write(map(row, range(1000, 1010)))]
    assert len(pickle.dumps(done)) < 1000
    writer.commit(done)
    assert len(list(text_files._names(str(tmp_path)))) == 1010 and not list(tmp_path.glob("_*"))
    again = text_files._Writer(str(tmp_path))
    with pytest.raises(ValueError, match="one name"):
        again.commit([again.write(map(row, range(2000, 2010))), again.write(map(row, range(2009, 2020)))])
    assert len(list(text_files._names(str(tmp_path)))) == 1010 and not list(tmp_path.glob("_*"))


def test_paths_of_an_import_stay_out_of_the_driver(spark, tmp_path):
    """Spark's log of the stream names lists, of which each is a batch, and no files; new files are listed once, hidden ones never."""
    folder, lib, check = tmp_path / "in", Library(spark, str(tmp_path / "lib")), tmp_path / "check"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.TXT", "c.txt", "sub/d e%20ع.txt", "_no.txt", ".no.txt", "e.pdf"):
        (folder / name).write_text(f"plain {name.isascii()}", encoding="utf-8")
    run = lambda: import_stream(spark, f"file://{folder}", lib, f"file://{check}", files_per_batch=3).awaitTermination()
    run()
    logged = "".join(p.read_text(encoding="utf-8") for p in (check / "sources" / "0").iterdir() if p.name.isdigit())
    assert logged.count('"path"') == 2 and ".txt" not in logged
    (folder / "sub" / "later.txt").write_text("plain", encoding="utf-8")
    run()
    run()
    assert sorted(r.book_title for r in lib.pages().collect()) == ["a", "b", "c", "d e%20ع", "later"]


def test_a_file_that_goes_before_it_is_read_fails_alone(spark, tmp_path):
    """lists are made before files are read."""
    (tmp_path / "a.txt").write_text("plain", encoding="utf-8")
    listed = spark.createDataFrame([(f"file:{tmp_path}/{n}.txt", 5) for n in "ab"], listing.LISTED)
    got = {r.title: (r.text, r.error) for r in files.read_texts(listing.with_contents(listed)).collect()}
    assert got == {"a": ("plain", None), "b": (None, files.UNREADABLE)}


def test_listed_paths_are_not_broadcast(spark, tmp_path, monkeypatch):
    """a million paths are few bytes of Parquet, and would be 262 MB in the driver."""
    plans = []
    monkeypatch.setattr(listing, "stage", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, path))
    (tmp_path / "lists").mkdir()
    (tmp_path / "a.txt").write_text("plain", encoding="utf-8")
    for _ in range(2):
        listing.list_new(spark, str(tmp_path), f"file://{tmp_path}/lists", 10, 1)
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans)
    assert [r.path for r in spark.read.option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/lists").collect()] == [f"file:{tmp_path}/a.txt"]


def test_an_import_that_goes_on_finds_new_files(spark, tmp_path, monkeypatch):
    """lists are made as long as the stream runs."""
    monkeypatch.setattr(ingest, "COMMIT_SECONDS", 1)
    folder, lib, done = tmp_path / "in", Library(spark, str(tmp_path / "lib")), []
    folder.mkdir()
    query = import_stream(spark, str(folder), lib, str(tmp_path / "check"), once=False, on_batch=lambda *x: done.append(x))
    try:
        for i in range(2):
            (folder / f"{i}.txt").write_text("plain", encoding="utf-8")
            until = time.time() + 60
            while len(done) <= i and time.time() < until and query.isActive:
                time.sleep(0.2)
    finally:
        query.stop()
    assert done == [(0, 1, 0), (1, 1, 0)] and sorted(r.book_title for r in lib.pages().collect()) == ["0", "1"]
