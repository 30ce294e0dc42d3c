"""Tables of documents seen as a library: one page a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents_as_pages(documents: DataFrame, nation: DataFrame) -> DataFrame:
    """Page rows: language as category (none for ids ending in 3), years from the identifier, a nation as country.

    The nations are 25 rows by definition, so they are broadcast.
    """
    i = F.col("doc_id")
    year = F.when(i % 10 == 0, "0000").otherwise(F.lpad((1000 + i % 50).cast("string"), 4, "0"))
    names = nation.select((F.col("n_nationkey").cast("long")).alias("__n"), F.col("n_name").alias("country"))
    df = documents.select(
        i.alias("book_id"), F.lit(1).alias("page_num"), F.lit(None).cast("string").alias("original_page_number"), F.col("text").alias("content"),
        F.concat(F.lit("doc-"), i.cast("string")).alias("book_title"), F.col("source").alias("author"), F.when(i % 10 != 3, F.col("lang")).alias("category"),
        year.alias("year"), year.alias("death_year"),
    )
    return df.join(F.broadcast(names), F.col("book_id") % 25 == F.col("__n"), "left").drop("__n")
