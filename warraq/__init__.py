"""warraq: page-level text research over large collections, on Spark DataFrames."""
