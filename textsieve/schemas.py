"""Fixed schemas of the engine's tables."""

from pyspark.sql import types as T

CORPUS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("absolute_path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ms", T.DoubleType()),
        T.StructField("tracked", T.BooleanType()),
    ]
)
#: One row of a search's result; offsets count code points, lines and columns start at 1.
MATCH = "path string, start long, line long, column long, end_line long, end_column long, match string, context_before array<string>, context_line string, context_after array<string>"
POSTINGS = "term_hash long, docs array<long>"
CHANGES = "path string, change string, content_hash string"
