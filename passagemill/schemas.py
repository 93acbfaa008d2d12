"""Row shapes shared by the operators."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("size", T.LongType()),
])

DOCUMENTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("processed_at", T.TimestampType()),
])

EMBEDDING = T.ArrayType(T.FloatType())

# ``hash`` is the hash of the file the chunk was cut from.
STORE = T.StructType(CHUNKS.fields + [T.StructField("hash", T.StringType()), T.StructField("embedding", EMBEDDING)])

REQUEST_BODY = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("k", T.LongType()),
    T.StructField("search_type", T.StringType()),
    T.StructField("fetch_k", T.LongType()),
    T.StructField("lambda_mult", T.DoubleType()),
])

# The counts again, as numbers of any size, to tell what does not fit from what is absent.
REQUEST_NUMBERS = T.StructType([T.StructField("k", T.DoubleType()), T.StructField("fetch_k", T.DoubleType())])

HIT_COLUMNS = [
    "q_id", "rank", "chunk_id", "content", "source",
    "file_name", "file_type", "file_size", "distance",
]
