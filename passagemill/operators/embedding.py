"""Turning text into vectors: built-in hashing, a trained model, or a user function."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.schemas import EMBEDDING
from passagemill.settings import HASH_DIM

# A token is a run of letters and digits of the lower-cased text.
TOKEN = re.compile(r"[^\W_]+")


class _TokenHashes(dict):
    """Hash of each token seen by this worker, forgotten when it grows large."""

    LIMIT = 125_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        digest = hashlib.md5(token.encode("utf-8"), usedforsecurity=False).digest()
        value = self[token] = int.from_bytes(digest[:4], "big")
        return value


_TOKEN_HASHES = _TokenHashes()


def _as_lists(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A (n, dim) block as an Arrow list array; invalid rows become null."""
    n, dim = rows.shape
    offsets = np.arange(0, (n + 1) * dim, dim, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)), mask=pa.array(~valid))


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each text has, and the hashes of all of them in turn."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for position, value in enumerate(texts):
        if value is not None:
            tokens = TOKEN.findall(value.lower())
            sizes[position] = len(tokens)
            hashes.extend(map(_TOKEN_HASHES.__getitem__, tokens))
    return sizes, np.array(hashes, dtype=np.int64)


def term_counts(texts: list[str | None], dim: int = HASH_DIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and count of the entries of ``token_counts`` that are not zero."""
    sizes, hashes = _hashed(texts)
    cells, counts = np.unique(np.repeat(np.arange(len(texts)) * dim, sizes) + hashes % dim, return_counts=True)
    return cells // dim, cells % dim, counts


def token_counts(text: Column, dim: int = HASH_DIM) -> Column:
    """Token counts hashed into ``dim`` buckets, as array<float>."""

    @F.arrow_udf(EMBEDDING)
    def count_batch(texts: pa.Array) -> pa.Array:
        sizes, hashes = _hashed(texts.to_pylist())
        cells = np.repeat(np.arange(len(texts)) * dim, sizes) + hashes % dim
        rows = np.bincount(cells, minlength=len(texts) * dim).astype(np.float32).reshape(len(texts), dim)
        return _as_lists(rows, texts.is_valid().to_numpy(zero_copy_only=False))

    return count_batch(text)


def unit_rows(counts: np.ndarray) -> np.ndarray:
    wide = counts.astype(np.float64)
    length = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return np.divide(wide, length, out=np.zeros_like(wide), where=length > 0).astype(np.float32)


def hash_vector(text: Column, dim: int = HASH_DIM) -> Column:
    """``token_counts`` scaled to unit length; a text without tokens gives zeros."""

    @F.arrow_udf(EMBEDDING)
    def scale_batch(counts: pa.Array) -> pa.Array:
        valid = counts.is_valid().to_numpy(zero_copy_only=False)
        filled = np.zeros((len(counts), dim), dtype=np.float32)
        filled[valid] = counts.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return _as_lists(unit_rows(filled), valid)

    return scale_batch(token_counts(text, dim))


def embed_hash(df: DataFrame, dim: int = HASH_DIM, text_col: str = "content", out_col: str = "embedding") -> DataFrame:
    """Built-in embedder: no model, no network, no shuffle."""
    return df.withColumn(out_col, hash_vector(F.col(text_col), dim))


def sparse_terms(df: DataFrame, id_col: str, dim: int = HASH_DIM, text_col: str = "content") -> DataFrame:
    """The non-zero entries of ``token_counts`` as rows (id, dim, tf)."""
    return (
        df.select(id_col, token_counts(F.col(text_col), dim).alias("counts"))
        .select(id_col, F.posexplode_outer("counts").alias("dim", "tf"))
        .where("tf > 0")
        .select(id_col, F.col("dim").cast("long").alias("dim"), F.col("tf").cast("long").alias("tf"))
    )


def embed(
    df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int,
    text_col: str = "content", out_col: str = "embedding",
) -> DataFrame:
    """Vectors from a user function.

    ``load`` runs once per task and returns the function that turns a list of
    texts into an (n, dim) array, so a model is opened once, not per row.
    """

    @F.arrow_udf(EMBEDDING)
    def embed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for texts in batches:
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            filled = np.zeros((len(texts), dim), dtype=np.float32)
            if valid.any():
                vectors = np.asarray(encode(texts.drop_null().to_pylist()), dtype=np.float32)
                if vectors.shape != (int(valid.sum()), dim):
                    raise ValueError(f"embedding function returned shape {vectors.shape}, expected {(int(valid.sum()), dim)}")
                filled[valid] = vectors
            yield _as_lists(filled, valid)

    return df.withColumn(out_col, embed_batches(F.col(text_col)))


#: Words of a training task at least; below that, averaging tasks' vectors costs more than it saves.
TASK_WORDS = 200_000
#: What a word of the vocabulary takes on the driver without its vectors (its code and path in Spark's tree are 40 numbers
#: each), copies of a vector there, and words that any driver is trusted with.
WORD_BYTES, VECTOR_COPIES, LEAST_WORDS = 512, 4, 2_000_000


def most_words(heap: int, dim: int) -> int:
    """Words of the largest vocabulary that may be trained: beyond it the driver's heap, or Spark's limit of 2^31 numbers, is passed for certain."""
    return min(max(LEAST_WORDS, heap // (WORD_BYTES + VECTOR_COPIES * 4 * dim)), (2**31 - 2) // dim)


def fit_word2vec(
    documents: DataFrame, dim: int = HASH_DIM, text_col: str = "content", min_count: int = 5,
    max_vocabulary: int | None = None, partitions: int | None = None, seed: int = 7, max_iter: int | None = None,
):
    """Train word vectors with Spark ML on words that occur ``min_count`` times or more; others have none.

    Training is spread evenly over as many tasks as there are cores, as long as
    each has ``TASK_WORDS``; then three rounds average what the tasks learn.
    The model keeps its vocabulary on the driver, so its size is counted first
    and one that the driver cannot hold (or beyond ``max_vocabulary``) needs a
    larger driver or a higher ``min_count``.
    """
    words = documents.select(word_list(F.col(text_col)).alias("words"))
    counts = words.select(F.explode("words").alias("w")).groupBy("w").count()
    frequent, total = counts.agg(F.count_if(F.col("count") >= min_count), F.coalesce(F.sum("count"), F.lit(0))).first()
    if max_vocabulary is None:
        max_vocabulary = most_words(documents.sparkSession._jvm.Runtime.getRuntime().maxMemory(), dim)
    if frequent > max_vocabulary:
        raise ValueError(f"{frequent} words occur {min_count} times or more, {max_vocabulary} can be held; give the driver more memory or raise min_count")
    if partitions is None:
        partitions = max(1, min(total // TASK_WORDS, documents.sparkSession.sparkContext.defaultParallelism))
    return Word2Vec(
        vectorSize=dim, minCount=min_count, numPartitions=partitions, seed=seed, maxIter=max_iter or (1 if partitions == 1 else 3),
        inputCol="words", outputCol="vector",
    ).fit(words)


def known_words(documents: DataFrame, model, id_col: str, text_col: str = "content") -> DataFrame:
    """(id, n_words, n_known): a text's words, and those that have a vector; without any, its vector is zero."""
    words = documents.select(id_col, F.explode_outer(word_list(F.col(text_col))).alias("word"))
    known = model.getVectors().select("word", F.lit(1).alias("known"))
    return words.join(known, "word", "left").groupBy(id_col).agg(F.count("word").alias("n_words"), F.count("known").alias("n_known"))


def word_list(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def embed_word2vec(df: DataFrame, model, text_col: str = "content", out_col: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    with_words = df.withColumn("words", word_list(F.col(text_col)))
    return model.transform(with_words).withColumn(out_col, vector_to_array("vector", "float32")).drop("words", "vector")
