"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.shipping import ship  # noqa: F401  the operators take these from here
from lacuna.staging import new_path, settled, staged  # noqa: F401

#: The six ASCII white-space characters that separate words.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = "[\\x20\\x09-\\x0D]+"

#: A table of at most this many narrow rows may be broadcast; beyond it operators shuffle.
BROADCAST_ROWS = 200_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the given columns, never null: rows with equal values share them, so
    they identify a row's content where ids may be null or repeated."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return [F.xxhash64(F.lit(1), *parts).alias("_k1"), F.xxhash64(F.lit(2), *parts).alias("_k2")]


def few(df: DataFrame, n: int) -> DataFrame:
    """A table of n rows as the small side of a join."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


#: A filter of at most so many words of 64 bits goes to the tasks, whatever the number of keys.
FILTER_WORDS = 1 << 22


def maybe_in(keys: DataFrame, n: int, key: Column, words: int = FILTER_WORDS) -> Column:
    """Whether the bigint `key` (a hash) may be among the n keys of the one column of `keys`: a Bloom filter of two
    bits a key. No key is missed. About 1 in 60 of the others passes up to words * 4 keys; beyond, ever more do."""
    size = 64
    while size < min(words, n // 4):
        size *= 2

    def places(x: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(k), x), F.lit(64 * size)) for k in (3, 4)]

    def bit(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))

    set_bits = keys.toDF("key").select(F.explode(F.array(*places(F.col("key")))).alias("x"))
    rows = set_bits.select(F.shiftright("x", 6).alias("word"), bit(F.col("x")).alias("bits"))
    rows = rows.unionAll(keys.sparkSession.range(size).select("id", F.lit(0).cast("bigint")))
    rows = rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("filter")).scalar()
    hits = [F.get(found, F.shiftright(x, 6).cast("int")).bitwiseAND(bit(x)) != 0 for x in places(key)]
    return hits[0] & hits[1]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lets the session hand Python batches of about so many bytes (a row at least), however long the texts are; Spark's own bound is
    64 MB, which each task holds in the JVM and again in Python. A bound that the session has set itself stays."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The same for what runs within it."""
    own = spark.conf.get(BATCH_BYTES, None)
    bound_batches(spark)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH_BYTES)


def text_slices(batch: pa.RecordBatch, column: int, chars: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about so many characters at most, null as ''.
    Bounds the Python objects alive at once; a text is never cut."""
    start, held, texts = 0, 0, []
    values = batch.column(column)
    for i in range(batch.num_rows):
        x = values[i].as_py() or ""
        if texts and held + len(x) > chars:
            yield start, texts
            start, held, texts = i, 0, []
        texts.append(x)
        held += len(x)
    if texts:
        yield start, texts
