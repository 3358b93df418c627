"""Pieces shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.session import ensure_checkpoint_dir

#: White space that separates words everywhere in this package (blank, tab .. carriage return).
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(c: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def one_space(c: str | Column) -> Column:
    """The text with each run of white space as one blank."""
    return F.regexp_replace(text_of(c), WS, " ")


def n_words(c: str | Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and read on from there, so
    that it is computed once and survives the loss of any executor.

    A written table also starts with the size of its files.  ``checkpoint()`` hands on
    estimated sizes, which loops of joins multiply until planning them dominates."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


SLOTS = 1 << 23  # bits that tell where to look for wanted rows


def marked(rows: DataFrame, wanted: DataFrame, *cols: str, slots: int = SLOTS) -> DataFrame:
    """The rows whose ``cols`` have their bit set by a row of ``wanted``: all that are there, and few others.
    The bits are ``slots`` in all whatever the input, a row of 4 KiB for each 2^15."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(slots))
    bits = wanted.select(slot.alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("_k")).where(
        F.call_function("getbit", byte, at.bitwiseAND(F.lit(7))) == 1).drop("_k", "_bits")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get at most ``rows`` texts at a time, to bound their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) <= 0 or int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most ``rows`` rows at a time in jobs started inside; then the
    caller's setting holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
