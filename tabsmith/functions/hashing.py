"""Row keys and fingerprints (X10 base, X12, X14).

SHA-256 over a canonical text form is used where the value must be portable
between engines (a row id written today must be re-derivable tomorrow, in
Spark or in SQL).  ``xxhash64`` is used only where the value never leaves
Spark (bucketing, order-free table checksums).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)


def _text(df: DataFrame, c: str, null_token: str, float_format: str | None) -> Column:
    return F.coalesce(_raw_text(df, c, float_format), F.lit(null_token))


def _raw_text(df: DataFrame, c: str, float_format: str | None = None) -> Column:
    """The column as text, null where it is null."""
    dtype = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if float_format and isinstance(dtype, _FLOATS):
        return F.when(col.isNotNull(), F.format_string(float_format, col.cast("double")))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        # microseconds only where there are some, so whole seconds keep their short form
        fine = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.regexp_replace(fine, r"\.000000$", "")
    return col.cast("string")


_TAGS = ((T.BooleanType, "b"), (T.IntegralType, "i"), (T.FractionalType, "f"), (T.StringType, "s"),
         (T.DateType, "t"), (T.TimestampType, "t"), (T.TimestampNTZType, "t"))


def row_text(df: DataFrame, cols: list[str] | None = None) -> Column:
    """A row as text that no other row has: per field its kind, the length of its text and the
    text (``s3:abc``), a null as kind and ``-``.  Doubles take their shortest exact form."""
    parts = []
    for c in cols or df.columns:
        tag = next((t for kind, t in _TAGS if isinstance(df.schema[c].dataType, kind)), "x")
        text = _raw_text(df, c)
        # null as a whole for a null, so the text is made once
        known = F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(known, F.lit(f"{tag}-")))
    return F.concat(*parts)


def row_key_hash(df: DataFrame, cols: list[str], sep: str = "-", null_token: str = "nan") -> Column:
    """X10 base: SHA-256 of the key columns' text joined by ``sep``."""
    return F.sha2(F.concat_ws(sep, *[_text(df, c, null_token, None) for c in cols]), 256)


def input_row_hash(df: DataFrame, exclude: list[str] | tuple = (), float_format: str = "%.9e") -> Column:
    """SHA-256 of all columns (sorted by name), null -> ``NULL``, ``|``-joined.

    Floats use a fixed scientific format so the text does not depend on the
    engine's shortest-repr rules.
    """
    cols = sorted(c for c in df.columns if c not in set(exclude))
    return F.sha2(F.concat_ws("|", *[_text(df, c, "NULL", float_format) for c in cols]), 256)


def hash_unit_interval(key: Column, seed: int | str = 42) -> Column:
    """Portable uniform number in [0, 1) from SHA-256 of ``key:seed`` (60 bits)."""
    h = F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long").cast("double") / F.lit(float(2 ** 60))


def fingerprint_exprs(df: DataFrame) -> list[Column]:
    """X14 aggregate expressions, order-free: row count plus two mergeable
    reductions of per-row hashes (independent of partitioning and row order)."""
    # xxhash64 passes over nulls, so their places are hashed too
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    row_hash = F.xxhash64(nulls, *[F.col(f"`{c}`") for c in df.columns])
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(row_hash).alias("xor_hash"),
        F.sum(row_hash.cast("decimal(38,0)")).cast("string").alias("sum_hash"),
    ]


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """X14, reproducible outside Spark: row count and the sum of the first 60
    bits of each row's SHA-256 (:func:`row_text`, which tells any two rows of a table apart), as a
    decimal string.  Order-free and mergeable."""
    h = F.conv(F.substring(F.sha2(row_text(df), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("sum_sha"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """X14 as a one-row table (one aggregate pass)."""
    return df.agg(*fingerprint_exprs(df))


def schema_fingerprint(schema: T.StructType) -> str:
    """SHA-256 of (name, type) pairs; computed on the driver from metadata only."""
    import hashlib
    text = "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)
    return hashlib.sha256(text.encode()).hexdigest()
