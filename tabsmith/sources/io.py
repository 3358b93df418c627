"""Scans and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "arrow")
CODECS = ("snappy", "gzip", "lz4", "zstd", "none", "brotli")

INFERENCE_WRITERS = 8  # files that a task of the inference sink keeps open; rows of further partitions are sorted

# pandas' default missing-value tokens for CSV input, plus the
# empty string; any of them reads as null.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]


def read_data(spark: SparkSession, fmt: str, path: str, schema: T.StructType | None = None,
              null_tokens: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """One entry point for the four formats; an explicit schema avoids inference."""
    fmt = fmt.lower()
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    if fmt == "csv":
        return read_csv(spark, path, schema, null_tokens)
    if fmt == "json":
        # JSON lines by default (splittable); multiLine for one document per file
        reader = spark.read.option("multiLine", multiline)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.json(path)
    if fmt == "arrow":
        return read_arrow_ipc(spark, path, schema)
    raise ValueError(f"unknown format {fmt!r}; expected one of {FORMATS}")


def apply_null_tokens(df: DataFrame, cols: list[str] | None = None,
                      tokens: list[str] | None = None) -> DataFrame:
    """Map CSV null tokens to null on string columns (one projection)."""
    tokens = NULL_TOKENS if tokens is None else tokens
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(cols) if cols is not None else string_cols
    return df.select(*[
        F.when(F.col(f"`{c}`").isin(tokens), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
        if c in targets and c in string_cols else F.col(f"`{c}`")
        for c in df.columns
    ])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             null_tokens: list[str] | None = None, splittable: bool = False) -> DataFrame:
    """CSV with header; every field read as text, null tokens mapped, then cast.

    Quoted fields may hold line breaks and doubled quotes, so a file is read by one
    task; ``splittable`` is for files known to have no line breaks in fields.

    Spark's ``nullValue`` takes a single token, so tokens are applied as one
    projection before the typed cast (ANSI casts raise on bad input).
    """
    raw = spark.read.options(header=True, inferSchema=False, multiLine=not splittable, quote='"', escape='"').csv(path)
    raw = apply_null_tokens(raw, tokens=null_tokens)
    if schema is None:
        return raw
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def read_arrow_ipc(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Arrow IPC / Feather files: list the files, then decode each inside a task.

    Only paths are listed (``binaryFile`` prunes the content column), so file
    bytes never pass through the driver.
    """
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("path")
    if schema is None:
        first = files.first()
        if first is None:
            raise FileNotFoundError(path)
        schema = _arrow_schema_to_spark(_open_ipc(first["path"]).schema)
    spark_schema = schema
    names = [f.name for f in spark_schema.fields]

    def decode(batches):
        # self-contained: executors need only pyarrow, not this package
        import pyarrow.fs as pafs
        import pyarrow.ipc as ipc

        for batch in batches:
            for p in batch.column("path").to_pylist():
                uri = p.replace("s3a://", "s3://", 1) if "://" in p else "file://" + p.replace("file:", "", 1)
                fs, local = pafs.FileSystem.from_uri(uri)
                reader = ipc.open_file(fs.open_input_file(local))
                for i in range(reader.num_record_batches):
                    rb = reader.get_batch(i)
                    yield pa.RecordBatch.from_arrays([rb.column(rb.schema.get_field_index(n)) for n in names],
                                                     names=names)

    return files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(decode, spark_schema)


def _open_ipc(uri: str):
    import pyarrow.fs as pafs
    import pyarrow.ipc as ipc

    fs, p = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.replace("file:", "", 1))
    return ipc.open_file(fs.open_input_file(p))


def _arrow_schema_to_spark(schema) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def write_arrow_ipc(df: DataFrame, path: str) -> DataFrame:
    """Write each partition as one Arrow IPC file under ``path`` (shared storage).

    Returns a DataFrame of the written file paths (one row per partition);
    the write happens inside the tasks, when that DataFrame is computed.
    """
    import pyarrow as pa

    def write(batches):
        # one file per partition, named by partition id and published by an
        # atomic rename: a retried or speculative attempt rewrites the same
        # file instead of adding a duplicate ("_" files are hidden from readers)
        import pyarrow.fs as pafs
        import pyarrow.ipc as ipc
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid, attempt = ctx.partitionId(), ctx.attemptNumber()
        uri = path.replace("s3a://", "s3://", 1) if "://" in path else "file://" + path.replace("file:", "", 1)
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        target = f"{root}/part-{pid:05d}.arrow"
        tmp = f"{root}/_tmp-{pid:05d}-{attempt}.arrow"
        it = iter(batches)
        first = next(it, None)
        if first is None:
            return
        with fs.open_output_stream(tmp) as sink:
            writer = ipc.new_file(sink, first.schema)
            writer.write_batch(first)
            for b in it:
                writer.write_batch(b)
            writer.close()
        fs.move(tmp, target)
        yield pa.RecordBatch.from_pylist([{"path": target}])

    return df.mapInArrow(write, "path string")


def save_data(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists",
              partition_by: list[str] | None = None) -> None:
    """Parquet sink with a validated codec."""
    codec = compression.lower()
    if codec not in CODECS:
        raise ValueError(f"unknown codec {compression!r}")
    if codec == "brotli":
        raise ValueError("brotli has no bundled Parquet codec in Spark; choose another")
    writer = df.write.mode(mode).option("compression", "uncompressed" if codec == "none" else codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S13 CSV sink (distributed: one file per partition); quotes in fields are doubled."""
    df.write.mode(mode).options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                ignoreTrailingWhiteSpace=False).csv(path)


def snapshot_path(store: str, name: str, version: str, snapshot_id: str) -> str:
    return os.path.join(store, name, version, snapshot_id)


def persist_feature_snapshot(df: DataFrame, store: str, name: str, version: str,
                             snapshot_id: str, bucket_by: str | None = None,
                             n_buckets: int | None = None) -> str:
    """Immutable snapshot; writing over an existing one is an error.

    With ``bucket_by`` the rows are hash-partitioned by the entity key and
    sorted within files before the write: row groups then carry tight min/max
    statistics on the key (pruning) and compress better.  This is not a Spark
    bucket spec (that needs a catalog table), so assembly joins still shuffle.
    """
    path = os.path.join(snapshot_path(store, name, version, snapshot_id), "features.parquet")
    out = df
    if bucket_by:
        n = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = df.repartition(n, bucket_by).sortWithinPartitions(bucket_by)
    out.write.mode("errorifexists").parquet(path)
    return path


def save_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One write partitioned by split; the committer makes it atomic."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def save_inference(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """L5 sink: one write partitioned by run and stage.

    Hashes and ids as hex are most of a row; zstd brings them to about half, snappy leaves them as they
    are.  Files of a task's partitions are open side by side: else Spark sorts all rows of a task by
    partition first, and spills what does not fit in memory."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(max(INFERENCE_WRITERS, int(before))))
    try:
        df.write.mode(mode).option("compression", "zstd").partitionBy("run_id", "model_stage").parquet(path)
    finally:
        conf.set(name, before)


def save_metrics_csv(df: DataFrame, path: str) -> None:
    """Report table as a folder of CSV files, each with a header, one per partition."""
    save_csv(df, path, "overwrite")


def schema_table(spark: SparkSession, df: DataFrame, entity_key: str | None = None,
                 roles: dict[str, str] | None = None, source_operator: dict[str, str] | None = None) -> DataFrame:
    """(feature, dtype, role[, source_operator, materialized]) from metadata only."""
    rows = []
    for f in df.schema.fields:
        if f.name == entity_key:
            continue
        role = (roles or {}).get(f.name)
        if source_operator is None:
            rows.append((f.name, f.dataType.simpleString(), role))
        elif f.name in source_operator:
            rows.append((f.name, f.dataType.simpleString(), role, source_operator[f.name], True))
    if source_operator is None:
        return spark.createDataFrame(rows, "feature string, dtype string, role string")
    return spark.createDataFrame(
        rows, "feature string, dtype string, role string, source_operator string, materialized boolean")


def load_predictions(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """One stage of an inference run; partition pruning on ``model_stage``."""
    return spark.read.parquet(path).where(F.col("model_stage") == stage)


def table_profile(df: DataFrame) -> DataFrame:
    """Row count, column count, content fingerprint and logical bytes in one pass."""
    from tabsmith.functions.hashing import fingerprint_exprs
    from tabsmith.operators.profile import logical_bytes_expr

    return df.agg(*fingerprint_exprs(df), logical_bytes_expr(df).alias("logical_bytes")) \
        .withColumn("n_columns", F.lit(len(df.columns)))
