"""Stored fingerprints of a snapshot and their check.

A manifest has one row per fact: the schema's hash, the content's fingerprint, and per file a hash
tree.  Files are hashed in chunks, spread over tasks and read as streams, so a file's size does not
matter; a file's hash is that of its chunks' hashes in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.hashing import portable_fingerprint, schema_fingerprint

CHUNK_BYTES = 64 << 20
READ_BYTES = 1 << 20


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            uri = row["path"]
            store, path = fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
            digest = hashlib.sha256()
            with store.open_input_file(path) as f:
                f.seek(row["begin"])
                left = row["size"]
                while left:
                    got = f.read(min(left, READ_BYTES))
                    if not got:
                        raise EOFError(f"{uri} ended early")
                    digest.update(got)
                    left -= len(got)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "begin": batch.column("begin"), "sha256": pa.array(out, pa.string())})


def file_hashes(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, glob: str = "*.parquet") -> DataFrame:
    """Q13: ``file, length, sha256`` of every data file below ``path``; the hash is that of the
    chunks' hexadecimal hashes joined by line breaks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    begins = F.expr(f"transform(sequence(0L, greatest(length - 1, 0L) div {int(chunk_bytes)}), k -> k * {int(chunk_bytes)}L)")
    chunks = files.select("path", "length", F.explode(begins).alias("begin"))
    chunks = chunks.withColumn("size", F.least(F.lit(int(chunk_bytes)).cast("long"), F.col("length") - F.col("begin")))
    chunks = chunks.repartition("path", "begin")
    done = chunks.select("path", "begin", "size").mapInArrow(_hash_chunks, "path string, begin long, sha256 string")
    tree = done.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("begin", "sha256"))).alias("t"))
    return tree.join(files, "path").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length",
                                           F.sha2(F.array_join(F.col("t.sha256"), "\n"), 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``kind, name, value``: schema hash, content fingerprint and file hashes of a Parquet snapshot."""
    data = spark.read.parquet(path)
    schema = spark.createDataFrame([("schema", "", schema_fingerprint(data.schema))], "kind string, name string, value string")
    content = portable_fingerprint(data).select(F.lit("content").alias("kind"), F.lit("").alias("name"),
                                                F.concat_ws(":", F.col("n_rows").cast("string"), "sum_sha").alias("value"))
    files = file_hashes(spark, path).select(F.lit("file").alias("kind"), F.col("file").alias("name"), F.col("sha256").alias("value"))
    return schema.unionByName(content).unionByName(files)


def write_manifest(spark: SparkSession, path: str, manifest_path: str) -> None:
    manifest(spark, path).write.parquet(manifest_path)


def compare_manifest(spark: SparkSession, path: str, manifest_path: str) -> DataFrame:
    """Facts that differ: ``kind, name, stored, actual``; a missing side is null."""
    stored = spark.read.parquet(manifest_path).withColumnRenamed("value", "stored")
    both = stored.join(manifest(spark, path).withColumnRenamed("value", "actual"), ["kind", "name"], "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("actual")))


def verify_feature_set(spark: SparkSession, path: str, manifest_path: str, entity_key: str, strict: bool = True) -> list[str]:
    """Q8: the key is there and the schema is the stored one, else an error; if ``strict``, files
    must be the stored ones too, and a different content is returned as a warning."""
    data = spark.read.parquet(path)
    if entity_key not in data.columns:
        raise ValueError(f"entity key {entity_key!r} missing in {path}")
    stored = [r["value"] for r in spark.read.parquet(manifest_path).where("kind = 'schema'").collect()]
    if stored != [schema_fingerprint(data.schema)]:
        raise ValueError(f"schema hash of {path} differs from the manifest")
    if not strict:
        return []
    differs = {r["kind"]: r["count"] for r in compare_manifest(spark, path, manifest_path).groupBy("kind").count().collect()}
    if differs.get("file"):
        raise ValueError(f"{differs['file']} files of {path} differ from the manifest")
    return ["content fingerprint differs from the manifest"] if differs.get("content") else []

