"""Lineage: digests of files, the logged way to the hold-out, guarded paths."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.sources.files import append_lines

ENTRY = "path string, sha256 string, bytes bigint, endpoint string, params map<string,string>, fetched_at string"


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, sha256, bytes`` of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def record(spark: SparkSession, folder: str, manifest: str, endpoint: str, params: dict[str, str] | None = None) -> None:
    """Append the digests of a folder's files to a manifest (JSON lines)."""
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    pairs = [x for k, v in (params or {}).items() for x in (F.lit(k), F.lit(v))]
    rows = digests(spark, folder).select("*", F.lit(endpoint).alias("endpoint"), F.create_map(*pairs).cast("map<string,string>").alias("params"), F.lit(now).alias("fetched_at"))
    rows.write.mode("append").json(manifest)


def latest(entries: DataFrame) -> DataFrame:
    """The latest entry of each path; of equal times the later in order of ``seq``."""
    order = Window.partitionBy("path").orderBy(F.desc("fetched_at"), F.desc("seq"))
    return entries.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def verify(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``path, status`` of each recorded path: ok, missing or mismatch."""
    there = found.select("path", F.col("sha256").alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "mismatch").otherwise("ok")
    return latest(entries).join(there, "path", "left").select("path", status.alias("status"))


class SealedError(PermissionError):
    """A way to the hold-out past its gateway."""


def guard(path: str, sealed: str, index: str = "events_index") -> str:
    """The real path, unless it lies in the sealed folder or is the index of all events."""
    real, vault = os.path.realpath(path), os.path.realpath(sealed)
    if real == vault or real.startswith(vault + os.sep) or os.path.basename(real).startswith(index):
        raise SealedError(f"{path} belongs to the hold-out")
    return real


def read_sealed(spark: SparkSession, path: str, reason: str, log: str, script: str = "", commit: str = "") -> DataFrame:
    """The hold-out, after the reason for reading it has been logged."""
    if len(reason.strip()) < 10:
        raise ValueError("the reason for opening the hold-out needs at least 10 characters")
    found = digests(spark, path, "*.parquet").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256)).first()[0]
    append_lines(log, [{"time": time.time(), "script": script, "commit": commit, "sha256": found, "reason": reason.strip()}])
    return spark.read.parquet(path)
