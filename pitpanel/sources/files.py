"""Readers and writers of JSON, JSON lines, text lists and tables."""

from __future__ import annotations

import gzip
import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "title string, text string, date string, url string, source string"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines, or one document a file; gzip is told by the name."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file's entries, one a line; blank lines and ``#`` comments are left out."""
    return listed(spark.read.text(path))


def listed(lines: DataFrame) -> DataFrame:
    entry = F.trim("value")
    return lines.select(entry.alias("value")).filter((entry != "") & ~entry.startswith("#"))


def read_keyed_arrays(spark: SparkSession, path: str, item: str = f"struct<{ARTICLE.replace(' string', ': string')}>") -> DataFrame:
    """A JSON object of key -> array, one document a file, as rows ``key, place, item``.

    The document is one value; it has to fit in a task. Several files are read side by side.
    """
    return keyed_arrays(spark.read.option("wholetext", True).text(path), item)


def keyed_arrays(objects: DataFrame, item: str) -> DataFrame:
    """The same of a column ``value`` with one JSON object a row."""
    pairs = objects.select(F.explode(F.from_json("value", f"map<string, array<{item}>>")).alias("key", "items"))
    return pairs.select("key", F.posexplode("items").alias("place", "item"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def not_yet(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``done``, each key once."""
    return new.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def checkpointed_append(spark: SparkSession, new: DataFrame, path: str, key: str, score) -> int:
    """Score what isn't in the table at ``path`` yet and append it; how many rows that were."""
    try:
        todo = not_yet(new, spark.read.parquet(path), key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = new.dropDuplicates([key])
    before = todo.count()
    if before:
        score(todo).write.mode("append").parquet(path)
    return before


def dump(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def write_gzip_json(path: str, value) -> None:
    """The same value gives the same bytes: sorted keys, no time stamp, no name."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as raw, gzip.GzipFile(filename="", fileobj=raw, mode="wb", mtime=0) as out:
        out.write(dump(value).encode())


def replace_json(path: str, value) -> None:
    """Written aside, then moved: a reader sees the old or the new value."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, aside = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as out:
        out.write(json.dumps(value, sort_keys=True, indent=2))
    os.replace(aside, path)


def append_lines(path: str, values: Iterable) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a") as out:
        for value in values:
            out.write(dump(value) + "\n")


def read_settings(path: str) -> dict:
    """A YAML file of settings."""
    import yaml

    with open(path) as source:
        return yaml.safe_load(source) or {}
