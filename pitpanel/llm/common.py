"""What the corpus operators share: input columns, batches, shared storage, ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of so many characters is handled at once inside a Python worker; a longer
#: document is handled alone.
CHUNK_CHARS = 1_000_000
#: Bytes of an Arrow batch between the JVM and a Python worker, where the session sets none.
BATCH_BYTES = 8_000_000
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: rows alone, as by default, don't bound long texts."""
    if not spark.conf.get(BATCH_CONF, None):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of a table, whatever other columns it has."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def by_position(docs: DataFrame) -> DataFrame:
    """The same rows under column names by place, so that no name can clash or need quotes.

    ``toDF(*docs.columns)`` gives them their names back.
    """
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts in order, null as empty, in lists of bounded total length."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def give_back() -> None:
    """Hand freed memory back to the system, which Arrow and the C library would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)  # glibc's
    if trim:
        trim(ctypes.c_size_t(0))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker, which is kept for later tasks, holds no memory that it doesn't use."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_texts(
    docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], work: Callable[[], Callable[[list[str]], list[tuple]]]
) -> DataFrame:
    """Add columns that depend on a row's text alone to ``doc_id``.

    ``docs`` has ``doc_id, text``. ``work()`` is called once in each task and gives a
    function from a bounded list of texts to one tuple of values a text. ``fields``
    are (name, SQL type, Arrow type). No row meets another, so nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{name} {sql}" for name, sql, _ in fields)])
    types = [t for _, _, t in fields]
    names = ["doc_id", *(name for name, _, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            ids, column, at = batch.column(0), batch.column(1), 0
            for part in chunks(x.as_py() for x in column):
                rows = each(part)
                columns = [pa.array([row[k] for row in rows], types[k]) for k in range(len(types))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), *columns], names=names)
                at += len(part)

    return docs.mapInArrow(lean(run), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the session runs in one process, as in tests, a temporary
    folder is used; on a cluster it has to be set.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="pitpanel-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, materialised in the shared folder: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a table written to the shared folder."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast: a key with more than 1 / HOT of all rows is one of
#: fewer than HOT.
HOT = 100_000


def meet(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``table``, which has one row a key and ``n``,
    the number of its rows, which is dropped.

    Keys of more than 1 / HOT of the ``total`` rows, of which there are fewer than HOT, are
    joined where their rows are; the others by a shuffle, in which no key is large.
    """
    hot = table.filter(F.col("n") > total / HOT)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col("n") <= total / HOT), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold).drop("n")


#: Ids that may be broadcast, of eight bytes each.
IDS = 2_000_000


def only(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` whose key is among the distinct ``ids`` (``left_semi``) or isn't (``left_anti``).

    Up to IDS of them, as counted, the ids go to the rows, which may be texts; beyond that
    both are shuffled.
    """
    held = cut(ids)
    return rows.join(F.broadcast(held) if held.count() <= IDS else held, key, how)
