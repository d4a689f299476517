"""Shared helpers: durable intermediate tables, text to words, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


#: With this set, the shuffle files of an execution go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a
    lost executor costs no more than the reader's own tasks. The shuffle files
    behind the table are removed once it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete the files of a durable() table that nothing will read again."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/skein/" in file:
            remove(df.sparkSession, file)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus).cast("long"))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z only; null has none.

    bytes.lower and bytes.split know only ASCII, which is just that rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def arrow_schema(ddl_fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl_fields])


def to_batches(schema: pa.Schema, columns: list[list], rows: int = 10_000):
    """Record batches of at most so many rows from column lists."""
    n = len(columns[0])
    for at in range(0, n, rows):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[at : at + rows], type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


def fresh_name(taken: list[str], wanted: str) -> str:
    """wanted, with underscores until it clashes with no taken name (case-insensitive)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


_memo: dict[str, object] = {}
_owner = ""


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_memo(owner: str, key: str, make):
    """make() once per key in this Python process.

    Workers outlive a stage, so only one owner (an operator's step) holds anything:
    when another asks, all that the one before remembered is dropped.
    """
    global _owner
    if owner != _owner:
        if _memo:
            _memo.clear()
            _give_back()
        _owner = owner
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def with_text_columns(docs: DataFrame, text_col: str, fields: list[tuple[str, str, pa.DataType]], make, rows: int = 500) -> DataFrame:
    """docs with further columns worked out from its text, in its own order and partitions.

    make() gives a function from a list of texts to a list of columns; it is called
    once per task. A field whose name docs has already gets underscores.
    """
    names = list(docs.columns)
    taken = []
    for name, _, _ in fields:
        taken.append(fresh_name([*names, *taken], name))
    text = fresh_name([*names, *taken], "text_")

    def run(batches):
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = of(part.column(len(names)).to_pylist())
                arrays = [pa.array(x, type=f[2]) for x, f in zip(found, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *arrays], names=[*names, *taken])

    ddl = ", ".join(f"`{n}` {kind}" for n, kind in [*docs.dtypes, *((t, f[1]) for t, f in zip(taken, fields, strict=True))])
    return docs.withColumn(text, F.col(text_col).cast("string")).mapInArrow(run, ddl)
