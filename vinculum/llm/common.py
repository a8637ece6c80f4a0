"""Helpers shared by the operators: column isolation, durable intermediate tables, sizing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words and is stripped from lines: space, \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
#: A word, as a regular expression that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"
M64 = (1 << 64) - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def isolate(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str], list[tuple[str, str]]]:
    """Rename every column by position, so that no extra column can clash.

    Returns the renamed frame, the internal names of ``wanted`` and all (internal, original)
    pairs.  A wanted name is matched exactly, or else in any case.
    """
    pairs = [(f"_c{i}", name) for i, name in enumerate(df.columns)]
    by_name = {n.lower(): c for c, n in reversed(pairs)} | {n: c for c, n in reversed(pairs)}
    return df.toDF(*[c for c, _ in pairs]), [by_name.get(w) or by_name[w.lower()] for w in wanted], pairs


def restore(df: DataFrame, pairs: list[tuple[str, str]], added: dict[str, str]) -> DataFrame:
    """Undo :func:`isolate` and append ``added`` (output name -> internal column).

    An input column whose name equals an added one, in any case, gives way to it.
    """
    taken = {n.lower() for n in added}
    keep = [(c, n) for c, n in pairs if n.lower() not in taken]
    return df.select(*[F.col(c) for c, _ in keep], *[F.col(c) for c in added.values()]).toDF(
        *[n for _, n in keep], *added
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vinculum-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``by``: a column of few values; rows of each are kept apart and read alone where it is filtered.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vinculum/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # once the table is written, nothing reads the shuffles that made it
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more.

    What was made from them must be written already, as a lost executor is otherwise made good
    from them.
    """
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable) -> Callable:
    """An Arrow function after which the worker gives freed memory back: it lives on and serves later stages."""

    def lean_run(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return lean_run


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate (for scans and written tables the file size); measured where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    return int(df.agg(F.coalesce(F.sum(sum(long, F.lit(8 * len(df.columns)))), F.lit(0))).first()[0])


def parts_for(df: DataFrame, each: int, least: int = 8) -> int:
    """How many partitions of about ``each`` bytes of input ``df`` fills."""
    return int(min(max(least, -(-input_bytes(df) // each)), 1 << 17))


def byte_rows(batch: pa.RecordBatch, column: int | str, step: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 values) of a string column, a few rows at a time; null reads as empty."""
    values = batch.column(column)
    values = values.cast(pa.large_binary())
    for at in range(0, batch.num_rows, step):
        yield at, [x or b"" for x in values.slice(at, step).to_pylist()]


def n_points(data: bytes) -> int:
    """Code points in UTF-8 bytes."""
    return len(data) if data.isascii() else len(data.decode())
