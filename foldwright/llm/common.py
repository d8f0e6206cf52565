"""Shared helpers of the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import json
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Settings while a table is written: its shuffle files go, and a Python worker gets texts in small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}
_lock = threading.Lock()
_writing: dict = {"now": 0, "before": {}}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for tables between jobs: ``spark.checkpoint.dir``, else, with a local master, a temporary one.

    Elsewhere executors and driver share no local folder, so there the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="foldwright-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, outlives lost executors.

    The write's shuffle files are dropped when it ends. The folder goes when the driver's Python ends. Writes of several
    threads overlap as they like: the session's own settings come back when the last one ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with _lock:
        if not _writing["now"]:
            _writing["before"] = {k: spark.conf.get(k, None) for k in WRITING}
            for k, v in WRITING.items():
                spark.conf.set(k, v)
        _writing["now"] += 1
    try:
        df.write.parquet(path)
    finally:
        with _lock:
            _writing["now"] -= 1
            if not _writing["now"]:
                for k, v in _writing["before"].items():
                    spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``saved`` that nothing reads any more, lazy results included."""
    for df in tables:
        item = (df.sparkSession, df._saved_path)
        _delete(*item)
        _made.remove(item)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already at exit; the folder is scratch
            return


def slices(batch: pa.RecordBatch, at: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many characters."""
    begin, size = 0, 0
    for i, n in enumerate(pc.utf8_length(batch.column(at)).to_pylist()):
        size += n or 0
        if size >= chars:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def released() -> None:
    """Gives memory that a worker has freed back to the system; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def heaps_trimmed(spark: SparkSession) -> None:
    """Executors collect garbage and give free heap back to the system; else a JVM keeps what its largest step has taken.

    One task for each core, so while the cluster is free each executor gets one. It is for memory alone: results don't need it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def mapped(df: DataFrame, run: Callable, added: list[T.StructField]) -> DataFrame:
    """``df.mapInArrow`` where ``run`` adds columns at the end; columns may have any names, which it doesn't see."""
    inner = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*df.schema.fields, *added])]
    out = df.toDF(*(f.name for f in inner[: len(df.columns)])).mapInArrow(run, T.StructType(inner))
    return out.toDF(*df.columns, *(f.name for f in added))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of a bounded number of rows that the driver made, as one literal of the plan."""
    names = [c.split()[0] for c in ddl.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{a}: {b}' for a, b in (c.split() for c in ddl.split(',')))}>>")))


def sized(df: DataFrame, n_rows: int, most: int = 50_000) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; else the planner decides, and large ones are shuffled."""
    return F.broadcast(df) if n_rows <= most else df
