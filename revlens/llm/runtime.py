"""Session plumbing of the operators: shared scratch tables and code shipping."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_folders: dict[str, str] = {}       # of local applications without spark.checkpoint.dir
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows go to the Python workers in batches; by Spark's default one holds 10,000
# rows however long, in the executor (its buffer doubled as it grows) and twice
# in the worker.  Workers use slices of half a MB, so larger batches gain nothing.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.  Only a local
    session without that setting (tests) gets a folder of its own; on a
    cluster an unset folder is an error, since a machine-local folder would not
    survive the loss of an executor."""
    found = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="revlens-llm-")
        found = _own_folders[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: the
    lineage is cut by a table that every executor can reach, so a lost
    executor repeats its own tasks only.  The shuffle files of the write are
    dropped when it ends."""
    spark = df.sparkSession
    path, schema = new_path(spark, name), df.schema
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that
    tasks can import it wherever the driver loaded it from, and bound the bytes
    of the batches they get, unless the session has a bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="revlens-code-"), "revlens_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def tidy(run: Callable[[Iterator], Iterator], keep_chunks: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow in a Python worker that lives on between tasks
    and stages: what an earlier stage looked up is dropped first (unless this
    one looks up the same), and freed memory goes back to the system at the end."""
    def with_ends(batches: Iterator) -> Iterator:
        chunks = sys.modules.get("revlens.llm.byte_bpe")
        if chunks is not None and not keep_chunks:
            chunks.forget()
            release()
        yield from run(batches)
        release()
    return with_ends


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # no glibc: nothing to trim
        pass


def plainly_named(docs: DataFrame, known: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns outside ``known`` named by their place, so that
    no name of theirs (dots and quotes included) meets one of an operator's, and
    the function that gives a result with all these columns its names back."""
    names = [c if c in known else f"other_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def task_count(spark: SparkSession) -> int:
    """Partitions that the session gives a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
