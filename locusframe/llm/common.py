"""What the corpus operators share: reading tables, cutting lineage, shipping code and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker is sent at once.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches and makes this package importable on every executor, once per context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_locusframe_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    own = tempfile.mkdtemp(prefix="locusframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    path = os.path.join(own, "locusframe_src.zip")
    Path(path).write_bytes(packed.getvalue())
    sc.addPyFile(path)
    sc._locusframe_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_locusframe_folder", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        own = tempfile.mkdtemp(prefix="locusframe-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = spark.sparkContext._locusframe_folder = "file://" + own
    return found


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clean() -> None:
    """Removes the tables that this process has written to the shared folder; results that read them can't be used after. Runs at the end of the process in any case."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001  the context may have gone
            return


def own_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed when the process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/locusframe/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def read_note(spark: SparkSession, path: str) -> str | None:
    """A small text file that write_note has written, None where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.text(path, wholetext=True).first().value


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small text file by a rename, so that a reader never sees half of it."""
    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lost executors lose nothing before it."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._locusframe_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that cut has written, once all that read them is written itself."""
    for t in tables:
        entry = (t.sparkSession, t._locusframe_path)
        if entry in _written:
            _written.remove(entry)
            _remove(*entry)


def fresh(name: str, taken) -> str:
    """name, with underscores behind it until no column of taken has it; upper and lower case are the same to Spark."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def release() -> None:
    """Gives a worker's free memory back to the system; the worker waits for its next task beside the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a function that is made once for each task. Batches without rows are skipped."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows and (out := f(b)) is not None and out.num_rows:
                yield out
        f = b = out = None
        release()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty where it is null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def residue(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df marked for broadcast where its counted rows are within the bound; else unmarked, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def by_group(df: DataFrame, key: str, sort: list[str], f: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f for all rows of a key together, in order. A task holds one key's rows at a time, so keys must be of bounded size."""
    spark = df.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and keys[lo] != last:
                    if (out := f(pa.Table.from_batches(held))) is not None and out.num_rows:
                        yield out
                    held = []
                last = keys[lo]
                held.append(b.slice(lo, hi - lo))
        if held and (out := f(pa.Table.from_batches(held))) is not None and out.num_rows:
            yield out
        held, b, out = [], None, None
        release()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key, *sort).mapInArrow(run, schema)
