"""What the operators share: tables, settled intermediate results, Arrow groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 2000  # whole texts of an Arrow batch; Spark's own default holds five times as much in every worker
BATCH_BYTES = 8 << 20  # of an Arrow batch, beyond which it ends whatever its rows
READ_ROWS = 32  # whole texts that a task's Parquet reader decodes at once; Spark's own default is 4,096


def text_batches(spark: SparkSession) -> None:
    """Bound what tasks of this session hold at once, in rows and bytes: rows here are whole documents.

    Arrow batches hold ``BATCH_ROWS`` rows and about ``BATCH_BYTES``, Parquet readers ``READ_ROWS`` rows; lower settings stay.
    """
    bounds = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
        "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS,
    }
    parsed = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in bounds.items():
        if not 0 < parsed(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's reader opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none the context's own folder is used, and on a local master (tests) one is made where that
    is missing too; on a cluster that is an error, as its machines share no temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and held.isDefined():
        found = held.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tagloom-")
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # a path without a scheme is of the default file system, which need not be the machine's: workers are told which
    return path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tagloom-{spark.sparkContext.applicationId}"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system for workers: the machine's (with what is mounted there), or what a URI's scheme names."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def open_file(path: str, mode: str) -> pa.NativeFile:
    """A file of the shared folder, for reading ("r") with seeks or for writing ("w"), on driver or executors."""
    system, at = _file_system(path)
    if mode == "r":
        return system.open_input_file(at)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at)


def file_size(path: str) -> int:
    system, at = _file_system(path)
    return system.get_file_info(at).size


def forget(spark: SparkSession) -> None:
    """Delete what this application has settled, once no result of an operator is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and no lost executor takes it along."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def least_hashes(df: DataFrame, keys: Sequence[str], size: int, seed: int, n: int) -> DataFrame:
    """The ``size`` of ``n`` rows whose keys have the least hashes; ``keys`` tell rows apart.

    Rows far beyond the expected border are left out where they are, so that the last step sees half more than ``size``
    rows, not as many from every partition.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    near = 1.5 * size / max(n, 1)
    if near < 0.5:
        bits = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 11)  # the least hash is 0 here
        df = df.where(bits < F.lit(int(near * 2**53)))
    return df.orderBy(h, *keys).limit(size)


def unsettle(df: DataFrame) -> None:
    """Delete the files behind a settled frame that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of two or more rows with equal ``keys`` from batches sorted by them; single rows are passed over.

    Memory is bounded by a batch and the largest run, so callers split large groups beforehand.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            same = all(held[-1].column(k)[-1].as_py() == batch.column(k)[-1].as_py() for k in keys)
            if same:  # the whole batch belongs to the run that is open
                held.append(batch)
                continue
        rows = pa.Table.from_batches([*held, batch])
        starts = _starts(rows, keys)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1:
                yield rows.slice(a, b - a)
        held = rows.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows > 1:
            yield rows


def _starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
