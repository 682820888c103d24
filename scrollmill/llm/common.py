"""Shared helpers: tables, shared folders, file access from tasks, row normalisation."""

from __future__ import annotations

import gc
import uuid
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, and only on one machine, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


_kept: list[str] = []


def keep(df: DataFrame, kind: str) -> DataFrame:
    """Cut lineage with a written table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    schema = df.schema
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(schema).parquet(path)


def kept_count() -> int:
    return len(_kept)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of jobs that are over go when the driver collects its garbage; a job of many rounds asks for it, or they all stay to its end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_kept(before: int, but: tuple[str, ...] = ()) -> None:
    """Delete the tables kept since kept_count() was `before`, without those of some kinds."""
    spark = SparkSession.active()
    stay = [p for p in _kept[before:] if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in but]
    for old in set(_kept[before:]) - set(stay):
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _kept[before:] = stay


def settle(make, kind: str) -> DataFrame:
    """make() written to the shared folder; the tables that it kept on its way are deleted then."""
    before = len(_kept)
    out = keep(make(), kind)
    path = _kept.pop()
    drop_kept(before)
    _kept.append(path)
    return out


def open_store(uri: str):
    """(filesystem, path) of a shared folder, for tasks that read or write whole files."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, write) -> None:
    """Write a whole file under a private name, then move it: a repeated attempt replaces it whole."""
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    final = str(PurePosixPath(path) / name)
    private = f"{final}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(private, compression=None) as out:
        write(out)
    store.move(private, final)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges [start, start + count) one after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def id_last(c: str) -> Column:
    """A null id behaves as the largest one."""
    return F.coalesce(F.col(c).cast("long"), F.lit(2**63 - 1))


def crc_bucket(c: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(n)), F.lit(0))


#: A key with over 1/HOT_PER of all rows is hot; by counting there are fewer than HOT_PER of them.
HOT_PER, HOT_BYTES = 1000, 10_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, counts: str) -> DataFrame:
    """Inner join of many rows with one row per key, whose `counts` says how many of the rows have it.

    Hot keys are joined by broadcast (fewer than HOT_PER, keys of HOT_BYTES at most), so their rows stay where
    they lie; the rest is shuffled without them.
    """
    total = side.agg(F.sum(counts)).first()[0] or 0
    hot = (F.col(counts) * HOT_PER > F.lit(total)) & (F.length(F.col(key).cast("string")) <= HOT_BYTES)
    few, rest = F.broadcast(side.filter(hot).drop(counts)), side.filter(~hot).drop(counts)
    cold = rows.join(F.broadcast(side.filter(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(rest, key))


def release() -> None:
    """Give memory that a task no longer needs back to the system; idle workers would hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def with_text_columns(df: DataFrame, text: str | list[str], added: str, make, at_once: int | None = None) -> DataFrame:
    """Add columns (DDL in `added`) computed from a text column (or several), in Arrow batches.

    `make()` runs once in each task and gives a function from a list of texts (None for null)
    for each column to one list or array per added column; `at_once` bounds the rows of a call. Input columns of the same names are replaced; all
    others pass through with their exact types.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T.StructType.fromDDL(added) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(added)
    texts = [text] if isinstance(text, str) else text
    base = df.drop(*[c for c in new.names if c not in texts])
    schema = T.StructType([*base.schema.fields, *new.fields])

    def run(batches):
        import pyarrow as pa

        kinds = to_arrow_schema(new).types
        fn = None
        for batch in (part for whole in batches for part in parts(whole)):
            fn = fn or make()
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, kind) for a, kind in zip(fn(*[batch.column(c).to_pylist() for c in texts]), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)
            del batch, arrays
        release()

    def parts(batch):
        return [batch.slice(a, at_once) for a in range(0, batch.num_rows, at_once)] if at_once else [batch]

    return base.mapInArrow(run, schema)
