"""Durable intermediate tables and session settings shared by the operators.

Lineage is cut by writing a table under the folder named in
``spark.checkpoint.dir``, which all executors and the driver share. Only where
that setting is absent and the master is local is a temporary folder made.
"""

from __future__ import annotations

import ctypes
import gc
import io
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes that Spark hands to a Python worker at once.
ARROW_ROWS = 1000
ARROW_BYTES = "4m"


#: What to drop at the end of a task besides: the workers' vocabularies and caches.
_AT_END: list[Callable[[], None]] = []


def dropped_at_end(cache: dict) -> dict:
    """A worker's cache that is emptied when a task ends, as idle workers keep their memory."""
    _AT_END.append(cache.clear)
    return cache


def give_back() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


#: Caches by identity that wait to be dropped, with their timers.
_WAITING: dict[int, threading.Timer] = {}
#: Seconds that a cache outlives the last task that used it.
PAUSE = 3.0


@contextmanager
def lent(cache: dict) -> Iterator[None]:
    """Use of a worker's cache that is kept between tasks that follow one another, and dropped in a pause.

    Who holds an entry when it is dropped can go on using it.
    """

    def drop() -> None:
        cache.clear()
        give_back()

    if (waiting := _WAITING.pop(id(cache), None)) is not None:
        waiting.cancel()
    try:
        yield
    finally:
        timer = _WAITING[id(cache)] = threading.Timer(PAUSE, drop)
        timer.daemon = True
        timer.start()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as a task that gives its memory back to the system when it ends."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for drop in _AT_END:
                drop()
            give_back()

    return task


class Files:
    """Opens files of a folder that may be local, or in any store that Arrow reaches."""

    def __init__(self, folder: str) -> None:
        scheme = urlsplit(folder).scheme
        self.store, self.root = None, folder
        if scheme in ("", "file"):
            self.root = urlsplit(folder).path
        else:
            from pyarrow import fs

            self.store, self.root = fs.FileSystem.from_uri(folder)

    def write(self, name: str):
        if self.store is None:
            os.makedirs(self.root, exist_ok=True)
            return open(f"{self.root}/{name}", "wb")
        self.store.create_dir(self.root, recursive=True)
        return self.store.open_output_stream(f"{self.root}/{name}")

    def read(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.store is None else self.store.open_input_file(f"{self.root}/{name}")


def store_array(folder: str, name: str, values: np.ndarray) -> None:
    buffer = io.BytesIO()
    np.save(buffer, values, allow_pickle=False)
    with Files(folder).write(name) as out:
        out.write(buffer.getbuffer())


def load_array(folder: str, name: str) -> np.ndarray:
    """A stored array, mapped: from a mounted folder, or from a copy that has no name and goes with the mapping."""
    files = Files(folder)
    if files.store is None:
        return np.load(f"{files.root}/{name}", mmap_mode="r")
    with files.read(name) as source, tempfile.TemporaryFile() as copy:
        shutil.copyfileobj(source, copy, 8 << 20)
        copy.seek(0)
        version = np.lib.format.read_magic(copy)
        shape, _, kind = np.lib.format.read_array_header_1_0(copy) if version == (1, 0) else np.lib.format.read_array_header_2_0(copy)
        return np.memmap(copy, kind, "r", copy.tell(), shape) if 0 not in shape else np.zeros(shape, kind)


def bound_arrow(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; they hold long documents."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tideline-")
    context.setCheckpointDir(own)
    return own


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(folder)
    return folder


#: Folders made inside each open :func:`scratch`.
_MADE: list[list[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._tideline_folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        folder = getattr(df, "_tideline_folder", None)
        if folder:
            delete_folder(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is written inside is deleted at the end, but for the folders put in the list that is given out."""
    _MADE.append([])
    keep: list[str] = []
    try:
        yield keep
    finally:
        for folder in _MADE.pop():
            if folder not in keep:
                delete_folder(spark, folder)
            elif _MADE:
                _MADE[-1].append(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
