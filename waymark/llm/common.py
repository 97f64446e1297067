"""What the operators share: word splitting, Arrow slices, lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T
from pyspark.sql.functions import broadcast

from waymark.shared import shared_dir

#: Rows that an operator holds as Python objects at a time.
SLICE_ROWS = 256
#: Bytes of text after which a slice ends early, so that very long texts do not add up.
SLICE_BYTES = 4_000_000

#: Maps A-Z to a-z and everything but 0-9, a-z and bytes of characters beyond ASCII to a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def space_words(text: str | None) -> list[bytes]:
    """Words between space, tab, newline, vertical tab, form feed and carriage return, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(ALNUM).split() if text else []


def release() -> None:
    """Gives memory that a task has freed back, as its worker lives on while others of the executor need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _length(column: pa.Array) -> pa.Array:
    return pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded rows and text."""
    size = np.asarray(pc.fill_null(_length(batch.column(text)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and (i - start >= SLICE_ROWS or total + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(size) > start:
        yield batch.slice(start)


def with_columns(df: DataFrame, text: str, more: str | T.StructType, f: Callable[[list], list[pa.Array]], setup: Callable | None = None) -> DataFrame:
    """df with columns that f makes from the texts of a slice; it replaces columns of these names.

    setup, where given, is called in each task, and what it returns is passed to f first.
    """
    added = T.StructType.fromDDL(more) if isinstance(more, str) else more
    names = {x.name.lower() for x in added}
    if text.lower() in names:
        raise ValueError(f"{text} is read and cannot be replaced")
    kept = [x for x in df.schema if x.name.lower() not in names]
    schema = T.StructType([*kept, *added])
    at = [x.name for x in kept]

    def run(batches):
        own = () if setup is None else (setup(),)
        for batch in batches:
            for s in slices(batch, text):
                out = f(*own, s.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([s.column(n) for n in at] + out, names=[x.name for x in schema])
        release()

    return df.select(*at).mapInArrow(run, schema)


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A list array of flat values, cut at the given ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


#: Rows of keys (some 100 bytes each) up to which they are broadcast; more are joined by a shuffle.
FEW = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and counted, with a hint to broadcast it only if it has few rows."""
    df = cut(df)
    if df.count() > FEW:
        return df
    out = broadcast(df)
    out._folder = df._folder
    return out


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that later steps neither recompute it nor depend on an executor, and read
    only the columns they need. It stays until :func:`drop` is called, as a result that nobody has read yet may need it."""
    folder = f"{shared_dir(df.sparkSession)}/waymark-{uuid.uuid4()}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def cut_rows(df: DataFrame) -> DataFrame:
    """The same for rows of long arrays or texts: a checkpoint, which is written and read a row at a time, where the reader of
    a table's columns would hold thousands."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint()
    out._folder = out._jdf.logicalPlan().rdd().getCheckpointFile().get()
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that :func:`cut` or :func:`small` has written."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
