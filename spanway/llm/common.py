"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only on one machine (a local master) and where the setting is absent is a local
    folder taken, and the session told about it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spanway-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_kept: set[str] = set()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives the loss of any executor.  Tables that a result no longer needs go by
    ``forget``, all others of the process by ``release``."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    _kept.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in list(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _kept.discard(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, {df._stored_at} & _kept)


def release(spark: SparkSession) -> None:
    """Delete all tables that ``stored`` wrote: to be called when the results that read
    them have been written."""
    _delete(spark, _kept)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``limit`` bytes of text each (one row
    at least), so that a worker's memory doesn't depend on the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts = (np.cumsum(sizes) - 1).clip(0) // limit
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def plain_text(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as large strings, null as empty.

    The result's data begins at offset 0: kernels such as ascii_lower misread a
    slice that was cast, whose first offset isn't 0.
    """
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(text):
        return pa.array([], pa.large_string())
    _, places, data = text.buffers()
    offsets = np.frombuffer(places, np.int64)[text.offset : text.offset + len(text) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = data.slice(first, last - first) if data is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.ascontiguousarray(offsets - first)), data)


def ascii_word_codes(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

    Returns (code of each word, the distinct words as an Arrow array, offsets of each row).
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    offsets = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    base = int(offsets[0])
    words = split.values.slice(base, int(offsets[-1]) - base).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - base
    if (empty := pc.index(words.dictionary, "").as_py()) >= 0:
        keep = codes != empty
        kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        offsets, codes = kept[offsets], codes[keep]
    return codes, words.dictionary, offsets


def ascii_words(text: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """``ascii_word_codes`` with the distinct words as a list."""
    codes, names, offsets = ascii_word_codes(text)
    return codes, names.to_pylist(), offsets


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start_0, start_0+1, ... of every range, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1], dtype=np.int64)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where it isn't on their path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    here = sc.master.startswith("local[") and os.path.exists("spanway")
    if root in paths or here or getattr(sc, "_spanway_shipped", False):
        return
    import zipfile

    archive = os.path.join(tempfile.mkdtemp(prefix="spanway-zip-"), "spanway.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "spanway")):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(archive)
    sc._spanway_shipped = True
