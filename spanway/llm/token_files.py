"""Token-id files: Simple-8b chunks in ascending order of documents.

A set of files is a Parquet folder whose rows are chunks: ``shard`` and ``chunk``
(their order is the documents' order), ``n_ids``, ``doc_ids``, ``doc_lens`` (ids of
each document, with its end id), ``offsets`` (first word of each Simple-8b block,
unsigned 32-bit) and ``words`` (unsigned 64-bit, little-endian).  Spark's own writer
commits the files, so a lost executor leaves no half-written one, and they lie
wherever Spark can write.

Cases: null and empty texts are their end id alone; repeated ids keep a row each,
ordered by text; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanway.llm import simple8b
from spanway.llm.bpe import crc32_of, encoder
from spanway.llm.common import plain_text, ship, text_slices, work_dir

CHUNKS = "shard int, chunk int, n_ids long, doc_ids array<long>, doc_lens array<long>, offsets binary, words binary"
DOCS = "doc_id long, shard int, chunk int, start long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    words, offsets = simple8b.encode(ids)
    return offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()


def unpack(offsets: bytes, words: bytes, n: int) -> np.ndarray:
    return simple8b.decode(np.frombuffer(words, "<u8"), n, np.frombuffer(offsets, "<u4"))


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2) -> None:
    """Encode whole texts and write the files to ``path``."""
    ship(docs.sparkSession)

    def run(batches):
        own, shard = encoder(vocabulary), TaskContext.get().partitionId()
        for chunk, batch in enumerate(text_slices(batches, limit=8 << 20)):
            ids, lens = own.encode(plain_text(batch))
            ids = np.insert(ids, np.cumsum(lens), end_id)
            lens = lens + 1
            offsets, words = pack(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([chunk], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([lens.tolist()], pa.list_(pa.int64())),
                    pa.array([offsets], pa.binary()),
                    pa.array([words], pa.binary()),
                ],
                ["shard", "chunk", "n_ids", "doc_ids", "doc_lens", "offsets", "words"],
            )

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of the documents in the files."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["offsets"], row["words"], row["n_ids"]).astype(np.int64)
                ends = np.cumsum(row["doc_lens"])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([x.tolist() for x in np.split(ids, ends)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return spark.read.schema(CHUNKS).parquet(path).mapInArrow(run, "doc_id long, ids array<long>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files themselves."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                value = lambda c: row.column(c)[0].as_py()  # noqa: B023, E731
                lens = row.column("doc_lens").flatten().to_numpy(zero_copy_only=False)
                ids = unpack(value("offsets"), value("words"), value("n_ids")).astype("<u4")
                ends = np.cumsum(lens)
                crc = [crc32_of(ids[a:b]) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                n = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids").flatten(), pa.array(np.full(n, value("shard"), np.int32)), pa.array(np.full(n, value("chunk"), np.int32)), pa.array(ends - lens), pa.array(lens), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "chunk", "start", "n_tokens", "ids_crc32"],
                )

    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = chunks.select("shard", "chunk", "n_ids")
    # one row for each file, so one task can order them
    files = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    files = files.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("file_start"))
    inside = Window.partitionBy("shard").orderBy("chunk")
    bases = sizes.withColumn("chunk_start", F.sum("n_ids").over(inside) - F.col("n_ids")).join(files, "shard")
    bases = bases.select("shard", "chunk", (F.col("file_start") + F.col("chunk_start")).alias("base"))
    return (
        chunks.mapInArrow(run, DOCS)
        .join(bases, ["shard", "chunk"])
        .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the files, read them back, give each document's digest."""
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path, end_id)
    return digest(docs.sparkSession, path)
