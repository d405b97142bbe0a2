"""Operator 10: token ids in Simple-8b files.

``write_token_files`` encodes every text and writes a dataset of blocks in ascending ``doc_id``
order; ``read_token_files`` decodes it. The dataset is a folder of Parquet parts, so Spark's
committer deals with lost executors and any store that Spark writes to will do. A part covers a
range of ``doc_id``; its rows are blocks: the documents of the block, the number of ids of each,
the first word of each within ``words`` (documents start on a word boundary, so one document can be
decoded alone), the ids before the block in its part, the Simple-8b words, and the escapes.

Defined results: a null text counts as empty and has the end id alone; null ``doc_id`` sorts
first; rows that repeat a ``doc_id`` are each written, in the order of their texts; an empty table
gives an empty dataset; further columns of the input are ignored; a text of any length is one
document of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.llm import simple8b
from ledgerscope.llm.text import slices
from ledgerscope.llm.tokens import END_ID, STEP_BYTES, encoder, id_bytes
from ledgerscope.session import fresh_path, materialize, small

#: Ids at which a block is closed.
BLOCK_IDS = 65_536
#: Text bytes for one part.
PART_BYTES = 32 << 20

BLOCKS = "doc_ids array<bigint>, counts array<bigint>, first_word array<bigint>, before bigint, n_ids bigint, words binary, escapes binary"
_SCHEMA = pa.schema([*((n, pa.list_(pa.int64())) for n in ("doc_ids", "counts", "first_word")), ("before", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()), ("escapes", pa.binary())])
READ = "doc_id long, start long, n_tokens long, ids binary"
_READ_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _block(doc_ids: list, counts: np.ndarray, ids: np.ndarray, before: int) -> pa.RecordBatch:
    words, first, escapes = simple8b.encode(ids, np.cumsum(counts))
    row = {"doc_ids": doc_ids, "counts": counts, "first_word": first, "before": before, "n_ids": int(counts.sum()), "words": words, "escapes": escapes}
    return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)


def _encode(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, doc_ids, before = encoder(vocabulary), [], 0
        counts, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        for batch in batches:
            for part in slices(batch, limit=STEP_BYTES):
                more, n = ids_of.encode(part.column("text"), END_ID)
                doc_ids += part.column("doc_id").to_pylist()
                counts, ids = np.concatenate([counts, n]), np.concatenate([ids, more])
                # a block ends with the document that brings it to BLOCK_IDS
                ends = np.cumsum(counts)
                a = at = 0
                while a < len(ends) and ends[-1] - at >= BLOCK_IDS:
                    b = int(np.searchsorted(ends, at + BLOCK_IDS)) + 1
                    yield _block(doc_ids[a:b], counts[a:b], ids[at : ends[b - 1]], before)
                    before += int(ends[b - 1]) - at
                    a, at = b, int(ends[b - 1])
                doc_ids, counts, ids = doc_ids[a:], counts[a:], ids[at:]
        if doc_ids:
            yield _block(doc_ids, counts, ids, before)

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write the blocks under ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(size // PART_BYTES) + 1, spark.sparkContext.defaultParallelism)
    (
        docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(_encode(vocabulary), BLOCKS)
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd")
        .parquet(path)
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.array(row["counts"], dtype=np.int64)
            starts = row["part_start"] + row["before"] + np.cumsum(counts) - counts
            runs = simple8b.decode(row["words"], row["first_word"], counts, row["escapes"])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts), id_bytes(np.concatenate(runs), counts)], schema=_READ_SCHEMA)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: one row per document.

    ``ids`` are little-endian unsigned 32-bit integers, the end id last. ``start`` counts the ids
    of all documents before this one: a block knows the ids before it in its part, and the parts
    have a running sum of one row each.
    """
    blocks = spark.read.schema(BLOCKS + ", part int").parquet(path)
    parts = materialize(blocks.groupBy("part").agg(F.sum("n_ids").alias("total")), "token-parts")
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    return blocks.join(small(parts), "part").mapInArrow(_decode, READ)


def op10_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
