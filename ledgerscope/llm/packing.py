"""Operator 2: packing of documents into fixed-length sequences by the sum-of-squares rule.

``token_pieces`` encodes texts and cuts only documents longer than the capacity: the first piece
takes the remainder, so that every other piece fills a sequence. ``pack`` places pieces: each goes
into the open sequence (or a new one) after which the sum, over all gaps, of the squared number of
open sequences with that gap is smallest.

At scale the pieces are dealt by a hash into chunks of a fixed size, packed independently, longest
pieces first. Full sequences are final. The pieces of sequences with room left are dealt again and
packed anew; since few are, rounds shrink geometrically until one chunk holds the rest.

Defined results: a null text is empty, which still has the end id, so every row gives one piece at
least; repeated rows are pieces of their own; equal lengths are interchangeable; an empty table
gives no rows; columns of the input other than the id and the text are ignored by ``token_pieces``
and carried along by ``pack``, which replaces ``sequence_id`` and ``offset``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.text import slices, unused
from ledgerscope.llm.tokens import END_ID, STEP_BYTES, encoder, id_bytes
from ledgerscope.session import materialize

CAPACITY = 2048
#: Pieces that one task packs together.
CHUNK_PIECES = 8192
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids`` with ids as little-endian unsigned 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STEP_BYTES):
                ids, counts = encoder(vocabulary).encode(part.column("text"), END_ID)
                first, cuts = (counts - 1) % capacity + 1, -(-counts // capacity)
                of = np.repeat(np.arange(len(counts)), cuts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                length = np.where(piece == 0, first[of], capacity)
                start = np.where(piece == 0, 0, first[of] + (piece - 1) * capacity)
                columns = part.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), id_bytes(ids, length)
                yield pa.RecordBatch.from_arrays(list(columns), schema=_PIECES)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence of each piece, its offset there, and the room left in each sequence."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    with_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    never = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        # the change of the sum if the sequence left with gap j now has gap j + size
        change = 2 * (count[: capacity + 1 - size] - count[size:]) + 2
        change[0] = 1 - 2 * count[size]
        change[count[size:] == 0] = never
        left = int(change.argmin())
        opening = 2 * count[capacity - size] + 1 if size < capacity else 0
        if change[left] <= opening:
            place = with_gap[left + size].pop()
            count[left + size] -= 1
        else:
            place, left = len(gaps), capacity - size
            gaps.append(capacity)
        sequence[i], offset[i] = place, capacity - gaps[place]
        gaps[place] = left
        if left:
            count[left] += 1
            with_gap[left].append(place)
    return sequence, offset, np.array(gaps, dtype=np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``capacity``."""
    pieces = pieces.drop("sequence_id", "offset")
    kept = pieces.columns
    row_at, chunk_at, open_at = unused(kept, "_pack_row", "_pack_chunk", "_pack_open")
    waiting = materialize(pieces.withColumn(row_at, F.monotonically_increasing_id()), "pieces")
    added = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField(open_at, T.BooleanType())])
    schema = T.StructType([*waiting.schema, *added])
    done, turn, before = [], 0, 0
    while True:
        rows = waiting.count()
        chunks = -(-rows // chunk_pieces)
        number = turn << 56

        def place(chunk: pa.Table) -> pa.Table:
            sequence, offset, gaps = sum_of_squares(chunk.column("length").to_numpy(), capacity)
            base = number + (chunk.column(chunk_at)[0].as_py() << 24)
            chunk = chunk.drop_columns([chunk_at])
            for name, values in zip(added.names, (base + sequence, offset, gaps[sequence] > 0)):
                chunk = chunk.append_column(name, pa.array(values))
            return chunk

        chunk = F.pmod(F.xxhash64(F.col(row_at), F.lit(turn)), F.lit(max(chunks, 1)))
        placed = materialize(waiting.withColumn(chunk_at, chunk).groupBy(chunk_at).applyInArrow(place, schema), "packed")
        # the first chunks are dealt again even if there is one: its open sequences seldom stay as many;
        # later rounds end at one chunk, or where most pieces stay in sequences with room
        if not rows or turn and (chunks == 1 or 2 * rows > before):
            done.append(placed)
            break
        done.append(placed.filter(~F.col(open_at)))
        waiting = placed.filter(F.col(open_at)).drop(*added.names)
        turn, before = turn + 1, rows
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*(F.col(f"`{c}`") for c in kept), "sequence_id", "offset")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their place; of the ids, their checksum."""
    pieces = token_pieces(docs, capacity, vocabulary)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, n_ids, ids``: the ids of each sequence of placed pieces that carry ``ids``.

    A sequence holds at most the capacity, so each group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts"))
    return joined.select("sequence_id", "n_ids", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
