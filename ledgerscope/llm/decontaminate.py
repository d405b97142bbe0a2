"""Operator 4: benchmark items inside documents, by size-partitioned MinHash containment search.

The items are the query set; they are dealt into blocks of bounded size, and each block meets all
documents. Items are partitioned by the size of their sets of 5-word shingles (powers of two), and
for items of up to c shingles a document is the family of its windows of 2c shingles, at a stride of
c, so that a short item has a large share of some window however long the document is. Windows and
items that agree in any of 64 MinHash coordinates are candidates (with 80 % contained and this
partition, an item is missed with a chance below 1e-5); items of up to 8 shingles are their own
signature. The minima of the windows come from minima of blocks of 16, so each shingle is mixed 64
times whatever the number of partitions. A candidate counts if exactly that share of its shingles is in the
document's set.

Defined results: null and empty texts and items have no shingles and match nothing; a text of fewer
than five words is one shingle, its word sequence; rows that repeat give one result; an empty table
gives none; null ids are carried along; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.text import mix, shingles, slices, unused
from ledgerscope.session import materialize, small

CONTAINED_PERCENT = 80
COORDINATES, LEAST_BLOCK = 64, 16
#: Items of one block; their sets are sent to the tasks together.
BLOCK_ITEMS = 10_000

_A = mix(np.arange(101, 101 + COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(101, 101 + COORDINATES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32)


def _mixed(low: np.ndarray, k: int) -> np.ndarray:
    x = (low ^ _B[k]) * _A[k]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x


class Items:
    """The sets of a block of items, and which items have a value of a coordinate, by partition."""

    def __init__(self, rows: list[tuple]):
        hashes, per, _ = shingles(pa.array([t for _, t in rows], pa.string()))
        sets = [np.unique(s) for s in np.split(hashes, np.cumsum(per)[:-1])] if rows else []
        kept = [i for i, s in enumerate(sets) if len(s)]
        self.ids, self.sets = [rows[i][0] for i in kept], [sets[i] for i in kept]
        self.direct: dict[int, list[int]] = {}
        self.partitions: dict[int, tuple[np.ndarray, dict]] = {}
        for i, s in enumerate(self.sets):
            if len(s) <= 8:
                for h in s.tolist():
                    self.direct.setdefault(h, []).append(i)
                continue
            c = max(LEAST_BLOCK, 1 << int(len(s) - 1).bit_length())
            there, found = self.partitions.setdefault(c, (np.zeros((COORDINATES, 1 << 16), dtype=bool), {}))
            low = (s >> np.uint64(32)).astype(np.uint32)
            for k in range(COORDINATES):
                least = int(_mixed(low, k).min())
                there[k, least >> 16] = True
                found.setdefault((k, least), []).append(i)
        self.direct_keys = np.sort(np.array(list(self.direct), dtype=np.uint64))

    def candidates(self, hashes: np.ndarray, per: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of text and item numbers."""
        out: set[tuple[int, int]] = set()
        begins = np.cumsum(per) - per
        if len(self.direct_keys):
            for at in np.flatnonzero(np.isin(hashes, self.direct_keys)).tolist():
                text = int(np.searchsorted(begins, at, "right")) - 1
                while per[text] == 0:
                    text -= 1
                out.update((text, i) for i in self.direct[int(hashes[at])])
        there = np.flatnonzero(per)
        if not self.partitions or not len(there):
            return out
        # blocks of 16 shingles within each text, and above them blocks of twice as many, and so on
        top = max(self.partitions)
        counts, levels, c = per[there], {}, LEAST_BLOCK
        units = counts
        while c <= top:
            blocks = -(-counts // c)
            owner = np.repeat(np.arange(len(there)), blocks)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            width = LEAST_BLOCK if c == LEAST_BLOCK else 2
            starts = np.repeat(np.cumsum(units) - units, blocks) + number * width
            levels[c] = (starts, owner)
            units, c = blocks, 2 * c
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(COORDINATES):
            minima = _mixed(low, k)
            for c, (starts, owner) in levels.items():
                minima = np.minimum.reduceat(minima, starts)
                if c not in self.partitions:
                    continue
                window = minima.copy()
                joined = owner[1:] == owner[:-1]
                window[:-1][joined] = np.minimum(minima[:-1], minima[1:])[joined]
                bits, found = self.partitions[c]
                for w in np.flatnonzero(bits[k, window >> np.uint32(16)]).tolist():
                    out.update((int(there[owner[w]]), i) for i in found.get((k, int(window[w])), ()))
        return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_found", pa.int64())])


def _search(items: Items, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, per, _ = shingles(part.column("text"))
                begins, rows = np.cumsum(per) - per, []
                near = sorted(items.candidates(hashes, per))
                doc_ids = part.column("doc_id")
                for text, item in near:
                    wanted = items.sets[item]
                    there = int(np.isin(wanted, hashes[begins[text] : begins[text] + per[text]]).sum())
                    if 100 * there >= percent * len(wanted):
                        rows.append((doc_ids[text].as_py(), items.ids[item], len(wanted), there))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    return run


def contained_items(docs: DataFrame, items: DataFrame, percent: int = CONTAINED_PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, n_item, n_found, containment`` of items that documents contain."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        block = Items([(r["item_id"], r["text"]) for r in items.filter(F.col("block") == b).collect()])
        found = docs.mapInArrow(_search(block, percent), "doc_id long, item_id long, n_item long, n_found long")
        out = found if out is None else out.union(found)
    return out.distinct().withColumn("containment", F.col("n_found") / F.col("n_item"))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose ``doc_id`` is not in ``ids(doc_id)``; documents without an id stay."""
    (gone_id,) = unused(docs.columns, "gone")
    gone = materialize(ids.filter("doc_id is not null").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    return docs.join(small(gone), F.col("doc_id") == F.col(gone_id), "left_anti")


def op4_size_partitioned_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
with texts as (
  select 'd' as side, doc_id as id, text from documents union all select 'i', item_id, text from benchmark
), word_lists as (
  select side, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from texts where text is not null
), sets as (
  select distinct side, id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle
  from word_lists
), sizes as (
  select id, count(*) as n_item from sets where side = 'i' group by id
), hits as (
  select d.id as doc_id, i.id as item_id, count(*) as n_found
  from sets d join sets i on d.shingle = i.shingle where d.side = 'd' and i.side = 'i' group by 1, 2
)
select doc_id, item_id, n_item, n_found, n_found / n_item as containment
from hits join sizes on hits.item_id = sizes.id where 100 * n_found >= 80 * n_item
"""
