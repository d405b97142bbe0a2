"""Operator 7: near-duplicate documents by a signature-coordinate inverted join.

1. A document's set is its distinct 5-word shingles. Equal sets form one class.
2. A class has a MinHash signature of 128 coordinates. It is posted under the pair of number and
   value of each of the first 64. Pairs of documents of the wanted similarity agree in at least n
   of these: 43 for 0.85, 39 for 0.8 (a pair at exactly that similarity misses this with a chance
   below 1.5e-4, others with less).
3. Prefix: values that one class alone has are of no use; a class with fewer than n others has no
   partner. Of its c useful postings, a class keeps the c - (n - 1) rarest: two classes that agree
   in n share a posting that both keep. So the long lists, of passages and such, are skipped by all
   classes that have enough rare postings.
4. Merge: each class is checked against the member of its lists with which it collides most often
   among the members that lead them; then lists that still span several components are merged in
   blocks, counting agreements over whole signatures, and pairs of different components above the
   threshold (of 128, 93 for 0.85 and 85 for 0.8; missed with a chance below 1.5e-4 as well) are
   checked there. Pairs within a component can't change it.
5. Checks intersect the full sets. Components of confirmed links give the groups.

Defined results: a document without words (null, empty or white space) has the empty set, is its
own component and is kept; equal sets are linked whatever the texts; with null ``doc_id`` in a group
the smallest other id names it, and null only if there is none; rows that repeat an id stay rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.text import mix, shingles, slices, unused
from ledgerscope.operators.components import components
from ledgerscope.session import materialize, small

SHINGLE_WORDS = 5
#: Links have 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
COORDINATES, POSTED = 128, 64
#: Chance that a pair at exactly the wanted similarity falls below a threshold of agreements.
MISS = 1.5e-4
#: Members of a list that one group of the merge holds of each side.
BLOCK = 512

_A = (mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32)


@functools.cache
def least_agreement(coordinates: int, percent: int) -> int:
    """The largest threshold that pairs at ``percent`` similarity fall below with a chance of at most ``MISS``."""
    p, below = percent / 100, 0.0
    for k in range(coordinates):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > MISS:
            return k
    return coordinates


def signature(distinct: np.ndarray) -> np.ndarray:
    """Smallest value of each of the 128 mixings over a set of 64-bit hashes."""
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    low = (distinct >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        x = (low[None, at : at + 2048] ^ _B[:, None]) * _A[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    hashes, per, _ = shingles(texts, size)
    at = 0
    for n in per.tolist():
        yield np.unique(hashes[at : at + n])
        at += n


def _digest(distinct: np.ndarray) -> bytes:
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_key, n_shingles, digest, signature``; the last two are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [(len(s), _digest(s) if len(s) else None, signature(s).view(np.int32) if len(s) else None) for s in _sets(part.column("text"), size)]
                counts, digests, signed = zip(*found)
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "digest", "signature"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, signature array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def class_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``cid, hashes`` of the classes in ``wanted(cid, digest, doc_id, text_key)``, from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for cid, digest, s in zip(part.column("cid").to_pylist(), part.column("digest").to_pylist(), _sets(part.column("text"), size)):
                    if cid not in seen and digest == _digest(s):
                        seen.add(cid)
                        rows.append((cid, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cid", "hashes"])

    wanted = small(wanted).withColumnRenamed("doc_id", "of_doc").withColumnRenamed("text_key", "of_text")
    found = _keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")))
    return found.select("cid", "digest", "text").mapInArrow(run, "cid long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    with_x = pairs.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), "a")
    with_y = with_x.join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y")), "b")
    return with_y.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def kept_postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``key, cid``: the postings that classes ``cid, signature`` keep after the prefix rule."""
    posted = classes.select("cid", F.posexplode(F.slice("signature", 1, POSTED)).alias("number", "value")).select("cid", F.xxhash64("number", "value").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    useful = posted.join(shared, "key").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("lists"))
    least = least_agreement(POSTED, percent)
    prefix = F.expr(f"slice(lists, 1, size(lists) - {least - 1})")
    return useful.filter(F.size("lists") >= least).select("cid", F.explode(prefix).alias("list")).select(F.col("list.key").alias("key"), "cid")


def _merge(percent: int):
    """Confirmed links between components in one group of the merge: ``side`` 0 against ``side`` 1."""

    least = least_agreement(COORDINATES, percent)

    def run(table: pa.Table) -> pa.Table:
        side, cid, comp, n, key = (table.column(c).to_numpy() for c in ("side", "cid", "comp", "n_shingles", "key"))
        signed = table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        agree = np.zeros((len(one), len(two)), dtype=np.uint8)
        for k in range(COORDINATES):
            agree += signed[one, k][:, None] == signed[two, k][None, :]
        near = (agree >= least) & (comp[one][:, None] != comp[two][None, :])
        low, high = np.minimum(n[one][:, None], n[two][None, :]), np.maximum(n[one][:, None], n[two][None, :])
        x, y = np.nonzero(near & (100 * low >= percent * high))
        order = np.argsort(-agree[x, y].astype(np.int16), kind="stable")
        hashes, lists = table.column("hashes"), table.column("keys")
        sets: dict[int, tuple] = {}
        parent: dict[int, int] = {}

        def content(i: int) -> tuple:
            if i not in sets:
                sets[i] = np.frombuffer(hashes[i].as_py(), dtype=np.uint64), frozenset(lists[i].as_py())
            return sets[i]

        def root(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        links = []
        for i, j in zip(one[x[order]].tolist(), two[y[order]].tolist()):
            r, t = root(comp[i]), root(comp[j])
            if r == t:
                continue
            (a, a_lists), (b, b_lists) = content(i), content(j)
            if min(a_lists & b_lists) != key[0]:
                continue  # the pair is looked at in the first list that both are in
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[max(r, t)] = min(r, t)
                links.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def merged_links(lists: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links ``a, b`` that join different components, between classes that share a list.

    The members outside the largest component of a list are compared with all its members. Both
    are dealt into blocks, so a group of the merge is bounded whatever the length of a list. A group
    checks full sets, best agreement first, and gives one link for each two components it joins.
    """
    rows = lists.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("comp"))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("total"), F.count("*").alias("comps")).filter("comps > 1")
    spread = spread.select("key", F.col("main.comp").alias("main"), F.ceil(F.col("total") / BLOCK).cast("int").alias("n_all"), F.ceil((F.col("total") - F.col("main.n")) / BLOCK).cast("int").alias("n_minor"))
    rows = materialize(rows.join(spread, "key"), "spread")
    whole = rows.groupBy("cid").agg(F.collect_list("key").alias("keys")).join(classes.select("cid", "n_shingles", "signature"), "cid").join(sets, "cid")
    mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("key", "cid", "comp", F.lit(0).alias("side"), mine("n_all").alias("i"), every("n_minor").alias("j"))
    minors = rows.filter("comp <> main").select("key", "cid", "comp", F.lit(1).alias("side"), mine("n_minor").alias("j"), every("n_all").alias("i"))
    dealt = members.unionByName(minors).join(whole, "cid")
    return dealt.groupBy("key", "i", "j").applyInArrow(_merge(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key, label`` for each row of ``docs(doc_id, text)``.

    ``text_key`` is a hash of the text, ``label`` a number of the component; null without words.
    """
    sketched = materialize(sketches(docs, size), "sketches")
    classes = sketched.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    posted = materialize(kept_postings(classes, percent), "postings")

    lead = posted.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "cid").alias("h"), "cid")).alias("lead"), F.count("*").alias("members")).filter("members > 1").select("key", F.col("lead.cid").alias("lead"))
    lists = materialize(posted.join(lead, "key"), "lists")
    counted = lists.filter("cid <> lead").groupBy("cid", "lead").agg(F.count("*").alias("hits"))
    best = counted.groupBy("cid").agg(F.max(F.struct("hits", F.xxhash64("cid", "lead").alias("h"), "lead")).alias("best"))
    first_pairs = best.select(F.least("cid", "best.lead").alias("a"), F.greatest("cid", "best.lead").alias("b")).distinct()

    wanted = classes.join(lists.select("cid").distinct(), "cid", "left_semi").select("cid", "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    sets = materialize(class_sets(docs, materialize(wanted, "wanted"), size), "sets")
    links = materialize(confirmed(first_pairs, sets, percent), "links")
    labels = components(links, "a", "b")
    more = materialize(merged_links(lists, labels, classes, sets, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more), "a", "b")

    named = classes.select("cid", "digest", "least_id").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component"))
    names = materialize(named.join(least, "label").select("digest", "component", "label"), "names")
    out = sketched.select("doc_id", "n_shingles", "digest", "text_key").join(names, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", "label")


def without_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Documents without all rows but one of each group.

    The row of the smallest id stays (null ids last, then by a hash of the text), whatever ids repeat;
    of rows that share its id and text any one stays. Rows without words all stay.
    """
    found = near_duplicates(docs, percent=percent).filter("label is not null")
    row = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")
    lead = found.groupBy("label").agg(F.min(row).alias("lead"))
    other_id, other_text, key = unused(docs.columns, "other_id", "other_text", "text_key")
    named = lambda df: df.select(F.col("doc_id").alias(other_id), F.col("text_key").alias(other_text))
    gone = materialize(named(found.join(lead, "label").filter(row != F.col("lead"))).distinct(), "gone")
    twice = materialize(named(found.groupBy("label", "doc_id", "text_key").count().filter("count > 1").join(lead, "label").filter(row == F.col("lead"))), "twice")
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    at = F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_text))
    kept = keyed.join(small(gone), at, "left_anti")
    if not twice.isEmpty():
        kept = kept.join(small(twice), at, "left_anti").unionByName(kept.join(small(twice), at, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.select(*docs.columns)


def op7_signature_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "label")
