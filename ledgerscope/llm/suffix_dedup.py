"""Operator 11: exact substring dedup by suffix buckets, sorted with a difference cover.

Of every text go all bytes that a string of ``LENGTH`` bytes covers which also starts in a document
with a smaller ``doc_id``. Four passes find them:

1. *Anchors.* A suffix's anchor is the smallest hash of the 16-byte grams among its first
   ``LENGTH`` bytes: equal strings have equal anchors, and neighbouring suffixes mostly share one.
   Anchors are posted by text, and those of two texts or more are kept.
2. *Suffix buckets.* Each run of suffixes with a kept anchor is sent to the bucket of the anchor as
   one row, with the bytes it needs; the rest of the corpus never moves. Equal rows of a step of
   texts are resolved where they are: only that of the smallest document travels.
3. *Sorting, one bucket at a time.* Suffixes are sorted by their first 16 bytes. Longer ties are
   resolved by ranks of a difference cover sample: of any two places there is a distance below
   ``PERIOD`` at which both are in the sample, so comparing the ranks there orders them. Only the
   sample, 4 of 13 places, is ranked to depth ``LENGTH``. Runs of equal strings then show their
   smallest document.
4. *Cutting.* Places come back to their documents.

Copies of whole texts are folded first: the copy of the smallest document stands for all. An anchor
of more than ``HOT`` runs has its suffixes sent one by one, to buckets by hashes of their whole
strings, so no bucket holds more than it could sort.

Defined results: a null text counts as empty; a null ``doc_id`` counts as smaller than any other;
rows that repeat a ``doc_id`` are one document's and never remove each other's bytes; texts below
``LENGTH`` bytes keep everything; an empty table gives no rows; further columns are ignored.
Two texts whose 60-bit keys agree count as one when anchors are kept; all that follows is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.text import mix, slices
from ledgerscope.session import materialize, small

LENGTH = 50
#: Bytes of a gram; the grams of a string of LENGTH bytes are its anchor's candidates.
GRAM = 16
#: Every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text for one bucket of anchors, and for one bucket of suffixes.
ANCHOR_BYTES, BUCKET_BYTES = 16 << 20, 2 << 20
#: Runs beyond which an anchor's suffixes are sent one by one.
HOT = 100_000
#: Bytes hashed at once, and bytes of text in a step.
WINDOW, STEP = 1 << 18, 2 << 20

_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_MUL = [_U(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
#: Anchors are posted as this many bytes.
_KEPT_BYTES = 6


def anchors(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, size, value`` of the runs of suffixes that share an anchor; ``ends`` are those of the texts in ``buf``."""
    begins = np.concatenate([[0], ends[:-1]])
    span = length - GRAM + 1
    starts, sizes, values = [], [], []
    for at in range(0, max(len(buf) - length + 1, 0), WINDOW):
        part = buf[at : at + WINDOW + length - 1]
        h, width = _BYTE[part], 1
        for m in _MUL:
            h = h[:-width] * m + h[width:]
            width *= 2
        h ^= h >> _U(32)
        h *= _MUL[0]
        h ^= h >> _U(29)
        # the smallest of ``span`` neighbours, by windows of doubled width
        width = 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - span + width], h[span - width :])
        h >>= _U(64 - 8 * _KEPT_BYTES)
        n = len(h)
        # suffixes that begin in the last bytes of a text are too short
        lo, hi = np.searchsorted(ends, [at, at + n + length], "right")
        off = np.zeros(n + 1, dtype=np.int32)
        np.add.at(off, np.clip(np.maximum(begins[lo : hi + 1], ends[lo : hi + 1] - length + 1) - at, 0, n), 1)
        np.add.at(off, np.clip(ends[lo : hi + 1] - at, 0, n), -1)
        fits = np.cumsum(off[:-1]) == 0
        edge = np.ones(n + 1, dtype=bool)
        edge[1:-1] = (h[1:] != h[:-1]) | (fits[1:] != fits[:-1])
        cuts = np.flatnonzero(edge)
        good = fits[cuts[:-1]]
        starts.append(cuts[:-1][good] + at)
        sizes.append(np.diff(cuts)[good])
        values.append(h[cuts[:-1][good]])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *sizes]), np.concatenate([empty.astype(_U), *values])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT_BYTES]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _KEPT_BYTES, 8), dtype=np.uint8)
    out[:, :_KEPT_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _KEPT_BYTES)
    return out.view("<u8").ravel()


def _by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


POSTS = "bucket long, vals binary, texts binary, nth binary, counts binary"
_POSTS = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("vals", "texts", "nth", "counts"))])
KEPT = "part long, keys binary, vals binary"
HITS = "key long, vals binary"


def _post(buckets: int, length: int) -> Callable:
    """Anchors of each step of texts, once each, dealt to buckets; those of several texts of the step are known to be kept."""

    def row(bucket: int, values: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> dict:
        named, nth = np.unique(keys, return_inverse=True)
        return {"bucket": bucket, "vals": _packed(values), "texts": named.astype("<i8").tobytes(), "nth": nth.astype("<u4").tobytes(), "counts": counts.astype("<u4").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 * STEP):
                buf, ends = _bytes_of(part.column("text"))
                start, _, value = anchors(buf, ends, length)
                if not len(value):
                    continue
                key = part.column("key").to_numpy(zero_copy_only=False)[np.searchsorted(ends, start, "right")]
                order, first = _by(value)
                value, key = value[order], key[order]
                low, high = np.minimum.reduceat(key, first), np.maximum.reduceat(key, first)
                counts = np.diff(first, append=len(value))
                shared = np.repeat(low != high, counts)
                one, n = value[first], np.where(low != high, counts, 1)
                dealt, cuts = _by((one % _U(buckets)).astype(np.int64))
                out = [row(int(one[d[0]] % _U(buckets)), one[d], low[d], n[d]) for d in np.split(dealt, cuts[1:])]
                if shared.any():
                    out.append(row(buckets + int(value[0] % _U(1 << 20)), value[shared], key[shared], np.full(int(shared.sum()), 2)))
                yield pa.RecordBatch.from_pylist(out, schema=_POSTS)

    return run


def _keep(buckets: int, hot: int) -> Callable:
    """Anchors of several texts with these texts, dealt to parts by text; in no part those of more than ``hot`` runs."""

    def run(group: pa.Table) -> pa.Table:
        vals, keys, counts = [], [], []
        for row in group.select(["vals", "texts", "nth", "counts"]).to_pylist():
            vals.append(_unpacked(row["vals"]))
            keys.append(np.frombuffer(row["texts"], dtype="<i8")[np.frombuffer(row["nth"], dtype="<u4")])
            counts.append(np.frombuffer(row["counts"], dtype="<u4").astype(np.int64))
        value, key, count = np.concatenate(vals), np.concatenate(keys), np.concatenate(counts)
        very = np.zeros(0, dtype=_U)
        if group.column("bucket")[0].as_py() < buckets:
            order, first = _by(value)
            value, key, count = value[order], key[order], count[order]
            total = np.add.reduceat(count, first)
            kept = (np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)) | (np.maximum.reduceat(count, first) > 1)
            very = value[first][total > hot]
            there = np.repeat(kept, np.diff(first, append=len(value)))
            value, key = value[there], key[there]
        order, first = _by((mix(key.astype(_U)) % _U(buckets)).astype(np.int64))
        rows = [(int(mix(key[d[:1]].astype(_U))[0] % _U(buckets)), key[d].astype("<i8").tobytes(), _packed(value[d])) for d in np.split(order, first[1:])] if len(key) else []
        rows += [(None, b"", _packed(very))] if len(very) else []
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary()), "vals": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _by_text(group: pa.Table) -> pa.Table:
    """Kept anchors of one part, a row for each text."""
    key = np.concatenate([np.frombuffer(x.as_py(), dtype="<i8") for x in group.column("keys")])
    value = np.concatenate([_unpacked(x.as_py()) for x in group.column("vals")])
    order, first = _by(key)
    return pa.table({"key": pa.array(key[order][first]), "vals": pa.array([_packed(value[d]) for d in np.split(order, first[1:])], pa.binary())})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for vals in batch.column("vals"):
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(vals.as_py()).astype(np.int64))], names=["anchor"])


RUNS = "bucket long, anchor long, rank long, key long, start long, size long, bytes binary"
_RUNS = pa.schema([("bucket", pa.int64()), ("anchor", pa.int64()), ("rank", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("bytes", pa.binary())])


def _cut_out(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    place = np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(buf[place])])


def _resolved(bucket: np.ndarray, anchor: np.ndarray, rank: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, held: pa.Array, buckets: int) -> pa.RecordBatch:
    """Runs of one step; of equal ones only those of the smallest document keep their bytes, and of larger documents all is known."""
    code = held.dictionary_encode().indices.to_numpy()
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
    least = np.empty(len(code), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(rank[order], first), np.diff(first, append=len(order)))
    sent = rank == least
    held = pc.if_else(pa.array(sent), held, pa.scalar(None, pa.binary()))
    where = np.where(sent, bucket, buckets + (key & 0xFFFF))
    return pa.RecordBatch.from_arrays([pa.array(where), *(pa.array(x) for x in (anchor, rank, key, start, size)), held], schema=_RUNS)


def _send(buckets: int, length: int) -> Callable:
    """Runs of suffixes under kept anchors. Rows without bytes are starts known to be taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=STEP):
                buf, ends = _bytes_of(part.column("text"))
                start, size, value = anchors(buf, ends, length)
                nth = np.searchsorted(ends, start, "right")
                kept = [_unpacked(x) for x in part.column("vals").to_pylist()]
                wanted = np.concatenate([np.zeros(0, dtype=_U), *kept]) | (np.repeat(np.arange(len(kept), dtype=_U), [len(x) for x in kept]) << _U(8 * _KEPT_BYTES))
                mine = np.isin(value | (nth.astype(_U) << _U(8 * _KEPT_BYTES)), wanted)
                start, size, value, nth = start[mine], size[mine], value[mine], nth[mine]
                if not len(start):
                    continue
                begins = ends - np.diff(ends, prepend=0)
                rank, key = (part.column(c).to_numpy(zero_copy_only=False)[nth] for c in ("rank", "key"))
                held = _cut_out(buf, start, size + length - 1)
                yield _resolved((value % _U(buckets)).astype(np.int64), value.astype(np.int64), rank, key, start - begins[nth], size, held, buckets)

    return run


def _alone(buckets: int, length: int) -> Callable:
    """Runs of very frequent anchors as single suffixes, dealt by their whole strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.and_(batch.column("hot"), pc.is_valid(batch.column("bytes")))
            plain = batch.drop_columns(["hot"])
            if calm := plain.filter(pc.invert(split)):
                yield calm.cast(_RUNS)
            plain = plain.filter(split)
            for at in range(0, plain.num_rows, 4096):
                part = plain.slice(at, 4096)
                held = part.column("bytes")
                buf, _ = _bytes_of_binary(held)
                size = part.column("size").to_numpy(zero_copy_only=False)
                lengths = size + length - 1
                nth = np.repeat(np.arange(len(size)), size)
                within = np.arange(len(nth)) - np.repeat(np.cumsum(size) - size, size)
                begin = (np.cumsum(lengths) - lengths)[nth] + within
                one = _cut_out(buf, begin, np.full(len(begin), length))
                words = np.frombuffer(one.buffers()[2], dtype=np.uint8).reshape(-1, length)
                h = np.zeros(len(words), dtype=_U)
                for j in range(length):
                    h = h * _MUL[j % 4] + _BYTE[words[:, j]]
                bucket = (mix(h) % _U(buckets)).astype(np.int64)
                anchor, rank, key, start = (part.column(c).to_numpy(zero_copy_only=False)[nth] for c in ("anchor", "rank", "key", "start"))
                yield _resolved(bucket, anchor, rank, key, start + within, np.ones(len(nth), dtype=np.int64), one, buckets)

    return run


def _bytes_of_binary(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    held = held.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _distances() -> np.ndarray:
    """For two residues the smallest distance at which both places are in the cover."""
    out = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


_DISTANCE = _distances()


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys without gaps."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.empty(len(keys), dtype=_U)
    out[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]), dtype=np.int64).astype(_U)
    return out


def sorted_suffixes(buf: np.ndarray, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``places`` in the order of the suffixes there, and whether each has the first ``length`` bytes of the one before.

    ``length`` is at least 16. The order is that of the first ``length`` bytes at least.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(2 * length + 32, dtype=np.uint8)])
    words = np.ndarray(shape=(n + length + 16,), dtype=">u8", buffer=padded, strides=(1,)).astype(_U)
    eight = _dense(words)
    pair = lambda p: eight[p] << _U(32) | eight[p + 8]
    # ranks of the cover's places to the depth of ``length``
    near = np.zeros(n + PERIOD, dtype=bool)
    for d in range(PERIOD):
        near[places + d] = True
    sample = np.flatnonzero(near & np.isin(np.arange(n + PERIOD) % PERIOD, COVER))
    rank = pair(sample)
    for at in range(16, length, 16):
        rank = _dense(rank) << _U(32) | _dense(pair(sample + min(at, length - 16)))
    ranks = np.zeros(n + PERIOD, dtype=np.int64)
    ranks[sample] = _dense(rank).astype(np.int64)
    # the first 16 bytes, which are more than PERIOD
    head = pair(places)
    order = np.argsort(head)
    out = places[order]
    fresh = np.concatenate([[True], head[order][1:] != head[order][:-1]])
    group = np.cumsum(fresh) - 1
    # ties: split each group by a pivot into smaller, equal and larger, until none is left
    slots = np.flatnonzero(np.bincount(group)[group] > 1)
    group = group[slots]
    while len(slots):
        mine = out[slots]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(first, append=len(slots))
        pivot = np.repeat(mine[first + sizes // 2], sizes)
        gap = _DISTANCE[mine % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[mine + gap] - ranks[pivot + gap]) + 1
        key = 3 * np.repeat(np.arange(len(first)), sizes) + side
        moved = np.argsort(key, kind="stable")
        out[slots] = mine[moved]
        key = key[moved]
        live = (np.bincount(key)[key] > 1) & (key % 3 != 1)
        slots, group = slots[live], key[live]
    same = np.ones(len(out), dtype=bool)
    same[:1] = False
    for at in [*range(0, length - 15, 16), length - 16]:
        held = pair(out + at)
        same[1:] &= held[1:] == held[:-1]
    return out, same


FOUND = "rank long, key long, start long, size long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("rank", "key", "start", "size")])


def _sort(length: int) -> Callable:
    """Runs of starts whose string a smaller document has, in one bucket."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        known = pc.is_null(group.column("bytes"))
        done = group.filter(known).select(_FOUND.names).cast(_FOUND)
        group = group.filter(pc.invert(known))
        if not group.num_rows:
            return done
        buf, ends = _bytes_of_binary(group.column("bytes").combine_chunks())
        rank, key, start, size = (group.column(c).to_numpy() for c in _FOUND.names)
        nth = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(nth)) - np.repeat(np.cumsum(size) - size, size)
        places = (ends - np.diff(ends, prepend=0))[nth] + within
        at = np.zeros(len(buf), dtype=np.int64)  # the number of the suffix at each place
        at[places] = np.arange(len(places))
        order, same = sorted_suffixes(buf, places, length)
        order = at[order]
        first = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(rank[nth[order]], first), np.diff(first, append=len(order)))
        taken = np.zeros(len(nth), dtype=bool)
        taken[order] = rank[nth[order]] > least
        edge = np.ones(len(nth) + 1, dtype=bool)
        edge[1:-1] = (taken[1:] != taken[:-1]) | (nth[1:] != nth[:-1])
        cuts = np.flatnonzero(edge)
        good = taken[cuts[:-1]]
        begin, n = cuts[:-1][good], np.diff(cuts)[good]
        row = nth[begin]
        found = pa.table([pa.array(x) for x in (rank[row], key[row], start[row] + within[begin], n)], schema=_FOUND)
        return pa.concat_tables([done, found])

    return run


CUT = "rank long, key long, n_removed long, n_spans long, kept_sha256 string"
_CUT = pa.schema([("rank", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def spans_of(starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``begin, end`` of the maximal runs of bytes that strings starting in these runs cover."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], (starts + sizes + length - 1)[order]
    reach = np.maximum.accumulate(end)
    fresh = np.concatenate([[True], begin[1:] > reach[:-1]])
    lead = np.flatnonzero(fresh)
    return begin[lead], np.maximum.reduceat(reach, lead)


def _cut(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, rank, key, starts, sizes in zip(*(batch.column(c) for c in ("text", "rank", "key", "starts", "sizes"))):
                raw = text.as_py().encode()
                begin, end = spans_of(np.asarray(starts.values), np.asarray(sizes.values), length)
                kept = hashlib.sha256()
                at = 0
                for b, e in zip(begin.tolist(), end.tolist()):
                    kept.update(raw[at:b])
                    at = e
                kept.update(raw[at:])
                out.append((rank.as_py(), key.as_py(), int((end - begin).sum()), len(begin), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), _CUT)] if out else [pa.array([], t.type) for t in _CUT], schema=_CUT)

    return run


def repeated_starts(docs: DataFrame, length: int = LENGTH, hot: int = HOT, anchor_bytes: int = ANCHOR_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rank, key, starts, sizes`` by distinct text ``rank, key, digest, text``: runs of starts whose string a smaller rank has.

    ``rank`` orders documents and ``key`` names texts; ``starts`` and ``sizes`` are arrays. Rows of one
    digest with a larger rank than its smallest are left to the caller.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parallel = spark.sparkContext.defaultParallelism
    n_anchor, n_bucket = max(total // anchor_bytes, parallel) + 1, max(total // bucket_bytes, 4 * parallel) + 1
    long_enough = F.octet_length("text") >= length
    posts = docs.filter(long_enough).select("key", "text").mapInArrow(_post(n_anchor, length), POSTS)
    hits = materialize(posts.groupBy("bucket").applyInArrow(_keep(n_anchor, hot), KEPT), "anchors")
    heads = docs.filter(long_enough).groupBy("digest", "key").agg(F.min("rank").alias("first"))
    wanted = heads.join(hits.filter("part is not null").groupBy("part").applyInArrow(_by_text, HITS), "key").select("digest", F.col("first").alias("rank"), "vals")
    met = docs.join(wanted, ["digest", "rank"]).select("rank", "key", "text", "vals")
    runs = met.mapInArrow(_send(n_bucket, length), RUNS)
    frequent = hits.filter("part is null").select("vals")
    if not frequent.isEmpty():
        frequent = materialize(frequent.mapInArrow(_frequent, "anchor long").distinct().withColumn("hot", F.lit(True)), "frequent")
        runs = runs.join(small(frequent), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        runs = runs.select("bucket", "anchor", "rank", "key", "start", "size", "bytes", "hot").mapInArrow(_alone(n_bucket, length), RUNS)
    found = runs.select("bucket", "rank", "key", "start", "size", "bytes").groupBy("bucket").applyInArrow(_sort(length), FOUND)
    each = found.groupBy("rank", "key").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    return each.select("rank", "key", F.col("runs.start").alias("starts"), F.col("runs.size").alias("sizes"))


def without_repeats(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2("text", 256)
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"), digest.alias("digest"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"), "text")
    found = materialize(repeated_starts(docs, length, **sizes), "repeats")
    cut = docs.select("rank", "key", "text").join(small(found), ["rank", "key"]).mapInArrow(_cut(length), CUT).dropDuplicates(["rank", "key"])
    plain = docs.select("doc_id", "rank", "digest", "key", F.octet_length("text").cast("long").alias("n_bytes"))
    heads = plain.groupBy("digest").agg(F.min("rank").alias("first"))
    rows = plain.join(heads, "digest").join(cut, ["rank", "key"], "left")
    whole = (F.col("rank") > F.col("first")) & (F.col("n_bytes") >= length)
    pick = lambda all_of_it, part, none: F.when(whole, all_of_it).otherwise(F.coalesce(part, none))
    return rows.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).alias("n_removed"), pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("digest")).alias("kept_sha256"),
    )


def op11_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """
with rows as (select row_number() over () as rn, doc_id, encode(coalesce(text, '')) as b from documents),
sized as (select *, octet_length(b) as n from rows),
starts as (select rn, doc_id, b, unnest(range(1, n - 48)) as i from sized),
strings as (select rn, doc_id, i, b[i:i + 49] as s from starts),
least as (select s, min(doc_id) as low from strings group by s),
taken as (select rn, i, lag(i) over (partition by rn order by i) as before from strings join least using (s) where doc_id > low),
runs as (select rn, i, before, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by rn order by i) as run from taken),
spans as (select rn, run, min(i) as a, max(i) + 49 as z from runs group by rn, run),
gaps as (select rn, run, z + 1 as a, lead(a) over (partition by rn order by run) - 1 as z from spans union all select rn, 0, 1, min(a) - 1 from spans group by rn),
kept as (select rn, string_agg(hex(b[gaps.a:coalesce(gaps.z, n)]), '' order by run) as h from gaps join sized using (rn) where gaps.a <= coalesce(gaps.z, n) group by rn),
summed as (select rn, count(*) as n_spans, sum(z - a + 1) as n_removed from spans group by rn)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(case when n_spans is null then b else unhex(coalesce(h, '')) end) as kept_sha256
from sized left join summed using (rn) left join kept using (rn)
"""
