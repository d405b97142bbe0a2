"""Operator 13: how the tokens of two tokenizers overlap, and how often each pair of ids does.

Both tokenizers read a space and the text, as bytes. Places where tokens of both end cut a text into
groups; a link is a pair of token occurrences whose bytes overlap. Pairs of ids are counted over the
whole corpus, and each document's links are judged by these counts:

1. *First pass.* Each task aligns its documents and counts the pairs of ids that it meets.
2. *Index.* The distinct pairs get a minimal perfect hash, built by blocks of pairs: a pair takes the
   first of some bit tables in which no other pair of its block falls on the same bit; its number is
   the number of bits set before. The key of each number is kept, so a foreign pair is found out.
3. *Tree of sums.* Tasks' counts become dense vectors under these numbers, a vector for each block,
   and are summed ``FAN`` at a time until one vector is left.
4. *Second pass.* Documents are aligned again, and the counts of their pairs looked up.

The index and the vectors are sent to all tasks behind a count of the pairs. Beyond ``INDEXED`` pairs
counts are summed and looked up by shuffles.

Neither tokenizer has a token over the border between a visible character and the space behind it,
around a single newline or between a letter and a mark behind it (tests hold this against whole
texts), so texts are cut there, and each distinct unit goes through both tokenizers once in a while.
A text in which white space stands otherwise goes through them whole.

Defined results: texts that are null, empty, or not given back byte by byte by one of the tokenizers
(one with U+2581, say) have no tokens, zeros and an empty ``groups_sha256``; rows that repeat a
``doc_id`` are counted and returned each; a null ``doc_id`` is returned as null; an empty table gives no
rows; further columns are ignored. Ids are below 2^17 for A and below 2^15 for B.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.text import mix, slices
from ledgerscope.session import materialize

#: Letters, and marks that are no apostrophe (A reads some letters behind one as a unit).
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΈ-ΊΎ-ΡΣ-ώЀ-ҁҊ-ԧ"
_MARKS = "!-&(-/:-@\\[-`{-~"
#: A unit that can be read alone: visible characters behind one space or none.
_UNIT = "\\A ?[^\\s\\p{Z}\\p{C}\u2581]+\\z"
#: Units that a worker remembers; beyond it the memory is emptied.
REMEMBERED = 500_000
STEP_BYTES = 4 << 20
BLOCKS, LEVELS, FAN = 256, 24, 16
#: Distinct pairs whose index is sent to all tasks: about 20 bytes each.
INDEXED = 8_000_000
_B_BITS = 15
_U = np.uint64


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Aligned:
    """Alignments of texts in a row: numbers by text, pairs of all links, and the groups as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: list[bytes]


class Aligner:
    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        of = _byte_of_character()
        named = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in named.items():
            self.a_bytes[i] = bytes(of.get(c, 0) for c in token)
        raw = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("\u2581", " ").encode()
        self.b_bytes = [raw(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        opens = lambda table: np.array([x[:1] == b" " for x in table])
        self.a_opens, self.b_opens = opens(self.a_bytes), opens(self.b_bytes)
        self.a_line, self.b_line = self.a_bytes.index(b"\n"), self.b_bytes.index(b"\n")
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.epoch = uuid.uuid4().hex
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.pairs = np.zeros(0, dtype=np.int64)
        self.groups: np.ndarray = np.zeros(0, dtype=object)
        self.starts = np.zeros(1, dtype=np.int64)

    def _ids_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.int64) for x in self.b.encode(texts, num_threads=1)]

    def _align(self, raw: list[bytes], ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> Aligned:
        """Align texts of which both tokenizers give back all bytes; others have no tokens."""
        whole = np.array([len(r) for r in raw], dtype=np.int64)
        sums = lambda size, ids, n: np.diff(np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(n)])])
        fits = (sums(self.a_size, ids_a, n_a) == whole) & (sums(self.b_size, ids_b, n_b) == whole)
        text = b"".join(raw)
        if not fits.all() or b"".join(map(self.a_bytes.__getitem__, ids_a)) != text or b"".join(map(self.b_bytes.__getitem__, ids_b)) != text:
            ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
            for i in np.flatnonzero(fits):
                a, b = ids_a[ends_a[i] - n_a[i] : ends_a[i]], ids_b[ends_b[i] - n_b[i] : ends_b[i]]
                fits[i] = b"".join(map(self.a_bytes.__getitem__, a)) == raw[i] and b"".join(map(self.b_bytes.__getitem__, b)) == raw[i]
            ids_a, ids_b, n_a, n_b = ids_a[np.repeat(fits, n_a)], ids_b[np.repeat(fits, n_b)], np.where(fits, n_a, 0), np.where(fits, n_b, 0)
            whole = np.where(fits, whole, 0)
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        bounds = np.cumsum(whole)
        per = lambda ends: np.diff(np.searchsorted(ends, bounds, "right"), prepend=0)
        # the B tokens that overlap an A token: from the first that ends behind its start to the first that ends at its end or behind
        low = np.searchsorted(end_b, end_a - self.a_size[ids_a], "right")
        n = np.searchsorted(end_b, end_a, "left") - low + 1
        left, place = np.repeat(np.arange(len(ids_a)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pairs = (ids_a[left] << _B_BITS) | ids_b[low[left] + place]
        links = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(n_a)])])
        cuts_a, cuts_b = (np.concatenate([[0], np.searchsorted(e, common, "right")]).tolist() for e in (end_a, end_b))
        named_a, named_b = (list(map(self.names.__getitem__, x.tolist())) for x in (ids_a, ids_b))
        each = [",".join(named_a[i:j]) + "|" + ",".join(named_b[k:m]) for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
        n_groups = per(common)
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        return Aligned(n_a, n_b, n_groups, links, pairs, [";".join(each[i:j]).encode() for i, j in zip(at, at[1:])])

    def whole(self, texts: list[str | None]) -> Aligned:
        """Alignments of texts read whole."""
        texts = [t or "" for t in texts]
        a, b = self._ids_a([" " + t for t in texts]), self._ids_b(texts)
        n = [np.array([len(x) for x in ids], dtype=np.int64) for ids in (a, b)]
        none = np.zeros(0, dtype=np.int64)
        return self._align([(" " + t).encode() for t in texts], np.concatenate([none, *a]), n[0], np.concatenate([none, *b]), n[1])

    def _learn(self, units: list[str]) -> None:
        """Align new units: those behind a space together, each behind a newline otherwise."""
        found: list[Aligned] = []
        spaced, bare = [u for u in units if u[0] == " "], [u for u in units if u[0] != " " and u != "\n"]
        for some in (spaced, bare):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                if some is spaced:
                    a, b = self._ids_a(["".join(part)])[0], self._ids_b(["".join(part)[1:]])[0]
                    cut_a, cut_b = np.flatnonzero(self.a_opens[a]), np.flatnonzero(self.b_opens[b])
                    n_a, n_b = np.diff(cut_a, append=len(a)), np.diff(cut_b, append=len(b))
                else:
                    a, b = self._ids_a(["\n" + "\n".join(part)])[0], self._ids_b(["\n" + "\n".join(part)])[0][1:]
                    cut_a, cut_b = np.flatnonzero(a == self.a_line), np.flatnonzero(b == self.b_line)
                    n_a, n_b = np.diff(cut_a, append=len(a)) - 1, np.diff(cut_b, append=len(b)) - 1
                    a, b = a[a != self.a_line], b[b != self.b_line]
                found.append(self._align([u.encode() for u in part], a, n_a, b, n_b))
        if "\n" in units:
            one = np.ones(1, dtype=np.int64)
            found.append(self._align([b"\n"], one * self.a_line, one, one * self.b_line, one))
        names = spaced + bare + ["\n"] * ("\n" in units)
        first = len(self.n_a)
        for c in ("n_a", "n_b", "n_groups", "n_links", "pairs"):
            setattr(self, c, np.concatenate([getattr(self, c), *(getattr(f, c) for f in found)]))
        more = np.empty(len(names), dtype=object)
        more[:] = [g for f in found for g in f.groups]
        self.groups = np.concatenate([self.groups, more])
        self.starts = np.concatenate([[0], np.cumsum(self.n_links)])
        self.known.update(zip(names, range(first, first + len(names))))

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the units of texts, units by text, and which texts are to be read whole (they have no units)."""
        given = pc.fill_null(texts.cast(pa.large_string()), "")
        # a NUL marks each cut; texts with one of their own are odd
        cut = pc.replace_substring(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), given, pa.scalar("", pa.large_string())), " ", "\0 "), "\n", "\0\n\0")
        cut = pc.replace_substring_regex(cut, f"([{_LETTERS}])([{_MARKS}])", "\\1\0\\2")
        lists = pc.split_pattern(pc.utf8_slice_codeunits(cut, 1), "\0")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        offsets = offsets - offsets[0]
        at, n = coded.indices.to_numpy(), np.diff(offsets)
        plain = pc.or_(pc.match_substring_regex(coded.dictionary, _UNIT), pc.equal(coded.dictionary, "\n")).to_numpy(zero_copy_only=False)
        odd = np.add.reduceat(~plain[at], offsets[:-1], dtype=np.int64) > 0 if len(at) else np.zeros(len(n), dtype=bool)
        # a text's own NUL makes a cut where none belongs
        odd |= pc.match_substring(given, "\0").to_numpy(zero_copy_only=False)
        used = np.repeat(~odd, n)
        at, n = at[used], np.where(odd, 0, n)
        if len(self.known) > REMEMBERED:
            self._forget()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        mine = np.unique(at)
        numbers = np.zeros(len(names), dtype=np.int64)
        found = list(map(self.known.get, names[mine].tolist()))
        if None in found:
            self._learn([x for x, f in zip(names[mine].tolist(), found) if f is None])
            found = list(map(self.known.get, names[mine].tolist()))
        numbers[mine] = found
        return numbers[at], n, odd


def _per(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``n`` at a time."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(n)])])


def lost(of: Aligner, numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Texts with a unit that isn't given back: it takes the whole text with it."""
    return _per(of.n_a[numbers] == 0, n) > 0


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(vocabularies: tuple[str, str]) -> Aligner:
    """The aligner of this worker process, which keeps what it remembers from task to task."""
    if vocabularies not in _ALIGNERS:
        _ALIGNERS[vocabularies] = Aligner(*vocabularies)
    return _ALIGNERS[vocabularies]


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and their counts summed."""
    keys, nth = np.unique(pairs, return_inverse=True)
    return keys, np.bincount(nth, weights=None, minlength=len(keys)) if counts is None else _added(nth, counts, len(keys))


def _added(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, at, counts)
    return out


def _block(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs.astype(_U)) >> _U(56)).astype(np.int64) % BLOCKS


COUNTED = "part long, block long, pairs binary, counts binary"
_COUNTED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())])


def _rows(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    block = _block(keys)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
    rows = [{"part": part, "block": int(block[i[0]]), "pairs": keys[i].astype("<i8").tobytes(), "counts": counts[i].astype("<i8").tobytes()} for i in np.split(order, cuts[1:]) if len(i)]
    return pa.RecordBatch.from_pylist(rows, schema=_COUNTED)


def _count(vocabularies: tuple[str, str]) -> Callable:
    """First pass: the pairs of a task and their counts, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part = aligner(vocabularies), TaskContext.get().partitionId()
        keys = sums = np.zeros(0, dtype=np.int64)
        seen = np.zeros(0, dtype=np.int64)

        def settle() -> None:
            """Counts of units become counts of pairs."""
            nonlocal keys, sums, seen
            n = len(seen)
            if n:
                pairs = of.pairs[: of.starts[n]]
                keys, sums = _summed(np.concatenate([keys, pairs]), np.concatenate([sums, np.repeat(seen, of.n_links[:n])]))
            seen = np.zeros(0, dtype=np.int64)

        for batch in batches:
            for texts in (s.column("text") for s in slices(batch, limit=STEP_BYTES)):
                if len(of.known) > REMEMBERED:
                    settle()
                numbers, n, odd = of.units(texts)
                numbers = numbers[np.repeat(~lost(of, numbers, n), n)]
                more = np.bincount(numbers, minlength=len(of.n_a))
                more[: len(seen)] += seen
                seen = more
                if odd.any():
                    pairs = of.whole(texts.filter(pa.array(odd)).to_pylist()).pairs
                    keys, sums = _summed(np.concatenate([keys, pairs]), np.concatenate([sums, np.ones(len(pairs), dtype=np.int64)]))
        settle()
        if len(keys):
            yield _rows(part, keys, sums)

    return run


class PairIndex:
    """A minimal perfect hash of pairs, built by blocks of bit tables, with the pair of each number."""

    def __init__(self, blocks: list[dict]):
        self.size = np.ones((BLOCKS, LEVELS), dtype=np.int64)
        self.base = np.zeros((BLOCKS, LEVELS), dtype=np.int64)
        at, bits = 1, [np.zeros(1, dtype=bool)]  # a level that a block lacks is one bit that is not set
        self.first = np.zeros(BLOCKS + 1, dtype=np.int64)
        keys, blocks = [], {b["block"]: b for b in blocks}
        for b in range(BLOCKS):
            row = blocks.get(b)
            for level, size in enumerate(row["sizes"] if row else ()):
                self.size[b, level], self.base[b, level] = size, at
                at += size
            if row:
                bits.append(np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8))[: sum(row["sizes"])].astype(bool))
                keys.append(np.frombuffer(row["pairs"], dtype="<i8"))
            self.first[b + 1] = self.first[b] + (len(keys[-1]) if row else 0)
        self.bits = np.concatenate(bits)
        self.rank = (np.cumsum(self.bits) - 1).astype(np.int32)
        self.keys = np.concatenate([np.zeros(0, dtype=np.int64), *keys])

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 for a pair that the first pass has not met."""
        block, out = _block(pairs), np.full(len(pairs), -1, dtype=np.int64)
        left = np.arange(len(pairs))
        for level in range(LEVELS):
            place = self.base[block[left], level] + _place(pairs[left], level, self.size[block[left], level])
            hit = self.bits[place]
            out[left[hit]] = self.rank[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        if len(self.keys):
            out[self.keys[out] != pairs] = -1  # the bit of another pair
        return out


def _place(pairs: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (mix(pairs.astype(_U) + _U(1 + level) * _U(0x9E3779B97F4A7C15)) % np.asarray(size).astype(_U)).astype(np.int64)


HASHED = "block long, sizes array<long>, bits binary, pairs binary"


def _hash_block(group: pa.Table) -> pa.Table:
    """Bit tables of a block: each level takes the pairs that are alone on their bit; the last is large enough for all that is left."""
    left = np.unique(np.concatenate([np.frombuffer(x.as_py(), dtype="<i8") for x in group.column("pairs")]))
    sizes, bits, keys = [], [], []
    while len(left):
        size = 2 * len(left) + 1 if len(sizes) < LEVELS - 8 else max(64, len(left) ** 2) * 8
        place = _place(left, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        mine = alone[place]
        order = np.argsort(place[mine])
        sizes.append(size)
        bits.append(alone)
        keys.append(left[mine][order])
        left = left[~mine]
        if len(sizes) == LEVELS and len(left):
            raise RuntimeError("no perfect hash within the levels")
    row = {"block": group.column("block")[0].as_py(), "sizes": sizes, "bits": np.packbits(np.concatenate(bits)).tobytes(), "pairs": np.concatenate(keys).tobytes()}
    return pa.Table.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("pairs", pa.binary())]))


def _union(group: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([np.frombuffer(x.as_py(), dtype="<i8") for x in group.column("pairs")]))
    return pa.table({"part": group.column("part")[:1], "block": group.column("block")[:1], "pairs": pa.array([keys.tobytes()], pa.binary())})


VECTOR = "part long, block long, counts binary"
_VECTOR = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("counts", pa.binary())])


def _dense(index) -> Callable:
    """Counts of a task under the numbers of the index: a vector for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index.value
        for batch in batches:
            rows = []
            for part, block, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
                vector = np.zeros(of.first[block + 1] - of.first[block], dtype="<i8")
                vector[of.numbers(np.frombuffer(pairs, dtype="<i8")) - of.first[block]] = np.frombuffer(counts, dtype="<i8")
                rows.append((part, block, vector.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _VECTOR)] if rows else [pa.array([], f.type) for f in _VECTOR], schema=_VECTOR)

    return run


def _sum(group: pa.Table) -> pa.Table:
    total = None
    for x in group.column("counts"):
        vector = np.frombuffer(x.as_py(), dtype="<i8")
        total = vector.copy() if total is None else total + vector
    return pa.table({"part": group.column("part")[:1], "block": group.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _tree(df: DataFrame, fold: Callable, schema: str, parts: int) -> DataFrame:
    """Fold rows of a block, FAN parts at a time, until each block has one row."""
    while parts > 1:
        df = df.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("block", "part").applyInArrow(fold, schema)
        parts = -(-parts // FAN)
    return df


@dataclass(frozen=True)
class Counts:
    """Numbers of pairs, their counts, and the highest count of each B id."""

    index: PairIndex
    counts: np.ndarray
    highest: np.ndarray

    def judged(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair (0 for a foreign one), and whether it is the highest of its B id."""
        numbers = self.index.numbers(pairs)
        counts = np.where(numbers >= 0, self.counts[numbers], 0) if len(self.counts) else np.zeros(len(pairs), dtype=np.int64)
        return counts, (counts > 0) & (counts == self.highest[pairs & ((1 << _B_BITS) - 1)])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _hashed(of: Aligner, numbers: np.ndarray, n: np.ndarray, gone: np.ndarray) -> list[str]:
    ends = np.cumsum(n)
    return [hashlib.sha256(b";".join(of.groups[numbers[e - k : e]].tolist())).hexdigest() if k and not x else "" for e, k, x in zip(ends.tolist(), n.tolist(), gone.tolist())]


def _look_up(counts, vocabularies: tuple[str, str]) -> Callable:
    """Second pass: documents aligned again, their links judged by the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = aligner(vocabularies), counts.value
        epoch, best, total, least = None, None, None, None
        for batch in batches:
            for part in slices(batch, limit=STEP_BYTES):
                texts = part.column("text")
                numbers, n, odd = of.units(texts)
                if epoch != of.epoch:
                    epoch, (best, total, least) = of.epoch, np.zeros((3, 0), dtype=np.int64)
                if len(of.n_a) > len(best):
                    # sums of the links of each new unit; the worker may know units of other tables, whose pairs have no count here
                    count, top = table.judged(of.pairs[of.starts[len(best)] :])
                    links = of.n_links[len(best) :]
                    best, total, least = (np.concatenate([old, _per(new, links)]) for old, new in ((best, top), (total, count), (least, count == 0)))
                gone = lost(of, numbers, n)
                out = [np.where(gone, 0, _per(u[numbers], n)) for u in (of.n_a, of.n_b, of.n_groups, of.n_links, best, total)]
                foreign = (_per(least[numbers], n) > 0) & ~gone
                hashes = _hashed(of, numbers, n, gone)
                where = np.flatnonzero(odd)
                if len(where):
                    found = of.whole(texts.take(pa.array(where)).to_pylist())
                    count, top = table.judged(found.pairs)
                    foreign[where] = _per(count == 0, found.n_links) > 0
                    for column, values in zip(out, (found.n_a, found.n_b, found.n_groups, found.n_links, _per(top, found.n_links), _per(count, found.n_links))):
                        column[where] = values
                    for i, groups, k in zip(where.tolist(), found.groups, found.n_a.tolist()):
                        hashes[i] = hashlib.sha256(groups).hexdigest() if k else ""
                if foreign.any():
                    raise KeyError("a pair of ids that the first pass has not met")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in out), pa.array(hashes, pa.string())], schema=_RESULT)

    return run


LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_LINKED = pa.schema([*((c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _linked(vocabularies: tuple[str, str]) -> Callable:
    """Documents with their distinct pairs, for counts that are looked up by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(vocabularies)
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                found = of.whole([text])
                keys, times = np.unique(found.pairs, return_counts=True)
                n = int(found.n_a[0])
                rows.append({"row": row, "doc_id": doc_id, "n_a": n, "n_b": int(found.n_b[0]), "n_groups": int(found.n_groups[0]), "n_links": int(found.n_links[0]), "groups_sha256": hashlib.sha256(found.groups[0]).hexdigest() if n else "", "pairs": keys, "times": times})
            yield pa.RecordBatch.from_pylist(rows, schema=_LINKED)

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(pairs, dtype="<i8")), pa.array(np.frombuffer(counts, dtype="<i8"))], names=["pair", "count"])


def _by_join(docs: DataFrame, counted: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """The same result with counts summed and looked up by shuffles, whatever their number."""
    b_id = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    counts = materialize(counted.select("pairs", "counts").mapInArrow(_exploded, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count")), "pair-counts")
    judged = counts.join(counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("top")), b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_linked(vocabularies), LINKED), "linked")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(judged, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select(*(f.name for f in _RESULT))


def pair_index(counted: DataFrame, parts: int) -> PairIndex:
    """The index of all pairs of the first pass; the caller has checked how many there are."""
    hashed = _tree(counted.select("part", "block", "pairs"), _union, "part long, block long, pairs binary", parts).groupBy("block").applyInArrow(_hash_block, HASHED)
    return PairIndex([r.asDict() for r in hashed.collect()])


def aligned(docs: DataFrame, vocabularies: tuple[str, str] | None = None, indexed: int = INDEXED) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs(doc_id, text)``."""
    spark, vocabularies = docs.sparkSession, vocabularies or default_vocabularies()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = materialize(docs.select("text").mapInArrow(_count(vocabularies), COUNTED), "pairs")
    size = counted.agg(F.coalesce(F.max("part"), F.lit(-1)) + 1, F.count("*")).first()
    merged = materialize(_tree(counted.select("part", "block", "pairs"), _union, "part long, block long, pairs binary", size[0]), "distinct-pairs")
    distinct = merged.agg(F.coalesce(F.sum(F.octet_length("pairs")), F.lit(0))).first()[0] // 8
    if distinct > indexed:
        return _by_join(docs, counted, vocabularies)
    index = pair_index(merged, 1)
    sent = spark.sparkContext.broadcast(index)
    vectors = _tree(counted.select("part", "block", "pairs", "counts").mapInArrow(_dense(sent), VECTOR), _sum, VECTOR, size[0])
    counts = np.zeros(len(index.keys), dtype=np.int64)
    for row in vectors.collect():
        counts[index.first[row["block"]] : index.first[row["block"] + 1]] = np.frombuffer(row["counts"], dtype="<i8")
    highest = np.zeros(1 << _B_BITS, dtype=np.int64)
    np.maximum.at(highest, index.keys & ((1 << _B_BITS) - 1), counts)
    return docs.mapInArrow(_look_up(spark.sparkContext.broadcast(Counts(index, counts, highest)), vocabularies), RESULT)


def op13_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
