"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file is a parameter; it is read where it lies on each worker and never copied.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
#: Text bytes that are encoded in one step.
STEP_BYTES = 4 << 20
#: Distinct pieces and words whose ids a worker remembers; beyond it the memory is emptied and refilled.
REMEMBERED = 700_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΈ-ΊΎ-ΡΣ-ώЀ-ҁҊ-ԧ"
#: No apostrophe: the library reads some letters behind one as a unit.
_MARKS = "[!-&(-/:-@\\[-`{-~]"
_WORD = f"[{_LETTERS}]+{_MARKS}*"
#: In place of the number of a piece: texts with such a piece go through the library whole.
_ODD = -1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of many texts at once, by the tokenizers library.

    Byte-level BPE splits a text before merging: always before a single space with a visible
    character after it, around a single newline between visible characters, and between letters and
    marks such as a full stop after them. So texts are cut at spaces into pieces, and each distinct
    piece, or each distinct word and run of marks in it, goes through the library once. A piece with
    other white space inside goes through it whole, and so does a text in which white space stands
    beside a space or at an end. Ids of pieces lie one after the other in ``pool``; a text's ids are
    gathered from there.
    """

    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary or default_vocabulary())
        named = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(named.values()) + 1, dtype=bool)  # ids whose bytes begin with a space
        self.opens[[i for token, i in named.items() if token.startswith("Ġ")]] = True
        self.newline = self.whole(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        pa.default_memory_pool().release_unused()
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.held = self.known = 0
        self.starts, self.lengths = np.zeros((2, 1 << 14), dtype=np.int32)
        self.spaced: dict[str, int] = {}  # pieces behind a space
        self.bare: dict[str, int] = {}  # behind a newline or at the start of a text
        self.line = self._keep(self.newline, np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)).start

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> range:
        """Append ids to the pool; the numbers of the pieces that they make up."""
        while self.held + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + len(starts) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.pool[self.held : self.held + len(ids)] = ids
        numbers = range(self.known, self.known + len(starts))
        self.starts[numbers.start : numbers.stop], self.lengths[numbers.start : numbers.stop] = starts + self.held, lengths
        self.held, self.known = self.held + len(ids), numbers.stop
        return numbers

    def _learn(self, wanted: list[str], known: dict[str, int], mark: str) -> None:
        """Encode pieces without white space together, each behind a space or a newline, and cut the ids there."""
        for at in range(0, len(wanted), 4096):
            part = wanted[at : at + 4096]
            ids = self.whole([mark + mark.join(part)])[0]
            cuts = np.flatnonzero(ids == self.newline[0] if mark == "\n" else self.opens[ids])
            own = 1 if mark == "\n" else 0
            known.update(zip(part, self._keep(ids, cuts + own, np.diff(cuts, append=len(ids)) - own)))

    def _recall(self, wanted: pa.Array, known: dict[str, int], mark: str) -> None:
        """Make all of ``wanted`` known, as pieces behind ``mark``."""
        words = pc.match_substring_regex(wanted, f"\\A[{_LETTERS}]+\\z")
        made = pc.and_not(pc.match_substring_regex(wanted, f"\\A{_WORD}(\n{_WORD})*\\z"), words)
        plain, inner = wanted.filter(words).to_numpy(zero_copy_only=False).tolist(), []
        for piece in wanted.filter(pc.invert(pc.or_(words, made))).to_pylist():
            if not piece or piece[0].isspace() or piece[-1].isspace():
                known[piece] = _ODD
            elif len(piece.split()) == 1:
                plain.append(piece)
            else:
                inner.append(piece)
        self._learn([p for p in plain if p not in known], known, mark)
        if inner:
            ids = self.whole([mark + p if mark == " " else p for p in inner])
            sizes = np.array([len(x) for x in ids])
            known.update(zip(inner, self._keep(np.concatenate(ids), np.cumsum(sizes) - sizes, sizes)))
        pieces = wanted.filter(made)
        if len(pieces):
            parts = pc.replace_substring(pc.replace_substring_regex(pieces, f"([{_LETTERS}])({_MARKS})", "\\1\0\\2"), "\n", "\0\n\0")
            parts = pc.split_pattern(parts, "\0")
            coded, offsets = parts.flatten().dictionary_encode(), parts.offsets.to_numpy().astype(np.int64)
            names, at, firsts = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(), offsets[:-1] - offsets[0]
            used = np.zeros(len(at), dtype=np.int32)
            first = np.zeros(len(at), dtype=bool)
            first[firsts] = True
            for where, table, char in ((first, known, mark), (~first, self.bare, "\n")):
                wide = np.full(len(names), self.line, dtype=np.int32)
                mine = np.unique(at[where])
                mine = mine[names[mine] != "\n"]
                wide[mine] = self._numbers(names[mine], table, char)
                used[where] = wide[at[where]]
            ids, sizes = self._gather(used)
            sizes = np.add.reduceat(sizes, firsts)
            known.update(zip(pieces.to_numpy(zero_copy_only=False).tolist(), self._keep(ids, np.cumsum(sizes) - sizes, sizes)))

    def _gather(self, numbers: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other; a size beyond a piece's own leaves room behind it."""
        sizes = self.lengths[numbers] if sizes is None else sizes
        ends = np.cumsum(sizes)
        place = np.repeat((self.starts[numbers] - ends + sizes).astype(np.int32), sizes)
        place += np.arange(len(place), dtype=np.int32)
        return self.pool.take(place, mode="clip"), sizes

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and the number of each text's ids.

        Null texts are empty; ``end``, if given, is put behind each text.
        """
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        offsets -= offsets[0]
        pieces, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        heads, tails = at[offsets[:-1]], np.ones(len(at), dtype=bool)
        tails[offsets[:-1]] = False
        if self.known > REMEMBERED:
            self._forget()
        behind = np.zeros(len(pieces), dtype=bool)
        behind[at[tails]] = True
        numbers = np.full(len(pieces), _ODD, dtype=np.int32)
        mine = np.flatnonzero(behind)
        numbers[mine] = self._numbers(pieces[mine], self.spaced, " ")
        used = numbers[at]
        first = np.unique(heads)
        numbers[first] = self._numbers(pieces[first], self.bare, "\n")
        used[offsets[:-1]] = numbers[heads]
        strange = used == _ODD
        odd = np.flatnonzero(np.add.reduceat(strange, offsets[:-1], dtype=np.int64)) if strange.any() else ()
        sizes = self.lengths[used]
        last = offsets[1:] - 1
        alone = self.whole([texts[i].as_py() for i in odd]) if len(odd) else []
        for i, ids in zip(odd, alone):
            sizes[offsets[i] : offsets[i + 1]] = 0
            sizes[last[i]] = len(ids)
        if end is not None:
            sizes[last] += 1
        out, _ = self._gather(used, sizes)
        counts = np.add.reduceat(sizes, offsets[:-1])
        ends = np.cumsum(counts)
        for i, ids in zip(odd, alone):
            out[ends[i] - counts[i] : ends[i] - counts[i] + len(ids)] = ids
        if end is not None:
            out[ends - 1] = end
        return out, counts

    def _numbers(self, pieces: np.ndarray, known: dict[str, int], mark: str) -> np.ndarray:
        found = list(map(known.get, pieces.tolist()))
        if None in found:
            self._recall(pa.array([p for p, number in zip(pieces, found) if number is None], pa.string()), known, mark)
            found = list(map(known.get, pieces.tolist()))
        return np.array(found, dtype=np.int32)


def id_bytes(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ids as little-endian unsigned 32-bit bytes."""
    raw = np.ascontiguousarray(ids, dtype="<u4")
    ends = 4 * np.concatenate([[0], np.cumsum(counts)])
    if ends[-1] >> 31:  # beyond the offsets of one array of bytes
        return pa.array([raw[a // 4 : b // 4].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of this worker process, which keeps what it remembers from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]
