"""Simple-8b: unsigned integers packed into 64-bit words under a 4-bit selector.

The selector (top four bits) says how many values of how many bits the other 60 bits hold, the
first value lowest. Values of 60 bits or more do not fit a word: their place holds zero and the
block keeps them apart as escapes (position, value). A block starts on a word boundary and says
how many values it holds, so blocks decode on their own and every selector decodes as one array.
"""

from __future__ import annotations

import numpy as np

#: Values per word, by selector 0..13, and the bits of each.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_LIMIT = np.uint64(1) << np.uint64(60)


_SHORT = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    if not len(values) or int(values.max()) < 1 << 16:
        return _SHORT[values.astype(np.uint16)]
    out = np.ones(len(values), dtype=np.uint8)
    for width in range(1, 60):
        more = values >> np.uint64(width) != 0
        if not more.any():
            break
        out += more
    return out


def encode(values: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, bytes]:
    """Pack the runs of ``values`` that stop at ``ends``, each from a word boundary.

    Returns the words as little-endian bytes, the first word of each run, and the escapes as pairs
    of little-endian 64-bit integers. The last word of a run may hold values of the next one, which
    decoding cuts off by the length of the run.
    """
    values, ends = np.asarray(values, dtype=np.uint64), np.asarray(ends, dtype=np.int64)
    n = len(values)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if not n:
        return b"", np.zeros(len(ends), dtype=np.int64), b""
    far = np.flatnonzero(values >= _LIMIT)
    escapes = np.stack([far.astype(np.uint64), values[far]], axis=1).astype("<u8").tobytes()
    if len(far):
        values = values.copy()
        values[far] = 0
    bits = _bits(values)
    step = np.ones(n, dtype=np.int64)
    selector = np.full(n, len(BITS) - 1, dtype=np.uint8)
    most = int(bits.max())
    left = None  # the places where the selector before fits; others can't fit one of more values of fewer bits
    for s in range(len(BITS) - 2, -1, -1):
        c = COUNTS[s]
        if most <= BITS[s]:
            selector[:], step[:] = s, c
            continue
        wide = np.zeros(n + c, dtype=np.int32)
        np.cumsum(bits > BITS[s], out=wide[1 : n + 1])
        wide[n + 1 :] = wide[n]
        left = np.flatnonzero(wide[c:] == wide[:n]) if left is None else left[wide[left + c] == wide[left]]
        if not len(left):
            break
        selector[left], step[left] = s, c
    after = np.minimum(np.arange(n) + step, np.repeat(ends, ends - begins))
    # every eighth word is found one by one, those between by following eight at a time
    far = np.append(after, n)
    for _ in range(3):
        far = far[far]
    far, eighths, i = far.tolist(), [], 0
    while i < n:
        eighths.append(i)
        i = far[i]
    starts, after = np.empty((8, len(eighths)), dtype=np.int64), np.append(after, n)
    starts[0] = eighths
    for j in range(1, 8):
        starts[j] = after[starts[j - 1]]
    starts = starts.T.ravel()
    starts = starts[starts < n]
    used = selector[starts]
    padded = np.concatenate([values, np.zeros(60, dtype=np.uint64)])
    words = used.astype(np.uint64) << np.uint64(60)
    for s in np.unique(used):
        mine = np.flatnonzero(used == s)
        at, held = starts[mine], np.zeros(len(mine), dtype=np.uint64)
        for j in range(COUNTS[s]):
            held |= padded[at + j] << np.uint64(j * BITS[s])
        words[mine] |= held
    return words.astype("<u8").tobytes(), np.searchsorted(starts, begins), escapes


def decode(words: bytes, first: np.ndarray, counts: np.ndarray, escapes: bytes) -> list[np.ndarray]:
    """The runs of a block from its words, the first word and the length of each run, and the escapes."""
    packed = np.frombuffer(words, dtype="<u8")
    used = (packed >> np.uint64(60)).astype(np.intp)
    held = COUNTS[used]
    starts = np.concatenate([[0], np.cumsum(held)])
    out = np.zeros(int(starts[-1]), dtype=np.uint64)
    for s in np.unique(used):
        mine = np.flatnonzero(used == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        at, held = starts[mine], packed[mine]
        for j in range(COUNTS[s]):
            out[at + j] = (held >> np.uint64(j * BITS[s])) & mask
    runs = [out[starts[a] : starts[a] + n] for a, n in zip(first, counts)]
    if escapes:
        ends = np.cumsum(counts)
        for place, value in np.frombuffer(escapes, dtype="<u8").reshape(-1, 2):
            run = int(np.searchsorted(ends, place, "right"))
            runs[run][int(place) - int(ends[run] - counts[run])] = value
    return runs
