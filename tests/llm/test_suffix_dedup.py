"""Operator 11 against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from ledgerscope.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string"


def brute(rows: list[tuple], length: int = 50) -> list[tuple]:
    raw = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, int] = {}
    for d, b in raw:
        for i in range(len(b) - length + 1):
            least[b[i : i + length]] = min(d, least.get(b[i : i + length], d))
    out = []
    for (d, b), (doc, _) in zip(raw, rows):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def in_order(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(200)))
        if i % 2:
            at = rng.randrange(200)
            text += passage[at : at + rng.randrange(20, 120)]
        text += "".join(rng.choice("ab") for _ in range(rng.randrange(100)))
        if i % 9 == 0:
            text += "x" * rng.randrange(40, 400)  # one string at many places of a text
        rows.append((rng.choice([i, i, rng.randrange(60)]), text))
    again = [(7, rows[3][1]), (500, rows[4][1]), (501, rows[4][1])]
    return rows + again + [(None, passage), (None, None), (503, ""), (504, passage), (504, passage)]


def test_repeats_are_those_of_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert in_order(S.without_repeats(docs).collect()) == in_order(brute(rows))


def test_frequent_anchors_split_and_small_buckets_change_nothing(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert in_order(S.without_repeats(docs, hot=3, anchor_bytes=500, bucket_bytes=300).collect()) == in_order(brute(rows))


def test_shorter_strings_and_clashing_columns(spark):
    rows = odd_rows()[:60]
    docs = spark.createDataFrame([(*r, 1, "k", "d") for r in rows], SCHEMA + ", rank long, key string, Digest string")
    assert in_order(S.without_repeats(docs, length=20).collect()) == in_order(brute(rows, 20))


def test_a_long_text_and_an_empty_table(spark):
    long = "".join(random.Random(1).choices("abcdefghij ", k=700_000))
    rows = [(1, "a" * 600_000), (2, "b" + "a" * 600_000), (3, long), (4, long[1000:]), (5, "c" * 700_000), (6, "c" * 699_000)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in S.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (600_000, 0, 0), 2: (600_001, 600_000, 1), 3: (700_000, 0, 0), 4: (699_000, 699_000, 1), 5: (700_000, 0, 0), 6: (699_000, 699_000, 1)}
    assert S.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_difference_is_one_of_the_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_suffixes_come_in_order_and_equal_ones_are_marked():
    rng = np.random.default_rng(1)
    for trial in range(40):
        base = bytes(rng.integers(97, 99 + trial % 3, size=rng.integers(60, 400)).tolist())
        buf, length = np.frombuffer(base * int(rng.integers(1, 4)), dtype=np.uint8), (50, 16, 20, 33)[trial % 4]
        places = np.sort(rng.choice(len(buf) - length + 1, size=min(len(buf) - length + 1, 200), replace=False))
        order, same = S.sorted_suffixes(buf, places, length)
        strings = [buf.tobytes()[p : p + length] for p in order]
        assert strings == sorted(strings) and sorted(order) == places.tolist()
        assert same.tolist() == [i > 0 and strings[i] == strings[i - 1] for i in range(len(strings))]
