"""Operator 13 against brute force over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerscope.llm import token_alignment as T

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text, libraries) -> tuple[list, list]:
    """``(id, bytes)`` of A and B, empty if the bytes of either differ."""
    a, b = libraries
    if not text:
        return [], []
    found = a.encode(" " + text, add_special_tokens=False)
    table = T._byte_of_character()
    x = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in found.ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if b"".join(r for _, r in x) == whole == b"".join(r for _, r in y) else ([], [])


def brute(rows, libraries) -> list[tuple]:
    counts, seen = Counter(), []
    for doc_id, text in rows:
        x, y = tokens(text, libraries)
        spans = [[], []]
        for side, toks in zip(spans, (x, y)):
            at = 0
            for i, raw in toks:
                side.append((i, at, at + len(raw)))
                at += len(raw)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        counts.update(links)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in spans))
            low = cut
        seen.append((doc_id, len(x), len(y), groups, links))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(n, top.get(j, 0))
    return [(d, a, b, len(g), len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, k in seen]


def odd_rows() -> list[tuple]:
    rng = random.Random(2)
    parts = ["hello", "world", "naïve", "été", "Ünß", "Привет", "日本語", "don't", "x,y", "3.14", "foo-bar", "…", "\n", "\n\n", "  ", "\t", " ", "<|endoftext|>", "<s>", "<0x41>", "é", "\U0001f600", "ab'll", "A's,", "!?.", "\r\n", "”quoted“"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randrange(12)))) for i in range(150)]
    return rows + [(7, "again"), (None, "hello world"), (200, None), (201, ""), (202, "a▁b hello"), (203, " "), (204, "nul\0l hello"), (205, "hello, world. " * 50 + "end")]


def in_order(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_alignment_is_that_of_whole_texts(spark, libraries):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Part string").repartition(5)
    assert in_order(T.aligned(docs).collect()) == in_order(brute(rows, libraries))


def test_beyond_the_limit_shuffles_give_the_same(spark, libraries):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert in_order(T.aligned(docs, indexed=10).collect()) == in_order(brute(rows, libraries))


def test_documents_of_the_tables_and_an_empty_one(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000")
    rows = [tuple(r) for r in docs.collect()]
    assert in_order(T.aligned(docs).collect()) == in_order(brute(rows, libraries))
    assert T.aligned(docs.limit(0)).collect() == []


def test_units_are_what_whole_texts_give():
    of = T.aligner(T.default_vocabularies())
    rng = random.Random(4)
    alphabet = "abZéß ,.'-\n12#日"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(3000)]
    numbers, n, odd = of.units(pa.array(texts))
    whole = of.whole(texts)
    at = 0
    for i, k in enumerate(n.tolist()):
        if not odd[i]:
            assert b";".join(of.groups[numbers[at : at + k]].tolist()) == whole.groups[i], texts[i]
        at += k
    assert not odd.all()


def test_the_index_numbers_every_pair_once_and_finds_out_foreign_ones():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 1 << 31, size=20_000))
    blocks = T._block(pairs)
    rows = [T._hash_block(pa.table({"block": [int(b)], "pairs": pa.array([pairs[blocks == b].tobytes()], pa.binary())})).to_pylist()[0] for b in np.unique(blocks)]
    index = T.PairIndex(rows)
    assert sorted(index.numbers(pairs)) == list(range(len(pairs)))
    foreign = np.setdiff1d(rng.integers(0, 1 << 31, size=5_000), pairs)
    assert (index.numbers(foreign) == -1).all()
