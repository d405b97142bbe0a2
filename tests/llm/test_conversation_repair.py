"""Operator 12 against a search over all edits, and against its SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from ledgerscope.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0, 1, 1, 2)[min(kind, 3)] if kind <= 3 else [(conv, turn, "user" if kind == 4 else role, text)]
    return out


def brute_edits(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, str]:
    """Cheapest and then least edits of ``role, text, gone, cut``, over all prefixes of edits by cost and letters."""
    import heapq

    heap, done = [(0, "", 0, "", "")], set()
    finals = []
    while heap:
        cost, letters, i, initials, text = heapq.heappop(heap)
        if finals and cost > finals[0][0]:
            break
        if (letters, i, initials) in done:
            continue
        done.add((letters, i, initials))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            finals.append((cost, letters, text[1:]))
        if not re.fullmatch("s?(ua)*u?", initials) or cost > 4 * len(rows) + 6:
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, letters + "I", i, initials + role[0], f"{text}\n{role}:"))
        if i < len(rows):
            role, words, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, initials, text))
            if not gone:
                heapq.heappush(heap, (cost + 3 * cut, letters + "K", i + 1, initials + (role[:1] or "?"), f"{text}\n{role}:{words}"))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + 3 * cut, letters + "R", i + 1, initials + new[0], f"{text}\n{new}:{words}"))
    return min(finals)


def brute(rows: list[tuple]) -> list[tuple]:
    after, out = brute_damage(rows), []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
            if fault:
                counts[fault] += 1
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2] or "")[:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, text = brute_edits(faults) if mine else (0, "", "")
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def some_rows(conversations: int, most: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Hello.", "Hello", "How are you?", "", " \t", "Fine!", "é.", "well. ", "x", None]
    return [(c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"Row {rng.randrange(99)}.") for c in [*range(conversations), None] for t in range(rng.randrange(1, most))]


def in_order(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def run(spark, rows: list[tuple], schema: str = SCHEMA, **options):
    given = spark.createDataFrame(rows, schema).repartition(4)
    ids = given.selectExpr("coalesce(cast(conv_id as string), ' ') as key", "conv_id")
    return in_order(C.repair(C.damaged(given), ids, **options).collect())


@pytest.mark.parametrize("block", [64, 2])
def test_edits_are_the_cheapest_and_least(spark, block):
    rows = some_rows(60, 7)
    assert run(spark, rows, block=block) == in_order(brute(rows))


def test_long_conversations_in_blocks_are_those_in_one_and_of_the_sql(spark):
    rows = some_rows(6, 120, seed=3)
    whole = run(spark, rows, block=1000)
    assert run(spark, rows, block=7) == whole
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toArrow())
    assert in_order(con.sql(C.OP12_SQL).fetchall()) == whole


def test_the_tables_agree_with_the_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert in_order(C.op12_auction_repair(spark, sf_dir).collect()) == in_order(con.sql(C.OP12_SQL).fetchall())


def test_empty_and_clashing(spark):
    assert run(spark, []) == []
    rows = some_rows(10, 5, seed=9)
    clashing = spark.createDataFrame([(*r, "k", 1, "c") for r in rows], SCHEMA + ", Key string, n long, kind string")
    ids = clashing.selectExpr("coalesce(cast(conv_id as string), ' ') as key", "conv_id")
    assert in_order(C.repair(C.damaged(clashing), ids).collect()) == in_order(brute(rows))


def test_prices_never_exceed_an_arc_and_its_end():
    rng = random.Random(0)
    for _, n in itertools.product(range(20), range(6)):
        lattice = C.Lattice("".join(rng.choices("sua?", k=n)), [rng.random() < 0.3 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)], C.ENDS)
        price = lattice.auction(0)
        assert all(price[i] <= cost + price[end] for i, arcs in enumerate(lattice.arcs) for _, cost, end in arcs)
