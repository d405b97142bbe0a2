"""Operator 12: repair of conversations by an auction for cheapest edits.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its rows are kept, given another role or
deleted, and empty rows are inserted; each edit has an integer cost. Places in the rows times what may
come next (``Z``: nothing yet, ``S``: behind the system row, ``U``: behind a user, ``A``: behind an
assistant) make up a lattice, and cheapest edits are a shortest path through it.

The path is found by an auction. Nodes have prices, none above the cost of an arc plus the price at
its end. A path begins at the origin. Where the price of its last node is below the best arc's cost
plus price, it is raised to that and the path contracts by this node; else the path is extended along
the best arc, until it ends. Then the prices differ by the costs of all cheapest paths: their arcs are
the tight ones, and following tight arcs in the order of their letters gives the least audit.

Rows are sorted over the whole table and cut into blocks of ``BLOCK`` rows of one conversation, so a
conversation of any length is spread over tasks. A block's costs from each state to each are found by
auctions of their own; a conversation's blocks meet as one row of 16 numbers each, which give the
prices at their borders. Each block is then traced by itself from all states, and the states at
borders, one row a block again, pick the traces. The last step reads a conversation's repaired rows
in order, for its hash and its audit; this is the one task that follows the length of a
conversation, as these two values do themselves.

Defined results: rows are in the order of turn (nulls first), role, text; null roles and texts read as
one space, and so does a null ``conv_id`` in the rows' check sum, while null ids make one conversation
whose id is null; equal rows are one row and its duplicates; roles that begin with none of s, u, a (empty ones too) are
given another role or deleted; a conversation without rows has zeros, an empty audit and the hash of
the empty string; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.session import materialize

#: Rows of a conversation that one auction covers.
BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
STATES = "ZSUA"
#: The state behind a row with an initial, by the state before.
NEXT = {"Z": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
_STEP = [{c: STATES.index(n) for c, n in NEXT[q].items()} for q in STATES]
#: The initial that a new row or a new role has, and the state behind it.
_NEW = ["u", "u", "a", "u"]
_AFTER = [_STEP[q][_NEW[q]] for q in range(4)]
_ROLE = {"u": "user", "a": "assistant"}
#: The letters of what is missing behind the last row, and their cost. Blocks insert before rows alone.
TAIL = ["", "II", "I", ""]
ENDS = {q: INSERT * len(t) for q, t in enumerate(TAIL)}


class Lattice:
    """The edits of a block of rows, given by initials, rows that must go, and rows cut short."""

    def __init__(self, initials: str, gone: list[bool], cut: list[bool], ends: dict[int, int]):
        self.n, self.ends = len(initials), ends
        self.sink = 4 * (self.n + 1)
        self.arcs: list[list[tuple[str, int, int]]] = []
        for i in range(self.n + 1):
            for q in range(4):
                out = []
                if i < self.n:
                    out.append(("D", DELETE, 4 * (i + 1) + q))
                    out.append(("I", INSERT, 4 * i + _AFTER[q]))
                if i < self.n and not gone[i]:
                    more = TRUNCATED * cut[i]
                    if initials[i] in _STEP[q]:
                        out.append(("K", KEEP + more, 4 * (i + 1) + _STEP[q][initials[i]]))
                    out.append(("R", REROLE + more, 4 * (i + 1) + _AFTER[q]))
                if i == self.n and q in ends:
                    out.append(("", ends[q], self.sink))
                self.arcs.append(out)

    def auction(self, origin: int) -> list[int] | None:
        """Prices when a path from the origin has reached the sink; none if there is no path."""
        price = [0] * (self.sink + 1)
        # inserting two rows and deleting all is a path from anywhere to U and A; beyond its cost there is no path
        bound = DELETE * self.n + 2 * INSERT + max(self.ends.values(), default=0)
        path = [origin]
        while path[-1] != self.sink:
            node = path[-1]
            best, to = bound + 1, None
            for _, cost, end in self.arcs[node]:
                if cost + price[end] < best:
                    best, to = cost + price[end], end
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
                elif best > bound:
                    return None
            else:
                path.append(to)
        return price

    def cost(self, origin: int) -> int | None:
        price = self.auction(origin)
        return None if price is None else price[origin] - price[self.sink]

    def trace(self, origin: int) -> tuple[int, str, int] | None:
        """Cost, least letters and last state of the cheapest ways: tight arcs are followed in the order of their letters."""
        price = self.auction(origin)
        if price is None:
            return None
        dead: set[int] = set()
        way: list[tuple[int, str]] = [(origin, "")]
        turn = [0]
        while way[-1][0] != self.sink:
            node = way[-1][0]
            arcs = self.arcs[node]
            while turn[-1] < len(arcs):
                letter, cost, end = arcs[turn[-1]]
                turn[-1] += 1
                if price[node] == cost + price[end] and end not in dead:
                    way.append((end, letter))
                    turn.append(0)
                    break
            else:
                dead.add(node)
                way.pop()
                turn.pop()
        return price[origin] - price[self.sink], "".join(letter for _, letter in way), way[-2][0] % 4


def repaired(letters: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The rows behind edits from a state on, as ``role:text``."""
    out, i = [], 0
    for letter in letters:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = _STEP[state][roles[i][:1]]
        else:
            out.append(f"{_ROLE[_NEW[state]]}:{texts[i] if letter == 'R' else ''}")
            state = _AFTER[state]
        i += letter != "I"
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``key, conv_id, turn, role, text`` of the rows after the contract's damage."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select(space("conv_id").alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.filter("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


_VISIBLE = "[^\\x20\\x09-\\x0D]"


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``n``, how often each is there, ``again``, whether an earlier row has its role and text, ``blank`` and ``cut``."""
    each = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n"))
    first = each.groupBy("key", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("first"))).alias("first"))
    blank = ~F.col("text").rlike(_VISIBLE)
    later = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("first")) > F.col("first")
    return each.join(first, ["key", "role", "text"]).select("key", "turn", "role", "text", "n", blank.alias("blank"), later.alias("again"), (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("cut"))


BLOCKS = "key string, part long, nth long, roles array<string>, texts array<string>, gone array<boolean>, cut array<boolean>"
_LIST = lambda t: pa.list_(t)
_BLOCKS = pa.schema([("key", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("roles", _LIST(pa.string())), ("texts", _LIST(pa.string())), ("gone", _LIST(pa.bool_())), ("cut", _LIST(pa.bool_()))])


def _cut(size: int) -> Callable:
    """Blocks of rows that come in order, each of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, key = TaskContext.get().partitionId(), 0, None
        rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            roles, texts, gone, cut = (list(c) for c in zip(*rows))
            return pa.RecordBatch.from_pylist([{"key": key, "part": part, "nth": nth, "roles": roles, "texts": texts, "gone": gone, "cut": cut}], schema=_BLOCKS)

        for batch in batches:
            for k, role, text, n, blank, again, cut in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text", "n", "blank", "again", "cut"))):
                for copy in range(n):
                    if rows and (k != key or len(rows) == size):
                        yield block()
                        nth, rows = nth + 1, []
                    key = k
                    rows.append((role, text, blank or again or copy > 0, cut and not blank))
        if rows:
            yield block()

    return run


def _lattice(row: dict, ends: dict[int, int]) -> Lattice:
    return Lattice("".join(r[:1] or " " for r in row["roles"]), row["gone"], row["cut"], ends)


COSTS = "key string, part long, nth long, costs array<long>"


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each state to each the cost of a block; null where there is no way."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            to = [_lattice(row, {q: 0}) for q in range(4)]
            out.append({"key": row["key"], "part": row["part"], "nth": row["nth"], "costs": [to[q].cost(p) for p in range(4) for q in range(4)]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("costs", _LIST(pa.int64()))]))


PRICES = "key string, part long, nth long, ends array<long>, last boolean"


def _prices(group: pa.Table) -> pa.Table:
    """What it costs from each state behind a block to the end of its conversation."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["nth"]))
    ends, out = [ENDS.get(q) for q in range(4)], []
    for row in reversed(rows):
        out.append({k: row[k] for k in ("key", "part", "nth")} | {"ends": ends, "last": not out})
        ways = [[row["costs"][4 * p + q] + ends[q] for q in range(4) if row["costs"][4 * p + q] is not None and ends[q] is not None] for p in range(4)]
        ends = [min(w, default=None) for w in ways]
    return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("ends", _LIST(pa.int64())), ("last", pa.bool_())]))


TRACES = "key string, part long, nth long, state long, cost long, letters string, to long, rows array<string>"
_TRACES = pa.schema([("key", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("letters", pa.string()), ("to", pa.int64()), ("rows", _LIST(pa.string()))])


def _traces(states: tuple[int, ...]) -> Callable:
    """Each block's cheapest edits from states before it; without ``ends`` a block is a whole conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ends = {q: e for q, e in enumerate(row["ends"]) if e is not None} if row.get("ends") else ENDS
                lattice = _lattice(row, ends)
                for state in states:
                    if found := lattice.trace(state):
                        cost, letters, to = found
                        letters += TAIL[to] if row.get("last", True) else ""
                        out.append({k: row[k] for k in ("key", "part", "nth")} | {"state": state, "cost": cost, "letters": letters, "to": to, "rows": repaired(letters, state, row["roles"], row["texts"])})
            yield pa.RecordBatch.from_pylist(out, schema=_TRACES)

    return run


PICKED = "key string, part long, nth long, state long"


def _picked(group: pa.Table) -> pa.Table:
    """The state before each block of a conversation, from traces ``part, nth, state, to``."""
    to = {(r["part"], r["nth"], r["state"]): r["to"] for r in group.to_pylist()}
    state, out = 0, []
    for part, nth in sorted({(p, n) for p, n, _ in to}):
        out.append({"key": group.column("key")[0].as_py(), "part": part, "nth": nth, "state": state})
        state = to[part, nth, state]
    return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("state", pa.int64())]))


AUDITS = "key string, cost long, audit string, repaired_sha256 string"
_AUDITS = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation whose traces come in order."""
    key = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    out.append((key, cost, "".join(letters), held.hexdigest()))
                key, cost, letters, held, mark = row["key"], row["cost"], [], hashlib.sha256(), b""
            letters.append(row["letters"])
            for line in row["rows"]:
                held.update(mark + line.encode())
                mark = b"\n"
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), _AUDITS)], schema=_AUDITS)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((key, cost, "".join(letters), held.hexdigest()), _AUDITS)], schema=_AUDITS)


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Illegal neighbours within each block, and its ends."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            initials = [r[:1] for r in row["roles"]]
            bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            out.append((row["key"], row["part"], row["nth"], bad, initials[0], initials[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())], names=["key", "part", "nth", "bad", "first", "last"])


def _illegal(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["nth"]))
    borders = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return pa.table({"key": [rows[0]["key"]], "illegal": [borders + sum(r["bad"] for r in rows)]})


def repair(rows: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """The contract's columns for every ``key, conv_id`` of ``ids``, from ``rows(key, turn, role, text)``."""
    spark = rows.sparkSession
    faults = materialize(_faults(rows), "faults")
    copies = F.col("n") - F.when(F.col("again"), 0).otherwise(1)
    counted = faults.groupBy("key").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(~F.col("blank"), copies).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("again") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    turns = faults.filter("turn is not null").groupBy("key", "turn").agg(F.lit(1)).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    blocks = materialize(faults.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "role", "text", "n", "blank", "again", "cut").mapInArrow(_cut(block), BLOCKS), "blocks")
    many = blocks.groupBy("key").agg(F.count("*").alias("of")).filter("of > 1").select("key")
    alone = blocks.join(many, "key", "left_anti").mapInArrow(_traces((0,)), TRACES)
    several = blocks.join(many, "key", "left_semi")
    prices = several.mapInArrow(_costs, COSTS).groupBy("key").applyInArrow(_prices, PRICES)
    traces = materialize(several.join(prices, ["key", "part", "nth"]).mapInArrow(_traces((0, 1, 2, 3)), TRACES), "traces")
    picked = traces.select("key", "part", "nth", "state", "to").groupBy("key").applyInArrow(_picked, PICKED)
    chosen = alone.unionByName(traces.join(picked, ["key", "part", "nth", "state"]).select(alone.columns))
    audits = chosen.repartition("key").sortWithinPartitions("key", "part", "nth").mapInArrow(_audits, AUDITS)
    illegal = blocks.select("key", "part", "nth", "roles").mapInArrow(_adjacent, "key string, part long, nth long, bad long, first string, last string").groupBy("key").applyInArrow(_illegal, "key string, illegal long")
    out = ids.select("key", "conv_id").distinct().join(counted, "key", "left").join(turns, "key", "left").join(illegal, "key", "left").join(audits, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "conv_id")
    return repair(damaged(conversations), ids)


def _sql() -> str:
    """The contract in SQL: the best cost, letters and text of each state, row by row."""
    kind = "struct(c bigint, l varchar, t varchar)"
    best = lambda *ways: f"list_min(list_filter([{', '.join(ways)}]::{kind}[], lambda x: x is not null))"
    way = lambda q, cost, letter, text="''", when="true": f"case when {q} is not null and {when} then {{'c': {q}.c + {cost}, 'l': {q}.l || '{letter}', 't': {q}.t || {text}}} end"
    put = lambda role: f"chr(10) || '{role}:'"
    keep = lambda q, c: way(q, "more", "K", "chr(10) || role || ':' || text", f"not gone and c = '{c}'")
    turn = lambda q, role: way(q, "3 + more", "R", f"chr(10) || '{role}:' || text", "not gone")
    user = best("u", *(way(q, 3, "I", put("user")) for q in "zsa"))
    return rf"""
with recursive named as (
  select coalesce(cast(conv_id as varchar), ' ') as k, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as h from conversations),
checked as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h) + 1), lambda i: ascii(h[i])::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, r: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 20 as kind from named),
damaged as (
  select k, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when kind = 3 then [0, 1] else [0] end) as copy from checked where kind <> 0),
ordered as (select *, row_number() over (partition by k order by turn nulls first, role, text) as i from damaged),
placed as (
  select *, row_number() over (partition by k, role, text order by i) as again, lag(role[1:1]) over (partition by k order by i) as before from ordered),
judged as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut from placed),
faults as (select k, i, role, text, role[1:1] as c, blank or again > 1 as gone, case when cut and not blank then 3 else 0 end as more from judged),
counted as (
  select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (not blank and again > 1) as duplicate,
    count(*) filter (not blank and again = 1 and cut) as truncated, count(*) filter (before || role[1:1] not in ('su', 'ua', 'au')) as illegal, max(i) as n from judged group by k),
reach as (
  select k, 0::bigint as i, {{'c': 0, 'l': '', 't': ''}}::{kind} as z, null::{kind} as s, null::{kind} as u, null::{kind} as a from counted
  union all
  select k, i, {way("z", 4, "D")}, {best(way("s", 4, "D"), keep("z", "s"))},
    {best(way("u", 4, "D"), *(keep(q, "u") for q in "zsa"), *(turn(q, "user") for q in "zsa"))},
    {best(way("a", 4, "D"), keep("u", "a"), turn("u", "assistant"))}
  from (select k, i + 1 as i, z, s, u, {best("a", way("u", 3, "I", put("assistant")))} as a from (select k, i, z, s, a, {user} as u from reach)) join faults using (k, i)),
ended as (select k, i, {best("z", "a", way("u", 3, "I", put("assistant")))} as w from (select k, i, z, a, {user} as u from reach)),
solved as (select k, w.c as cost, w.l as audit, sha256(w.t[2:]) as h from ended join counted using (k) where i = n)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct k, conv_id from named) left join counted using (k) left join solved using (k)
"""


OP12_SQL = _sql()
