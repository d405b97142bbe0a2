"""Queries D: amounts in small units, where subsets of inputs and outputs do balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import amounts as A
from ledgerscope.operators.links import remeet_groups
from ledgerscope.plans.queries_ledger import small_amounts
from ledgerscope.plans.registry import Registry
from ledgerscope.session import materialize
from ledgerscope.sources import adapter
from ledgerscope.sources.ledger import Ledger

R = Registry()
QUERIES, SQL = R.queries, R.sql

_UNITS = """
uv as (select coin_id, case when producer is null then 3 * (value % 40 + 1) else value % 25 + 1 end as v from coins),
ui as (select tid, in_pos, v from tx_inputs join uv using (coin_id)), uo as (select tid, out_pos, v from tx_outputs join uv using (coin_id)),
am as (select tid, i.n, o.m, greatest(i.s - o.s, 0) as fee, i.a as ins, o.a as outs from (select tid, count(*) as n, sum(v)::bigint as s, list(v order by in_pos) as a from ui group by 1) i
  join (select tid, count(*) as m, sum(v)::bigint as s, list(v order by out_pos) as a from uo group by 1) o using (tid))"""
_SUMS = _UNITS + """,
si as (select tid, mask, list_sum(list_transform(range(0, n), lambda k: case when (mask >> k) & 1 = 1 then ins[k + 1] else 0 end))::bigint as total from am, unnest(range(1, 1 << n::int)) u(mask)),
so as (select tid, mask, list_sum(list_transform(range(0, m), lambda k: case when (mask >> k) & 1 = 1 then outs[k + 1] else 0 end))::bigint as total from am, unnest(range(1, 1 << m::int)) u(mask))"""


def unit_ledger(g: Ledger) -> Ledger:
    units = F.when(F.col("producer").isNull(), 3 * (F.col("value") % 40 + 1)).otherwise(F.col("value") % 25 + 1)
    coins = g.coins.withColumn("value", units)
    value = coins.select("coin_id", "value")
    side = lambda legs, name: legs.join(value, "coin_id").groupBy("tid").agg(F.sum("value").alias(name))
    fee = side(g.tx_inputs, "paid").join(side(g.tx_outputs, "received"), "tid")
    txs = g.txs.drop("fee").join(fee, "tid").withColumn("fee", F.greatest(F.col("paid") - F.col("received"), F.lit(0))).drop("paid", "received")
    return Ledger(coins, g.coin_truth, txs, g.tx_inputs, g.tx_outputs)


_UNIT: dict = {}


def unit_amounts(g: Ledger) -> DataFrame:
    if id(g) not in _UNIT:
        _UNIT[id(g)] = (g, materialize(A.amounts(unit_ledger(g)), "units"))
    return _UNIT[id(g)][1]


@R.ledger(f"{_SUMS} select tid, mask::int as mask, total from si")
def d1_subset_sums(g: Ledger) -> DataFrame:
    return A.subset_sums(unit_amounts(g), "ins").withColumn("mask", F.col("mask").cast("int"))


@R.ledger(f"{_SUMS} select tid, mask::int as mask, total from so where bit_count(mask::int) <= 2")
def d2_bounded_sums(g: Ledger) -> DataFrame:
    return A.subset_sums(unit_amounts(g), "outs", 2).withColumn("mask", F.col("mask").cast("int"))


@R.ledger(f"{_SUMS}, di as (select distinct tid, total from si), do2 as (select distinct tid, total from so), nr as (select distinct tid, a.total from di a join do2 b using (tid) where abs(a.total - b.total) <= 1) select tid, (select count(*) from nr where nr.tid = am.tid) / (select count(*) from di where di.tid = am.tid) as density from am")
def d3_ambiguity(g: Ledger) -> DataFrame:
    return A.ambiguity(unit_amounts(g), 1)


@R.ledger()
def d4_subtx_verdicts(g: Ledger) -> DataFrame:
    found = A.subtx_verdict(unit_amounts(g), 0)
    return found.select("tid", "kind", F.array_join(F.transform("parts", lambda p: F.concat_ws("/", p["i"].cast("string"), F.array_join(p["o"], "+"))), ",").alias("parts"))


@R.ledger("""
a as (select tid, in_pos, value as vi, sum(value) over (partition by tid) as si from tx_inputs join (select coin_id, value from coins) using (coin_id)), b as (select tid, out_pos, value as vo, sum(value) over (partition by tid) as so from tx_outputs join (select coin_id, value from coins) using (coin_id))
select tid, in_pos, out_pos from a join b using (tid) join txs using (tid) where si - vi < vo - 500 or so - vo < vi - fee - 500""")
def d5_forced_pairs(g: Ledger) -> DataFrame:
    return A.forced_pairs(g)


@R.ledger("""
k as (select tid, in_pos, value, addr_key as g, in_pos as p from tx_inputs join (select coin_id, value, addr_key from coins) using (coin_id)), gg as (select tid, g, min(p) as first, sum(value)::bigint as value, string_agg(p::varchar, ',' order by p) as positions from k group by 1, 2)
select tid, row_number() over (partition by tid order by first) - 1 as place, value, positions from gg""")
def d6_merged_inputs(g: Ledger) -> DataFrame:
    ins = g.with_inputs().select("tid", "in_pos", "value", F.col("addr_key").alias("group"))
    return A.merge_inputs(ins.drop("group"), ins).withColumn("positions", F.array_join("positions", ","))


@R.ledger()
def d7_session_scores(g: Ledger) -> DataFrame:
    sessions = unit_amounts(g).join(adapter.sessions(g), "tid", "left_semi").select("tid", F.size("ins").alias("parties"))
    return A.session_scores(unit_amounts(g), sessions, 0)


def remeets(g: Ledger) -> DataFrame:
    small = small_amounts(g)
    return A.remeet_report(small, remeet_groups(small)).drop("tx_seq")


@R.ledger()
def d8_remeet_verdicts(g: Ledger) -> DataFrame:
    """Verdicts of sessions with and without their re-met inputs as one."""
    return remeets(g)


@R.ledger()
def d8_picked_remeet(g: Ledger) -> DataFrame:
    small = small_amounts(g)
    return A.pick_remeet(A.remeet_report(small, remeet_groups(small))).drop("tx_seq")


@R.ledger()
def d9_picked_session(g: Ledger) -> DataFrame:
    return A.pick_session(d7_session_scores(g), g.txs)


@R.ledger()
def d10_strands(g: Ledger) -> DataFrame:
    return A.strands(unit_ledger(g), A.subtx_verdict(unit_amounts(g), 0))
