"""Queries A and B: the ledger itself, projections and scalar tells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.functions import exprs as X
from ledgerscope.plans.registry import Registry
from ledgerscope.sources import adapter
from ledgerscope.sources.ledger import Ledger, coin_day, public_lines, record_order, through, truth_lines, utxos, validate

R = Registry()
QUERIES, SQL = R.queries, R.sql
MENU = ", ".join(map(str, X.DENOMINATIONS))


@R.ledger("select 'coins' as name, count(*) as n, sum(value)::bigint as total from coins union all select 'txs', count(*), sum(fee)::bigint from txs union all select 'inputs', count(*), sum(coin_id)::bigint from tx_inputs union all select 'outputs', count(*), sum(coin_id)::bigint from tx_outputs")
def a1_ledger_tables(g: Ledger) -> DataFrame:
    row = lambda name, df, c: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(c).cast("long").alias("total"))
    return row("coins", g.coins, "value").unionByName(row("txs", g.txs, "fee")).unionByName(row("inputs", g.tx_inputs, "coin_id")).unionByName(row("outputs", g.tx_outputs, "coin_id"))


@R.ledger("""
sums as (select tid, sum(value)::bigint as paid from tx_inputs join coins using (coin_id) group by 1),
gets as (select tid, sum(value)::bigint as received from tx_outputs join coins using (coin_id) group by 1)
select 'fee not the difference' as rule, tid, null::bigint as coin_id from txs join sums using (tid) join gets using (tid) where fee <> paid - received
union all select 'fee not by size', tid, null from txs where fee <> ceil((10.5 + 57.5 * n_in + 43 * n_out) * feerate)""")
def a3_constraint_violations(g: Ledger) -> DataFrame:
    return validate(g)


@R.ledger("""
mid as (select (min(day) + max(day)) // 2 as d from txs), kept as (select tid from txs, mid where day <= d)
select coin_id, value, producer, case when dest in (select tid from kept) then dest end as dest from coins, mid
where coalesce(entered, 0) <= d and (producer is null or producer in (select tid from kept))""")
def a4_time_travel(g: Ledger) -> DataFrame:
    low, high = g.txs.agg(F.min("day"), F.max("day")).first()
    return through(g, (low + high) // 2).coins.select("coin_id", "value", "producer", "dest")


@R.ledger("select coin_id, value from coins where dest is null")
def a5_unspent(g: Ledger) -> DataFrame:
    return utxos(g).select("coin_id", "value")


@R.ledger("""
ins as (select tid, string_agg(coin_id || '/' || low_r, ',' order by in_pos) as ins from tx_inputs group by 1),
outs as (select t.tid, string_agg(concat_ws('/', c.coin_id, value, addr_key, script), ',' order by t.out_pos) as outs from tx_outputs t join coins c on c.coin_id = t.coin_id group by 1)
select coin_seq as seq, concat_ws(' ', 'root', entered, concat_ws('/', coin_id, value, addr_key, script)) as line from coins where producer is null
union all select tx_seq, concat_ws(' ', 'tx', tid, day, feerate, fee, coalesce(locktime, '-'), minute, ins, outs) from txs join ins using (tid) join outs using (tid)""")
def a6_public_lines(g: Ledger) -> DataFrame:
    return public_lines(g)


@R.ledger("select coin_id, concat_ws(' ', coin_id, owner, coalesce(funder::varchar, '-'), coalesce(label, '-'), kyc) as line from coin_truth")
def a6_truth_lines(g: Ledger) -> DataFrame:
    return truth_lines(g)


@R.ledger("select coin_id, value, producer, dest, addr_key, script from coins")
def b1_public_projection(g: Ledger) -> DataFrame:
    return g.coins.select("coin_id", "value", "producer", "dest", "addr_key", "script")


@R.ledger("select tid, 10.5 + 57.5 * n_in + 43.0 * n_out as vsize, ceil((10.5 + 57.5 * n_in + 43.0 * n_out) * feerate)::bigint as size_fee from txs")
def b2_size_and_fee(g: Ledger) -> DataFrame:
    return g.txs.select("tid", X.vsize(F.col("n_in"), F.col("n_out")).alias("vsize"), X.tx_fee(F.col("n_in"), F.col("n_out"), F.col("feerate")).alias("size_fee"))


_USD = "coalesce(abs(value * usd_per_btc / 1e8 - floor(value * usd_per_btc / 1e8 / 10 + 0.5) * 10) < 0.05, false)"


@R.ledger(f"""
outs as (select o.tid, c.coin_id, value, usd_per_btc from tx_outputs o join coins c on o.coin_id = c.coin_id join txs using (tid) left join prices using (day))
select tid, coin_id, length(replace(value::varchar, '0', '')) as digits, {_USD} as round_usd,
  case when {_USD} then 1 else 0 end + case when length(replace(value::varchar, '0', '')) <= 1 then 2 else 0 end as kinds,
  value in ({MENU}) as denomination from outs""")
def b3_b6_amount_tells(g: Ledger) -> DataFrame:
    outs = g.tx_outputs.join(g.coins.select("coin_id", "value"), "coin_id").join(g.txs.select("tid", "day"), "tid").join(adapter.prices(g), "day", "left")
    value, price = F.col("value"), F.col("usd_per_btc")
    return outs.select("tid", "coin_id", X.dec_hw(value).cast("long").alias("digits"), X.round_usd(value, price).alias("round_usd"), X.amount_kinds(value, price).alias("kinds"), X.is_denomination(value).alias("denomination"))


#: Amounts small enough to repeat: the test tables hardly repeat a denomination otherwise.
_SMALL = "case when value % 3 = 0 then 100000 else value end"


def small_amounts(g: Ledger) -> Ledger:
    """The same ledger where one amount in three is a common denomination."""
    return Ledger(g.coins.withColumn("value", F.when(F.col("value") % 3 == 0, F.lit(100000)).otherwise(F.col("value"))), g.coin_truth, g.txs, g.tx_inputs, g.tx_outputs)


@R.ledger(f"""
outs as (select tid, {_SMALL} as v from tx_outputs o join coins c on o.coin_id = c.coin_id),
radix as (select distinct tid from (select tid, v from outs where v in ({MENU}) group by 1, 2 having count(*) >= 2))
select tid, n_in >= 2 as session from txs where tid in (select tid from radix)""")
def b7_b8_session_shapes(g: Ledger) -> DataFrame:
    from ledgerscope.operators.links import radix_txs

    g = small_amounts(g)
    return g.txs.join(radix_txs(g), "tid").select("tid", (F.col("n_in") >= 2).alias("session"))


@R.ledger("select tid, count(distinct script) as scripts from tx_inputs join coins using (coin_id) group by 1 having count(distinct script) > 1")
def b9_mixed_scripts(g: Ledger) -> DataFrame:
    return g.with_inputs().groupBy("tid").agg(F.countDistinct("script").alias("scripts")).filter("scripts > 1")


@R.ledger("""
legs as (select tid, coin_id, true as output from tx_outputs union all select tid, coin_id, false from tx_inputs),
n as (select tid, script, count(*) as n, max(case when output then coin_id end) as coin_id from legs join coins using (coin_id) group by 1, 2),
fam as (select tid, string_agg(script, ',' order by tx_inputs.in_pos) as families from tx_inputs join coins using (coin_id) group by 1)
select tid, families, n.coin_id as odd_output, n.script as odd_script from fam left join n using (tid) where n.n = 1 and n.coin_id is not null""")
def b10_input_families(g: Ledger) -> DataFrame:
    legs = g.tx_outputs.select("tid", "coin_id", F.lit(True).alias("output")).unionByName(g.tx_inputs.select("tid", "coin_id", F.lit(False).alias("output"))).join(g.coins.select("coin_id", "script"), "coin_id")
    alone = legs.withColumn("n", F.count("*").over(Window.partitionBy("tid", "script"))).filter("n = 1 and output").select("tid", F.col("coin_id").alias("odd_output"), F.col("script").alias("odd_script"))
    families = g.with_inputs().groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("in_pos", "script"))), lambda x: x["script"]), ",").alias("families"))
    return families.join(alone, "tid")


@R.ledger("select coin_id, case script when 'legacy' then 'P2PKH (legacy)' when 'compat' then 'P2SH-wrapped segwit' when 'segwit' then 'P2WPKH (segwit v0)' else 'P2TR (segwit v1, taproot)' end as title, case script when 'legacy' then 'P2PKH' when 'compat' then 'P2SH' when 'segwit' then 'P2WPKH' else 'P2TR' end as label, format('{:,}', value) as sats from coins")
def b11_labels(g: Ledger) -> DataFrame:
    return g.coins.select("coin_id", X.script_title(F.col("script")).alias("title"), X.script_label(F.col("script")).alias("label"), X.format_sats(F.col("value")).alias("sats"))


@R.ledger("select coin_id, coalesce(day, entered, -1) as coin_day from coins left join txs on producer = tid")
def b12_coin_days(g: Ledger) -> DataFrame:
    return coin_day(g)


@R.ledger("""
d as (select max(day) as top from txs), c as (select tid, value, feerate, day, minute from tx_outputs o join coins c on o.coin_id = c.coin_id join txs using (tid))
select least(greatest(floor(log2(greatest(value, 1)))::int - 8, 0), 23) as amount, least(greatest(floor(2 * log2(greatest(feerate, 0.25)))::int + 2, 0), 11) as rate,
 floor(day * 8 / (top + 1))::int as eighth, (minute // 180)::int as slot, count(*) as n from c, d group by 1, 2, 3, 4""")
def b13_buckets(g: Ledger) -> DataFrame:
    outs = g.tx_outputs.join(g.coins.select("coin_id", "value"), "coin_id").join(g.txs, "tid")
    top = g.txs.agg(F.max("day")).first()[0]
    return outs.groupBy(X.amount_bucket(F.col("value")).alias("amount"), X.feerate_bucket(F.col("feerate")).alias("rate"), X.day_eighth(F.col("day"), F.lit(top)).alias("eighth"), X.minute_slot(F.col("minute")).alias("slot")).agg(F.count("*").alias("n"))


@R.ledger("select tid, (place * 4 // (select count(*) from txs))::int as epoch from (select tid, row_number() over (order by tx_seq) - 1 as place from txs)")
def f8_epochs(g: Ledger) -> DataFrame:
    n = g.txs.count()
    return record_order(g.txs).select("tid", F.least(F.floor(F.col("place") * 4 / n), F.lit(3)).cast("int").alias("epoch"))
