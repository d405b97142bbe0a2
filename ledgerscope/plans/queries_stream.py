"""Queries J and A2: the log, replayed in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.operators.links import links_cioh
from ledgerscope.plans.queries_ledger import MENU, small_amounts
from ledgerscope.plans.registry import Registry
from ledgerscope.session import fresh_path, materialize
from ledgerscope.sources import adapter
from ledgerscope.sources.ledger import LOG_SCHEMA, Ledger, digest, ledger_from_log, memo_lines, payments_from_log
from ledgerscope.streaming import jobs as J

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _log_stream(g: Ledger) -> DataFrame:
    path = fresh_path(g.coins.sparkSession, "log")
    J.log_of(g).repartition(4).write.parquet(path)
    return g.coins.sparkSession.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 2).parquet(path)


@R.ledger("select coin_id, coin_seq, value, producer, out_pos, dest, in_pos, entered, addr_key, script from coins")
def a2_replayed_log(g: Ledger) -> DataFrame:
    return ledger_from_log(J.log_of(g)).coins.select("coin_id", "coin_seq", "value", "producer", "out_pos", "dest", "in_pos", "entered", "addr_key", "script")


@R.ledger("select tid, day, feerate, fee, n_in, n_out, locktime, minute from txs")
def a2_replayed_txs(g: Ledger) -> DataFrame:
    return ledger_from_log(J.log_of(g)).txs.drop("tx_seq")


@R.ledger("select tid, in_pos, coin_id, low_r from tx_inputs")
def a2_replayed_inputs(g: Ledger) -> DataFrame:
    return ledger_from_log(J.log_of(g)).tx_inputs


@R.ledger("""
payers as (select tid, string_agg(owner::varchar, ',' order by owner) as paid_by from (select distinct tid, owner from tx_inputs join coin_truth using (coin_id)) group by 1)
select coin_id, owner, case when producer is not null then coalesce(funder::varchar, paid_by) end as funders, label, kyc from coin_truth join coins using (coin_id) left join payers on tid = producer""")
def a2_replayed_truth(g: Ledger) -> DataFrame:
    """Outputs without funders on record are paid by all owners of their transaction's inputs."""
    return ledger_from_log(J.log_of(g)).coin_truth.withColumn("funders", F.array_join("funders", ","))


@R.ledger("select tid, day, payer, payee, memo, form, case when form = 'settlement' then tid || ',' || (tid + 1) end as obligations from payments")
def a2_replayed_payments(g: Ledger) -> DataFrame:
    owed = F.when(F.col("form") == "settlement", F.array("tid", F.col("tid") + 1))
    return payments_from_log(J.log_of(g, adapter.payments(g).withColumn("obligations", owed))).withColumn("obligations", F.array_join("obligations", ","))


@R.ledger("select tid, concat_ws(' ', 'tx', tid, payer, coalesce(payee::varchar, '-'), form, memo) as line from payments")
def a6_memo_lines(g: Ledger) -> DataFrame:
    return memo_lines(adapter.payments(g))


@R.ledger()
def a7_digests(g: Ledger) -> DataFrame:
    named = lambda name, df: digest(df).withColumn("name", F.lit(name))
    return named("public", g.coins).unionByName(named("truth", g.coin_truth.withColumn("funders", F.array_join("funders", ","))))


@R.ledger("""
w as (select owner, case when owner % 2 = 0 then 'zero' else 'height' end as l from (select distinct owner from coin_truth))
select tid, coalesce(locktime, l) as locktime from txs join first_in using (tid) join w on w.owner = payer""")
def j2_enriched_habits(g: Ledger) -> DataFrame:
    wallets = g.coin_truth.select("owner").distinct().select("owner", F.when(F.col("owner") % 2 == 0, "zero").otherwise("height").alias("locktime"), F.lit(True).alias("low_r"), F.lit("segwit").alias("script"), F.lit(600).alias("minute"))
    return J.enrich_habits(g, wallets).txs.select("tid", "locktime")


def arriving(rows: DataFrame, key: str, schema: str, judge: Callable[[DataFrame, DataFrame], DataFrame], out_schema: str, backwards: bool = False) -> DataFrame:
    """What a streaming job makes of rows that arrive in three pieces by ``key``, stopped and started again after each."""
    spark = rows.sparkSession
    path, out, checkpoint = (fresh_path(spark, name) for name in ("arriving", "stream-out", "stream-checkpoint"))
    low, high = rows.approxQuantile(key, [1 / 3, 2 / 3], 0.01)
    at = F.col(key)
    pieces = [at < low, (at >= low) & (at < high), at >= high]
    for piece in reversed(pieces) if backwards else pieces:
        rows.filter(piece).write.mode("append").parquet(path)
        J.drained(spark.readStream.schema(schema).parquet(path), job=J.growing(out, out_schema, judge), out=out, checkpoint=checkpoint)
    return spark.read.schema(out_schema).parquet(out)


_INDEX = """select coin_id, null::bigint as tid, 'create' as kind from coins where producer is null union all select coin_id, producer, 'create' from coins where producer is not null union all select coin_id, tid, 'spend' from tx_inputs"""


def _index(g: Ledger, backwards: bool) -> DataFrame:
    log = materialize(J.log_of(g), "log")
    found = arriving(log, "log_seq", LOG_SCHEMA, J.stream_ledger, J.INDEX_SCHEMA, backwards)
    return J.latest(found).select("coin_id", "tid", "kind")


@R.ledger(_INDEX)
def j3_streamed_index(g: Ledger) -> DataFrame:
    return _index(g, False)


@R.ledger(_INDEX)
def j3_late_index(g: Ledger) -> DataFrame:
    """The log's last part arrives first: spends come before the creation of their coins."""
    return _index(g, True)


@R.ledger(f"{_INDEX} union all select coin_id, -tid, 'double spend' from tx_inputs where tid % 50 = 0 union all select -tid, -tid, 'unknown input' from txs where tid % 50 = 0")
def j3_violations(g: Ledger) -> DataFrame:
    """The log with transactions that spend again what some have spent, and a coin that is on no record."""
    log = materialize(J.log_of(g), "log")
    tid = F.col("tx.tid")
    again = F.col("tx").withField("tid", -tid).withField("inputs", F.concat("tx.inputs", F.array(-tid))).withField("outputs", F.slice("tx.outputs", 1, 0))
    bad = log.filter("kind = 'tx' and tx.tid % 50 = 0").withColumns({"log_seq": F.col("log_seq") + 50, "tx": again})
    found = arriving(materialize(log.unionByName(bad), "log"), "log_seq", LOG_SCHEMA, J.stream_ledger, J.INDEX_SCHEMA)
    return J.latest(found).select("coin_id", "tid", "kind")


@R.ledger("select addr_key, coin_id from (select addr_key, coin_id, row_number() over (partition by addr_key order by coin_seq) as i from coins) where i = 2")
def j4_streamed_reuse(g: Ledger) -> DataFrame:
    coins = g.coins.select("coin_id", "coin_seq", "addr_key")
    found = arriving(coins, "coin_seq", "coin_id long, coin_seq long, addr_key string", J.stream_reuse, J.REUSE_SCHEMA)
    return found.filter("place = 2").select("addr_key", "coin_id")


def j5_streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of the event stream as transactions whose feerate is a part of their value."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    path = fresh_path(spark, "events")
    spark.read.schema(schema).parquet(f"{sf_dir}/events.parquet").write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path).filter("event_type = 'purchase'")
    out = fresh_path(spark, "days")
    J.drained(J.stream_day_fees(stream, "ts", F.col("value") / 4), "complete", lambda batch, _: batch.write.mode("overwrite").parquet(out))
    return J.day_median(spark.read.parquet(out)).withColumn("day_start", F.date_format("day_start", "yyyy-MM-dd"))


QUERIES["j5_streamed_days"] = j5_streamed_days
SQL["j5_streamed_days"] = """
with f as (select strftime(ts, '%Y-%m-%d') as day_start, floor(value / 4)::int as step from events where event_type = 'purchase'),
o as (select day_start, step, row_number() over (partition by day_start order by step) - 1 as i, count(*) over (partition by day_start) as n from f)
select day_start, n, step as median from o where i = n // 2"""


@R.ledger(f"""
v as (select coin_id, case when value % 3 = 0 then 100000 else value end as v from coins)
select distinct tid from (select tid, v from tx_outputs join v using (coin_id) where v in ({MENU}) group by 1, 2 having count(*) >= 2) join txs using (tid) where n_in >= 2""")
def j6_streamed_sessions(g: Ledger) -> DataFrame:
    return g.coins.sparkSession.read.schema("tid long").parquet(J.drained(J.stream_sessions(_log_stream(small_amounts(g)))))


@R.ledger("select coin_id as node, first_value(coin_id) over (partition by tid order by coin_id) as label from tx_inputs join txs using (tid) where n_in >= 2")
def j7_streamed_clusters(g: Ledger) -> DataFrame:
    spark = g.coins.sparkSession
    path = fresh_path(spark, "links")
    links_cioh(g).select(F.col("coin_a").alias("src"), F.col("coin_b").alias("dst")).repartition(2).write.parquet(path)
    return J.streamed_clusters(spark, path, "src long, dst long")
