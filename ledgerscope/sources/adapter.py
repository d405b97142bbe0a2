"""A ledger from the TPC-H-like tables: line items are coins, orders are transactions.

Each statement here has its twin in ``LEDGER_SQL`` so that queries over the ledger can be checked
against another engine. A line item of an order is an output of it; the next order of the same part
spends it if it was returned and finished. Orders that spend nothing are no transactions: their
line items are roots. ``tx_seq`` and ``coin_seq`` keep the order of the record without a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.session import honest_sizes, left_join, materialize, plain_unions
from ledgerscope.sources.ledger import Ledger

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_KNOWN: dict[tuple[str, str], Ledger] = {}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("day"))
    orders = orders.withColumn("seq", F.expr("shiftleft(cast(day + 10000 as bigint), 40)") + F.col("o_orderkey"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    placed = lines.withColumn("out_pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    return placed.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _placed(coins: DataFrame) -> DataFrame:
    """Add ``in_pos``. Most coins are unspent: each has a window of its own, as a common one would be one task."""
    place = F.row_number().over(Window.partitionBy("dest", F.when(F.col("dest").isNull(), F.col("coin_id"))).orderBy("coin_id")) - 1
    return coins.withColumn("in_pos", F.when(F.col("dest").isNotNull(), place.cast("int")))


def build(spark: SparkSession, sf_dir: str) -> Ledger:
    lines = materialize(
        _lines(spark, sf_dir).select(
            (F.col("l_orderkey") * 100 + F.col("out_pos")).alias("coin_id"), F.col("l_orderkey").alias("made_by"), "seq", "day", "out_pos",
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"), F.col("l_suppkey").cast("int").alias("owner"), "l_partkey",
            F.concat_ws("/", "l_partkey", F.year("l_shipdate")).alias("addr_key"),
            F.element_at(F.array(*map(F.lit, ("legacy", "compat", "segwit", "taproot"))), F.pmod("l_suppkey", F.lit(4)).cast("int") + 1).alias("script"),
            F.expr("l_returnflag = 'R' and l_linestatus = 'F'").alias("spendable"), "o_custkey",
        ),
        "lines",
    )
    # dealt by part at once, as the window needs it
    steps = lines.select("l_partkey", "seq", "made_by", "spendable").repartition("l_partkey").groupBy("l_partkey", "seq", "made_by").agg(F.bool_or("spendable").alias("asked"))
    following = steps.withColumn("dest", F.lead("made_by").over(Window.partitionBy("l_partkey").orderBy("seq"))).filter("asked").select("l_partkey", "seq", "dest")
    # most lines can't be spent: they look for no spender
    linked = materialize(_placed(lines.filter("spendable").join(following, ["l_partkey", "seq"])), "linked")
    is_tx = linked.filter("dest is not null").select(F.col("dest").alias("made_by"), F.lit(True).alias("is_tx")).distinct()
    kept = lines.filter("not coalesce(spendable, false)").withColumns({"dest": F.lit(None).cast(lines.schema["made_by"].dataType), "in_pos": F.lit(None).cast("int")})
    coins = linked.unionByName(kept)
    coins = materialize(coins.join(is_tx, "made_by", "left").withColumn("producer", F.when(F.col("is_tx"), F.col("made_by"))), "coins")
    # every fourth output is on record as paid by the owner of its transaction's first input alone
    first = coins.filter("in_pos = 0").select(F.col("dest").alias("producer"), F.array("owner").alias("funders"))
    truth = left_join(coins, first, "producer").withColumn("funders", F.when(F.col("coin_id") % 4 == 0, F.col("funders")))
    truth = truth.select("coin_id", "owner", "funders", F.when(F.col("value") % 7 == 0, F.lit("change")).alias("label"), (F.pmod("coin_id", F.lit(11)) == 0).alias("kyc"))
    inputs = coins.filter("dest is not null").select(F.col("dest").alias("tid"), "in_pos", "coin_id", (F.pmod("coin_id", F.lit(3)) > 0).alias("low_r"))
    outputs = coins.filter("producer is not null").select(F.col("producer").alias("tid"), "out_pos", "coin_id")
    paid = coins.filter("dest is not null").groupBy(F.col("dest").alias("tid")).agg(F.sum("value").alias("paid"), F.count("*").cast("int").alias("n_in"))
    received = coins.filter("producer is not null").groupBy(F.col("producer").alias("tid")).agg(F.sum("value").alias("received"), F.count("*").cast("int").alias("n_out"), F.first("seq").alias("tx_seq"), F.first("day").alias("day"), F.first("o_custkey").alias("custkey"))
    txs = paid.join(received, "tid").select(
        "tid", "tx_seq", "day", ((F.col("tid") % 50) / 2.0 + 1.0).alias("feerate"), F.greatest(F.col("paid") - F.col("received"), F.lit(0)).alias("fee"), "n_in", "n_out",
        F.when(F.col("custkey") % 3 == 0, F.lit("zero")).when(F.col("custkey") % 3 == 1, F.lit("height")).alias("locktime"), (F.col("tid") % 1440).cast("int").alias("minute"),
    )
    coins = coins.select(
        "coin_id", (F.col("seq") * 100 + F.col("out_pos")).alias("coin_seq"), "value", "producer", F.when(F.col("producer").isNotNull(), F.col("out_pos")).alias("out_pos"),
        "dest", "in_pos", F.when(F.col("producer").isNull(), F.col("day")).alias("entered"), "addr_key", "script",
    )
    return Ledger(*(materialize(df, name) for df, name in ((coins, "coins"), (truth, "coin_truth"), (txs, "txs"), (inputs, "tx_inputs"), (outputs, "tx_outputs"))))


def load(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger of a folder, built once for an application and kept as tables in the shared folder."""
    honest_sizes(spark)
    plain_unions(spark)
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _KNOWN:
        _KNOWN[at] = build(spark, sf_dir)
    return _KNOWN[at]


def prices(ledger: Ledger) -> DataFrame:
    """A made-up price of each day with a transaction; one day in eleven lacks one."""
    days = ledger.txs.select("day").distinct()
    return days.filter(F.pmod("day", F.lit(11)) != 0).select("day", (F.lit(20000.0) + 37.5 * F.pmod(F.col("day") * 79, F.lit(1000))).alias("usd_per_btc"))


def payments(ledger: Ledger) -> DataFrame:
    """Who pays whom in each transaction: the owners of its first input and its first output."""
    first_in = ledger.tx_inputs.filter("in_pos = 0").join(ledger.coin_truth, "coin_id").select("tid", F.col("owner").alias("payer"))
    first_out = ledger.tx_outputs.filter("out_pos = 1").join(ledger.coin_truth, "coin_id").select("tid", F.col("owner").alias("payee"))
    form = F.element_at(F.array(*map(F.lit, ("coinjoin", "payjoin", "settlement", "unilateral", "unilateral"))), (F.col("tid") % 5).cast("int") + 1)
    memo = F.concat(F.when(F.col("tid") % 3 == 0, F.lit("batch")).otherwise(F.lit("memo")), (F.col("tid") % 3).cast("string"))
    return ledger.txs.select("tid", "day").join(first_in, "tid").join(first_out, "tid").select("tid", "day", "payer", F.when(F.col("tid") % 7 != 0, F.col("payee")).alias("payee"), memo.alias("memo"), form.alias("form"))


def sessions(ledger: Ledger) -> DataFrame:
    """``tid`` of the transactions that several parties made together."""
    return payments(ledger).filter("form = 'coinjoin'").select("tid")


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nations of customers owe to nations of suppliers, one obligation for each pair."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    owed = lines.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    owed = owed.join(read("customer").select("c_custkey", F.col("c_nationkey").alias("payer")), F.col("o_custkey") == F.col("c_custkey"))
    owed = owed.join(read("supplier").select("s_suppkey", F.col("s_nationkey").alias("payee")), F.col("l_suppkey") == F.col("s_suppkey"))
    return owed.filter("payer <> payee").groupBy("payer", "payee").agg(F.sum("cents").alias("cents")).select((F.col("payer") * 100 + F.col("payee")).alias("id"), "payer", "payee", "cents")


LEDGER_SQL = """
with recursive ords as (
  select o_orderkey, o_custkey, datediff('day', date '1995-01-01', o_orderdate::date)::int as day from orders
), oseq as (
  select *, ((day + 10000)::bigint << 40) + o_orderkey as seq from ords
), lines as (
  select l_orderkey * 100 + row_number() over w as coin_id, l_orderkey as made_by, seq, day, (row_number() over w)::int as out_pos, round(l_extendedprice * 100)::bigint as value,
    l_suppkey::int as owner, l_partkey, concat_ws('/', l_partkey, year(l_shipdate)) as addr_key, ['legacy', 'compat', 'segwit', 'taproot'][(l_suppkey % 4 + 1)::int] as script,
    l_returnflag = 'R' and l_linestatus = 'F' as spendable, o_custkey
  from lineitem join oseq on l_orderkey = o_orderkey
  window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
), steps as (
  select distinct l_partkey, seq, made_by from lines
), following as (
  select l_partkey, seq, lead(made_by) over (partition by l_partkey order by seq) as dest from steps
), linked as (
  select lines.*, case when spendable then dest end as dest from lines join following using (l_partkey, seq)
), allcoins as materialized (
  select a.*, case when dest is not null then (row_number() over (partition by dest order by coin_id) - 1)::int end as in_pos,
    case when made_by in (select dest from linked where dest is not null) then made_by end as producer
  from linked a
), coins as materialized (
  select coin_id, seq * 100 + out_pos as coin_seq, value, producer, case when producer is not null then out_pos end as out_pos, dest, in_pos, case when producer is null then day end as entered, addr_key, script from allcoins
), coin_truth as (
  select a.coin_id, a.owner, case when a.coin_id % 4 = 0 then p.owner end as funder, case when a.value % 7 = 0 then 'change' end as label, a.coin_id % 11 = 0 as kyc
  from allcoins a left join allcoins p on p.in_pos = 0 and p.dest = a.producer
), tx_inputs as (
  select dest as tid, in_pos, coin_id, coin_id % 3 > 0 as low_r from allcoins where dest is not null
), tx_outputs as (
  select producer as tid, out_pos, coin_id from allcoins where producer is not null
), paid as (
  select dest as tid, sum(value)::bigint as paid, count(*)::int as n_in from allcoins where dest is not null group by 1
), received as (
  select producer as tid, sum(value)::bigint as received, count(*)::int as n_out, min(seq) as tx_seq, min(day) as day, min(o_custkey) as custkey from allcoins where producer is not null group by 1
), txs as materialized (
  select tid, tx_seq, day, (tid % 50) / 2.0::double + 1.0 as feerate, greatest(paid - received, 0) as fee, n_in, n_out,
    case custkey % 3 when 0 then 'zero' when 1 then 'height' end as locktime, (tid % 1440)::int as minute
  from paid join received using (tid)
), prices as (
  select day, 20000.0::double + 37.5 * (((day * 79) % 1000 + 1000) % 1000) as usd_per_btc from (select distinct day from txs) where day % 11 <> 0
), first_in as (
  select tid, owner as payer from tx_inputs join coin_truth using (coin_id) where in_pos = 0
), first_out as (
  select tid, owner as payee from tx_outputs join coin_truth using (coin_id) where out_pos = 1
), payments as (
  select tid, day, payer, case when tid % 7 <> 0 then payee end as payee, case when tid % 3 = 0 then 'batch' else 'memo' end || (tid % 3) as memo, ['coinjoin', 'payjoin', 'settlement', 'unilateral', 'unilateral'][(tid % 5 + 1)::int] as form
  from txs join first_in using (tid) join first_out using (tid)
), obligations as (
  select c_nationkey * 100 + s_nationkey as id, c_nationkey as payer, s_nationkey as payee, sum(round(l_extendedprice * 100)::bigint)::bigint as cents
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where c_nationkey <> s_nationkey group by 1, 2, 3
)
"""
