"""The ledger: coins, transactions and their hidden truth as tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.functions.exprs import tx_fee
from ledgerscope.session import honest_sizes, left_join

#: Fixed schemas; identifiers are 64-bit or text, whichever the source has.
SCHEMAS = {
    "coins": "coin_id long, coin_seq long, value long, producer long, out_pos int, dest long, in_pos int, entered int, addr_key string, script string",
    "coin_truth": "coin_id long, owner int, funders array<int>, label string, kyc boolean",
    "txs": "tid long, tx_seq long, day int, feerate double, fee long, n_in int, n_out int, locktime string, minute int",
    "tx_inputs": "tid long, in_pos int, coin_id long, low_r boolean",
    "tx_outputs": "tid long, out_pos int, coin_id long",
}


@dataclass(frozen=True)
class Ledger:
    coins: DataFrame
    coin_truth: DataFrame
    txs: DataFrame
    tx_inputs: DataFrame
    tx_outputs: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Ledger:
        """A1: fixed schemas, so a scan reads the wanted columns only."""
        honest_sizes(spark)
        return cls(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})

    def write(self, path: str) -> None:
        for name in SCHEMAS:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def with_inputs(self) -> DataFrame:
        """Inputs with the coins that they spend."""
        return self.tx_inputs.join(self.coins.drop("in_pos", "dest"), "coin_id")


#: Events name their coins and the places of these in the record; nothing is derived from numbers of outputs.
COIN_TYPE = "coin_id: long, coin_seq: long, value: long, owner: int, label: string, kyc: boolean, addr_key: string, script: string"
ROOT_TYPE = f"struct<{COIN_TYPE}>"
TX_TYPE = f"struct<tid: long, feerate: double, fee: long, locktime: string, minute: int, inputs: array<long>, low_r: array<boolean>, outputs: array<struct<{COIN_TYPE}, funders: array<int>>>>"
NOTE_TYPE = "struct<tid: long, payer: int, payee: int, memo: string, form: string, obligations: array<long>>"
LOG_SCHEMA = f"log_seq long, day int, kind string, root {ROOT_TYPE}, tx {TX_TYPE}, note {NOTE_TYPE}"


def ledger_from_log(log: DataFrame) -> Ledger:
    """A2: replay an append-only log of root, tx and note events into tables.

    Coins keep the ids and places that the log gives them, whatever the number of outputs; inputs
    beyond the list of signature habits have none. Roots enter on their event's day.
    """
    none = lambda t: F.lit(None).cast(t)
    roots = log.filter("kind = 'root'").select("day", "root.*")
    txs = log.filter("kind = 'tx'").select("log_seq", "day", "tx.*")
    legs_in = txs.select("tid", "low_r", F.posexplode("inputs").alias("in_pos", "coin_id")).select("tid", "in_pos", "coin_id", F.get("low_r", F.col("in_pos")).alias("low_r"))
    outs = txs.select("tid", F.posexplode("outputs").alias("place", "o")).select("tid", (F.col("place") + 1).alias("out_pos"), "o.*")
    made = outs.select("coin_id", "coin_seq", "value", F.col("tid").alias("producer"), "out_pos", none("int").alias("entered"), "addr_key", "script")
    born = roots.select("coin_id", "coin_seq", "value", none("long").alias("producer"), none("int").alias("out_pos"), F.col("day").alias("entered"), "addr_key", "script")
    spent = legs_in.select("coin_id", F.col("tid").alias("dest"), "in_pos")
    coins = born.unionByName(made).join(spent, "coin_id", "left").select(*(c.split()[0] for c in SCHEMAS["coins"].split(", ")))
    owners = roots.select("coin_id", "owner").unionByName(outs.select("coin_id", "owner"))
    paid_by = legs_in.join(owners, "coin_id").groupBy("tid").agg(F.array_sort(F.collect_set("owner")).alias("paid_by"))
    out_truth = outs.join(paid_by, "tid", "left").select("coin_id", "owner", F.coalesce("funders", "paid_by").alias("funders"), "label", "kyc")
    root_truth = roots.select("coin_id", "owner", none("array<int>").alias("funders"), "label", "kyc")
    tx_rows = txs.select("tid", F.col("log_seq").alias("tx_seq"), "day", "feerate", "fee", F.size("inputs").alias("n_in"), F.size("outputs").alias("n_out"), "locktime", "minute")
    return Ledger(coins, root_truth.unionByName(out_truth), tx_rows, legs_in, outs.select("tid", "out_pos", "coin_id"))


def payments_from_log(log: DataFrame) -> DataFrame:
    """A2: ``tid, day, payer, payee, memo, form, obligations`` of the notes of a log."""
    return log.filter("kind = 'note'").select("note.tid", "day", "note.payer", "note.payee", "note.memo", "note.form", "note.obligations")


def validate(ledger: Ledger, check_size: bool = True) -> DataFrame:
    """A3: ``rule, tid, coin_id`` of every violated constraint."""
    coins, txs, ins = ledger.coins, ledger.txs, ledger.tx_inputs
    none = F.lit(None).cast("long")
    outs = ledger.tx_outputs.join(coins.select("coin_id", "value"), "coin_id")

    def row(df: DataFrame, rule: str, tid: Column | str = none, coin: Column | str = none) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), (F.col(tid) if isinstance(tid, str) else tid).alias("tid"), (F.col(coin) if isinstance(coin, str) else coin).alias("coin_id"))

    many = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1")
    owner_of = ledger.coin_truth.select("coin_id", "owner")
    paid_by = ins.join(owner_of, "coin_id").groupBy("tid").agg(F.collect_set(F.struct("owner")).alias("payers"))
    funded = ledger.tx_outputs.join(ledger.coin_truth, "coin_id").join(paid_by, "tid", "left")
    sums = ins.join(coins.select("coin_id", "value"), "coin_id").groupBy("tid").agg(F.sum("value").alias("paid"))
    sums = sums.join(outs.groupBy("tid").agg(F.sum("value").alias("received")), "tid", "left").join(txs, "tid")
    balance = F.col("fee") != F.col("paid") - F.coalesce("received", F.lit(0))
    found = [
        row(many(coins, "coin_id"), "duplicate coin", coin="coin_id"),
        row(coins.filter("producer is null and value <= 0"), "root not positive", coin="coin_id"),
        row(many(txs, "tid"), "duplicate transaction", tid="tid"),
        row(txs.join(ins, "tid", "left_anti"), "no inputs", tid="tid"),
        row(many(ins, "tid", "coin_id"), "input twice", tid="tid", coin="coin_id"),
        row(ins.join(coins, "coin_id", "left_anti"), "unknown input", tid="tid", coin="coin_id"),
        row(ins.groupBy("coin_id").agg(F.countDistinct("tid").alias("n")).filter("n > 1"), "double spend", coin="coin_id"),
        row(sums.filter(balance), "fee not the difference", tid="tid"),
        row(outs.filter("value <= 0"), "output not positive", tid="tid", coin="coin_id"),
        row(funded.filter((F.size("funders") == 0) | (F.size(F.array_distinct("funders")) < F.size("funders"))), "funders empty or repeated", tid="tid", coin="coin_id"),
        row(funded.filter(F.exists("funders", lambda f: ~F.exists("payers", lambda p: p["owner"].eqNullSafe(f)))), "funder without input", tid="tid", coin="coin_id"),
    ]
    if check_size:
        found.append(row(txs.filter(F.col("fee") != tx_fee(F.col("n_in"), F.col("n_out"), F.col("feerate"))), "fee not by size", tid="tid"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def through(ledger: Ledger, day: int, txs_into_day: int | None = None) -> Ledger:
    """A4: the ledger as of a day, of which only the first transactions if ``txs_into_day`` is given."""
    txs = ledger.txs.filter(F.col("day") <= day)
    if txs_into_day is not None:
        first = txs.filter(F.col("day") == day).orderBy("tx_seq").limit(txs_into_day)
        txs = txs.filter(F.col("day") < day).unionByName(first)
    kept = txs.select(F.col("tid").alias("kept"))
    there = ledger.coins.filter(F.coalesce("entered", F.lit(0)) <= day)
    roots, made = there.filter("producer is null"), there.join(kept, F.col("producer") == F.col("kept"), "left_semi")
    coins = left_join(roots.unionByName(made), kept.select(F.col("kept").alias("dest"), "kept"), "dest").select(*there.columns, "kept")
    coins = coins.withColumn("dest", F.col("kept")).withColumn("in_pos", F.when(F.col("kept").isNotNull(), F.col("in_pos"))).drop("kept")
    semi = lambda df: df.join(kept, F.col("tid") == F.col("kept"), "left_semi")
    return replace(ledger, coins=coins, coin_truth=ledger.coin_truth.join(coins.select("coin_id"), "coin_id", "left_semi"), txs=txs, tx_inputs=semi(ledger.tx_inputs), tx_outputs=semi(ledger.tx_outputs))


def utxos(ledger: Ledger) -> DataFrame:
    """A5."""
    return ledger.coins.filter("dest is null")


def _dash(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def public_lines(ledger: Ledger) -> DataFrame:
    """One line per root and per transaction with all public fields, in record order."""
    ins = ledger.with_inputs().groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("in_pos", "coin_id", "low_r"))), lambda x: F.concat(x["coin_id"].cast("string"), F.lit("/"), F.coalesce(x["low_r"].cast("string"), F.lit("-")))), ",").alias("ins"))
    coin = F.concat_ws("/", F.col("coin_id"), F.col("value"), _dash("addr_key"), _dash("script"))
    outs = ledger.tx_outputs.join(ledger.coins.drop("out_pos"), "coin_id").groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("out_pos", coin.alias("coin")))), lambda x: x["coin"]), ",").alias("outs"))
    tx = ledger.txs.join(ins, "tid").join(outs, "tid", "left")
    tx = tx.select(F.col("tx_seq").alias("seq"), F.concat_ws(" ", F.lit("tx"), "tid", "day", _dash("feerate"), "fee", _dash("locktime"), _dash("minute"), "ins", F.coalesce("outs", F.lit("-"))).alias("line"))
    roots = ledger.coins.filter("producer is null").select(F.col("coin_seq").alias("seq"), F.concat_ws(" ", F.lit("root"), _dash("entered"), coin).alias("line"))
    return roots.unionByName(tx)


def truth_lines(ledger: Ledger) -> DataFrame:
    """Owners, funders, kyc and labels, apart from the public record."""
    funders = F.coalesce(F.array_join(F.transform("funders", lambda f: F.coalesce(f.cast("string"), F.lit("-"))), ","), F.lit("-"))
    return ledger.coin_truth.select("coin_id", F.concat_ws(" ", "coin_id", _dash("owner"), funders, _dash("label"), _dash("kyc")).alias("line"))


def memo_lines(payments: DataFrame) -> DataFrame:
    """``tid, line``: who pays whom and what for, apart from the public record."""
    return payments.select("tid", F.concat_ws(" ", F.lit("tx"), "tid", _dash("payer"), _dash("payee"), _dash("form"), _dash("memo")).alias("line"))


def digest(df: DataFrame) -> DataFrame:
    """A fingerprint of a table that doesn't depend on the order of its rows."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"))


def coin_day(ledger: Ledger) -> DataFrame:
    """``coin_id, coin_day``: the day of the producer, else of entry, else -1."""
    days = ledger.txs.select(F.col("tid").alias("producer"), "day")
    return left_join(ledger.coins, days, "producer").select("coin_id", F.coalesce("day", "entered", F.lit(-1)).alias("coin_day"))


def record_order(txs: DataFrame) -> DataFrame:
    """``tid, place``: dense numbers from 0 in record order.

    Transactions are numbered within their day, days have a running sum of one row each.
    """
    days = txs.groupBy("day").count()
    before = days.select("day", (F.sum("count").over(Window.orderBy("day")) - F.col("count")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("day").orderBy("tx_seq")) - 1
    return txs.select("tid", "day", inner.alias("inner")).join(before, "day").select("tid", (F.col("before") + F.col("inner")).alias("place"))
