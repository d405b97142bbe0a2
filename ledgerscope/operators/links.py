"""What links coins of one owner: address reuse, common inputs, repeated sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.exprs import is_denomination
from ledgerscope.sources.ledger import Ledger


def radix_txs(ledger: Ledger) -> DataFrame:
    """``tid`` of transactions with a denomination that repeats among their outputs."""
    outs = ledger.tx_outputs.join(ledger.coins.select("coin_id", "value").filter(is_denomination(F.col("value"))), "coin_id")
    return outs.groupBy("tid", "value").count().filter("count >= 2").select("tid").distinct()


def sessions(ledger: Ledger) -> DataFrame:
    """``tid`` of radix transactions with two inputs at least."""
    return radix_txs(ledger).join(ledger.txs.filter("n_in >= 2").select("tid"), "tid", "left_semi")


def refuted(groups: DataFrame, grants: DataFrame | None) -> DataFrame | None:
    """C4: ``group`` of ``group, coin_id`` whose grants name two owners; a null owner is an owner."""
    if grants is None:
        return None
    return groups.join(grants, "coin_id").groupBy("group").agg(F.countDistinct(F.struct("owner")).alias("n")).filter("n > 1").select("group")


def mixed_scripts(groups: DataFrame, coins: DataFrame) -> DataFrame:
    """``group`` whose coins have two scripts; coins without one don't count."""
    return groups.join(coins.select("coin_id", "script"), "coin_id").groupBy("group").agg(F.countDistinct("script").alias("n")).filter("n > 1").select("group")


def allowed(groups: DataFrame, ledger: Ledger, grants: DataFrame | None, fingerprints: bool) -> DataFrame:
    """Groups without those that grants refute or, with fingerprints, whose scripts are mixed."""
    vetoes = [v for v in (refuted(groups, grants), mixed_scripts(groups, ledger.coins) if fingerprints else None) if v is not None]
    for veto in vetoes:
        groups = groups.join(veto, "group", "left_anti")
    return groups


def links_reuse(ledger: Ledger) -> DataFrame:
    """``addr_key, coin_a, coin_b``: each later coin of an address with its first one."""
    coins = ledger.coins.filter("addr_key is not null").select("addr_key", "coin_id", "coin_seq")
    first = coins.groupBy("addr_key").agg(F.min_by("coin_id", "coin_seq").alias("coin_a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return coins.join(first, "addr_key").filter("coin_id <> coin_a").select("addr_key", "coin_a", F.col("coin_id").alias("coin_b"))


def star(groups: DataFrame) -> DataFrame:
    """``group, coin_a, coin_b`` of ``group, pos, coin_id``: each coin with the first of its group."""
    first = groups.groupBy("group").agg(F.min_by("coin_id", "pos").alias("coin_a"))
    return groups.join(first, "group").filter("coin_id <> coin_a").select("group", "coin_a", F.col("coin_id").alias("coin_b"))


def input_groups(ledger: Ledger, cap: int | None = None) -> DataFrame:
    """``group, pos, coin_id`` of transactions with two inputs at least, and at most ``cap``."""
    txs = ledger.txs.filter("n_in >= 2")
    txs = txs if cap is None else txs.filter(F.col("n_in") <= cap)
    return ledger.tx_inputs.join(txs.select("tid"), "tid", "left_semi").select(F.col("tid").alias("group"), F.col("in_pos").alias("pos"), "coin_id")


def links_cioh(ledger: Ledger, cap: int | None = None, grants: DataFrame | None = None, fingerprints: bool = False) -> DataFrame:
    """``tid, coin_a, coin_b``: the inputs of one transaction."""
    return star(allowed(input_groups(ledger, cap), ledger, grants, fingerprints)).withColumnRenamed("group", "tid")


def remeet_groups(ledger: Ledger, grants: DataFrame | None = None, fingerprints: bool = False) -> DataFrame:
    """``tid, via, in_pos, coin_id`` of inputs of a session that one earlier session issued."""
    ses = sessions(ledger)
    ins = ledger.with_inputs().join(ses, "tid", "left_semi").filter("producer is not null")
    ins = ins.join(ses.withColumnRenamed("tid", "producer"), "producer", "left_semi")
    many = ins.groupBy("tid", "producer").count().filter("count >= 2").drop("count")
    groups = ins.join(many, ["tid", "producer"]).select(F.struct("tid", "producer").alias("group"), F.col("in_pos").alias("pos"), "coin_id")
    groups = allowed(groups, ledger, grants, fingerprints)
    return groups.select("group.tid", F.col("group.producer").alias("via"), F.col("pos").alias("in_pos"), "coin_id")


def links_remeet(ledger: Ledger, grants: DataFrame | None = None, fingerprints: bool = False) -> DataFrame:
    """``tid, via, coin_a, coin_b``."""
    groups = remeet_groups(ledger, grants, fingerprints)
    made = star(groups.select(F.struct("tid", "via").alias("group"), F.col("in_pos").alias("pos"), "coin_id"))
    return made.select("group.tid", "group.via", "coin_a", "coin_b")
