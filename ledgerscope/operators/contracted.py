"""The ledger contracted to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.sources.ledger import Ledger, coin_day, record_order


def ends(ledger: Ledger, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``tid, src`` of inputs and ``tid, coin_id, dst`` of outputs, by cluster."""
    rep = clusters.select("coin_id", "rep")
    ins = ledger.tx_inputs.join(rep, "coin_id").select("tid", F.col("rep").alias("src")).distinct()
    outs = ledger.tx_outputs.join(rep, "coin_id").select("tid", "coin_id", F.col("rep").alias("dst"))
    return ins, outs


def contracted_edges(ledger: Ledger, clusters: DataFrame) -> DataFrame:
    """``tid, src, dst`` of each input cluster and each other cluster that is paid; transactions within clusters vanish."""
    ins, outs = ends(ledger, clusters)
    paid = outs.select("tid", "dst").distinct().join(ins.withColumnRenamed("src", "dst"), ["tid", "dst"], "left_anti")
    return ins.join(paid, "tid")


def incidences(edges: DataFrame) -> DataFrame:
    """``incidence, tid`` with stable ids: ``rep>tid`` into a transaction and ``tid>rep`` out of it."""
    into = edges.select(F.concat_ws(">", "src", "tid").alias("incidence"), "tid")
    return into.union(edges.select(F.concat_ws(">", "tid", "dst"), "tid")).distinct()


def _mirrored(pairs: DataFrame, *keys: str) -> DataFrame:
    counted = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("w"))
    both = counted.unionByName(counted.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy(*keys, "a", "b").agg(F.sum("w").alias("w"))


def adjacency(ledger: Ledger, clusters: DataFrame, epochs: DataFrame | None = None) -> DataFrame:
    """``[epoch,] a, b, w``: one for each output and other input cluster, both ways."""
    ins, outs = ends(ledger, clusters)
    pairs = ins.join(outs, "tid").filter("src <> dst").select("tid", F.col("src").alias("a"), F.col("dst").alias("b"))
    return _mirrored(pairs) if epochs is None else _mirrored(pairs.join(epochs, "tid"), "epoch")


def transfer_adjacency(ledger: Ledger, clusters: DataFrame) -> DataFrame:
    """one for each contracted edge, both ways."""
    return _mirrored(contracted_edges(ledger, clusters).select(F.col("src").alias("a"), F.col("dst").alias("b")))


def pseudonym_graph(ledger: Ledger, clusters: DataFrame) -> DataFrame:
    """``src, dst``: distinct directed edges between clusters of two coins at least."""
    member = clusters.select("coin_id", "rep").join(pseudonyms(clusters), "rep", "left_semi")
    side = lambda legs, name: legs.join(member, "coin_id").select("tid", F.col("rep").alias(name)).distinct()
    return side(ledger.tx_inputs, "src").join(side(ledger.tx_outputs, "dst"), "tid").filter("src <> dst").select("src", "dst").distinct()


def pseudonyms(clusters: DataFrame) -> DataFrame:
    """``rep`` of clusters of two coins at least, those without an edge too."""
    return clusters.groupBy("rep").count().filter("count >= 2").select("rep")


def aux_graph(relationships: DataFrame) -> DataFrame:
    """``src, dst`` without loops."""
    return relationships.filter("payer <> payee").select(F.col("payer").alias("src"), F.col("payee").alias("dst")).distinct()


def outsider_edges(relationships: DataFrame, least: float) -> DataFrame:
    """relationships of which some memo reaches ``least``."""
    return relationships.groupBy("payer", "payee").agg(F.max("hi").alias("hi")).filter(F.col("hi") >= least)


def tx_epochs(ledger: Ledger, k: int) -> DataFrame:
    """F8: record order cut into ``k`` runs of equal count."""
    n = ledger.txs.count()
    return record_order(ledger.txs).select("tid", F.least(F.floor(F.col("place") * k / max(n, 1)), F.lit(k - 1)).cast("int").alias("epoch"))


def first_seen(ledger: Ledger, clusters: DataFrame) -> DataFrame:
    """``rep, first_day``."""
    return clusters.join(coin_day(ledger), "coin_id").groupBy("rep").agg(F.min("coin_day").alias("first_day"))


def partition_columns(ledger: Ledger, clusters: DataFrame, k: int) -> DataFrame:
    """``rep, column``: clusters by first day and smallest member, cut into ``k`` runs.

    Clusters are numbered within their first day; days have a running sum of one row each.
    """
    seen = clusters.join(coin_day(ledger), "coin_id").groupBy("rep").agg(F.min("coin_day").alias("day"), F.min("coin_id").alias("least"))
    days = seen.groupBy("day").count()
    before = days.select("day", (F.sum("count").over(Window.orderBy("day")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("least")) - 1
    placed = seen.withColumn("inner", place).join(before, "day")
    return placed.select("rep", F.least(F.floor((F.col("before") + F.col("inner")) * k / F.col("n")), F.lit(k - 1)).cast("int").alias("column"))


def lanes(columns: DataFrame, base: DataFrame, fused: DataFrame) -> DataFrame:
    """``rep, lanes``: the columns of the base clusters of each fused cluster."""
    of = base.select("coin_id", F.col("rep").alias("base")).join(fused.select("coin_id", "rep"), "coin_id").select("rep", "base").distinct()
    return of.join(columns.select(F.col("rep").alias("base"), "column"), "base").groupBy("rep").agg(F.array_sort(F.collect_set("column")).alias("lanes"))


def overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """``rep, piece, n, share``: the pieces of each new cluster by old cluster."""
    pieces = new.select("coin_id", "rep").join(old.select("coin_id", F.col("rep").alias("piece")), "coin_id").groupBy("rep", "piece").agg(F.count("*").alias("n"))
    sizes = new.groupBy("rep").agg(F.count("*").alias("size"))
    return pieces.join(sizes, "rep").select("rep", "piece", "n", (F.col("n") / F.col("size")).alias("share"))
