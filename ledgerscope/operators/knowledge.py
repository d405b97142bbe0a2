"""What granted attributions and participants' own knowledge add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators.components import apply_merges
from ledgerscope.sources.ledger import Ledger


def kyc_grants(truth: DataFrame) -> DataFrame:
    """G1: ``coin_id, owner`` of flagged coins."""
    return truth.filter("kyc").select("coin_id", "owner")


def aux_grants(truth: DataFrame, seed: str, fraction: float) -> DataFrame:
    """Coins whose stable draw is below the fraction; a larger fraction grants more, never less."""
    draw = F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(seed), "coin_id").cast("binary"), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return truth.filter(draw < fraction).select("coin_id", "owner")


def observer_grants(*grants: DataFrame) -> DataFrame:
    """The union of grants, one row per coin."""
    out = grants[0]
    for more in grants[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["coin_id"])


def cluster_grant_owners(grants: DataFrame, clusters: DataFrame) -> DataFrame:
    """``rep, owner`` of clusters whose grants name exactly one owner, which may be null (outside)."""
    named = grants.join(clusters.select("coin_id", "rep"), "coin_id")
    one = named.groupBy("rep").agg(F.countDistinct(F.struct("owner")).alias("n"), F.first("owner").alias("owner"))
    return one.filter("n = 1").select("rep", "owner")


def grant_attribution(grants: DataFrame, clusters: DataFrame) -> DataFrame:
    """``coin_id, owner, direct``: granted coins, and the other members of unanimous clusters."""
    direct = grants.select("coin_id", "owner", F.lit(True).alias("direct"))
    spread = clusters.select("coin_id", "rep").join(cluster_grant_owners(grants, clusters), "rep").join(grants.select("coin_id"), "coin_id", "left_anti")
    return direct.unionByName(spread.select("coin_id", "owner", F.lit(False).alias("direct")))


def grant_pairs(grants: DataFrame, clusters: DataFrame) -> DataFrame:
    """``a, b``: unanimous clusters of one owner with the first of them; all outsiders are one."""
    owners = cluster_grant_owners(grants, clusters)
    lead = owners.groupBy("owner").agg(F.min("rep").alias("a"))
    return owners.join(lead, owners["owner"].eqNullSafe(lead["owner"])).filter("rep <> a").select("a", F.col("rep").alias("b"))


def grant_merges(grants: DataFrame, clusters: DataFrame) -> DataFrame:
    return apply_merges(clusters, grant_pairs(grants, clusters))


def agent_knowledge(ledger: Ledger, payments: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """``agent, coin_id, owner, direct`` for all agents at once.

    An agent knows its own coins. In a payment of two parties it knows the rest of the transaction;
    in a settlement of exactly two participants the other's coins; the payer of a joint session knows
    what its payee received. Clusters, if given, spread what is unanimous in an agent's view.
    """
    truth = ledger.coin_truth.select("coin_id", "owner")
    legs = ledger.tx_inputs.select("tid", "coin_id").unionByName(ledger.tx_outputs.select("tid", "coin_id")).join(truth, "coin_id").distinct()
    own = truth.filter("owner is not null").select(F.col("owner").alias("agent"), "coin_id", "owner")
    side = lambda agent, other: F.struct(F.col(agent).alias("agent"), F.col(other).alias("other"))
    both = F.when(F.col("payee").isNotNull(), F.array(side("payer", "payee"), side("payee", "payer"))).otherwise(F.array(side("payer", "payee")))
    sides = payments.select("tid", "form", F.explode(both).alias("side")).select("tid", "form", "side.*")
    two = sides.filter("form in ('unilateral', 'payjoin')").join(legs, "tid").select("agent", "coin_id", "owner")
    # the parties of a settlement are those whose obligations it settles
    parties = sides.filter("form = 'settlement'").select("tid", F.explode(F.array("agent", "other")).alias("agent")).filter("agent is not null").distinct()
    two_sided = parties.groupBy("tid").agg(F.count("*").alias("n")).filter("n = 2").select("tid")
    members = parties.join(two_sided, "tid")
    other = members.select("tid", F.col("agent").alias("owner"))
    of_two = members.join(other, "tid").filter("owner <> agent").join(legs, ["tid", "owner"]).select("agent", "coin_id", "owner")
    outs = ledger.tx_outputs.select("tid", "coin_id").join(truth, "coin_id")
    joint = payments.filter("form = 'coinjoin' and payee is not null").select("tid", F.col("payer").alias("agent"), "payee").join(outs, "tid").filter("owner = payee").select("agent", "coin_id", "owner")
    known = own.unionByName(two).unionByName(of_two).unionByName(joint).distinct().withColumn("direct", F.lit(True))
    if clusters is None:
        return known
    inside = known.join(clusters.select("coin_id", "rep"), "coin_id")
    one = inside.groupBy("agent", "rep").agg(F.countDistinct(F.struct("owner")).alias("n"), F.first("owner").alias("owner")).filter("n = 1").drop("n")
    spread = one.join(clusters.select("coin_id", "rep"), "rep").join(known.select("agent", "coin_id"), ["agent", "coin_id"], "left_anti")
    return known.unionByName(spread.select("agent", "coin_id", "owner", F.lit(False).alias("direct")))


def known_txs(ledger: Ledger, payments: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """``agent, tid`` of transactions that agents took part in: their payments, and ``sessions(tid)`` with an input of theirs."""
    sides = payments.select(F.col("payer").alias("agent"), "tid").union(payments.select("payee", "tid")).filter("agent is not null")
    if sessions is not None:
        own = ledger.tx_inputs.join(sessions.select("tid"), "tid", "left_semi").join(ledger.coin_truth.select("coin_id", "owner"), "coin_id")
        sides = sides.union(own.filter("owner is not null").select(F.col("owner").alias("agent"), "tid"))
    return sides.distinct()


def counterparty_tally(ledger: Ledger, known: DataFrame) -> DataFrame:
    """``agent, owner, coins, unspent`` of others' coins known directly."""
    others = known.filter("direct and not (owner <=> agent)").join(ledger.coins.select("coin_id", "dest"), "coin_id")
    return others.groupBy("agent", "owner").agg(F.count("*").alias("coins"), F.count_if(F.col("dest").isNull()).alias("unspent"))
