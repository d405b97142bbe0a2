"""Queries C: clustering and the lattice of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import components as C
from ledgerscope.operators import links as L
from ledgerscope.plans.queries_ledger import MENU, small_amounts
from ledgerscope.plans.registry import Registry
from ledgerscope.session import materialize
from ledgerscope.sources.ledger import Ledger

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: Classes of coins spent together, the only links that DuckDB can close without iteration.
CIOH = """
led as (select tid, min(coin_seq) as lead from tx_inputs join coins using (coin_id) group by 1),
cl as materialized (select c.coin_id, coalesce(l.coin_id, c.coin_id) as rep from coins c left join led on c.dest = led.tid left join coins l on l.coin_seq = led.lead)"""
OWNERS = "own as (select coin_id, first_value(coin_id) over (partition by owner order by coin_seq) as rep from coins join coin_truth using (coin_id))"


def cioh_clusters(g: Ledger) -> DataFrame:
    """Coins spent together: each coin is spent once, so the transaction is the key of its class."""
    return C.cluster_by(g.coins, F.col("dest"))


def owner_clusters(g: Ledger) -> DataFrame:
    return C.cluster_by(g.coins.join(g.coin_truth.select("coin_id", "owner"), "coin_id"), F.struct("owner"))


def base_links(g: Ledger) -> DataFrame:
    return L.links_reuse(g).select("coin_a", "coin_b").union(L.links_cioh(g).select("coin_a", "coin_b"))


@R.ledger(f"{CIOH} select size, count(*) as clusters from (select rep, count(*) as size from cl group by 1) group by 1")
def clusters_by_size(g: Ledger) -> DataFrame:
    sizes = C.cluster(g.coins, L.links_cioh(g)).groupBy("rep").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"))


@R.ledger(f"{CIOH} select coin_id, rep from cl")
def c1_components(g: Ledger) -> DataFrame:
    return C.cluster(g.coins, L.links_cioh(g))


@R.ledger("""
pairs as (select coin_a, coin_b from (select coin_id as coin_b, first_value(coin_id) over (partition by addr_key order by coin_seq) as coin_a from coins) where coin_a <> coin_b
  union all select coin_a, coin_b from (select coin_id as coin_b, first_value(coin_id) over (partition by tid order by in_pos) as coin_a from tx_inputs) where coin_a <> coin_b),
pairs2 as (select coin_a as u, coin_b as v from pairs union select coin_b, coin_a from pairs),
reach(coin_id, seen) as (select coin_id, coin_id from coins union select coin_id, v from reach join pairs2 on u = seen)
select r.coin_id, arg_min(c.coin_id, c.coin_seq) as rep from reach r join coins c on c.coin_id = seen group by 1""")
def c1_components_with_reuse(g: Ledger) -> DataFrame:
    return C.cluster(g.coins, base_links(g))


@R.ledger(f"{CIOH}, s as (select rep, count(*) as size from cl group by 1), r as (select rep, row_number() over (order by size desc, rep) as rank from s) select coin_id, rep, rank from cl join r using (rep)")
def c2_cluster_rank(g: Ledger) -> DataFrame:
    return C.ranked(cioh_clusters(g))


@R.ledger("select addr_key, coin_a, coin_b from (select addr_key, coin_id as coin_b, first_value(coin_id) over (partition by addr_key order by coin_seq) as coin_a from coins where addr_key is not null) where coin_a <> coin_b")
def c3_reuse_links(g: Ledger) -> DataFrame:
    return L.links_reuse(g)


@R.ledger("select tid from tx_inputs join coin_truth using (coin_id) where kyc group by 1 having count(distinct owner) > 1")
def c4_refuted_by_grants(g: Ledger) -> DataFrame:
    grants = g.coin_truth.filter("kyc").select("coin_id", "owner")
    return L.refuted(L.input_groups(g), grants).withColumnRenamed("group", "tid")


@R.ledger("""
bad as (select tid from tx_inputs join coins using (coin_id) group by 1 having count(distinct script) > 1)
select tid, coin_a, coin_b from (select tid, coin_id as coin_b, first_value(coin_id) over (partition by tid order by in_pos) as coin_a from tx_inputs where tid not in (select tid from bad)) where coin_a <> coin_b""")
def c5_common_input_links(g: Ledger) -> DataFrame:
    return L.links_cioh(g, fingerprints=True)


@R.ledger(f"""
v as (select coin_id, producer, case when value % 3 = 0 then 100000 else value end as v from coins),
ses as (select distinct tid from (select tid, v from tx_outputs join v using (coin_id) where v in ({MENU}) group by 1, 2 having count(*) >= 2) join txs using (tid) where n_in >= 2),
g as (select tid, producer as via, in_pos, coin_id from tx_inputs join v using (coin_id) where tid in (select tid from ses) and producer in (select tid from ses))
select tid, via, coin_a, coin_b from (select tid, via, coin_id as coin_b, first_value(coin_id) over (partition by tid, via order by in_pos) as coin_a from g) where coin_a <> coin_b""")
def c6_remeet_links(g: Ledger) -> DataFrame:
    return L.links_remeet(small_amounts(g))


@R.ledger(f"{OWNERS} select coin_id, rep from own")
def c14_owner_partition(g: Ledger) -> DataFrame:
    return owner_clusters(g)


@R.ledger(f"""{CIOH}, addr as (select coin_id, first_value(coin_id) over (partition by addr_key order by coin_seq) as rep from coins),
pairs as (select coin_id as u, rep as v from cl where coin_id <> rep union select coin_id, rep from addr where coin_id <> rep), pairs2 as (select u, v from pairs union select v, u from pairs),
reach(coin_id, seen) as (select coin_id, coin_id from coins union select coin_id, v from reach join pairs2 on u = seen)
select r.coin_id, arg_min(c.coin_id, c.coin_seq) as rep from reach r join coins c on c.coin_id = seen group by 1""")
def c15_partition_join(g: Ledger) -> DataFrame:
    return C.partition_join(g.coins, cioh_clusters(g), C.cluster_by(g.coins, F.col("addr_key")))


@R.ledger(f"{CIOH}, {OWNERS} select coin_id, first_value(coin_id) over (partition by cl.rep, own.rep order by coin_seq) as rep from cl join own using (coin_id) join coins using (coin_id)")
def c16_partition_meet(g: Ledger) -> DataFrame:
    return C.partition_meet(g.coins, cioh_clusters(g), owner_clusters(g))


@R.ledger(f"{CIOH}, {OWNERS} select bool_and(n = 1) as refines, false as same from (select cl.rep, count(distinct own.rep) as n from cl join own using (coin_id) group by 1)")
def c17_refines(g: Ledger) -> DataFrame:
    a, b = cioh_clusters(g), owner_clusters(g)
    return C.refines(a, b).crossJoin(C.same_partition(a, b))


@R.ledger(f"""{CIOH}, {OWNERS}, pairs as (select distinct cl.rep as u, own.rep as v from cl join own using (coin_id) join coin_truth using (coin_id) where kyc and cl.rep <> own.rep and own.rep in (select rep from cl)),
pairs2 as (select u, v from pairs union select v, u from pairs), reach(rep, seen) as (select distinct rep, rep from cl union select rep, v from reach join pairs2 on u = seen),
fused as (select coin_id, lead as rep from cl join (select rep, min(seen) as lead from reach group by 1) using (rep)), s as (select rep, row_number() over (order by count(*) desc, rep) as rank from fused group by rep)
select coin_id, rep, rank from fused join s using (rep)""")
def c18_apply_merges(g: Ledger) -> DataFrame:
    cl, own = cioh_clusters(g), owner_clusters(g)
    kyc = g.coin_truth.filter("kyc").select("coin_id")
    pairs = cl.join(kyc, "coin_id").join(own.select("coin_id", F.col("rep").alias("b")), "coin_id").select(F.col("rep").alias("a"), "b")
    pairs = pairs.join(cl.select(F.col("rep").alias("b")).distinct(), "b", "left_semi").filter("a <> b")
    return C.apply_merges(materialize(cl, "clusters"), pairs)


@R.ledger("""
events as (select coin_seq as event_seq, case when value % 2 = 0 then 'merge' else 'split' end as kind, dest % 40 as a, producer % 40 as b from coins where dest is not null and producer is not null)
select a, b from (select least(a, b) as a, greatest(a, b) as b, arg_max(kind, event_seq) as kind from events group by 1, 2) where kind = 'merge'""")
def c19_active_pairs(g: Ledger) -> DataFrame:
    events = g.coins.filter("dest is not null and producer is not null").select(F.col("coin_seq").alias("event_seq"), F.when(F.col("value") % 2 == 0, "merge").otherwise("split").alias("kind"), (F.col("dest") % 40).alias("a"), (F.col("producer") % 40).alias("b"))
    return C.active_pairs(events)
