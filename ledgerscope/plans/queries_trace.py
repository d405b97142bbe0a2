"""Queries E: tracing. Seeds are all coins that a transaction with three inputs or more issued."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import trace as T
from ledgerscope.plans.queries_clusters import CIOH, cioh_clusters
from ledgerscope.plans.registry import Registry
from ledgerscope.session import materialize
from ledgerscope.sources import adapter
from ledgerscope.sources.ledger import Ledger

R = Registry()
QUERIES, SQL = R.queries, R.sql

_SEEDS = "sd as (select coin_id as seed from coins join txs on tid = producer where n_in >= 3)"
_STEP = "st as (select o.coin_id, i.coin_id as before from tx_outputs o join tx_inputs i using (tid))"
_CONE = f"{_SEEDS}, {_STEP}, cone(seed, coin_id) as (select seed, seed from sd union select seed, before from cone join st using (coin_id))"
_SESSION = "ses as (select tid from payments where form = 'coinjoin')"


def seeds(g: Ledger) -> DataFrame:
    made = g.coins.join(g.txs.filter("n_in >= 3").select(F.col("tid").alias("producer")), "producer", "left_semi")
    return made.select(F.col("coin_id").alias("seed"), "coin_id")


_CONES: dict = {}


def cones(g: Ledger) -> DataFrame:
    """The cones of all seeds, kept for the queries that start from them."""
    if id(g) not in _CONES:
        _CONES[id(g)] = (g, materialize(T.ancestry(g, seeds(g)), "cones"))
    return _CONES[id(g)][1]


@R.ledger(f"{_CONE} select seed, coin_id from cone")
def e1_ancestry(g: Ledger) -> DataFrame:
    return T.ancestry(g, seeds(g))


@R.ledger(f"{_CONE} select distinct seed, producer as tid from cone join coins using (coin_id) where producer is not null")
def e1_ancestry_txs(g: Ledger) -> DataFrame:
    return T.cone_txs(g, cones(g))


_FLOW = f"{_SEEDS}, {_STEP}, tst as (select st.coin_id, before from st join coin_truth o on o.coin_id = st.coin_id join coin_truth i on i.coin_id = before where o.funder is null or o.funder = i.owner)"
_FLOW += ", flow(seed, coin_id) as (select seed, seed from sd union select seed, before from flow join tst using (coin_id))"


@R.ledger(f"{_FLOW} select seed, coin_id from flow")
def e2_true_flow(g: Ledger) -> DataFrame:
    return T.true_flow(g, seeds(g))


@R.ledger(f"{_STEP}, tc(seed, coin_id) as (select tid, coin_id from tx_inputs join txs using (tid) where n_in >= 2 union select seed, before from tc join st using (coin_id)) select seed, coin_id from tc")
def e3_tx_ancestry(g: Ledger) -> DataFrame:
    return T.tx_ancestry(g, g.txs.filter("n_in >= 2").select("tid"))


_JOINT = f"{_CONE}, sets as (select producer as trace, coin_id as seed from coins where coin_id in (select seed from sd)), nn as (select trace, count(*) as n from sets group by 1)"


def _sets(g: Ledger) -> DataFrame:
    return g.coins.join(seeds(g).select("coin_id"), "coin_id", "left_semi").select(F.col("producer").alias("trace"), F.col("coin_id").alias("seed"))


@R.ledger(f"""{_JOINT}, k as (select trace, coin_id, count(distinct seed) as k, bool_or(coin_id = seed) as s from sets join cone using (seed) group by 1, 2)
select trace, coin_id, case when n = 1 then s else k = n or s end as whole from k join nn using (trace)""")
def e4_joint_trace(g: Ledger) -> DataFrame:
    return T.joint_trace(cones(g), _sets(g))


@R.ledger(f"""{_JOINT}, {CIOH}, w as (select trace, rep from sets join cone using (seed) join cl using (coin_id) group by 1, 2 having count(distinct seed) = (select n from nn where nn.trace = sets.trace)),
wm as (select trace, coin_id from w join cl using (rep))
select distinct trace, coin_id, (trace, coin_id) in (select trace, coin_id from wm) as whole from (select trace, coin_id from sets join cone using (seed) union select trace, coin_id from wm)""")
def e5_joint_trace_clusters(g: Ledger) -> DataFrame:
    return T.joint_trace(cones(g), _sets(g), materialize(cioh_clusters(g), "clusters"))


@R.ledger(f"""{_JOINT}, {CIOH}, w as (select trace, rep from sets join cone using (seed) join cl using (coin_id) group by 1, 2 having count(distinct seed) = (select n from nn where nn.trace = sets.trace))
select trace, count(distinct rep) as clusters, count(*) as coins from w join cl using (rep) group by 1""")
def i12_joint_summary(g: Ledger) -> DataFrame:
    clusters = materialize(cioh_clusters(g), "clusters")
    return T.joint_summary(T.joint_trace(cones(g), _sets(g), clusters), clusters)


@R.ledger(f"{_FLOW} select distinct producer as trace, flow.coin_id from flow join coins on coins.coin_id = seed")
def e6_joint_true_flow(g: Ledger) -> DataFrame:
    return _sets(g).join(T.true_flow(g, seeds(g)), "seed").select("trace", "coin_id").distinct()


_INS = f"{_STEP}, ti as (select tid as trace, coin_id as seed from tx_inputs), tic(seed, coin_id) as (select distinct seed, seed from ti union select seed, before from tic join st using (coin_id)), tn as (select trace, count(*) as n from ti group by 1)"


@R.ledger(f"""{_INS}, tk as (select trace, coin_id, count(*) as k, bool_or(coin_id = seed) as s from ti join tic using (seed) group by 1, 2),
xk as (select trace, producer as tid, count(distinct seed) as k from ti join tic using (seed) join coins using (coin_id) where producer is not null group by 1, 2)
select trace, 'coin' as kind, coin_id as id, s or n > 1 and k = n as whole from tk join tn using (trace) union all select trace, 'tx', tid, n > 1 and k = n from xk join tn using (trace) union all select trace, 'tx', trace, true from tn""")
def e7_trace_txs(g: Ledger) -> DataFrame:
    return T.trace_tx(g, g.txs.select("tid"))


@R.ledger(f"{_CONE} select seed, coin_id from cone join coins using (coin_id) where producer is null")
def e8_origins(g: Ledger) -> DataFrame:
    return T.origins(g, cones(g))


_ROBUST: dict = {}


def robust(g: Ledger) -> DataFrame:
    if id(g) not in _ROBUST:
        _ROBUST[id(g)] = (g, materialize(T.robust_origins(g, cones(g)), "robust"))
    return _ROBUST[id(g)][1]


@R.ledger()
def e9_robust_origins(g: Ledger) -> DataFrame:
    return robust(g)


_GRANT = "gr as (select coin_id from coin_truth where kyc)"


@R.ledger(f"""{_CONE}, {_GRANT}, oc(seed, coin_id) as (select seed, seed from sd where seed not in (select coin_id from gr) union select seed, before from oc join st using (coin_id) where before not in (select coin_id from gr)),
b as (select seed, coin_id from cone join coins using (coin_id) where producer is null)
select seed, count(*) as before, count(*) filter (b.coin_id in (select coin_id from gr)) as granted, count(*) - count(*) filter (b.coin_id in (select coin_id from gr)) - count(oc.coin_id) as fractured, count(oc.coin_id) as after from b left join oc using (seed, coin_id) group by 1""")
def e10_aux_decay(g: Ledger) -> DataFrame:
    return T.aux_decay(g, seeds(g), g.coin_truth.filter("kyc").select("coin_id"))


@R.ledger(f"""{_CONE}, rt as (select seed, coin_id, owner from cone join coins using (coin_id) join coin_truth using (coin_id) where producer is null),
pr as (select rt.seed, rt.owner, count(*) as granted from rt join coin_truth t on t.coin_id = rt.seed where rt.owner <> t.owner group by 1, 2),
oc(seed, owner, coin_id) as (select seed, pr.owner, seed from pr join coin_truth t on t.coin_id = seed where t.owner <> pr.owner union select seed, oc.owner, before from oc join st using (coin_id) join coin_truth t on t.coin_id = before where t.owner <> oc.owner),
af as (select seed, owner, count(*) as after from oc join coins using (coin_id) where producer is null group by 1, 2), bf as (select seed, count(*) as before from rt group by 1),
sc as (select seed, owner, before - granted - coalesce(after, 0) as fractured, granted from pr join bf using (seed) left join af using (seed, owner)),
s2 as (select seed, owner, case when fractured > 0 then 1000 else 0 end + fractured + granted as score from sc)
select seed, owner, score from (select *, row_number() over (partition by seed order by score desc, owner) as i from s2) where i = 1""")
def e11_most_damaging_grant(g: Ledger) -> DataFrame:
    return T.rank_grants(g, seeds(g))


@R.ledger(f"{_STEP}, dp(coin_id, depth) as (select coin_id, 0 from coins where producer is null union select st.coin_id, depth + 2 from dp join st on st.before = dp.coin_id) select coin_id, max(depth) as depth from dp group by 1")
def e12_depth(g: Ledger) -> DataFrame:
    return T.depth(g)


_PAST = f"{_CONE}, {_SESSION}, ps as (select distinct seed, producer as tid from cone join coins using (coin_id) where producer in (select tid from ses))"


@R.ledger(f"{_PAST} select seed, tid from ps")
def e13_session_pasts(g: Ledger) -> DataFrame:
    return T.session_pasts(g, cones(g), adapter.sessions(g))


@R.ledger(f"""{_PAST}, np as (select seed, count(*) as n from ps group by 1), sh as (select x.seed as a, y.seed as b, count(*) as k from ps x join ps y using (tid) where x.seed < y.seed group by 1, 2)
select a, b, (p.n > k)::int + (q.n > k)::int as tier from sh join np p on p.seed = a join np q on q.seed = b where (p.n > k)::int + (q.n > k)::int > 0""")
def e13_apart_pairs(g: Ledger) -> DataFrame:
    return T.apart_pairs(materialize(T.session_pasts(g, cones(g), adapter.sessions(g)), "pasts"))


@R.ledger(f"own2 as (select coin_id, first_value(coin_id) over (partition by addr_key order by coin_seq) as rep from coins), {_SESSION} select tid, count(distinct rep) as candidates from tx_inputs join own2 using (coin_id) where tid in (select tid from ses) group by 1")
def e14_fresh_origin(g: Ledger) -> DataFrame:
    from ledgerscope.operators.components import cluster_by

    return T.fresh_origin(g, cluster_by(g.coins, F.col("addr_key")), adapter.sessions(g))


@R.ledger(f"{CIOH} select rep, coin_id, dest as tid from cl join coins using (coin_id)")
def e15_footprints(g: Ledger) -> DataFrame:
    return T.footprint(g, cioh_clusters(g))


@R.ledger()
def i12_origin_summary(g: Ledger) -> DataFrame:
    cone = cones(g)
    return T.origin_summary(cone, T.origins(g, cone), robust(g))
