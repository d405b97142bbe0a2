"""Queries F, G, H1-H6 and I: contracted graph, knowledge, matching, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.operators import contracted as N
from ledgerscope.operators import grading as G
from ledgerscope.operators import knowledge as K
from ledgerscope.operators import links as L
from ledgerscope.operators import matching as M
from ledgerscope.plans.queries_clusters import CIOH, OWNERS, cioh_clusters, owner_clusters
from ledgerscope.plans.registry import Registry
from ledgerscope.sources import adapter
from ledgerscope.sources.ledger import Ledger

R = Registry()
QUERIES, SQL = R.queries, R.sql

ADDR = "ad as (select coin_id, first_value(coin_id) over (partition by addr_key order by coin_seq) as rep from coins)"
_EDGES = f"""{OWNERS},
ins as (select distinct tid, rep as src from tx_inputs join own using (coin_id)),
outs as (select tid, coin_id, rep as dst from tx_outputs join own using (coin_id)),
ce as (select tid, src, dst from ins join (select distinct tid, dst from outs where (tid, dst) not in (select tid, src from ins)) using (tid))"""
_ADJ = _EDGES + """,
adjp as (select tid, src as a, dst as b from ins join outs using (tid) where src <> dst),
adj as (select a, b, count(*) as w from (select tid, a, b from adjp union all select tid, b, a from adjp) group by 1, 2)"""
_REL = "rel as (select payer, payee, memo, min(day)::double as lo, max(day)::double as hi from payments where payee is not null group by 1, 2, 3)"


def relationships(g: Ledger) -> DataFrame:
    return adapter.payments(g).filter("payee is not null").groupBy("payer", "payee", "memo").agg(F.min("day").cast("double").alias("lo"), F.max("day").cast("double").alias("hi"))


@R.ledger(f"{_EDGES} select tid, src, dst from ce")
def f1_contracted_edges(g: Ledger) -> DataFrame:
    return N.contracted_edges(g, owner_clusters(g))


@R.ledger(f"{_EDGES} select distinct src || '>' || tid as incidence, tid from ce union select tid || '>' || dst, tid from ce")
def f2_incidence_ids(g: Ledger) -> DataFrame:
    return N.incidences(N.contracted_edges(g, owner_clusters(g)))


@R.ledger(f"{_ADJ} select a, b, w::bigint as w from adj")
def f3_adjacency(g: Ledger) -> DataFrame:
    return N.adjacency(g, owner_clusters(g))


@R.ledger(f"{_EDGES} select a, b, count(*) as w from (select src as a, dst as b from ce union all select dst, src from ce) group by 1, 2")
def f4_transfer_adjacency(g: Ledger) -> DataFrame:
    return N.transfer_adjacency(g, owner_clusters(g))


@R.ledger(f"{_EDGES}, big as (select rep from own group by 1 having count(*) >= 2) select distinct src, dst from ins join (select distinct tid, dst from outs) using (tid) where src <> dst and src in (select rep from big) and dst in (select rep from big)")
def f5_pseudonym_graph(g: Ledger) -> DataFrame:
    return N.pseudonym_graph(g, owner_clusters(g))


@R.ledger(f"{_REL} select distinct payer as src, payee as dst from rel where payer <> payee")
def f6_aux_graph(g: Ledger) -> DataFrame:
    return N.aux_graph(relationships(g))


@R.ledger(f"{_REL} select payer, payee, max(hi) as hi from rel group by 1, 2 having max(hi) >= 600")
def f7_outsider_edges(g: Ledger) -> DataFrame:
    return N.outsider_edges(relationships(g), 600.0)


@R.ledger(f"""{_ADJ}, ep as (select tid, (place * 3 // (select count(*) from txs))::int as epoch from (select tid, row_number() over (order by tx_seq) - 1 as place from txs))
select epoch, a, b, count(*) as w from (select tid, a, b from adjp union all select tid, b, a from adjp) join ep using (tid) group by 1, 2, 3""")
def f9_epoch_adjacency(g: Ledger) -> DataFrame:
    return N.adjacency(g, owner_clusters(g), N.tx_epochs(g, 3))


_SEEN = f"{CIOH}, cd as (select coin_id, coalesce(day, entered, -1) as d from coins left join txs on producer = tid)"
_COLS = f"{_SEEN}, fs as (select rep, min(d) as d, min(coin_id) as least from cl join cd using (coin_id) group by 1), cols as (select rep, ((row_number() over (order by d, least) - 1) * 8 // count(*) over ())::int as \"column\" from fs)"


@R.ledger(f"{_SEEN} select rep, min(d) as first_day from cl join cd using (coin_id) group by 1")
def f10_first_seen(g: Ledger) -> DataFrame:
    return N.first_seen(g, cioh_clusters(g))


@R.ledger(f"{_COLS} select rep, \"column\" from cols")
def f11_timeline_columns(g: Ledger) -> DataFrame:
    return N.partition_columns(g, cioh_clusters(g), 8)


@R.ledger(f"{_COLS}, {OWNERS} select own.rep, string_agg(distinct \"column\"::varchar, ',' order by \"column\"::varchar) as lanes from own join cl using (coin_id) join cols on cols.rep = cl.rep group by 1")
def f11_lanes(g: Ledger) -> DataFrame:
    base = cioh_clusters(g)
    return N.lanes(N.partition_columns(g, base, 8), base, owner_clusters(g)).withColumn("lanes", F.array_join("lanes", ","))


@R.ledger(f"{CIOH}, {OWNERS} select own.rep, cl.rep as piece, count(*) as n, count(*) / sum(count(*)) over (partition by own.rep) as share from own join cl using (coin_id) group by 1, 2")
def f12_partition_overlap(g: Ledger) -> DataFrame:
    return N.overlap(cioh_clusters(g), owner_clusters(g))


@R.ledger("select coin_id, owner from coin_truth where kyc")
def g1_kyc_grants(g: Ledger) -> DataFrame:
    return K.kyc_grants(g.coin_truth)


@R.ledger("select coin_id, owner from coin_truth where ('0x' || substr(sha256('seed/' || coin_id), 1, 12))::bigint / 281474976710656 < 0.2")
def g2_random_grants(g: Ledger) -> DataFrame:
    return K.aux_grants(g.coin_truth, "seed", 0.2)


@R.ledger("select coin_id, owner from coin_truth where kyc or ('0x' || substr(sha256('seed/' || coin_id), 1, 12))::bigint / 281474976710656 < 0.2")
def g3_union_grants(g: Ledger) -> DataFrame:
    return K.observer_grants(K.kyc_grants(g.coin_truth), K.aux_grants(g.coin_truth, "seed", 0.2))


_ONE = f"{CIOH}, uo as (select rep, min(owner) as owner from cl join coin_truth using (coin_id) where kyc group by 1 having count(distinct owner) = 1)"


@R.ledger(f"{_ONE} select rep, owner from uo")
def g4_unanimous_owners(g: Ledger) -> DataFrame:
    return K.cluster_grant_owners(K.kyc_grants(g.coin_truth), cioh_clusters(g))


@R.ledger(f"{_ONE} select coin_id, owner, true as direct from coin_truth where kyc union all select cl.coin_id, uo.owner, false from cl join uo using (rep) join coin_truth t on t.coin_id = cl.coin_id where not kyc")
def g5_grant_attribution(g: Ledger) -> DataFrame:
    return K.grant_attribution(K.kyc_grants(g.coin_truth), cioh_clusters(g))


@R.ledger(f"""{_ONE}, gp as (select rep, min(rep) over (partition by owner) as lead from uo), fused as (select coin_id, coalesce(lead, cl.rep) as rep from cl left join gp on gp.rep = cl.rep),
fr as (select rep, row_number() over (order by count(*) desc, rep) as rank from fused group by 1) select coin_id, rep, rank from fused join fr using (rep)""")
def g6_grant_fusion(g: Ledger) -> DataFrame:
    return K.grant_merges(K.kyc_grants(g.coin_truth), cioh_clusters(g))


_KNOWN = """
legs as (select distinct tid, coin_id, owner from (select tid, coin_id from tx_inputs union all select tid, coin_id from tx_outputs) join coin_truth using (coin_id)),
sides as (select tid, form, payer as agent from payments union all select tid, form, payee from payments where payee is not null),
pt as (select tid, payer as agent from payments where form = 'settlement' union select tid, payee from payments where form = 'settlement' and payee is not null),
n2 as (select tid from pt group by 1 having count(*) = 2),
known as (select owner as agent, coin_id, owner from coin_truth
  union select agent, coin_id, owner from sides join legs using (tid) where form in ('unilateral', 'payjoin')
  union select m.agent, l.coin_id, l.owner from n2 join pt m using (tid) join pt o using (tid) join legs l on l.tid = n2.tid and l.owner = o.agent where m.agent <> o.agent
  union select payer, coin_id, owner from payments join tx_outputs using (tid) join coin_truth using (coin_id) where form = 'coinjoin' and owner = payee)"""


@R.ledger(f"{_KNOWN} select agent, coin_id, owner, true as direct from known")
def g7_agent_knowledge(g: Ledger) -> DataFrame:
    return K.agent_knowledge(g, adapter.payments(g))


@R.ledger(f"""{_KNOWN}, ad as (select coin_id, first_value(coin_id) over (partition by addr_key order by coin_seq) as rep from coins),
un as (select agent, rep, min(owner) as owner from known join ad using (coin_id) group by 1, 2 having count(distinct owner) = 1)
select agent, coin_id, owner, false as direct from un join ad using (rep) where (agent, coin_id) not in (select agent, coin_id from known)""")
def g7_spread_knowledge(g: Ledger) -> DataFrame:
    """What agents infer beyond what they know, through clusters of one address."""
    from ledgerscope.operators.components import cluster_by

    return K.agent_knowledge(g, adapter.payments(g), cluster_by(g.coins, F.col("addr_key"))).filter("not direct")


@R.ledger("select distinct agent, tid from (select payer as agent, tid from payments union all select payee, tid from payments union all select owner, tid from payments join tx_inputs using (tid) join coin_truth using (coin_id) where form = 'coinjoin') where agent is not null")
def g7_known_txs(g: Ledger) -> DataFrame:
    return K.known_txs(g, adapter.payments(g), adapter.sessions(g))


@R.ledger(f"{_KNOWN} select agent, owner, count(*) as coins, count(*) filter (dest is null) as unspent from known join coins using (coin_id) where owner <> agent group by 1, 2")
def g8_counterparty_tally(g: Ledger) -> DataFrame:
    return K.counterparty_tally(g, K.agent_knowledge(g, adapter.payments(g)))


_PAIRS = f"{_ADJ}, deg as (select a, sum(w) as d from adj group by 1), sp as (select x.a, x.b, round(x.w / (p.d + q.d - x.w), 12) as score from adj x join deg p on p.a = x.a join deg q on q.a = x.b where x.a < x.b)"


def scored_pairs(g: Ledger) -> DataFrame:
    """Neighbours scored by their shared weight over their total weight."""
    adj = N.adjacency(g, owner_clusters(g))
    deg = adj.groupBy("a").agg(F.sum("w").alias("d"))
    pairs = adj.filter("a < b").join(deg.withColumnRenamed("d", "da"), "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    return pairs.select("a", "b", (F.col("w") / (F.col("da") + F.col("db") - F.col("w"))).alias("score"))


@R.ledger(f"""{_PAIRS}, sd as (select a as x, score from sp union all select b, score from sp), st as (select x, max(score) as best, count(*) as n, stddev_pop(score) as dev from sd group by 1),
s2 as (select x, best, n, dev, count(*) filter (score = best) as ties, max(score) filter (score < best) as second from sd join st using (x) group by 1, 2, 3, 4),
ok as (select x, best from s2 where ties = 1 and n >= 2 and best >= 0.01 and dev > 0 and (best - second) / dev >= 0.5)
select a, b, score from sp join ok p on p.x = a and p.best = score join ok q on q.x = b and q.best = score""")
def h1_reciprocal_matches(g: Ledger) -> DataFrame:
    return M.accept_reciprocal(scored_pairs(g), 0.01)


@R.ledger("select day, feerate from (select day, feerate, row_number() over (partition by day order by feerate) - 1 as i, count(*) over (partition by day) as n from txs) where i = n // 2")
def h2_day_medians(g: Ledger) -> DataFrame:
    return M.day_medians(g.txs)


_TWO = "two as (select a.id as i, b.id as j, a.payer as p, b.payee as q, b.payer as m from obligations a join obligations b on a.payee = b.payer)"


def h5_netting_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.netting_groups(adapter.obligations(spark, sf_dir))
    return found.select("kind", F.array_join("ids", ",").alias("ids"))


def h6_net_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    owed = adapter.obligations(spark, sf_dir)
    groups = M.netting_groups(owed).filter("kind = 'cycle'").select(F.array_join("ids", ",").alias("group"), F.explode("ids").alias("id"))
    return M.net_positions(groups, owed)


def h5_eligible_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of obligations whose parties all care for privacy and whose payers don't batch."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("party"), (F.col("n_regionkey") > 0).alias("private"), (F.length("n_name") > 8).alias("batches"))
    found = M.netting_groups(adapter.obligations(spark, sf_dir), nations)
    return found.select("kind", F.array_join("ids", ",").alias("ids"))


QUERIES["h5_netting_groups"], QUERIES["h6_net_positions"], QUERIES["h5_eligible_groups"] = h5_netting_groups, h6_net_positions, h5_eligible_groups
SQL["h5_netting_groups"] = adapter.LEDGER_SQL.rstrip() + f""", {_TWO}
select 'mutual' as kind, concat_ws(',', i, j) as ids from two where p = q and i < j union all select 'chain', concat_ws(',', i, j) from two where p <> q
union all select 'cycle', concat_ws(',', i, j, c.id) from two join obligations c on c.payer = q and c.payee = p where p <> q and i < j and i < c.id"""
SQL["h5_eligible_groups"] = adapter.LEDGER_SQL.rstrip() + f""", el as (select o.* from obligations o join nation p on p.n_nationkey = payer join nation q on q.n_nationkey = payee where p.n_regionkey > 0 and q.n_regionkey > 0 and length(p.n_name) <= 8),
{_TWO.replace('obligations', 'el')}
select 'mutual' as kind, concat_ws(',', i, j) as ids from two where p = q and i < j union all select 'chain', concat_ws(',', i, j) from two where p <> q
union all select 'cycle', concat_ws(',', i, j, c.id) from two join el c on c.payer = q and c.payee = p where p <> q and i < j and i < c.id"""
SQL["h6_net_positions"] = adapter.LEDGER_SQL.rstrip() + f""", {_TWO}, cy as (select concat_ws(',', i, j, c.id) as "group", unnest([i, j, c.id]) as id from two join obligations c on c.payer = q and c.payee = p where p <> q and i < j and i < c.id)
select "group", party, sum(net)::bigint as net, sum(gross)::bigint as gross from (select "group", payer as party, -cents as net, cents as gross from cy join obligations using (id) union all select "group", payee, cents, 0 from cy join obligations using (id)) group by 1, 2"""


@R.ledger("""
lk as (select 'cioh' as method, null as basis, tid, tid::varchar as place, coin_id from tx_inputs join txs using (tid) where n_in >= 2
 union all select 'subtx', 'bound', i.tid, concat_ws('/', i.coin_id, o.coin_id), unnest([i.coin_id, o.coin_id]) from tx_inputs i join tx_outputs o using (tid) join txs using (tid) where n_in >= 2 and i.in_pos + 1 = o.out_pos
 union all select 'change', 'residue', i.tid, i.tid::varchar, unnest([i.coin_id, o.coin_id]) from tx_inputs i join tx_outputs o using (tid) join txs using (tid) where in_pos = 0 and out_pos = n_out)
select method, tid, place, count(distinct owner) as owners, case method when 'cioh' then 'inputs of several owners' when 'change' then 'payment of another owner taken for change' else 'forced pair is a payment' end as reason
 from lk join coin_truth using (coin_id) group by method, tid, place having count(distinct owner) > 1""")
def i6_grade_links(g: Ledger) -> DataFrame:
    """Three kinds of links, several of a kind in a transaction: inputs, inputs and outputs of one place, last outputs as change."""
    n = g.txs.select("tid", "n_in", "n_out")
    ins = g.tx_inputs.select("tid", "in_pos", F.col("coin_id").alias("i"))
    both = ins.join(g.tx_outputs.select("tid", "out_pos", F.col("coin_id").alias("o")), "tid").join(n, "tid")
    lit = lambda df, method, basis, place: df.select(F.lit(method).alias("method"), F.lit(basis).cast("string").alias("basis"), "tid", place.cast("string").alias("place"), F.explode("coins").alias("coin_id"))
    links = lit(L.input_groups(g).select(F.col("group").alias("tid"), F.array("coin_id").alias("coins")), "cioh", None, F.col("tid"))
    paired = both.filter("n_in >= 2 and in_pos + 1 = out_pos").withColumn("coins", F.array("i", "o"))
    last = both.filter("in_pos = 0 and out_pos = n_out").withColumn("coins", F.array("i", "o"))
    links = links.unionByName(lit(paired, "subtx", "bound", F.concat_ws("/", "i", "o"))).unionByName(lit(last, "change", "residue", F.col("tid")))
    return G.grade_links(links.withColumnRenamed("place", "event"), g.coin_truth).withColumnRenamed("event", "place")


def _grade(of: str) -> str:
    return f"""on_{of} as (select rep, owner, count(*) as n from {of} join coin_truth using (coin_id) group by 1, 2), sz_{of} as (select rep, sum(n)::bigint as size, max(n) as major from on_{of} group by 1),
st_{of} as (select *, size - major as wrong from sz_{of} where size >= 2), oo_{of} as (select sum(n)::bigint as a, max(n) as b from on_{of} group by owner),
gr_{of} as (select count(*) as stacks, sum(size)::bigint as stacked, sum(wrong)::bigint as misplaced, max(size) as largest, arg_max(wrong, size * 1000000000000000 - rep) as largest_wrong, median(size)::double as median,
  (select sum(b)::bigint from oo_{of} where a >= 2) as gathered, (select sum(a)::bigint from oo_{of} where a >= 2) as gatherable from st_{of})"""


@R.ledger(f"{CIOH}, {_grade('cl')} select * from gr_cl")
def i7_grade_map(g: Ledger) -> DataFrame:
    return G.grade_map(cioh_clusters(g), g.coin_truth)


@R.ledger(f"{CIOH} select rep, owner, count(*) as n, count(*) / sum(count(*)) over (partition by rep) as share, row_number() over (partition by rep order by count(*) desc, owner) as place from cl join coin_truth using (coin_id) group by 1, 2")
def i8_owner_mix(g: Ledger) -> DataFrame:
    return G.owner_mix(cioh_clusters(g), g.coin_truth)


_FIGURES = ["stacks", "stacked", "misplaced", "largest", "largest_wrong", "median", "gathered", "gatherable"]


@R.ledger(f"{CIOH}, {ADDR}, {_grade('cl')}, {_grade('ad')} select a.*, " + ", ".join(f"b.{c} as {c}_after, b.{c} - a.{c} as {c}_change" for c in _FIGURES) + " from gr_cl a, gr_ad b")
def i10_compare_grades(g: Ledger) -> DataFrame:
    from ledgerscope.operators.components import cluster_by

    return G.compare_grades(G.grade_map(cioh_clusters(g), g.coin_truth), G.grade_map(cluster_by(g.coins, F.col("addr_key")), g.coin_truth))


@R.ledger("""
c as (select c.*, owner, coalesce(t.day, c.entered, -1) as coin_day from coins c join coin_truth using (coin_id) left join txs t on t.tid = producer)
select owner, coin_id, coin_day, value, dest is not null as spent, count(*) over (partition by owner, addr_key) > 1 as reused, count(*) filter (dest is null) over (partition by owner) as n_unspent,
 coalesce(sum(value) filter (dest is null) over (partition by owner), 0)::bigint as balance from c""")
def i13_wallet_history(g: Ledger) -> DataFrame:
    return G.wallet_history(g)


@R.ledger("""
n as (select count(*) as n from coins join coin_truth using (coin_id) where dest is null group by owner), o as (select n, row_number() over (order by n) - 1 as i, count(*) over () as k from n)
select (select min(n) from n) as least, (select n from o where i = k // 2) as median, count(*) as spends, count(*) filter (n_in >= 2) as many from payments join txs using (tid) where form = 'unilateral' and not starts_with(memo, 'batch')""")
def i14_wallet_shape(g: Ledger) -> DataFrame:
    return G.wallet_shape(g, adapter.payments(g))


_SES = "ses as (select tid from payments where form = 'coinjoin')"


@R.ledger(f"""{_SES}, m as (select i.tid, label, c.producer in (select tid from ses) as s from tx_inputs i join coins c using (coin_id) join coin_truth using (coin_id))
select tid from m where tid not in (select tid from ses) group by 1 having count(*) >= 2 and bool_or(coalesce(s and label = 'change', false)) and bool_or(coalesce(s, false) and label is distinct from 'change')""")
def i15_toxic_spends(g: Ledger) -> DataFrame:
    return G.toxic_spends(g, adapter.sessions(g))


@R.ledger("select payer, memo, form, count(*) as n from payments group by 1, 2, 3")
def i16_form_tally(g: Ledger) -> DataFrame:
    return G.form_tally(adapter.payments(g))


@R.ledger("select tid, count(distinct coalesce(producer, -1)) as producers from tx_inputs join coins using (coin_id) group by 1 having count(distinct coalesce(producer, -1)) >= 2")
def i19_consolidations(g: Ledger) -> DataFrame:
    return G.consolidations(g)


@R.ledger("""
pay as (select tid, count(distinct owner) as n, min(owner) as payer from tx_inputs join coin_truth using (coin_id) group by 1),
c as (select coin_id, coin_seq, owner, coalesce(day, entered, -1) as d, coalesce(producer is not null and (funder = owner or funder is null and n = 1 and payer = owner), false) as internal from coins join coin_truth using (coin_id) left join txs t on t.tid = producer left join pay on pay.tid = producer)
select coin_id, owner, internal, (row_number() over (partition by owner, internal order by d, coin_seq) - 1)::int as index from c""")
def j1_address_indexes(g: Ledger) -> DataFrame:
    return G.assign_addresses(g)
