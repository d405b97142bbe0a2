"""Queries H and I that iterate: fingerprints, neighbourhoods, seeded matching, provenance, the observer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.exprs import RATE_EDGES
from ledgerscope.operators import amounts as A
from ledgerscope.operators import behaviour as B
from ledgerscope.operators import contracted as N
from ledgerscope.operators import knowledge as K
from ledgerscope.operators import propagate as P
from ledgerscope.operators import provenance as V
from ledgerscope.operators import social as S
from ledgerscope.operators.components import cluster_by
from ledgerscope.plans import observer as O
from ledgerscope.plans.queries_clusters import OWNERS, owner_clusters
from ledgerscope.plans.queries_graph import _ADJ, _REL, relationships
from ledgerscope.plans.registry import Registry
from ledgerscope.session import materialize
from ledgerscope.sources import adapter
from ledgerscope.sources.ledger import Ledger

R = Registry()
QUERIES, SQL = R.queries, R.sql
_KEPT: dict = {}


def kept(name: str, g: Ledger, make) -> DataFrame | O.Reading:
    """What several queries of a ledger start from, made once."""
    if (name, id(g)) not in _KEPT:
        _KEPT[name, id(g)] = (g, make())
    return _KEPT[name, id(g)][1]


def reading(g: Ledger) -> O.Reading:
    return kept("reading", g, lambda: O.cluster_observer(g, adapter.prices(g), O.Options(), K.kyc_grants(g.coin_truth)))


def plain_reading(g: Ledger) -> O.Reading:
    return kept("plain reading", g, lambda: O.cluster_observer(g, adapter.prices(g)))


def without(g: Ledger) -> dict[str, DataFrame]:
    return kept("without", g, lambda: V.clusters_without(g, adapter.prices(g), reading(g), O.Options(), K.kyc_grants(g.coin_truth)))


_MEDIAN = "med as (select day, feerate as median from (select day, feerate, row_number() over (partition by day order by feerate) - 1 as i, count(*) over (partition by day) as n from txs) where i = n // 2)"
_AMT = "least(greatest(floor(log2(greatest(value, 1)))::int - 8, 0), 23)"
_EIGHTH = "least(greatest(floor(greatest(d, 0) * 8 / (top + 1))::int, 0), 7)"
_FEATURES = f"""{OWNERS}, {_MEDIAN}, mx as (select greatest(1, (select max(day) from txs), (select max(entered) from coins)) as top),
got as (select rep, value, script, coalesce(t.day, c.entered, -1) as d from coins c join own using (coin_id) left join txs t on t.tid = c.producer),
i as (select tid, in_pos, rep, low_r from tx_inputs join own using (coin_id)), sp as (select distinct tid, rep, day as d, feerate, median from i join txs using (tid) join med using (day)),
bd as (select rep, locktime, minute from i join txs using (tid) where in_pos = 0), pd as (select sp.rep, sp.d, value from sp join tx_outputs o using (tid) join (select coin_id, value from coins) c on c.coin_id = o.coin_id join (select coin_id, rep as dest_rep from own) x on x.coin_id = o.coin_id where dest_rep <> sp.rep),
f as (select rep, 'amounts' as block, {_AMT} as idx, 1.0::double as w from got union all select rep, 'script', list_position(['legacy', 'compat', 'segwit', 'taproot'], script) - 1, 1 from got union all select rep, 'temporal', {_EIGHTH}, 1 from got, mx
 union all select rep, 'spends', 0, 1 from sp union all select rep, 'temporal', {_EIGHTH}, 1 from sp, mx union all select rep, 'fee_abs', least(greatest(floor(2 * log2(greatest(feerate, 0.25)))::int + 2, 0), 11), 1 from sp
 union all select rep, 'fee_rel', {" + ".join(f"(feerate / median >= {e})::int" for e in RATE_EDGES)}, 1 from sp where median > 0 union all select rep, 'habits', case when locktime = 'height' then 0 else 1 end, 1 from bd where locktime is not null
 union all select rep, 'hours', minute // 180, 1 from bd union all select rep, 'habits', case when low_r then 2 else 3 end, 1 from i union all select rep, 'amounts', {_AMT}, 1 from pd),
feat as (select rep, block, idx::int as idx, sum(w) as weight from f group by 1, 2, 3 union all select rep, 'drift', {_EIGHTH}, round(avg(log2(value)) / 24, 9) from pd, mx group by 1, 3)"""


def features(g: Ledger) -> DataFrame:
    return kept("features", g, lambda: materialize(B.fingerprints(g, owner_clusters(g)), "features"))


@R.ledger(f"{_FEATURES} select rep, block, idx, weight from feat")
def h3_fingerprints(g: Ledger) -> DataFrame:
    return B.fingerprints(g, owner_clusters(g)).withColumn("weight", F.when(F.col("block") == "drift", F.round("weight", 9)).otherwise(F.col("weight")))


@R.ledger(f"""{_FEATURES}, act as (select rep from feat where block = 'spends' and weight >= 2), fl as (select * from feat where block <> 'spends' and rep in (select rep from act)),
nm as (select rep, block, sum(weight * weight) as n from fl group by 1, 2), dt as (select x.rep as a, y.rep as b, x.block, sum(x.weight * y.weight) as dot from fl x join fl y on x.block = y.block and x.idx = y.idx where x.rep < y.rep group by 1, 2, 3),
pr as (select p.rep as a, q.rep as b, count(*) as k from nm p join nm q using (block) where p.rep < q.rep group by 1, 2)
select a, b, round(sum(dot / sqrt(p.n * q.n)) / any_value(k), 6) as score from dt join nm p on p.rep = a and p.block = dt.block join nm q on q.rep = b and q.block = dt.block join pr using (a, b) group by 1, 2""")
def h4_fingerprint_similarity(g: Ledger) -> DataFrame:
    return B.similarities(features(g)).withColumn("score", F.round("score", 6))


@R.ledger()
def h4_fingerprint_matches(g: Ledger) -> DataFrame:
    return B.fingerprint_matches(g, owner_clusters(g), 0.5)


@R.ledger(f"""{_ADJ}, nm as (select a, sum(w * w) as n from adj group by 1), dt as (select x.a, y.a as b, sum(x.w * y.w) as dot from adj x join adj y on x.b = y.b where x.a < y.a group by 1, 2)
select dt.a, dt.b, round(dot / sqrt((p.n - coalesce(d.w * d.w, 0)) * (q.n - coalesce(d.w * d.w, 0))), 6) as score from dt join nm p on p.a = dt.a join nm q on q.a = dt.b left join adj d on d.a = dt.a and d.b = dt.b""")
def h7_neighbour_similarity(g: Ledger) -> DataFrame:
    from pyspark.sql.types import LongType

    none = g.coins.sparkSession.createDataFrame([], "node long, label long")
    assert isinstance(none.schema["node"].dataType, LongType)
    return S.neighbour_similarity(N.adjacency(g, owner_clusters(g)), none).withColumn("score", F.round("score", 6))


def epoch_adjacency(g: Ledger, k: int = 2) -> DataFrame:
    return kept(f"epochs{k}", g, lambda: materialize(N.adjacency(g, owner_clusters(g), N.tx_epochs(g, k)), "epoch-adjacency"))


@R.ledger(f"""{_ADJ}, ep as (select tid, least(place * 2 // (select count(*) from txs), 1)::int as epoch from (select tid, row_number() over (order by tx_seq) - 1 as place from txs)),
ea as (select epoch, a, b, count(*)::double as w from (select tid, a, b from adjp union all select tid, b, a from adjp) join ep using (tid) group by 1, 2, 3), nm as (select epoch, a, sum(w * w) as n from ea group by 1, 2),
dt as (select x.a, y.a as b, x.epoch as e, y.epoch as f, sum(x.w * y.w) as dot from ea x join ea y on x.b = y.b where x.a < y.a and x.epoch <> y.epoch group by 1, 2, 3, 4)
select dt.a, dt.b, e, f, round(dot / sqrt((p.n - coalesce(u.w * u.w, 0)) * (q.n - coalesce(v.w * v.w, 0))), 9) as score from dt join nm p on p.a = dt.a and p.epoch = e join nm q on q.a = dt.b and q.epoch = f
 left join ea u on u.epoch = e and u.a = dt.a and u.b = dt.b left join ea v on v.epoch = f and v.a = dt.b and v.b = dt.a""")
def h8_epoch_pairs(g: Ledger) -> DataFrame:
    none = g.coins.sparkSession.createDataFrame([], "node long, label long")
    return S.epoch_pairs(epoch_adjacency(g), none).withColumn("score", F.round("score", 9))


def social(g: Ledger) -> DataFrame:
    return kept("social", g, lambda: materialize(S.social_matches(epoch_adjacency(g), 0.1), "social"))


@R.ledger()
def h9_social_matches(g: Ledger) -> DataFrame:
    return social(g)


@R.ledger()
def h10_rejudged_matches(g: Ledger) -> DataFrame:
    """What one more pass would split of all that a run has ever merged."""
    return S.rejudge(epoch_adjacency(g), materialize(social(g).filter("kind = 'merge'").select("a", "b").distinct(), "active"), 0.1)


def _mapping(g: Ledger) -> DataFrame:
    seeds = P.pure_seeds(cluster_by(g.coins.join(g.coin_truth.select("coin_id", "owner"), "coin_id"), F.struct("owner")), g.coin_truth, 8)
    return seeds.select(F.lit(0).alias("run"), "node", "image")


def _graphs(g: Ledger) -> tuple[DataFrame, DataFrame]:
    return kept("graphs", g, lambda: (materialize(N.pseudonym_graph(g, owner_clusters(g)), "target"), materialize(N.aux_graph(relationships(g)), "aux")))


def _nodes(g: Ledger) -> dict[str, DataFrame]:
    agents = g.coin_truth.filter("owner is not null").select(F.col("owner").alias("node")).distinct()
    return {"nodes": N.pseudonyms(owner_clusters(g)).select(F.col("rep").alias("node")), "images": agents}


def _sweep(g: Ledger, theta: float = 1.5, exact_order: bool = True) -> DataFrame:
    return kept(f"sweep {theta} {exact_order}", g, lambda: materialize(P.propagation_sweep(*_graphs(g), _mapping(g), theta, exact_order, **_nodes(g)), "sweep"))


_SEEDS = f"{OWNERS}, pu as (select rep as node, min(owner) as image, count(*) as size from own join coin_truth using (coin_id) group by 1 having count(*) >= 2 and count(distinct owner) = 1), sds as (select node, image from pu order by size desc, node limit 8)"


#: The threshold of the sweeps: the dense graphs of the tables hold few nodes that stand out far.
LOOSE = 0.1
_VOUCH = """select node, cand, round(sum(s), 12) as score from (
 select t.{b} as node, x.{d} as cand, 1 / sqrt((select count(*) from {aux} y where y.{d} = x.{d})) as s from {target} t join {map} m on m.{k} = t.{a} join {aux} x on x.{c} = m.{v}
 union all select t.{a}, x.{c}, 1 / sqrt((select count(*) from {aux} y where y.{c} = x.{c})) from {target} t join {map} m on m.{k} = t.{b} join {aux} x on x.{d} = m.{v})
 where node not in (select {k} from {map}) and cand not in (select {v} from {map}) group by 1, 2"""
_ENDS = dict(a="src", b="dst", c="src", d="dst", map="sds")
_BEST = """select node, max(case when i = 1 then cand end) as best, case when {n} < 2 then null when greatest(sum(score * score) / {n} - power(sum(score) / {n}, 2), 0) < 1e-18 then 0
 else (max(score) - coalesce(max(case when i = 2 then score end), 0)) / sqrt(greatest(sum(score * score) / {n} - power(sum(score) / {n}, 2), 0)) end as ecc
 from (select *, row_number() over (partition by node order by score desc, cand) as i from {of}) group by 1"""
_ROUND = f"""tin as (select distinct tid, rep from tx_inputs join own using (coin_id)), tout as (select distinct tid, rep from tx_outputs join own using (coin_id)), big as (select rep as node from own group by 1 having count(*) >= 2),
tg as (select distinct a.rep as src, b.rep as dst from tin a join tout b using (tid) where a.rep <> b.rep and a.rep in (select node from big) and b.rep in (select node from big)),
{_REL}, ax as (select distinct payer as src, payee as dst from rel where payer <> payee),
fs as ({_VOUCH.format(target='tg', aux='ax', k='node', v='image', **_ENDS)}), bs as ({_VOUCH.format(target='ax', aux='tg', k='image', v='node', **_ENDS)}),
nt as (select (select count(*) from big) - (select count(*) from sds) as t, (select count(distinct owner) from coin_truth where owner is not null) - (select count(*) from sds) as a),
fb as ({_BEST.format(of='fs', n='(select a from nt)')}), bb as ({_BEST.format(of='bs', n='(select t from nt)')}),
judged as (select node, fb.best, fb.ecc, bb.best as back, bb.ecc as back_ecc from (select node from big where node not in (select node from sds)) left join fb using (node) left join bb on bb.node = fb.best)"""


@R.ledger(f"{_SEEDS} select node, image from sds")
def h12_pure_seeds(g: Ledger) -> DataFrame:
    return _mapping(g).select("node", "image")


@R.ledger()
def h11_propagation_sweep(g: Ledger) -> DataFrame:
    return _sweep(g, LOOSE).drop("run")


@R.ledger(f"""{_SEEDS}, {_ROUND} select node, case when best is null then 'no-signal' when not (ecc >= {LOOSE}) then 'below-threshold' when back = node and back_ecc >= {LOOSE} then 'accepted' else 'reverse-mismatch' end as outcome,
 case when ecc >= {LOOSE} and back = node and back_ecc >= {LOOSE} then best end as mapped from judged""")
def h11_one_round(g: Ledger) -> DataFrame:
    """All nodes against the seeds alone."""
    return _sweep(g, LOOSE, False).drop("run")


@R.ledger()
def h13_graded_mappings(g: Ledger) -> DataFrame:
    return P.grade_mappings(_sweep(g, LOOSE), owner_clusters(g), g.coin_truth).drop("run")


@R.ledger()
def h14_seed_scan(g: Ledger) -> DataFrame:
    return P.scan_seed_choices(*_graphs(g), owner_clusters(g), g.coin_truth, LOOSE, **_nodes(g))


@R.ledger()
def i18_sweep_report(g: Ledger) -> DataFrame:
    rel = relationships(g).select("payer", "payee").distinct()
    return P.sweep_report(_sweep(g, LOOSE), _mapping(g), owner_clusters(g), rel, N.outsider_edges(relationships(g), 600.0), _nodes(g)["images"]).drop("run")


@R.ledger()
def i18_mapped_edges(g: Ledger) -> DataFrame:
    known = N.outsider_edges(relationships(g), 600.0).select(F.col("payer").alias("src"), F.col("payee").alias("dst"))
    return P.mapped_edges(_sweep(g, LOOSE), _mapping(g), known).drop("run")


@R.ledger(f"{_FEATURES} select rep, block, arg_max(idx, weight * 1000000 - idx * 0.001) as peak from (select rep, block, idx, round(weight, 6) as weight from feat where block not in ('spends', 'drift')) group by 1, 2")
def i11_fingerprint_summary(g: Ledger) -> DataFrame:
    return B.fingerprint_summary(features(g).filter("block <> 'drift'"))


@R.ledger()
def c7_c9_link_events(g: Ledger) -> DataFrame:
    return reading(g).events.select("tid", "method", "basis", "via", F.array_join("coins", ",").alias("coins"))


@R.ledger()
def c10_change_reads(g: Ledger) -> DataFrame:
    r = reading(g).change_reads
    return r.select("tid", "part_no", F.array_join("payments", ",").alias("payments"), F.array_join("selfs", ",").alias("selfs"), "change", "unknowns", "abstain")


@R.ledger()
def c12_observer_clusters(g: Ledger) -> DataFrame:
    return reading(g).clusters


@R.ledger()
def i1_support_chains(g: Ledger) -> DataFrame:
    """Why the inputs of each spend are one owner's."""
    r = reading(g)
    pairs = V.claim_pairs(g).select("a", "b")
    return V.support(r.events, r.clusters, pairs).withColumn("chain", F.array_join("chain", ","))


@R.ledger()
def i2_remove_one_method(g: Ledger) -> DataFrame:
    return V.remove_one_method(V.claim_pairs(g).select("a", "b").distinct(), without(g))


@R.ledger()
def i3_payjoin_detection(g: Ledger) -> DataFrame:
    return V.payjoin_detection(g, plain_reading(g))


@R.ledger()
def i4_picked_payjoin(g: Ledger) -> DataFrame:
    return V.pick_payjoin(g, V.payjoin_detection(g, plain_reading(g)), adapter.payments(g))


@R.ledger()
def i5_settlement_report(g: Ledger) -> DataFrame:
    return V.settlement_report(g, adapter.payments(g), A.amounts(g))


@R.ledger()
def i9_change_summary(g: Ledger) -> DataFrame:
    return O.summarise_reads(reading(g).change_reads)


@R.ledger("select i.tid, i.coin_id as a, j.coin_id as b from tx_inputs i join coin_truth t on t.coin_id = i.coin_id join tx_inputs j on j.tid = i.tid and i.coin_id < j.coin_id join coin_truth u on u.coin_id = j.coin_id and u.owner = t.owner")
def i17_claim_pairs(g: Ledger) -> DataFrame:
    return V.claim_pairs(g)


@R.ledger()
def i17_claim_report(g: Ledger) -> DataFrame:
    found = V.claim_report(g, reading(g), without(g))
    return found.withColumn("chain", F.array_join("chain", ","))


def _bundle(g: Ledger, wants: tuple[str, ...]) -> DataFrame:
    """Frames of the bundle as rows ``name, a, b, what, score``: coins or clusters, and what is said of them."""
    from ledgerscope.plans.analysis import run_analysis

    out = run_analysis(g, adapter.prices(g), O.Options(), K.kyc_grants(g.coin_truth), reading(g), wants, 0.1)
    none = F.lit(None)
    shaped = {
        "clusters": ("coin_id", "rep", none, none), "base": ("coin_id", "rep", none, none), "attribution": ("coin_id", "owner", F.when(F.col("direct"), "direct").otherwise("indirect") if "attribution" in out else none, none),
        "links": ("event", "tid", F.col("reason"), F.col("owners")), "social": ("a", "b", F.col("kind"), F.round("score", 9)), "behaviour": ("a", "b", F.col("round"), F.round("score", 9)),
    }
    total = None
    for name, df in out.items():
        a, b, what, score = shaped[name]
        rows = df.select(F.lit(name).alias("name"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), what.cast("string").alias("what"), score.cast("double").alias("score"))
        total = rows if total is None else total.unionByName(rows)
    return total


@R.ledger()
def i20_analysis_bundle(g: Ledger) -> DataFrame:
    """Clusters, what grants say of them, the base that these merge, and the links' grades."""
    return _bundle(g, ("clusters", "attribution", "base", "links"))


@R.ledger()
def i20_bundle_matches(g: Ledger) -> DataFrame:
    """The matching runs over the base of the bundle."""
    return _bundle(g, ("social", "behaviour"))
