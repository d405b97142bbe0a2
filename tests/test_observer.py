import random
from dataclasses import replace

from pyspark.sql import functions as F

from ledgerscope.operators.components import apply_merges, cluster, cluster_by, components, from_groups, partition_join, partition_meet, ranked, refines, same_partition
from ledgerscope.operators import provenance
from ledgerscope.operators.provenance import payjoin_detection
from ledgerscope.plans.observer import Options, cluster_observer
from tests.ledgers import build, classes, fee, prices

PLAIN = Options(subsum=False)


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for e in edges for n in e}


def test_common_inputs(spark):
    g = build(spark, {1: 200_000, 2: 300_000, 3: 500_000}, [(1, 1, 2, [1, 2], [350_000, 150_000 - fee(2, 2, 2)])])
    rep = {r["coin_id"]: r["rep"] for r in cluster_observer(g, prices(spark, {}), PLAIN).clusters.collect()}
    assert rep[1] == rep[2] != rep[3]


def test_round_payment_leaves_change(spark):
    g = build(spark, {1: 1_000_000}, [(1, 1, 1, [1], [100_000, 900_000 - fee(1, 2, 1)])])
    r = cluster_observer(g, prices(spark, {1: 100_000}), PLAIN)
    assert [x["coin_id"] for x in r.change_guess.collect()] == [102]
    rep = {x["coin_id"]: x["rep"] for x in r.clusters.collect()}
    assert rep[1] == rep[102] != rep[101]


def test_two_round_outputs_are_no_guess(spark):
    g = build(spark, {1: 1_000_000}, [(1, 1, 1, [1], [100_000, 200_000])])
    assert cluster_observer(g, prices(spark, {1: 100_000}), PLAIN).change_guess.count() == 0


def test_batch_abstains(spark):
    g = build(spark, {1: 1_000_000 + fee(1, 3, 1)}, [(1, 1, 1, [1], [150_000, 371_300, 478_700])])
    r = cluster_observer(g, prices(spark, {1: 100_000}), PLAIN)
    assert [x["abstain"] for x in r.change_reads.collect()] == ["batch"] and r.change_guess.count() == 0


def test_radix_outputs_are_self_spends(spark):
    g = build(spark, {1: 4_371_337 + fee(1, 3, 1)}, [(1, 1, 1, [1], [2_000_000, 2_000_000, 371_337])])
    r = cluster_observer(g, prices(spark, {}), PLAIN)
    assert {x["basis"] for x in r.events.collect()} == {"radix"} and r.change_guess.count() == 0
    assert classes(r.clusters) == [[1, 101, 102, 103]]


def test_grants_veto_common_inputs(spark):
    g = build(spark, {1: 200_000, 2: 300_000}, [(1, 1, 2, [1, 2], [350_000, 149_000])], {1: 7, 2: 8})
    grants = spark.createDataFrame([(1, 7), (2, 8)], "coin_id long, owner int")
    assert classes(cluster_observer(g, prices(spark, {}), PLAIN, grants).clusters) == [[1], [2], [101], [102]]


def test_change_of_many_inputs_waits_for_an_earlier_link(spark):
    # with common inputs off, the second spend's inputs are one cluster only through the first spend's change
    txs = [(1, 1, 1, [1], [100_000, 877_777]), (2, 2, 1, [102, 1_000], [100_000, 801_111])]
    g = build(spark, {1: 1_000_000, 1_000: 50_000}, txs)
    off = Options(cioh=False, subsum=False)
    assert {x["abstain"] for x in cluster_observer(g, prices(spark, {}), off).change_reads.filter("tid = 2").collect()} == {"inputs"}
    keyed = g.coins.withColumn("addr_key", F.when(F.col("coin_id").isin(1, 1_000), F.lit("k")))
    linked = type(g)(keyed, g.coin_truth, g.txs, g.tx_inputs, g.tx_outputs)
    assert {x["coin_id"] for x in cluster_observer(linked, prices(spark, {}), off).change_guess.collect()} == {102, 202}


def test_unique_parts_are_linked(spark):
    g = build(spark, {1: 230_500, 2: 777_000 + fee(2, 3, 2)}, [(1, 1, 2, [1, 2], [100_000, 130_500, 777_000])])
    r = cluster_observer(g, prices(spark, {}), Options())
    assert classes(r.clusters) == [[1, 101, 102], [2, 103]]


def test_lattice(spark):
    coins = spark.createDataFrame([(i, i) for i in range(6)], "coin_id long, coin_seq long")
    groups = lambda gs: from_groups(coins, spark.createDataFrame([(i, c) for i, g in enumerate(gs) for c in g], "group int, coin_id long"))
    coarse, fine = groups([[0, 1, 2, 3]]), groups([[0, 1], [2, 3], [4, 5]])
    assert classes(partition_meet(coins, coarse, fine)) == [[0, 1], [2, 3], [4], [5]]
    joined = partition_join(coins, groups([[0, 1], [2, 3]]), groups([[1, 2]]))
    assert classes(joined) == [[0, 1, 2, 3], [4], [5]]
    assert refines(partition_meet(coins, coarse, fine), coarse).first()[0] and not refines(coarse, fine).first()[0]
    assert same_partition(fine, fine).first()[0] and not same_partition(fine, coarse).first()[0]
    # absorption
    assert classes(partition_join(coins, coarse, partition_meet(coins, coarse, fine))) == classes(coarse)


def test_rank_and_merges(spark):
    coins = spark.createDataFrame([(i, i) for i in range(5)], "coin_id long, coin_seq long")
    links = spark.createDataFrame([(0, 1), (2, 3)], "coin_a long, coin_b long")
    got = ranked(cluster(coins, links))
    assert {r["rep"]: r["rank"] for r in got.collect()} == {0: 1, 2: 2, 4: 3}
    fused = apply_merges(got, spark.createDataFrame([(0, 4), (2, 4)], "a long, b long"))
    assert classes(fused) == [[0, 1, 2, 3, 4]]


def addressed(g, keys):
    return replace(g, coins=g.coins.withColumn("addr_key", F.element_at(F.create_map(*(F.lit(x) for pair in keys.items() for x in pair)), F.col("coin_id"))))


def detected_by_reading_again(g, price, opts):
    """I3 by its definition: the observer's clusters with one spend left out, for each spend."""
    spark, out = g.coins.sparkSession, {}
    for tid, coins in g.tx_inputs.groupBy("tid").agg(F.collect_list("coin_id")).filter("size(`collect_list(coin_id)`) > 1").collect():
        rep = {r["coin_id"]: r["rep"] for r in cluster_observer(g, price, opts, excluded=spark.createDataFrame([(tid,)], "tid long")).clusters.collect()}
        sizes = [sum(r == rep[c] for r in rep.values()) for c in coins]
        distinct = len({rep[c] for c in coins}) == len(coins)
        out[tid] = (distinct, min(sizes), distinct and min(sizes) >= 2)
    return out


def test_payjoin_detection_is_the_record_read_again(spark):
    g = build(spark, {1: 3_000_000, 2: 2_000_000}, [(1, 1, 1, [1, 2], [100_000, 4_871_337]), (2, 1, 1, [102], [2_000_000, 2_000_000, 871_000])])
    g, price = addressed(g, {1: "a", 201: "a", 2: "b", 102: "b"}), prices(spark, {1: 100_000})
    got = {r["tid"]: tuple(r)[1:] for r in payjoin_detection(g, cluster_observer(g, price, PLAIN)).collect()}
    assert got == detected_by_reading_again(g, price, PLAIN) == {1: (False, 6, False)}

    rnd = random.Random(6)
    free, txs, roots = [1, 2, 3, 4, 5, 6], [], {c: rnd.choice([2_000_000, 3_000_000]) for c in range(1, 7)}
    values = dict(roots)
    for tid in range(10, 17):
        inputs = rnd.sample(free, min(len(free), rnd.randint(1, 3)))
        total = sum(values[c] for c in inputs) - 1_000
        outs = [total // 3, total // 3, total - 2 * (total // 3)] if rnd.random() < 0.5 else [100_000, total - 100_000]
        txs.append((tid, 1, 1, inputs, outs))
        values |= {100 * tid + k: v for k, v in enumerate(outs, 1)}
        free = [c for c in free if c not in inputs] + [100 * tid + k for k in range(1, len(outs) + 1)]
    g = addressed(build(spark, roots, txs), {c: rnd.choice("pqrstuvwxyz") for c in values if rnd.random() < 0.6})
    got = {r["tid"]: tuple(r)[1:] for r in payjoin_detection(g, cluster_observer(g, price, PLAIN)).collect()}
    assert got == detected_by_reading_again(g, price, PLAIN) and got


def test_clusters_without_a_method_are_those_of_the_record_read_again(spark, monkeypatch):
    rnd = random.Random(8)
    free, txs, roots = [1, 2, 3, 4, 5, 6], [], {c: rnd.choice([2_000_000, 3_000_000]) for c in range(1, 7)}
    values = dict(roots)
    for tid in range(10, 20):
        inputs = rnd.sample(free, min(len(free), rnd.randint(1, 3)))
        total = sum(values[c] for c in inputs) - 1_000
        outs = [total // 3, total // 3, total - 2 * (total // 3)] if rnd.random() < 0.3 else [100_000, total - 100_000]
        txs.append((tid, 1, 1, inputs, outs))
        values |= {100 * tid + k: v for k, v in enumerate(outs, 1)}
        free = [c for c in free if c not in inputs] + [100 * tid + k for k in range(1, len(outs) + 1)]
    g = addressed(build(spark, roots, txs), {c: rnd.choice("pqrstuvwxyz") for c in values if rnd.random() < 0.5})
    price, opts = prices(spark, {1: 100_000}), Options()
    reading = cluster_observer(g, price, opts)
    want = {m: classes(cluster_observer(g, price, replace(opts, **{m: False})).clusters) for m in provenance.METHODS}
    assert len({str(c) for c in want.values()}) > 2
    reads = []
    monkeypatch.setattr(provenance, "cluster_observer", lambda *a, **k: (reads.append(1), cluster_observer(*a, **k))[1])
    got = {m: classes(c) for m, c in provenance.clusters_without(g, price, reading, opts).items()}
    assert got == want and len(reads) <= 2


def test_coins_without_a_key_share_no_task(spark):
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    kept = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        coins = spark.range(0, 4000, 1, 4).selectExpr("id as coin_id", "id as coin_seq", "if(id % 10 = 0, id div 20, null) as dest")
        got = cluster_by(coins, F.col("dest"))
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2000
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)
    rep = {r["coin_id"]: r["rep"] for r in got.collect()}
    assert rep == {i: i // 20 * 20 if i % 10 == 0 else i for i in range(4000)}


def test_clusters_of_one_size_are_ranked_in_several_tasks(spark):
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    rows = spark.range(4000).selectExpr("id as coin_id", "if(id < 3, 0, id) as rep")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = ranked(rows)
        assert "PARTITION BY size" not in (plan := got._jdf.queryExecution().toString()) and "windowspecdefinition(size" not in plan
        ranks = {r["rep"]: r["rank"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert ranks == {0: 1} | {rep: rep - 1 for rep in range(3, 4000)}
