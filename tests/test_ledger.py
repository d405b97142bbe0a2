from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerscope.functions import exprs as X
from ledgerscope.operators.links import links_reuse
from ledgerscope.session import honest_sizes, left_join
from ledgerscope.sources import adapter
from ledgerscope.sources.ledger import LOG_SCHEMA, ledger_from_log, through, utxos, validate
from ledgerscope.streaming import jobs
from tests.ledgers import build, fee


def chain(spark):
    v = [1_000_000]
    for _ in range(3):
        v.append(v[-1] - fee(1, 1, 1))
    return build(spark, {1: v[0]}, [(1, 1, 1, [1], [v[1]]), (2, 2, 1, [101], [v[2]]), (3, 3, 1, [201], [v[3]])])


def test_valid_ledger_has_no_violations(spark):
    assert validate(chain(spark)).count() == 0


def test_each_bad_ledger_is_reported(spark):
    rules = lambda g: {r["rule"] for r in validate(g).collect()}
    assert "fee not by size" in rules(build(spark, {1: 1000}, [(1, 1, 1, [1], [10])]))
    assert "double spend" in rules(build(spark, {1: 1000}, [(1, 1, 1, [1], [10]), (2, 1, 1, [1], [10])]))
    assert "input twice" in rules(build(spark, {1: 1000}, [(1, 1, 1, [1, 1], [10])]))
    assert "unknown input" in rules(build(spark, {1: 1000}, [(1, 1, 1, [9], [10])]))
    assert "output not positive" in rules(build(spark, {1: 1000}, [(1, 1, 1, [1], [0])]))
    assert "root not positive" in rules(build(spark, {1: 0}, []))
    assert "no inputs" in rules(build(spark, {}, [(1, 1, 1, [], [5])]))


def test_time_travel(spark):
    past = through(chain(spark), 1)
    assert [r["tid"] for r in past.txs.collect()] == [1]
    assert {r["coin_id"] for r in utxos(past).collect()} == {101}
    assert {r["coin_id"] for r in utxos(through(chain(spark), 2, 0)).collect()} == {101}


def test_log_replay_is_the_ledger(spark):
    g = chain(spark)
    cols = ["coin_id", "value", "producer", "dest", "in_pos"]
    assert sorted(map(tuple, ledger_from_log(jobs.log_of(g)).coins.select(cols).collect()), key=str) == sorted(map(tuple, g.coins.select(cols).collect()), key=str)


def test_denominations():
    assert len(X.DENOMINATIONS) == 56 and X.DENOMINATIONS[0] == 512 and X.DENOMINATIONS[-1] == 100_000_000


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=20))
def test_nonzero_digits(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "v long").select(X.dec_hw(F.col("v")).alias("n")).collect()
    assert [r["n"] for r in got] == [sum(c != "0" for c in str(v)) for v in values]


def test_round_usd(spark):
    df = spark.createDataFrame([(100_000, 100000.0), (150_000, None), (12_345, 100000.0)], "v long, p double")
    assert [r[0] for r in df.select(X.round_usd(F.col("v"), F.col("p"))).collect()] == [True, False, False]


def test_outputs_keep_their_ids_whatever_their_number(spark):
    coin = lambda i: {"coin_id": i, "coin_seq": i, "value": 10, "owner": i % 3, "label": None, "kyc": i % 2 == 0, "addr_key": f"k{i % 40}", "script": "segwit"}
    empty = {"root": None, "tx": None, "note": None}
    tx = lambda tid, inputs, first: {"tid": tid, "feerate": 1.0, "fee": 5, "locktime": "zero", "minute": 7, "inputs": inputs, "low_r": [True, False], "outputs": [{**coin(first + k), "funders": None} for k in range(130)]}
    rows = [{"log_seq": i, "day": 1, "kind": "root", **empty, "root": coin(i)} for i in range(3)]
    rows += [{"log_seq": 10 + t, "day": 2, "kind": "tx", **empty, "tx": tx(t, inputs, first)} for t, inputs, first in ((1, [0, 1, 2], 100), (2, [100, 229], 230))]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    g = ledger_from_log(log)
    assert g.coins.count() == g.coins.select("coin_id").distinct().count() == 263
    assert {(r["tid"], r["in_pos"]): r["low_r"] for r in g.tx_inputs.collect()} == {(1, 0): True, (1, 1): False, (1, 2): None, (2, 0): True, (2, 1): False}
    assert {r["coin_id"]: (r["dest"], r["addr_key"]) for r in g.coins.filter("dest is not null").collect()} == {0: (1, "k0"), 1: (1, "k1"), 2: (1, "k2"), 100: (2, "k20"), 229: (2, "k29")}
    assert links_reuse(g).count() == 263 - 40
    made = [r["coin_id"] for r in jobs.legs(log).filter("what = 'create'").collect()]
    assert sorted(made) == sorted([0, 1, 2, *range(100, 360)])
    again = jobs.log_of(g)
    assert sorted(map(str, ledger_from_log(again).coins.collect())) == sorted(map(str, g.coins.collect()))


def test_rows_without_a_key_are_spread_over_tasks(spark):
    rows = spark.range(8000).select(F.col("id").alias("coin_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 100).alias("dest"))
    # all columns are read, or Spark leaves out the window
    largest = lambda df: df.select(F.spark_partition_id().alias("task"), F.hash(*df.columns).alias("row")).groupBy("task").agg(F.count("*").alias("n"), F.max("row").alias("row")).agg(F.max("n"), F.max("row")).first()[0]
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        placed = adapter._placed(rows)
        assert largest(placed) < 2000
        assert {(r["dest"], r["in_pos"]) for r in placed.collect()} == {(None, None)} | {(d, i) for d in range(0, 100, 10) for i in range(80)}
        known = spark.range(0, 100, 20).select(F.col("id").alias("dest"), F.lit("x").alias("name"))
        joined = left_join(rows, known, "dest")
        assert largest(joined) < 3000
        canonical = lambda df: sorted(map(repr, df.select("coin_id", "dest", "name").collect()))
        assert canonical(joined) == canonical(rows.join(known, "dest", "left"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_files_of_many_rows_are_not_broadcast(spark, tmp_path):
    spark.range(1_000_000).write.option("compression", "zstd").parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    name = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(name)
    plan = lambda: ids.join(spark.read.parquet(f"{tmp_path}/ids"), "id")._jdf.queryExecution().executedPlan().toString()
    try:
        spark.conf.set(name, "1.0")
        assert "BroadcastHashJoin" in plan()
        honest_sizes(spark)
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.set(name, before)


def test_lines_that_cannot_be_spent_look_for_no_spender(spark, sf_dir, monkeypatch):
    rows, write = {}, adapter.materialize
    monkeypatch.setattr(adapter, "materialize", lambda df, name="step": (out := write(df, name), rows.setdefault(name, out.count()))[0])
    g = adapter.build(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert rows["linked"] == lines.filter("l_returnflag = 'R' and l_linestatus = 'F'").count() < rows["lines"] / 3
    assert g.coins.count() == rows["lines"] == lines.count()
    assert g.coins.filter("dest is not null").count() == g.tx_inputs.count() > 0
