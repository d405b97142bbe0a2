"""The spanning forest of links against a replay in record order."""

import random

from pyspark.sql import functions as F

from ledgerscope.operators.joined import NEVER, joined_at, settled, spanning_ways, star_edges
from ledgerscope.plans.observer import numbered

SCHEMA = "event long, coins array<long>, requires array<long>, ask boolean"


class Replay:
    def __init__(self):
        self.parent = {}

    def root(self, c):
        while self.parent.get(c, c) != c:
            c = self.parent[c]
        return c

    def join(self, coins):
        for r in {self.root(c) for c in coins}:
            self.parent[r] = self.root(min(coins))

    def one(self, coins):
        return len({self.root(c) for c in coins}) == 1


def random_events(seed, n_coins, n_events):
    rnd = random.Random(seed)
    events = []
    for number in sorted(rnd.sample(range(10 * n_events), n_events)):
        some = lambda: rnd.sample(range(n_coins), rnd.randint(1, 3))
        events.append((number, some(), some() if rnd.random() < 0.5 else None, False))
        if rnd.random() < 0.2:
            coins = some()
            events.append((number * 10_000 + 1, coins, coins, True))
    numbers = {e[0]: i for i, e in enumerate(sorted(events, key=lambda e: e[0] * 10_000 if e[0] < 10 * n_events else e[0]))}
    return sorted((numbers[e[0]], *e[1:]) for e in events)


def test_settled_events_are_those_of_a_replay(spark):
    events = random_events(1, 40, 60)
    replay, want = Replay(), set()
    for number, coins, requires, ask in events:
        if requires is None or replay.one(requires):
            want.add(number)
            if not ask:
                replay.join(coins)
    held, ways = settled(spark.createDataFrame(events, SCHEMA))
    assert {r["event"] for r in held.collect()} == want
    top = {r["node"]: r["labels"][-1] for r in ways.collect()}
    assert all((top[a] == top[b]) == replay.one([a, b]) for a in top for b in top)
    assert max(len(r["labels"]) for r in ways.collect()) <= 8


def test_the_link_that_joins_coins_is_found(spark):
    rnd = random.Random(5)
    links = [(i, rnd.sample(range(60), rnd.choice([2, 2, 2, 4]))) for i in range(50)]
    groups = [(g, rnd.sample(range(66), rnd.randint(1, 4))) for g in range(80)]
    replay, want = Replay(), {g: NEVER if len(c) == 1 else None for g, c in groups}
    for number, coins in links:
        replay.join(coins)
        for g, c in groups:
            if want[g] is None and replay.one(c):
                want[g] = number
    nodes = spark.range(60).selectExpr("id as node")
    ways, forest = spanning_ways(nodes, star_edges(spark.createDataFrame(links, "event long, coins array<long>")))
    got = {r["group"]: r["at"] for r in joined_at(spark.createDataFrame(groups, "group long, coins array<long>"), ways).collect()}
    assert got == want
    top = {r["node"]: r["labels"][-1] for r in ways.collect()}
    assert forest.count() == 60 - len(set(top.values()))


def test_a_long_chain_and_no_links(spark):
    chain = spark.range(3000).selectExpr("id as event", "array(id, id + 1) as coins")
    ways, _ = spanning_ways(spark.range(3001).selectExpr("id as node"), star_edges(chain))
    got = joined_at(spark.createDataFrame([(0, [0, 3000]), (1, [17, 1203]), (2, [5, 6])], "group long, coins array<long>"), ways).collect()
    assert {r["group"]: r["at"] for r in got} == {0: 2999, 1: 1202, 2: 5}
    held, ways = settled(spark.createDataFrame([], SCHEMA))
    assert held.count() == 0 and ways.count() == 0


def test_links_are_made_once_to_be_numbered(spark):
    made = spark.sparkContext.accumulator(0)

    def coins(i):
        made.add(1)
        return [i, i + 1]

    rows = spark.range(50).select((F.col("id") % 7).alias("seq"), F.lit(0).alias("stage"), F.lit(0).cast("long").alias("pos"), F.udf(coins, "array<long>")("id").alias("coins"))
    got = [tuple(r) for r in numbered(rows).orderBy("event").select("seq", "coins").collect()]
    assert got == sorted(got) and len(got) == 50
    assert made.value == 50
