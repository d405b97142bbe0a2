"""Connected components and partitions of coins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.session import left_join, materialize

MAX_ROUNDS = 60


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, label`` for every end of an edge; the label is the smallest node of its component.

    Each round hangs every node on its smallest neighbour, follows these pointers twice more and
    contracts the edges, so chains shrink geometrically. What a round leaves is written to the
    shared folder; edges of a hub are aggregated before the shuffle and its join can be split.
    """
    pair = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    open_edges = materialize(pair.filter("u <> v").distinct(), "edges")
    labels = None
    nodes = pair.select("u").union(pair.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("label"))
    for _ in range(MAX_ROUNDS):
        if open_edges.isEmpty():
            break
        both = open_edges.union(open_edges.select("v", "u"))
        hung = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = materialize(hung, "parents")
        jumped = hung
        for _ in range(2):
            above = hung.select(F.col("u").alias("m"), F.col("m").alias("mm"))
            jumped = jumped.join(above, "m").select("u", F.col("mm").alias("m"))
        jumped = materialize(jumped, "parents")
        start = nodes if labels is None else labels
        up = jumped.select(F.col("u").alias("label"), F.col("m").alias("higher"))
        labels = materialize(start.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label")), "labels")
        moved = open_edges.join(jumped.select("u", F.col("m").alias("a")), "u").join(jumped.select(F.col("u").alias("v"), F.col("m").alias("b")), "v")
        open_edges = materialize(moved.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"no fixed point within {MAX_ROUNDS} rounds")
    return nodes if labels is None else labels


def ranked(clusters: DataFrame) -> DataFrame:
    """Add ``rank``: by size, largest first, then representative.

    Most clusters may have one size. They are dealt by range and numbered in each part; the parts have a running
    count of one row each.
    """
    from pyspark.sql.window import Window

    order = [F.desc("size"), F.asc("rep")]
    sizes = materialize(clusters.groupBy("rep").agg(F.count("*").alias("size")), "sizes")
    # numbers hold the part above 33 bits and the place in it below
    placed = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.select("rep", F.shiftright("at", 33).alias("part"), (F.col("at") % (1 << 33) + 1).alias("within")), "places")
    per = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranks = placed.join(F.broadcast(before), "part").select("rep", (F.col("before") + F.col("within")).alias("rank"))
    return clusters.drop("rank").join(ranks, "rep").select("coin_id", "rep", "rank")


def cluster(coins: DataFrame, links: DataFrame) -> DataFrame:
    """``coin_id, rep`` of all coins under links ``coin_a, coin_b``; the first coin of a class leads it."""
    seq = coins.select("coin_id", "coin_seq")
    a = seq.select(F.col("coin_id").alias("coin_a"), F.col("coin_seq").alias("src"))
    b = seq.select(F.col("coin_id").alias("coin_b"), F.col("coin_seq").alias("dst"))
    labels = components(links.join(a, "coin_a").join(b, "coin_b"))
    led = seq.join(labels.withColumnRenamed("node", "coin_seq"), "coin_seq", "left").withColumn("label", F.coalesce("label", "coin_seq"))
    first = seq.select(F.col("coin_seq").alias("label"), F.col("coin_id").alias("rep"))
    return led.join(first, "label").select("coin_id", "rep")


def from_groups(coins: DataFrame, groups: DataFrame) -> DataFrame:
    """C17: a partition from ``group, coin_id``; coins in no group stand alone, overlapping groups fuse."""
    lead = groups.groupBy("group").agg(F.min("coin_id").alias("coin_a"))
    return cluster(coins, groups.join(lead, "group").select("coin_a", F.col("coin_id").alias("coin_b")))


def cluster_by(coins: DataFrame, key) -> DataFrame:
    """C14: coins with equal keys form a class; a null key stands alone. The first coin leads."""
    keyed = coins.withColumn("_key", key)
    lead = keyed.filter("_key is not null").groupBy("_key").agg(F.min_by("coin_id", "coin_seq").alias("rep"))
    return left_join(keyed, lead, "_key").select("coin_id", F.coalesce("rep", "coin_id").alias("rep"))


def partition_join(coins: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The finest partition that both refine."""
    links = a.select(F.col("coin_id").alias("coin_a"), F.col("rep").alias("coin_b")).union(b.select("coin_id", "rep"))
    return cluster(coins, links)


def partition_meet(coins: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The coarsest partition that refines both."""
    both = a.select("coin_id", F.col("rep").alias("rep_a")).join(b.select("coin_id", F.col("rep").alias("rep_b")), "coin_id").join(coins.select("coin_id", "coin_seq"), "coin_id")
    lead = both.groupBy("rep_a", "rep_b").agg(F.min_by("coin_id", "coin_seq").alias("rep"))
    return both.join(lead, ["rep_a", "rep_b"]).select("coin_id", "rep")


def refines(a: DataFrame, b: DataFrame) -> DataFrame:
    """C17: one row ``refines``: each class of ``a`` lies in one class of ``b``."""
    both = a.join(b.select("coin_id", F.col("rep").alias("rep_b")), "coin_id")
    spread = both.groupBy("rep").agg(F.min("rep_b").alias("low"), F.max("rep_b").alias("high"))
    return spread.agg(F.coalesce(F.bool_and(F.col("low") == F.col("high")), F.lit(True)).alias("refines"))


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """C17: one row ``same``: each refines the other."""
    return refines(a, b).crossJoin(refines(b, a).withColumnRenamed("refines", "back")).select((F.col("refines") & F.col("back")).alias("same"))


def apply_merges(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fuse clusters joined by pairs ``a, b`` of representatives; the smallest leads; ranks anew."""
    labels = components(pairs, "a", "b").select(F.col("node").alias("rep"), "label")
    fused = clusters.join(labels, "rep", "left").select("coin_id", F.coalesce("label", "rep").alias("rep"))
    return ranked(fused)


def active_pairs(events: DataFrame) -> DataFrame:
    """Pairs of ``event_seq, kind, a, b`` whose last event is a merge."""
    last = events.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max_by("kind", "event_seq").alias("kind"))
    return last.filter("kind = 'merge'").select("a", "b")
