"""Sub-transaction amounts of all transactions at once.

Distinct sums are folded, one amount at a time: the sums so far and the same with the amount added,
without repeats, so many inputs of few values have few sums. Larger sides are taken as two halves.
Sums of one side are matched with sums of the other by a band join: equal transaction and bucket of
the sum, then the exact tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.session import materialize
from ledgerscope.sources.ledger import Ledger

TOLERANCE = 500
#: Distinct sums of half a side, and pairs of half sums of the inputs. Beyond that a transaction has no density
#: (null), and others are judged all the same.
HALF_SUMS, SUM_PAIRS = 1 << 17, 1 << 26
#: Places of a transaction whose subsets are listed with their masks; beyond that it has one row of nulls.
MASKED = 30
#: Verdicts are inconclusive beyond this many inputs, beyond this many readings of half of the output values
#: or of these times subsets of inputs, and where this many pairs of subsets are to be expected in balance.
MAX_INPUTS, MAX_HALF, MAX_MET, MAX_BALANCED = 10, 1 << 20, 1 << 24, 1 << 22
PARTS = "array<struct<i: int, o: array<int>>>"


def amounts(ledger: Ledger) -> DataFrame:
    """``tid, fee, ins, outs``: amounts in order."""
    value = ledger.coins.select("coin_id", "value")
    side = lambda legs, pos, name: legs.join(value, "coin_id").groupBy("tid").agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "value"))), lambda x: x["value"]).alias(name))
    both = side(ledger.tx_inputs, "in_pos", "ins").join(side(ledger.tx_outputs, "out_pos", "outs"), "tid")
    return both.join(ledger.txs.select("tid", "fee"), "tid")


def subset_sums(values: DataFrame, column: str, max_degree: int | None = None) -> DataFrame:
    """``tid, mask, total`` of nonempty subsets of an array column, of ``max_degree`` elements at most.

    All subsets are listed of ``MASKED`` elements at most; a larger transaction has one row without mask and
    total. Bounded subsets of more than 63 elements have no mask.
    """
    if max_degree is None:
        n = F.size(column)
        # high and low bits apart: no array is longer than 2^15
        bits = lambda k: F.explode(F.expr(f"sequence(0L, shiftleft(1L, {k}) - 1)"))
        some = values.filter((n > 0) & (n <= MASKED)).select("tid", column, bits(f"greatest(size({column}) - 15, 0)").alias("high"))
        masks = some.select("tid", column, "high", bits(f"least(size({column}), 15)").alias("low")).select("tid", column, F.shiftleft("high", 15).bitwiseOR(F.col("low")).alias("mask")).filter("mask > 0")
        none = F.lit(None).cast("long")
        return masks.select("tid", "mask", _masked(column).alias("total")).union(values.filter(n > MASKED).select("tid", none, none))
    # a subset of one element more takes an element behind its last
    one = "if(size(all) <= 63, shiftleft(1L, last), null)"
    level = values.select("tid", F.col(column).alias("all"), F.posexplode(column).alias("last", "total")).withColumn("mask", F.expr(one))
    out = level
    for _ in range(max_degree - 1):
        level = level.filter("last + 1 < size(all)").withColumn("last", F.explode(F.expr("sequence(last + 1, size(all) - 1)")))
        level = level.withColumns({"total": F.col("total") + F.expr("all[last]"), "mask": F.col("mask").bitwiseOR(F.expr(one))})
        out = out.unionByName(level)
    return out.select("tid", "mask", "total")


def _masked(column: str) -> Column:
    return F.expr(f"aggregate(transform({column}, (v, i) -> if(shiftright(mask, i) & 1 = 1, v, 0L)), 0L, (a, x) -> a + x)")


def folded_sums(amounts: Column) -> Column:
    """The distinct sums of subsets, the empty one's 0 first; null beyond ``HALF_SUMS``."""
    more = lambda sums, v: F.array_distinct(F.concat(sums, F.transform(sums, lambda x: x + v)))
    held = F.aggregate(amounts, F.array(F.lit(0).cast("long")), lambda sums, v: F.when(F.size(sums) <= HALF_SUMS, more(sums, v)))
    return F.when(F.size(held) <= HALF_SUMS, held)


def halves(values: DataFrame, column: str) -> DataFrame:
    """Add ``x`` and ``y``: the distinct sums of the first half of an array column and of the rest."""
    half = F.expr(f"cast(size({column}) / 2 as int)")
    return values.withColumns({"x": folded_sums(F.slice(column, F.lit(1), half)), "y": folded_sums(F.slice(column, half + 1, F.size(column)))})


def distinct_sums(values: DataFrame, column: str) -> DataFrame:
    """``tid, total``: the distinct sums of nonempty subsets of positive amounts; one null row where they are too many."""
    both = halves(values.select("tid", column), column)
    fits = F.coalesce(F.size("x").cast("long") * F.size("y") <= SUM_PAIRS, F.lit(False))
    rows = both.filter(fits).select("tid", "y", F.explode("x").alias("a")).select("tid", F.explode(F.transform("y", lambda b: b + F.col("a"))).alias("total"))
    return rows.filter("total > 0").distinct().union(both.filter(~fits).select("tid", F.lit(None).cast("long")))


def ambiguity(values: DataFrame, tol: int | Column = TOLERANCE) -> DataFrame:
    """D3: ``tid, density``: the share of distinct input sums within ``tol`` of an output sum; null where the sums of a side are too many.

    Sums of the outputs are those of their first half plus those of the rest, matched by a band join:
    ``tol`` is constant in a transaction, so two buckets of 2 tol + 1 cover a band. Amounts are positive.
    """
    values = values.withColumn("tol", F.lit(tol) if isinstance(tol, int) else tol)
    sums = distinct_sums(values, "ins")
    n = sums.groupBy("tid").agg(F.count("*").alias("n"), F.count("total").alias("there"))
    outs = halves(values.select("tid", "tol", "outs"), "outs")
    over = outs.filter("x is null or y is null").select("tid", F.lit(True).alias("over"))
    first, rest = outs.select("tid", "tol", F.explode("x").alias("x")), outs.select("tid", "tol", F.explode("y").alias("y"))
    width = 2 * F.col("tol") + 1
    wanted = sums.filter("total is not null").join(first, "tid").withColumn("want", F.col("total") - F.col("x")).filter("want >= -tol")
    low = F.floor((F.col("want") - F.col("tol")) / width)
    near = wanted.withColumn("bucket", F.explode(F.array(low, low + 1))).join(rest.withColumn("bucket", F.floor(F.col("y") / width)).drop("tol"), ["tid", "bucket"])
    near = near.filter((F.abs(F.col("y") - F.col("want")) <= F.col("tol")) & (F.col("x") + F.col("y") > 0)).select("tid", "total").distinct().groupBy("tid").agg(F.count("*").alias("k"))
    judged = values.select("tid").join(n, "tid", "left").join(near, "tid", "left").join(over, "tid", "left")
    lost = F.coalesce("over", F.lit(False)) | F.coalesce(F.col("there") < F.col("n"), F.lit(False))
    return judged.select("tid", F.when(~lost, F.coalesce(F.col("k") / F.col("n"), F.lit(0.0))).alias("density"))


def _within(part: str, whole: str, guards: str = "g") -> str:
    """That a coded reading is part of another: a field that would go below 0 takes its guard bit."""
    return " and ".join(f"(({whole}{h} | {guards}{h}) - {part}{h}) & {guards}{h} = {guards}{h}" for h in "12")


def _coded(taken: str, shifts: str) -> str:
    return f"aggregate(zip_with({taken}, {shifts}, (x, s) -> shiftleft(cast(x as bigint), s)), 0L, (a, x) -> a + x)"


def coded(values: DataFrame) -> DataFrame:
    """Add what readings of the output values are coded with: the places of fields ``s1, s2``, all outputs ``a1, a2``, guard bits ``g1, g2``.

    A reading is two numbers, one for each half of ``kinds``, with a field of each value's count and a guard
    bit above it; with at most ``MAX_MET`` and ``MAX_HALF`` readings of the halves no number has over 48 bits.
    """
    half = "cast(size(kinds) / 2 as int)"
    for h, part in (("1", f"slice(counts, 1, {half})"), ("2", f"slice(counts, {half} + 1, size(counts))")):
        shifts = f"transform({part}, (x, k) -> aggregate(slice({part}, 1, k), 0, (a, y) -> a + length(bin(y)) + 1))"
        values = values.withColumn(f"s{h}", F.expr(shifts))
        values = values.withColumns({f"a{h}": F.expr(_coded(part, f"s{h}")), f"g{h}": F.expr(_coded(f"transform({part}, x -> shiftleft(1L, length(bin(x))))", f"s{h}"))})
    return values


def balanced(values: DataFrame, tol: int = TOLERANCE) -> DataFrame:
    """``tid, i, o1, o2, gap, least_in, least_out, n_out, n``: inputs that exceed outputs by ``gap``, at least -tol and at most fee + tol.

    ``i`` is a mask of ``n`` inputs; ``o1, o2`` code how often each of the distinct output values ``kinds`` is taken, out of
    ``counts``, so equal outputs are not told apart; ``n_out`` outputs are taken. The least amounts of both sides are given.
    """
    values = coded(values)
    width = F.col("fee") + 2 * tol + 1
    ins = subset_sums(values, "ins").join(values.select("tid", "fee", "ins"), "tid")
    least = F.expr("array_min(filter(ins, (v, k) -> shiftright(mask, k) & 1 = 1))")
    ins = ins.select("tid", F.col("mask").cast("int").alias("i"), "total", "fee", width.alias("width"), least.alias("least_in"))
    half = "cast(size(kinds) / 2 as int)"

    def readings(start: str, length: str, h: str, other: str) -> DataFrame:
        """How often each of some output values is taken, and what that makes."""
        part = values.select("tid", F.expr(f"slice(kinds, {start}, {length})").alias("v"), F.expr(f"slice(counts, {start}, {length})").alias("c"), f"s{h}")
        radix = F.expr("transform(c, (x, k) -> aggregate(slice(c, 1, k), 1L, (a, x) -> a * (x + 1)))")
        part = part.select("tid", "v", "c", f"s{h}", radix.alias("radix"), F.explode(F.expr("sequence(0L, aggregate(c, 1L, (a, x) -> a * (x + 1)) - 1)")).alias("n"))
        part = part.withColumn("taken", F.expr("transform(c, (x, k) -> cast((n div radix[k]) % (x + 1) as int))"))
        total, least = "aggregate(zip_with(taken, v, (x, v) -> x * v), 0L, (a, x) -> a + x)", "array_min(filter(v, (v, k) -> taken[k] > 0))"
        n = "aggregate(taken, 0, (a, x) -> a + x)"
        return part.select("tid", F.expr(_coded("taken", f"s{h}")).alias(f"o{h}"), F.expr(total).alias(other), F.expr(least).alias(f"least{h}"), F.expr(n).alias(f"n{h}"))

    first, rest = readings("1", half, "1", "x"), readings(f"{half} + 1", "size(kinds)", "2", "y")
    # what the rest has to make: between total - x - fee - tol and total - x + tol
    wanted = ins.join(first, "tid").withColumn("want", F.col("total") - F.col("x")).filter(F.col("want") >= -tol)
    low = F.floor((F.col("want") - F.col("fee") - tol) / F.col("width"))
    spread = wanted.withColumn("bucket", F.explode(F.array(low, low + 1)))
    dealt = rest.join(values.select("tid", width.alias("w")), "tid").withColumn("bucket", F.floor(F.col("y") / F.col("w"))).drop("w")
    gap = F.col("want") - F.col("y")
    met = spread.join(dealt, ["tid", "bucket"]).filter((gap >= -tol) & (gap <= F.col("fee") + tol) & (F.col("x") + F.col("y") > 0))
    return met.select("tid", "i", "o1", "o2", gap.alias("gap"), "least_in", F.least("least1", "least2").alias("least_out"), (F.col("n1") + F.col("n2")).alias("n_out"), F.bit_count("i").alias("n"))


def minimal_parts(pairs: DataFrame, fees: DataFrame, tol: int) -> DataFrame:
    """Balanced pairs without a balanced pair of proper subsets of both sides inside; ``fees(tid, fee, g1, g2, ...)``.

    What has a balanced pair inside has one inside that is not balanced without its least input or without its
    least output, so pairs are held against these alone. One input or one output has no proper part.
    """
    there = pairs.join(fees.select("tid", "fee", "g1", "g2"), "tid")
    alone = (F.col("n") > 1) & (F.col("gap") - F.col("least_in") >= -tol)
    alone = alone | (F.col("n_out") > 1) & (F.col("gap") + F.col("least_out") <= F.col("fee") + tol)
    all_i = fees.select("tid", F.expr("cast(shiftleft(1, n) - 1 as int)").alias("all_i"))
    inner = there.filter(~alone).join(all_i, "tid").select("tid", F.col("i").alias("i2"), F.col("o1").alias("p1"), F.col("o2").alias("p2"), F.col("all_i").bitwiseAND(F.bitwise_not("i")).alias("more"))
    inner = inner.select("tid", "p1", "p2", F.explode(F.expr("transform(filter(sequence(0, more), s -> s > 0 and s & more = s), s -> s | i2)")).alias("i"))
    large = there.filter("n > 1 and n_out > 1")
    inside = F.expr(f"(p1 <> o1 or p2 <> o2) and {_within('p', 'o')}")
    wide = large.alias("l").join(inner.alias("r"), (F.col("l.tid") == F.col("r.tid")) & (F.col("l.i") == F.col("r.i")) & inside, "left_anti")
    return there.filter("n = 1 or n_out = 1").unionByName(wide).select(*pairs.columns)


#: How many open covers of a transaction are followed at a time; where two covers are not found among these, more are.
BEAMS = (32, 2048, None)


def _covers(whole: DataFrame, parts: DataFrame, tol: int, beam: int | None) -> tuple[DataFrame, DataFrame | None]:
    """``tid, ways, parts`` of the covers found, and ``tid`` of the transactions of which not all open covers were followed."""
    empty = f"cast(array() as {PARTS})"
    of = whole.select("tid", "fee", "g1", "g2")
    state = whole.select("tid", F.col("all_i").alias("free_i"), F.col("a1").alias("f1"), F.col("a2").alias("f2"), F.col("all_gap").alias("left"), F.lit(1).alias("ways"), F.expr(empty).alias("parts"))
    done = cut = None
    for _ in range(MAX_INPUTS):
        # the part that holds the lowest free input has no lower one
        taken = state.withColumn("low", F.expr("free_i & -free_i")).join(parts, ["tid", "low"]).join(of, "tid").filter(f"i & free_i = i and {_within('o', 'f')}")
        moved = taken.select(
            "tid", "fee", (F.col("free_i") - F.col("i")).alias("free_i"), (F.col("f1") - F.col("o1")).alias("f1"), (F.col("f2") - F.col("o2")).alias("f2"), (F.col("left") - F.col("gap")).alias("left"),
            (F.col("ways") * F.col("several")).alias("ways"), F.array_append("parts", F.struct("i", F.col("mask").alias("o"))).alias("parts"),
        )
        # as many parts as free inputs at most make up what is left over
        n = F.bit_count("free_i")
        open_ = (n > 0) & ((F.col("f1") != 0) | (F.col("f2") != 0)) & (F.col("left") >= -tol * n) & (F.col("left") <= (F.col("fee") + tol) * n)
        moved = moved.filter(open_ | (n == 0) & (F.col("f1") == 0) & (F.col("f2") == 0)).groupBy("tid", "free_i", "f1", "f2", "left").agg(F.least(F.sum("ways"), F.lit(2)).cast("int").alias("ways"), F.min("parts").alias("parts"))
        if beam:
            order = F.when(F.col("free_i") == 0, 0).otherwise(1), F.xxhash64("free_i", "f1", "f2")
            moved = moved.withColumn("place", F.row_number().over(Window.partitionBy("tid").orderBy(*order))).filter(F.col("place") <= beam + 1)
        moved = materialize(moved, "covers")
        if beam:
            over = moved.filter(F.col("place") > beam).select("tid")
            cut = over if cut is None else cut.union(over)
            moved = moved.filter(F.col("place") <= beam).drop("place")
        ended = moved.filter("free_i = 0").select("tid", "ways", "parts")
        done = ended if done is None else done.union(ended)
        # two covers are enough
        settled = done.groupBy("tid").agg(F.sum("ways").alias("k")).filter("k > 1").select("tid")
        state = materialize(moved.filter("free_i <> 0").join(settled, "tid", "left_anti"), "open")
        if state.isEmpty():
            break
    return materialize(done.groupBy("tid").agg(F.least(F.sum("ways"), F.lit(2)).alias("ways"), F.min("parts").alias("parts")), "found"), cut


def subtx_verdict(values: DataFrame, tol: int = TOLERANCE) -> DataFrame:
    """``tid, kind, parts``; parts are masks of inputs and places of outputs, given where the partition is unique.

    Exact covers of all inputs and outputs by minimal parts, counted up to two: each round takes the
    part that holds the lowest free input. A part that takes some but not all outputs of a value could
    take others of them, so it counts twice. First few open covers of a transaction are followed, and all of
    them where that leaves it open whether there are two. Transactions beyond ``MAX_INPUTS``, ``MAX_HALF``, ``MAX_MET`` or
    ``MAX_BALANCED`` are inconclusive.
    """
    sized = values.withColumn("n", F.size("ins")).withColumn("m", F.size("outs"))
    trivial = sized.filter("n < 2 or m < 2").select("tid", F.lit("atomic").alias("kind"))
    sized = sized.filter("n >= 2 and m >= 2").withColumn("kinds", F.array_sort(F.array_distinct("outs"))).withColumn("counts", F.expr("transform(kinds, v -> size(filter(outs, x -> x = v)))"))
    of = lambda part: f"aggregate({part}, 1D, (a, x) -> a * (x + 1))"
    half = "cast(size(kinds) / 2 as int)"
    sized = sized.withColumns({"r1": F.expr(of(f"slice(counts, 1, {half})")), "r2": F.expr(of(f"slice(counts, {half} + 1, size(counts))")), "all": F.expr("aggregate(outs, 1D, (a, x) -> a + x)")})
    sized = sized.withColumn("expected", F.expr(f"pow(2D, n) * r1 * r2 * least(1D, (fee + 2 * {tol} + 1) / all)"))
    fits = f"n <= {MAX_INPUTS} and r2 <= {MAX_HALF} and pow(2D, n) * r1 <= {MAX_MET} and expected <= {MAX_BALANCED}"
    large = sized.filter(f"not ({fits})").select("tid", F.lit("inconclusive").alias("kind"))
    fit = sized.filter(fits).withColumn("places", F.expr("transform(kinds, v -> filter(transform(outs, (x, k) -> if(x = v, k, null)), k -> k is not null))"))
    fit = fit.withColumn("all_gap", F.expr("aggregate(ins, 0L, (a, x) -> a + x) - aggregate(outs, 0L, (a, x) -> a + x)"))
    fit = materialize(fit, "amounts")
    # parts in balance, of an input each at least, don't lack more than that
    whole = coded(fit.filter(F.col("all_gap") >= -tol * F.col("n"))).withColumn("all_i", F.expr("cast(shiftleft(1, n) - 1 as int)"))
    # the whole is no part of two, and parts are found within what balances
    pairs = materialize(balanced(fit.join(whole.select("tid"), "tid", "left_semi"), tol), "balanced")
    parts = minimal_parts(pairs, whole, tol).join(whole.select("tid", "all_i", "a1", "a2", "s1", "s2", "counts", "places"), "tid").filter("i <> all_i and (o1 <> a1 or o2 <> a2)")
    took = lambda h: f"transform(s{h}, (s, k) -> cast(shiftright(o{h}, s) & (shiftleft(1L, length(bin(counts[k{'' if h == '1' else ' + size(s1)'}]))) - 1) as int))"
    parts = parts.withColumn("o", F.expr(f"concat({took('1')}, {took('2')})"))
    several = F.expr("if(forall(zip_with(o, counts, (x, c) -> x = 0 or x = c), z -> z), 1, 2)")
    mask = F.expr("array_sort(flatten(zip_with(o, places, (x, p) -> if(x > 0, p, slice(p, 1, 0)))))")
    parts = materialize(parts.select("tid", "i", "o1", "o2", "gap", F.expr("i & -i").alias("low"), several.alias("several"), mask.alias("mask")), "parts")
    whole = materialize(whole.select("tid", "fee", "all_i", "a1", "a2", "g1", "g2", "all_gap"), "whole")
    asked, found = whole, None
    for beam in BEAMS:
        covers, cut = _covers(asked, parts, tol, beam)
        again = None if cut is None else materialize(cut.distinct().join(covers.filter("ways > 1").select("tid"), "tid", "left_anti"), "again")
        covers = covers if again is None else covers.join(again, "tid", "left_anti")
        found = covers if found is None else found.unionByName(covers)
        if again is None or again.isEmpty():
            break
        asked = asked.join(again, "tid", "left_semi")
    kind = F.when(F.col("ways").isNull(), "atomic").when(F.col("ways") == 1, "unique").otherwise("ambiguous")
    judged = fit.select("tid").join(found, "tid", "left").select("tid", kind.alias("kind"), F.when(F.col("ways") == 1, F.col("parts")).alias("parts"))
    none = F.lit(None).cast(PARTS)
    return judged.unionByName(trivial.withColumn("parts", none)).unionByName(large.withColumn("parts", none))


def forced_pairs(ledger: Ledger, tol: int = TOLERANCE) -> DataFrame:
    """``tid, in_pos, out_pos`` that belong together in every balanced reading."""
    value = ledger.coins.select("coin_id", "value")
    whole = Window.partitionBy("tid")
    ins = ledger.tx_inputs.join(value, "coin_id").select("tid", "in_pos", F.col("value").alias("v_in"), F.sum("value").over(whole).alias("all_in"))
    outs = ledger.tx_outputs.join(value, "coin_id").select("tid", "out_pos", F.col("value").alias("v_out"), F.sum("value").over(whole).alias("all_out"))
    both = ins.join(outs, "tid").join(ledger.txs.select("tid", "fee"), "tid")
    forced = (F.col("all_in") - F.col("v_in") < F.col("v_out") - tol) | (F.col("all_out") - F.col("v_out") < F.col("v_in") - F.col("fee") - tol)
    return both.filter(forced).select("tid", "in_pos", "out_pos")


def merge_inputs(inputs: DataFrame, groups: DataFrame) -> DataFrame:
    """``tid, place, value, positions`` of ``tid, in_pos, value`` with grouped inputs as one at their first place."""
    keyed = inputs.join(groups.select("tid", "in_pos", "group"), ["tid", "in_pos"], "left")
    merged = keyed.groupBy("tid", F.when(F.col("group").isNull(), F.col("in_pos")).alias("alone"), "group").agg(F.min("in_pos").alias("first"), F.sum("value").alias("value"), F.array_sort(F.collect_list("in_pos")).alias("positions"))
    place = F.row_number().over(Window.partitionBy("tid").orderBy("first")) - 1
    return merged.select("tid", place.alias("place"), "value", "positions")


def session_scores(values: DataFrame, parties: DataFrame, tol: int = TOLERANCE) -> DataFrame:
    """``tid, density, kind, determined`` with a tolerance that grows by the fee a party bears."""
    of = values.join(parties, "tid")
    density = ambiguity(of, (F.lit(tol) + F.ceil(F.col("fee") / F.col("parties"))).cast("long"))
    return density.join(subtx_verdict(of, tol).select("tid", "kind"), "tid").withColumn("determined", F.col("kind") == "unique")


def pick_session(scores: DataFrame, order: DataFrame, excluding: int | None = None) -> DataFrame:
    """The one session to show: ambiguous and dense first, then undetermined and dense, then the first."""
    dense = F.col("density") >= 0.5
    tier = F.when((F.col("kind") == "ambiguous") & dense, 0).when(~F.col("determined") & dense, 1).otherwise(2)
    left = scores if excluding is None else scores.filter(F.col("tid") != excluding)
    return left.join(order.select("tid", "tx_seq"), "tid").orderBy(tier, "tx_seq").limit(1).drop("tx_seq")


def remeet_report(ledger: Ledger, groups: DataFrame, tol: int = TOLERANCE) -> DataFrame:
    """``tid, tx_seq, via, size, kind_before, kind_after, tier`` of sessions with re-met inputs ``groups(tid, via, in_pos, coin_id)``.

    Verdicts with the inputs apart and with each group as one; ``via`` is the largest group of one owner,
    else the largest. Two points for a group of one owner, one for a conclusive verdict of the groups.
    """
    of = materialize(groups.select("tid").distinct(), "regrouped")
    values = ledger.with_inputs().select("tid", "in_pos", "value").join(of, "tid", "left_semi")
    merged = merge_inputs(values, groups.withColumn("group", F.col("via"))).groupBy("tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("ins"))
    plain = materialize(amounts(ledger).join(of, "tid", "left_semi"), "amounts")
    before = subtx_verdict(plain, tol).select("tid", F.col("kind").alias("kind_before"))
    after = subtx_verdict(plain.drop("ins").join(merged, "tid"), tol).select("tid", F.col("kind").alias("kind_after"))
    owned = groups.join(ledger.coin_truth.select("coin_id", "owner"), "coin_id").groupBy("tid", "via").agg((F.countDistinct(F.struct("owner")) == 1).alias("one_owner"), F.count("*").alias("size"), F.min("in_pos").alias("first"))
    shown = owned.groupBy("tid").agg(F.max_by(F.struct("via", "size", "one_owner"), F.struct("one_owner", "size", (-F.col("first")).alias("first"))).alias("shown"))
    tier = F.when(F.col("shown.one_owner"), 2).otherwise(0) + F.when(F.col("kind_after") != "inconclusive", 1).otherwise(0)
    out = shown.join(before, "tid").join(after, "tid").join(ledger.txs.select("tid", "tx_seq"), "tid")
    return out.select("tid", "tx_seq", "shown.via", "shown.size", "kind_before", "kind_after", tier.alias("tier"))


def pick_remeet(report: DataFrame) -> DataFrame:
    """The earliest session of the best tier."""
    return report.orderBy(F.desc("tier"), "tx_seq").limit(1)


def strands(ledger: Ledger, verdicts: DataFrame) -> DataFrame:
    """``tid, in_pos, out_pos, certain, small``: ways from inputs to outputs, by part where parts are unique."""
    txs = ledger.txs.select("tid", "n_in", "n_out").join(verdicts, "tid", "left")
    pairs = ledger.tx_inputs.select("tid", "in_pos").join(ledger.tx_outputs.select("tid", "out_pos"), "tid").join(txs, "tid")
    same = F.expr("exists(filter(parts, p -> shiftright(p.i, in_pos) & 1 = 1), p -> array_contains(p.o, out_pos - 1))")
    kept = pairs.filter(F.col("parts").isNull() | same)
    certain = F.col("parts").isNotNull() | ((F.col("n_in") == 1) & (F.col("n_out") == 1))
    return kept.select("tid", "in_pos", "out_pos", certain.alias("certain"), (F.col("n_in") * F.col("n_out") <= 150).alias("small"))
