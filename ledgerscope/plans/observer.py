"""The observer: all links that an outsider draws, and the clusters that they make.

Most links don't depend on others. A change link of a transaction whose inputs no own link joins
holds only if earlier links have joined them; and a radix link counts only if it joins something
new. Links are numbered in record order, and the spanning forest of all that hold says which of them
first joins two coins; so both kinds are judged by joins, whatever the size of a component.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import exprs as X
from ledgerscope.operators import amounts as A
from ledgerscope.operators import links as L
from ledgerscope.operators.components import ranked
from ledgerscope.operators.joined import joined_at, settled
from ledgerscope.session import materialize
from ledgerscope.sources.ledger import Ledger


@dataclass(frozen=True)
class Options:
    reuse: bool = True
    cioh: bool = True
    change: bool = True
    subsum: bool = True
    remeet: bool = True
    cap: int | None = None
    bar: int = 1
    tells: int = X.ALL
    fingerprints: bool = False
    tolerance: int = A.TOLERANCE


@dataclass(frozen=True)
class Reading:
    """``events(event, seq, stage, pos, tid, method, basis, via, coins, ...)`` accepted, clusters, and what was read of change.

    ``drawn`` are all events, those that did not hold too.
    """

    events: DataFrame
    clusters: DataFrame
    change_reads: DataFrame
    pay_guess: DataFrame
    change_guess: DataFrame
    drawn: DataFrame
    verdicts: DataFrame | None


def units(ledger: Ledger, verdicts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``tid, part, ins, outs, kind`` of what change is read from, and the verdict of each transaction.

    A uniquely partitioned transaction has a unit for each part, any other one unit.
    """
    ins = ledger.tx_inputs.groupBy("tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("in_pos", "coin_id"))), lambda x: x["coin_id"]).alias("ins"))
    outs = ledger.tx_outputs.groupBy("tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("out_pos", "coin_id"))), lambda x: x["coin_id"]).alias("outs"))
    whole = ledger.txs.select("tid", "tx_seq", "day", "n_in", "n_out").join(ins, "tid").join(outs, "tid")
    if verdicts is None:
        return whole.withColumns({"kind": F.lit("atomic"), "part": F.lit(0)}), whole.withColumn("kind", F.lit("atomic"))
    judged = whole.join(verdicts.select("tid", F.col("kind").alias("verdict"), "parts"), "tid", "left").withColumn("kind", F.coalesce("verdict", F.lit("atomic")))
    pick = lambda arr, mask: F.expr(f"filter({arr}, (c, i) -> shiftright({mask}, i) & 1 = 1)")
    parts = judged.filter("kind = 'unique'").select("*", F.posexplode("parts").alias("part", "p")).withColumns({"mi": F.col("p.i"), "mo": F.col("p.o")})
    parts = parts.withColumns({"ins": pick("ins", "mi"), "outs": F.expr("filter(outs, (c, i) -> array_contains(mo, i))")}).drop("p", "mi", "mo")
    return parts.unionByName(judged.filter("kind <> 'unique'").withColumn("part", F.lit(0))).drop("verdict", "parts"), judged


def _vetoed(ledger: Ledger, groups: DataFrame, grants: DataFrame | None, fingerprints: bool, mixed: str = "ins") -> DataFrame:
    """Add ``refuted`` (over ``all``) and ``mixed`` (over ``ins``) to units ``unit, ins, all``."""
    out = groups.withColumns({"refuted": F.lit(False), "mixed": F.lit(False)})
    if grants is not None:
        bad = L.refuted(groups.select(F.col("unit").alias("group"), F.explode("all").alias("coin_id")), grants).select(F.col("group").alias("unit"), F.lit(True).alias("r"))
        out = out.join(bad, "unit", "left").withColumn("refuted", F.coalesce("r", F.lit(False))).drop("r")
    if fingerprints:
        bad = L.mixed_scripts(groups.select(F.col("unit").alias("group"), F.explode(mixed).alias("coin_id")), ledger.coins).select(F.col("group").alias("unit"), F.lit(True).alias("m"))
        out = out.join(bad, "unit", "left").withColumn("mixed", F.coalesce("m", F.lit(False))).drop("m")
    return out


def identify_payments(ledger: Ledger, prices: DataFrame, parts: DataFrame, grants: DataFrame | None, opts: Options) -> DataFrame:
    """``unit, coin_id, role, kinds`` of every output; roles are payment, own (granted), self and unknown."""
    coins = ledger.coins.select("coin_id", "value", "script")
    outs = parts.select("unit", "tid", "day", "ins", F.explode("outs").alias("coin_id")).join(coins, "coin_id").join(prices, "day", "left")
    outs = outs.join(L.radix_txs(ledger).withColumn("radix", F.lit(True)), "tid", "left").withColumn("radix", F.coalesce("radix", F.lit(False)))
    ins = parts.select("unit", F.explode("ins").alias("coin_id")).join(coins.select("coin_id", "script"), "coin_id")
    outs = outs.join(ins.groupBy("unit").agg(F.collect_set("script").alias("scripts")), "unit", "left")
    amount = F.when(F.col("radix") & X.is_denomination(F.col("value")), F.lit(0)).otherwise(X.amount_kinds(F.col("value"), F.col("usd_per_btc"), opts.tells))
    other = (F.size("scripts") > 0) & F.col("script").isNotNull() & ~F.coalesce(F.array_contains("scripts", F.col("script")), F.lit(False))
    script = F.when(other & F.lit(bool(opts.tells & X.SCRIPT)), F.lit(X.SCRIPT)).otherwise(F.lit(0))
    outs = outs.withColumn("marks", amount.bitwiseOR(script)).withColumns({"given": F.lit(None).cast("boolean"), "same": F.lit(None).cast("boolean")})
    if grants is not None and opts.tells & X.AUX:
        named = parts.select("unit", F.explode("ins").alias("coin_id")).join(grants, "coin_id").groupBy("unit").agg(F.collect_set(F.struct("owner")).alias("owners"))
        given = grants.select("coin_id", F.struct("owner").alias("out_owner"))
        outs = outs.join(named, "unit", "left").join(given, "coin_id", "left")
        outs = outs.withColumns({"given": F.col("out_owner").isNotNull() & F.col("owners").isNotNull(), "same": F.exists("owners", lambda o: o["owner"].eqNullSafe(F.col("out_owner.owner")))})
    given, same = F.coalesce("given", F.lit(False)), F.coalesce("same", F.lit(False))
    role = F.when(given & same, "own").when(given | (F.col("marks") != 0), "payment").when(F.col("radix"), "self").otherwise("unknown")
    kinds = F.when(given & ~same, F.col("marks").bitwiseOR(F.lit(X.AUX))).otherwise(F.col("marks"))
    return outs.select("unit", "coin_id", role.alias("role"), F.when(role == "payment", kinds).otherwise(F.lit(0)).alias("kinds"))


#: Places of change links: the part, radix links before others, the output.
_PART, _OTHER = 32, 31


def numbered(events: DataFrame) -> DataFrame:
    """Events with ``event``: numbers in record order, ties in the order of their coins; the numbers have gaps."""
    order = ["seq", "stage", "pos", "coins"]
    # ranges are drawn from a sample, which would make the links a second time
    events = materialize(events, "drawn")
    return materialize(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("event", F.monotonically_increasing_id()), "events")


def accepted(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links that hold, the asked units whose inputs they join before, and the ways to the top of all coins."""
    held, ways = settled(events)
    held = materialize(events.join(held, "event"), "held")
    # a link that must join something new does so if the forest took it
    wanted = held.filter("new_only and not ask")
    stale = joined_at(wanted.select(F.col("event").alias("group"), "coins"), ways).filter("at < group").select(F.col("group").alias("event"))
    links = materialize(held.filter("not ask").join(stale, "event", "left_anti").drop("ask", "unit"), "accepted")
    return links, held.filter("ask").select("unit"), ways


def clusters_of(ledger: Ledger, ways: DataFrame) -> DataFrame:
    """``coin_id, rep`` of all coins; the first coin of a cluster leads it."""
    seq = ledger.coins.select("coin_id", "coin_seq").join(ways.select(F.col("node").alias("coin_id"), F.element_at("labels", -1).alias("top")), "coin_id", "left").withColumn("top", F.coalesce("top", "coin_id"))
    lead = seq.groupBy("top").agg(F.min_by("coin_id", "coin_seq").alias("rep"))
    return seq.join(lead, "top").select("coin_id", "rep")


def clusters_by_links(ledger: Ledger, drawn: DataFrame) -> DataFrame:
    """``coin_id, rep, rank`` under the links of ``drawn(event, coins, requires)`` that hold."""
    drawn = materialize(drawn.select("event", "coins", "requires").withColumn("ask", F.lit(False)), "links")
    return ranked(materialize(clusters_of(ledger, settled(drawn)[1]), "clusters"))


def cluster_observer(ledger: Ledger, prices: DataFrame, opts: Options = Options(), grants: DataFrame | None = None, excluded: DataFrame | None = None, verdicts: DataFrame | None = None) -> Reading:
    """Read the whole record; ``excluded(tid)`` are transactions that give no evidence of their own.

    They stay on record all the same: another session may still point to one that issued its inputs.
    ``verdicts`` of a reading with the same grants, fingerprints and re-met inputs save the search for them.
    """
    seen = ledger
    out = lambda df: df if excluded is None else df.join(excluded.select("tid"), "tid", "left_anti")
    seq = seen.txs.select("tid", "tx_seq")
    none = F.lit(None)
    found: list[DataFrame] = []

    def event(df: DataFrame, method: str, stage: int, pos: Column | int, basis: Column | None = None, via: Column | None = None, requires: Column | None = None, new_only: Column | bool = False, tid: str | None = "tid", ask: bool = False) -> None:
        lit = lambda v: F.lit(v) if isinstance(v, (int, bool)) else v
        found.append(df.select(
            F.col("tx_seq").cast("long").alias("seq") if tid else F.lit(-1).cast("long").alias("seq"), F.lit(stage).alias("stage"), lit(pos).cast("long").alias("pos"), (F.col(tid) if tid else none).cast("long").alias("tid"), F.lit(method).alias("method"),
            (none if basis is None else basis).cast("string").alias("basis"), (none if via is None else via).cast("long").alias("via"), "coins", (none if requires is None else requires).cast("array<long>").alias("requires"), lit(new_only).alias("new_only"), F.lit(ask).alias("ask"), (F.col("unit") if ask else none.cast("long")).alias("unit"),
        ))

    if opts.reuse:
        by = seen.coins.filter("addr_key is not null").groupBy("addr_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("coin_seq", "coin_id"))), lambda x: x["coin_id"]).alias("coins"), F.min("coin_seq").alias("first")).filter(F.size("coins") > 1)
        event(by, "reuse", 0, F.col("first"), tid=None)
    regrouped = None
    if opts.remeet:
        regrouped = materialize(L.remeet_groups(seen, grants, opts.fingerprints), "remeet")
        by = regrouped.groupBy("tid", "via").agg(F.transform(F.array_sort(F.collect_list(F.struct("in_pos", "coin_id"))), lambda x: x["coin_id"]).alias("coins"), F.min("in_pos").alias("first")).join(seq, "tid")
        event(by, "remeet", 1, F.col("first"), via=F.col("via"))
    if opts.subsum and verdicts is None:
        wanted = seen.txs.filter("n_in >= 2 and n_out >= 3").select("tid")
        values = A.amounts(seen).join(wanted, "tid", "left_semi")
        if regrouped is not None and not regrouped.isEmpty():
            # re-met inputs enter the search as one; verdicts of such transactions hold for the merged inputs
            again = A.merge_inputs(seen.with_inputs().select("tid", "in_pos", "value").join(regrouped.select("tid").distinct(), "tid", "left_semi"), regrouped.withColumn("group", F.col("via")))
            again = again.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("place", "value", "positions"))).alias("m"))
            values = values.join(again, "tid", "left").withColumn("ins", F.when(F.col("m").isNotNull(), F.transform("m", lambda x: x["value"])).otherwise(F.col("ins")))
            expand = values.filter("m is not null").select("tid", F.transform("m", lambda x: x["positions"]).alias("positions"))
            verdicts = A.subtx_verdict(values.drop("m"), opts.tolerance).join(expand, "tid", "left")
            bits = "aggregate(filter(positions, (x, i) -> shiftright(p.i, i) & 1 = 1), 0, (a, x) -> a + aggregate(x, 0, (b, y) -> b + cast(shiftleft(1, y) as int)))"
            whole = F.expr(f"transform(parts, p -> named_struct('i', {bits}, 'o', p.o))")
            verdicts = verdicts.withColumn("parts", F.when(F.col("positions").isNotNull(), whole).otherwise(F.col("parts"))).drop("positions")
        else:
            verdicts = A.subtx_verdict(values, opts.tolerance)
        verdicts = materialize(verdicts, "verdicts")
    verdicts = verdicts if opts.subsum else None
    parts, judged = units(seen, verdicts)
    parts = parts.withColumn("unit", F.xxhash64("tid", "part")).withColumn("all", F.when(F.col("kind") == "unique", F.concat("ins", "outs")).otherwise(F.col("ins")))
    parts = materialize(_vetoed(seen, parts, grants, opts.fingerprints), "units")
    if opts.subsum:
        free = parts.filter("kind = 'unique' and not refuted and not mixed").withColumn("coins", F.col("all"))
        event(free, "subtx", 2, F.col("part"))
        open_txs = judged.filter("kind in ('ambiguous', 'inconclusive')").select("tid")
        forced = A.forced_pairs(seen, opts.tolerance).join(open_txs, "tid", "left_semi").join(seen.tx_inputs.select("tid", "in_pos", F.col("coin_id").alias("i")), ["tid", "in_pos"]).join(seen.tx_outputs.select("tid", "out_pos", F.col("coin_id").alias("o")), ["tid", "out_pos"])
        forced = forced.withColumns({"coins": F.array("i", "o"), "unit": F.xxhash64("tid", "in_pos", "out_pos")})
        forced = _vetoed(seen, forced.withColumns({"all": F.col("coins"), "ins": F.col("coins")}), grants, False).filter("not refuted").join(seq, "tid")
        event(forced, "subtx", 2, F.shiftleft(F.col("in_pos").cast("long"), _PART) + F.col("out_pos"), basis=F.lit("bound"))
    joined = (F.col("kind") == "atomic") & (F.col("n_in") >= 2) & ~F.col("refuted") & ~F.col("mixed") & F.lit(opts.cioh)
    if opts.cap is not None:
        joined = joined & (F.col("n_in") <= opts.cap)
    if opts.cioh:
        event(parts.filter(joined).withColumn("coins", F.col("ins")), "cioh", 2, 0)
    reads = pay = None
    if opts.change:
        roles = materialize(identify_payments(seen, prices, parts, grants, opts), "roles")
        of = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("coin_id"))))
        seen_roles = roles.groupBy("unit").agg(of("payment").alias("payments"), of("self").alias("selfs"), of("unknown").alias("unknowns"), F.bit_or("kinds").alias("kinds"))
        state = F.when(F.col("kind").isin("ambiguous", "inconclusive"), "mapping").when(F.col("kind") == "unique", F.when(F.col("refuted") | F.col("mixed"), "part").otherwise("linked"))
        state = state.when((F.col("n_in") == 1) | joined, "linked").otherwise("contingent")
        read = materialize(parts.join(seen_roles, "unit").withColumns({"state": state, "anchor": F.element_at("ins", 1)}), "reads")
        live = read.filter("state in ('linked', 'contingent')")
        requires = F.when(F.col("state") == "contingent", F.col("ins"))
        place = seen.tx_outputs.select(F.col("coin_id").alias("coin"), "out_pos")
        pos = lambda other: F.shiftleft(F.col("part").cast("long"), _PART) + F.lit(other << _OTHER) + F.col("out_pos")
        event(read.filter("state = 'contingent'").withColumn("coins", F.col("ins")), "ask", 3, -1, requires=F.col("ins"), ask=True)

        def change_links(df: DataFrame, coin: str) -> DataFrame:
            rows = df.withColumns({"coins": F.array(F.col(coin), "anchor"), "all": F.concat(F.array(coin), "ins"), "unit": F.xxhash64("unit", coin)})
            return _vetoed(seen, rows.drop("refuted", "mixed"), grants, False).join(place, "coin")

        selfs = change_links(live.withColumn("coin", F.explode("selfs")), "coin").filter("not refuted")
        event(selfs, "change", 3, pos(0), basis=F.lit("radix"), requires=requires, new_only=True)
        single = change_links(live.filter(F.size("unknowns") == 1).withColumn("coin", F.element_at("unknowns", 1)), "coin")
        clear = F.bit_count("kinds") >= opts.bar
        event(single.filter(clear & ~F.col("refuted")), "change", 3, pos(1), basis=F.lit("residue"), requires=requires)
        reads, pay = out(read), roles.filter("role = 'payment'").join(out(parts.select("unit", "tid")), "unit").select("tid", "coin_id")
    events = found[0]
    for more in found[1:]:
        events = events.unionByName(more)
    events = numbered(out(events))
    held, joined_units, ways = accepted(events)
    events = events.filter("not ask").drop("ask", "unit")
    clusters = ranked(materialize(clusters_of(ledger, ways), "clusters"))
    guess = held.filter("basis = 'residue'").select("tid", F.element_at("coins", 1).alias("coin_id"), F.shiftright("pos", _PART).cast("int").alias("part"))
    if reads is None:
        empty = held.limit(0)
        return Reading(held, clusters, empty, empty, guess.drop("part"), events, verdicts)
    met = joined_units.withColumn("met", F.lit(True))
    reads = reads.join(met, "unit", "left").join(guess.withColumnRenamed("coin_id", "change"), ["tid", "part"], "left")
    linked = (F.col("state") == "linked") | F.coalesce("met", F.lit(False))
    rest = (F.size("unknowns") > 0) | (F.size("selfs") > 0)
    why = F.when(~linked, F.when(rest, F.when(F.col("state") == "contingent", "inputs").otherwise(F.col("state"))))
    why = F.when(linked, F.when((F.size("unknowns") == 1) & (F.bit_count("kinds") < opts.bar), "bar").when((F.size("unknowns") == 1) & F.col("change").isNull(), "refuted").when(F.size("unknowns") > 1, "batch")).otherwise(why)
    change_reads = reads.select("tid", F.col("part").alias("part_no"), "payments", F.when(linked, F.col("selfs")).otherwise(F.array().cast("array<long>")).alias("selfs"), "change", F.size("unknowns").alias("unknowns"), why.alias("abstain"))
    return Reading(held, clusters, change_reads, pay, guess.drop("part"), events, verdicts)


def summarise_reads(reads: DataFrame) -> DataFrame:
    """``tid, payments, selfs, changes, abstain``: counts, and the first reason to abstain."""
    return reads.groupBy("tid").agg(F.sum(F.size("payments")).alias("payments"), F.sum(F.size("selfs")).alias("selfs"), F.count("change").alias("changes"), F.min_by("abstain", F.when(F.col("abstain").isNotNull(), F.col("part_no"))).alias("abstain"))
