"""Small ledgers by hand."""

from ledgerscope.sources.ledger import SCHEMAS, Ledger


def fee(n_in, n_out, rate):
    size = 10.5 + 57.5 * n_in + 43 * n_out
    return int(-(-size * rate // 1))


def build(spark, roots, txs, owners=None):
    """``roots``: id to value; ``txs``: (tid, day, rate, inputs, output values). Output k of transaction t is 100 t + k."""
    owners = owners or {}
    coins, spent, rows, ins, outs, seq = {}, {}, [], [], [], 0
    for coin, value in roots.items():
        coins[coin] = (coin, seq, value, None, None)
        seq += 1
    for n, (tid, day, rate, inputs, values) in enumerate(txs):
        total = sum(coins[c][2] for c in inputs if c in coins)
        rows.append((tid, n, day, float(rate), total - sum(values), len(inputs), len(values), None, None))
        for i, c in enumerate(inputs):
            spent[c] = (tid, i)
            ins.append((tid, i, c, None))
        for k, v in enumerate(values, 1):
            coins[100 * tid + k] = (100 * tid + k, seq, v, tid, k)
            outs.append((tid, k, 100 * tid + k))
            seq += 1
    table = [(*c, *spent.get(c[0], (None, None)), 0 if c[3] is None else None, None, None) for c in coins.values()]
    truth = [(c, owners.get(c), None, None, None) for c in coins]
    data = {"coins": table, "coin_truth": truth, "txs": rows, "tx_inputs": ins, "tx_outputs": outs}
    return Ledger(**{name: spark.createDataFrame(data[name], schema) for name, schema in SCHEMAS.items()})


def prices(spark, by_day):
    return spark.createDataFrame([(d, float(p)) for d, p in by_day.items()], "day int, usd_per_btc double")


def classes(clusters):
    out = {}
    for r in clusters.collect():
        out.setdefault(r["rep"], set()).add(r["coin_id"])
    return sorted(map(sorted, out.values()))
