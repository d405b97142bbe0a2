"""Scalar expressions over amounts, fees and days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
USD, BTC, AUX, SCRIPT, ALL = 1, 2, 4, 8, 15
SCRIPT_TITLES = {"legacy": "P2PKH (legacy)", "compat": "P2SH-wrapped segwit", "segwit": "P2WPKH (segwit v0)", "taproot": "P2TR (segwit v1, taproot)"}
SCRIPT_LABELS = {"legacy": "P2PKH", "compat": "P2SH", "segwit": "P2WPKH", "taproot": "P2TR"}
DUST, WHOLE = 330, 100_000_000
RATE_EDGES = [0.7, 0.85, 0.95, 1.05, 1.2, 1.45, 2.0]


def denominations() -> list[int]:
    """Powers of two, once and twice powers of three, and 1, 2 and 5 times powers of ten: powers above dust, values up to one coin."""
    menu = {2: (1,), 3: (1, 2), 10: (1, 2, 5)}
    return sorted({m * base**i for base, multiples in menu.items() for i in range(28) for m in multiples if base**i >= DUST and m * base**i <= WHOLE})


DENOMINATIONS = denominations()


def vsize(n_in: Column, n_out: Column) -> Column:
    return F.lit(10.5) + F.lit(57.5) * n_in + F.lit(43.0) * n_out


def tx_fee(n_in: Column, n_out: Column, feerate: Column) -> Column:
    return F.ceil(vsize(n_in, n_out) * feerate).cast("long")


def dec_hw(value: Column) -> Column:
    """Number of nonzero decimal digits."""
    return F.length(F.regexp_replace(value.cast("string"), "[0-]", ""))


def round_usd(value: Column, price: Column) -> Column:
    """Within five cents of a multiple of ten dollars; without a price false."""
    usd = value * price / 1e8
    return F.coalesce(F.abs(usd - F.floor(usd / 10 + 0.5) * 10) < 0.05, F.lit(False))


def is_round_btc(value: Column) -> Column:
    return dec_hw(value) <= 1


def amount_kinds(value: Column, price: Column, tells: int = ALL) -> Column:
    """Bits of the enabled amount tells that fire."""
    usd = F.when(round_usd(value, price), F.lit(USD & tells)).otherwise(F.lit(0))
    btc = F.when(is_round_btc(value), F.lit(BTC & tells)).otherwise(F.lit(0))
    return usd.bitwiseOR(btc)


def plausible_payment(value: Column, price: Column, tells: int = ALL) -> Column:
    return amount_kinds(value, price, tells) != 0


def is_denomination(value: Column) -> Column:
    return value.isin(DENOMINATIONS)


def _named(script: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, title in names.items():
        out = F.when(script == name, F.lit(title)).otherwise(out)
    return out


def script_title(script: Column) -> Column:
    """The type and its family, for first mentions."""
    return _named(script, SCRIPT_TITLES)


def script_label(script: Column) -> Column:
    """The type as the record shows it."""
    return _named(script, SCRIPT_LABELS)


def format_sats(value: Column) -> Column:
    return F.format_number(value, 0)


def _within(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high)).cast("int")


def amount_bucket(value: Column) -> Column:
    return _within(F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))) - 8, 0, 23)


def feerate_bucket(feerate: Column) -> Column:
    return _within(F.floor(2 * F.log2(F.greatest(feerate, F.lit(0.25)))) + 2, 0, 11)


def relative_bucket(ratio: Column) -> Column:
    return sum((F.when(ratio >= edge, 1).otherwise(0) for edge in RATE_EDGES), F.lit(0))


def day_eighth(day: Column, max_day: Column) -> Column:
    return F.floor(day * 8 / (max_day + 1)).cast("int")


def minute_slot(minute: Column) -> Column:
    return F.floor(minute / 180).cast("int")
