"""Operator 9: secrets by patterns and by a battery of randomness tests, with DataFrame functions alone.

Patterns find assignments, access keys and long hex runs. The method looks at every maximal run of
20 or more token characters: it infers the encoding from the characters used, and tests whether the
symbols are a uniform random sequence over it: chi-squared of the alphabet in equal cells, runs above
and below its middle, and serial correlation of neighbours. The smallest of the three p-values, times
three, is the run's randomness. False discoveries are controlled by length: each run has a decoy, prose
of its own document in the characters of the run's encoding, cut to the same length and tested over the
same alphabet. A length band accepts from the least randomness on at which decoys suggest that at most
``MAX_FALSE`` of the accepted are prose; runs of letters of one case, which words are too, have bands
of their own.

Defined results: null and empty texts have no spans; rows that repeat are scanned each; a text of
any length is scanned whole; without runs (or an empty table) no band accepts anything; runs that
overlap a pattern's span add nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.session import materialize

#: Kinds in order, their patterns, and the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Encodings by the characters that they allow, narrowest first.
ENCODINGS = [
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper36", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
#: Encodings of letters alone.
WORDLIKE = [3, 4]
MAX_FALSE = 0.05
#: Lengths from which a new band begins, and the steps of randomness that a band can accept from.
BANDS = [20, 24, 32, 40, 64]
STEPS = 100
#: Matches of a text whose lengths are summed up together.
BLOCK = 64


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values, each of which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, found>>`` of leftmost non-overlapping matches, in code points."""
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    behind = lambda a, k: F.slice(a, k * BLOCK + 1, F.lit(BLOCK))
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # what ends before a match: whole blocks of matches, and those of its own block; each array is made once
    parts = _let({"found": found, "between": between}, lambda x: F.struct(x["found"].alias("found"), x["between"].alias("between"), F.zip_with(x["between"], x["found"], lambda b, f: F.length(b) + F.coalesce(F.length(f), F.lit(0))).alias("steps")))
    parts = _let({"x": parts}, lambda x: F.struct(x["x"].alias("x"), F.transform(F.sequence(F.lit(0), F.floor(F.size(x["x"]["found"]) / BLOCK).cast("int")), lambda k: F.aggregate(behind(x["x"]["steps"], k), F.lit(0), lambda s, n: s + n)).alias("sums")))
    parts = _let({"y": parts}, lambda y: F.struct(y["y"]["x"].alias("x"), F.transform(y["y"]["sums"], lambda _, k: total(y["y"]["sums"], k)).alias("before")))

    def span(parts: Column) -> Column:
        x, before = parts["p"]["x"], parts["p"]["before"]

        def place(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(before, block) + total(behind(x["steps"], block), i % BLOCK) + F.length(F.get(x["between"], i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"))

        return F.transform(x["found"], place)

    return F.when(text.rlike(pattern), _let({"p": parts}, span)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base spans and the runs with their decoys."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    df = df.withColumns({"_assign": matches(F.col("text"), ASSIGN), "_access": matches(F.col("text"), ACCESS), "_hex": matches(F.col("text"), HEX), "_runs": matches(F.col("text"), RUN)})
    df = df.withColumn("_assign", F.filter("_assign", lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 6))
    tag = lambda column, order, kind: F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.concat(tag("_assign", 0, "assign"), tag("_access", 1, "access"), tag("_hex", 2, "hex"))
    df = df.select("doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"), base.alias("base"), "_runs", F.when(F.size("_runs") > 0, F.col("text")).alias("text"))
    runs = _let({"prose": F.regexp_replace(F.regexp_replace("text", RUN, ""), "[^A-Za-z0-9]+", ""), "runs": F.col("_runs"), "base": F.col("base")}, _with_decoys)
    return df.select("doc_id", "n_assign", "n_access", "n_hex", "base", runs.alias("runs"), F.monotonically_increasing_id().alias("row"))


def _encoding(token: Column) -> Column:
    """The number of the narrowest encoding; one more than the last for a mixture."""
    return F.coalesce(*(F.when(token.rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)), F.lit(len(ENCODINGS)))


def _with_decoys(x: Column) -> Column:
    """Runs with their encoding and a decoy from a place of the prose that depends on the run, not on the row."""
    prose = []
    for _, _, letters in [*ENCODINGS, ("", "", ENCODINGS[-1][2])]:
        same_case = F.lower(x["prose"]) if letters == letters.lower() else F.upper(x["prose"]) if letters == letters.upper() else x["prose"]
        prose.append(F.regexp_replace(same_case, "[^" + letters.replace("-", "").replace("/", "") + "]+", ""))

    def shaped(y: Column) -> Column:
        def run(m: Column) -> Column:
            source, size = F.get(y["prose"], _encoding(m["found"])), F.length(m["found"])
            start = 1 + F.pmod(F.xxhash64(m["found"]), F.greatest(F.lit(1), F.length(source) - size))
            covered = F.exists(y["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found"), _encoding(m["found"]).alias("encoding"), F.substring(source, start.cast("int"), size).alias("decoy"), covered.alias("covered"))

        return F.transform(y["runs"], run)

    return _let({"prose": F.array(*prose), "runs": x["runs"], "base": x["base"]}, shaped)


def _tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z, by a logistic approximation."""
    return 1 / (1 + F.exp(F.greatest(F.least(1.5976 * z + 0.07056 * F.pow(z, 3), F.lit(300.0)), F.lit(-300.0))))


def randomness(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: three times the smallest p-value of the battery over the alphabet of ``encoding``, at most 1; null for texts under 16."""
    letters = F.get(F.array(*(F.lit(a) for _, _, a in ENCODINGS), F.lit(ENCODINGS[-1][2] + "-_")), F.col("encoding"))
    df = df.withColumn("_letters", letters).withColumn("_k", F.length("_letters"))
    df = df.withColumn("_v", F.expr(f"filter(transform(split({column}, ''), c -> locate(c, _letters) - 1), x -> x >= 0)"))
    df = df.withColumn("_n", F.size("_v")).withColumn("_g", F.greatest(F.lit(2), F.least("_k", F.floor(F.col("_n") / 4).cast("int"))))
    cells = "transform(sequence(0, _g - 1), b -> size(filter(_v, x -> floor(x * _g / _k) = b)))"
    df = df.withColumn("_cells", F.expr(cells))
    # a cell of the alphabet holds as many symbols as fall into it, which differs where g does not divide k
    share = "(ceil((b + 1) * _k / _g) - ceil(b * _k / _g)) / _k"
    df = df.withColumn("_chi", F.expr(f"aggregate(transform(_cells, (o, b) -> pow(o - _n * {share}, 2) / (_n * {share})), 0D, (s, x) -> s + x)"))
    free = F.col("_g") - 1
    wilson = (F.pow(F.col("_chi") / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    df = df.withColumn("_high", F.expr("size(filter(_v, x -> x >= _k / 2))")).withColumn("_low", F.col("_n") - F.col("_high"))
    df = df.withColumn("_turns", F.expr("1 + size(filter(zip_with(_v, slice(_v, 2, greatest(_n - 1, 0)), (a, b) -> (a >= _k / 2) <> (b >= _k / 2)), x -> x))"))
    product = 2.0 * F.col("_high") * F.col("_low")
    mean, spread = product / F.col("_n") + 1, F.sqrt(product * (product - F.col("_n")) / (F.pow("_n", 2) * (F.col("_n") - 1)))
    runs = F.when((product > F.col("_n")), F.abs(F.col("_turns") - mean) / spread).otherwise(F.lit(9.0))
    df = df.withColumn("_mean", F.expr("aggregate(_v, 0D, (s, x) -> s + x) / _n"))
    df = df.withColumn("_var", F.expr("aggregate(_v, 0D, (s, x) -> s + pow(x - _mean, 2))"))
    df = df.withColumn("_lag", F.expr("aggregate(zip_with(slice(_v, 1, greatest(_n - 1, 0)), slice(_v, 2, greatest(_n - 1, 0)), (a, b) -> (a - _mean) * (b - _mean)), 0D, (s, x) -> s + x)"))
    serial = F.when(F.col("_var") > 0, F.abs(F.col("_lag") / F.col("_var") + 1 / F.col("_n")) * F.sqrt("_n")).otherwise(F.lit(9.0))
    p = 3 * F.least(_tail(wilson), 2 * _tail(runs), 2 * _tail(serial))
    df = df.withColumn(out, F.when(F.col("_n") >= 16, F.least(p, F.lit(1.0))))
    return df.drop("_letters", "_k", "_v", "_n", "_g", "_cells", "_chi", "_high", "_low", "_turns", "_mean", "_var", "_lag")


def accept_from(scored: DataFrame) -> dict[int, float]:
    """Randomness from which each length band accepts: at most bands x steps rows reach the driver."""
    step = lambda c: F.least(F.floor(F.col(c) * STEPS), F.lit(STEPS - 1))
    both = scored.select("band", F.explode(F.array(F.struct(F.lit(0).alias("decoy"), step("p").alias("step")), F.struct(F.lit(1).alias("decoy"), step("decoy_p").alias("step")))).alias("x"))
    tally: dict[int, list[list[int]]] = {}
    for r in both.filter("x.step is not null").groupBy("band", "x.decoy", "x.step").count().collect():
        tally.setdefault(r["band"], [[0] * STEPS, [0] * STEPS])[r["decoy"]][r["step"]] += r["count"]
    out = {}
    for band, (real, decoys) in tally.items():
        share = sum(real) / max(1, sum(decoys))
        for at in range(1, STEPS):
            found, false = sum(real[at:]), share * (sum(decoys[at:]) + 1)
            if found and false <= MAX_FALSE * found:
                out[band] = at / STEPS
                break
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans``; spans are ``start, order, end, kind``."""
    rows = materialize(scanned(docs), "scanned")
    runs = rows.select("row", F.explode("runs").alias("r")).select("row", "r.*")
    band = F.lit(0)
    for least in BANDS:
        band = F.when(F.length("found") >= least, F.lit(least)).otherwise(band)
    band = F.when(F.col("encoding").isin(WORDLIKE), -band).otherwise(band)
    scored = randomness(randomness(runs, "found", "p"), "decoy", "decoy_p").select("row", "start", "end", "covered", band.alias("band"), "p", "decoy_p")
    scored = materialize(scored, "scored")
    limits = accept_from(scored)
    passes = F.lit(False)
    for b, p in limits.items():
        passes = passes | ((F.col("band") == b) & (F.col("p") >= p))
    new = scored.filter(passes & ~F.col("covered")).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("order"), "end", F.lit("random").alias("kind"))).alias("new"))
    df = rows.drop("runs").join(new, "row", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return df.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.concat("base", F.coalesce("new", none)).alias("spans"))


def op9_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_random = F.size(F.filter("spans", lambda s: s["kind"] == "random")).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), n_random.alias("n_random"))
