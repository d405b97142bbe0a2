"""Operator 6: quality rules, with DataFrame functions alone.

Base rules count words, symbols, repeated lines and repeated 8-word windows. The method compares
two histograms of a document with language references by Jensen-Shannon distance: character
classes, and common words against all words. The references are the totals over all documents of
each language in ``COMMON_WORDS``; a document is as far from them as from the nearest. Each
distance counts only where the document is long enough for its histogram to mean something.

Windows are compared by a 64-bit hash within one text.

Defined results: null, empty and white-space texts have no words, hence fail the base rule of 20
words; rows that repeat are judged alike; without references (an empty table, no known language)
the base rules alone decide; a null or unknown ``lang`` adds to no reference and changes no
verdict; other columns pass through, and columns named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.text import unused

#: Function words by language.
COMMON_WORDS = {
    "en": "the of and to in is that for was on with are".split(),
    "fr": "le la les de des du et en que un qui pour".split(),
    "de": "der die das und in zu den mit von ist nicht ein".split(),
    "es": "el la los las de que y en un por con para".split(),
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: Java regex character classes; lower-case letters and what is in none of them make a last class.
CLASSES = {"upper": "A-Z", "digit": "0-9", "letter": r"\x{80}-\x{10FFFF}", "stop": ".,;:'?\"()-", "bar": "|<>", "mark": "!#*$%&=/+@~^_"}
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Largest Jensen-Shannon distances (0 to 1), and the fewest characters or words for each test.
MAX_CHARACTER_DISTANCE, MIN_CHARACTERS = 0.22, 200
MAX_WORD_DISTANCE, MIN_HISTOGRAM_WORDS = 0.4, 100

WORKING = ["_text", "_odd", "_words", "_lines", "_windows", "_sorted", "_starts", "_letters", "_n_letters", "_common", "_word_shares", "_class_shares"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _only(text: Column, inside: str) -> Column:
    """Number of code points of a class."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", "")).cast("long")


def _odd(text: Column) -> Column:
    """The text without what most of it is: one pass over it, after which classes are counted in a short rest."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")


def base_counts(docs: DataFrame) -> DataFrame:
    """Add the base counts to ``docs(text)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.expr("btrim(_text, '\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D')")
    df = docs.withColumn("_text", text).withColumn("_odd", _odd(F.col("_text"))).withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    last = f"size(_words) - {WINDOW - 1}"
    df = df.withColumn("_windows", F.expr(f"case when {last} > 0 then transform(sequence(1, {last}), i -> xxhash64(slice(_words, i, {WINDOW}))) else array() end"))
    df = df.withColumn("_sorted", F.expr("case when size(array_distinct(_windows)) < size(_windows) then array_sort(transform(_windows, (h, i) -> struct(h, i))) end"))
    twice = "transform(filter(_sorted, (x, j) -> x.h = get(_sorted, j - 1).h or x.h = get(_sorted, j + 1).h), x -> x.i)"
    df = df.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.expr(twice))))
    covered = f"aggregate(zip_with(_starts, slice(_starts, 2, size(_starts)), (a, b) -> least(coalesce(b - a, {WINDOW}), {WINDOW})), 0L, (s, x) -> s + x)"
    return df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _only(F.col("_odd"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    ).drop("_words", "_lines", "_windows", "_sorted", "_starts")


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _classes(odd: Column, n_space: Column, n_chars: Column) -> list[Column]:
    counts = [n_space.cast("long"), *(_only(odd, inside) for inside in CLASSES.values())]
    return [*counts, n_chars.cast("long") - sum(counts[1:], counts[0])]


def references(docs: DataFrame) -> list[dict]:
    """``lang, classes, words`` with shares, for each known language that has documents.

    One pass of partial sums by language and class, one by language and word.
    """
    known = docs.filter(F.col("lang").isin(*COMMON_WORDS) & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    names = ["space", *CLASSES, "rest"]
    shaped = known.select("lang", F.length("text").alias("n_chars"), (F.length("text") - F.length(F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))).alias("n_space"), _odd(F.col("text")).alias("odd"))
    sums = shaped.select("lang", "n_chars", *(c.alias(n) for c, n in zip(_classes(F.col("odd"), F.col("n_space"), F.col("n_chars")), names))).groupBy("lang").agg(F.sum("n_chars").alias("n_chars"), *(F.sum(n).alias(n) for n in names)).collect()
    word = F.explode(_letters(F.col("text")))
    counts: dict[str, dict] = {}
    for r in known.select("lang", word.alias("word")).select("lang", F.when(F.col("word").isin(WORDS), F.col("word")).alias("word")).groupBy("lang", "word").count().collect():
        counts.setdefault(r["lang"], {})[r["word"]] = r["count"]
    out = []
    for r in sorted(sums):
        words = counts.get(r["lang"])
        if words and r["n_chars"]:
            total = sum(words.values())
            out.append({"lang": r["lang"], "classes": [r[n] / r["n_chars"] for n in names], "words": [words.get(w, 0) / total for w in [*WORDS, None]]})
    return out


def _distance(shares: str, reference: list[float]) -> str:
    """SQL of the Jensen-Shannon distance, base 2, of an array column from fixed shares."""
    fixed = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    term = "case when p > 0 then p * log2(2 * p / (p + q)) else 0D end + case when q > 0 then q * log2(2 * q / (p + q)) else 0D end"
    return f"sqrt(greatest(0D, aggregate(zip_with({shares}, {fixed}, (p, q) -> {term}), 0D, (a, x) -> a + x) / 2))"


def quality_rules(docs: DataFrame, known: list[dict] | None = None) -> DataFrame:
    """Add the base counts, ``base_failed``, both distances and ``kept`` to documents."""
    known = references(docs) if known is None else known
    results = [*BASE, "base_failed", "character_distance", "word_distance", "kept"]
    docs = docs.drop(*results)
    given = docs.columns
    # a column of the caller's that is named like a working one steps aside until the end
    aside = {c: unused(given + WORKING, c)[0] for c in given if c.lower() in WORKING}
    df = base_counts(docs.withColumnsRenamed(aside))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    if known:
        df = df.withColumn("_letters", _letters(F.col("_text")))
        df = df.withColumn("_n_letters", F.size("_letters")).withColumn("_common", F.filter("_letters", lambda w: w.isin(WORDS)))
        counts = [F.size("_common") - F.size(F.array_remove("_common", w)) for w in WORDS]
        df = df.withColumn("_word_shares", F.transform(F.array(*counts, F.col("_n_letters") - F.size("_common")), lambda n: n / F.greatest("_n_letters", F.lit(1))))
        df = df.withColumn("_class_shares", F.transform(F.array(*_classes(F.col("_odd"), F.length("_text") - F.col("word_chars"), F.length("_text"))), lambda n: n / F.greatest(F.length("_text"), F.lit(1))))
        nearest = lambda column, of: F.array_min(F.array(*(F.expr(_distance(column, r[of])) for r in known)))
        df = df.withColumn("character_distance", F.when(F.length("_text") >= MIN_CHARACTERS, nearest("_class_shares", "classes")))
        df = df.withColumn("word_distance", F.when(F.col("_n_letters") >= MIN_HISTOGRAM_WORDS, nearest("_word_shares", "words")))
        df = df.drop("_letters", "_n_letters", "_common", "_word_shares", "_class_shares")
    else:
        df = df.withColumns({"character_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")})
    near = (F.coalesce("character_distance", F.lit(0.0)) <= MAX_CHARACTER_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return df.withColumn("kept", ~F.col("base_failed") & near).drop("_text", "_odd").withColumnsRenamed({b: a for a, b in aside.items()})


def without_rejected(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The row number keeps the filter above the columns that it is made from: pushed below them, each
    of its terms would be spelled out down to the text, and planning would not end.
    """
    whole, row = unused(docs.columns, "whole", "row")
    judged = quality_rules(docs.withColumn(whole, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))).select(whole, "kept", F.monotonically_increasing_id().alias(row))
    return judged.filter(F.col("kept") & (F.col(row) >= 0)).select(f"{whole}.*")


def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs).drop("text", "lang")
