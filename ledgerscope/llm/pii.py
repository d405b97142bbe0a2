"""Operator 8: personal data, plain and disguised, with spans in the source text.

Plain identifiers are found by fixed patterns. Disguised ones are found in a normalised copy of the
text that three transducers make one after the other: look-alike letters, digits and invisible
characters; runs of spelled digits, with a "plus" before them; and "at"/"dot" written out. A bare "at"
counts where a dot is written out behind it or the word before it is none of prose. Every character of
the copy knows the source characters it stands for, so what is found there maps back. A find counts
as added only if it covers a changed character, or one behind a character left out, and each plain
find of its kind that it overlaps is a part of it.

Defined results: null text counts as empty and has no spans; texts are scanned whole; rows that
repeat are scanned each; an empty table gives no rows; all columns pass through, and a column
``pii`` is replaced. ``redact`` leaves null texts null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.text import slices

#: Kinds in order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Where the digits before a match's first dot begin makes no difference to the rest, so they are tried once a run.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Letters of other alphabets that look like ASCII ones.
LOOKS_LIKE = dict(zip("аеорсухіјѕԁһԛԝкмтнвАВЕКМНОРСТУХІЈЅαορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwkmthbABEKMHOPCTYXIJSaopvikTABEZHIKMNOPTYX", strict=True))
DIGIT_WORDS = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890"))
INVISIBLE = "­​‌‍⁠﻿"

_WORD = "|".join(f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:[Pp]lus[\s,.-]+)?(?:{_WORD})(?:[\s,.-]+(?:{_WORD})\b){{6,}}")
_ONE = re.compile(_WORD)
_UNUSUAL = re.compile("[­Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‍⁠﻿！-～\U0001d400-\U0001d7ff]")
_AT_DOT = re.compile(r"[\[({<]\s?(?:[Aa][Tt]|[Dd][Oo][Tt])\s?[\])}>]|\s[Dd][Oo][Tt]\s")
_BRACKET_AT = r"\s?[\[({<]\s?[Aa][Tt]\s?[\])}>]\s?"
_BRACKET_DOT = r"\s?[\[({<]\s?[Dd][Oo][Tt]\s?[\])}>]\s?"
_BARE_DOT = r"\s[Dd][Oo][Tt]\s"
#: Without brackets, "at" and "dot" are words too: a name must end in one of these.
TOP = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us"
_CHAIN = rf"[A-Za-z0-9-]+(?:(?:{_BARE_DOT}|{_BRACKET_DOT}|\.)[A-Za-z0-9-]+)*?(?:{_BARE_DOT}|{_BRACKET_DOT}|\.)(?:{TOP})\b"
_AT = re.compile(rf"{_BRACKET_AT}|(?<=[A-Za-z0-9])\s[Aa][Tt]\s(?={_CHAIN})")
_AFTER_AT = re.compile("@" + _CHAIN)
_WRITTEN_DOT = re.compile(rf"{_BARE_DOT}|{_BRACKET_DOT}")
_TARGET = re.compile(_CHAIN)
#: A bare "at" needs a dot written out behind it, or a local part that prose doesn't have: with one of these
#: characters, or behind one of these words.
_NO_WORD = frozenset("0123456789._%+")
_ADDRESSED = (":", "mail", "mailto", "contact", "write", "write to", "reach")
_DOT = re.compile(rf"{_BRACKET_DOT}|(?<=[0-9]){_BARE_DOT}(?=[0-9])")
_DOT_WORD = re.compile(_BARE_DOT)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, sought from each @ so that long runs without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def plain(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the identifiers written plainly."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


class Copy:
    """A normalised text whose characters know their source spans and whether they were changed."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def replace(self, spans: list[tuple[int, int, str]]) -> None:
        text, starts, ends, changed, at = [], [], [], [], 0
        behind = []  # what stands behind a deletion counts as changed
        for a, b, new in spans:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            behind += [] if new else [len(changed)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]
        for i in behind:
            self.changed[i : i + 1] = [True] * len(self.changed[i : i + 1])


def _lookalike(c: str) -> str:
    if c in LOOKS_LIKE:
        return LOOKS_LIKE[c]
    if c in INVISIBLE:
        return ""
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isascii():
        return folded
    return str(unicodedata.decimal(c, c))


def _stands_for_at(text: str, m: re.Match) -> bool:
    """Whether a match of ``_AT`` is part of an address and no word of prose."""
    if not m[0].strip().isalpha() or _WRITTEN_DOT.search(_TARGET.match(text, m.end())[0]):
        return True
    start = m.start()
    while start and text[start - 1] in LOCAL:
        start -= 1
    return not _NO_WORD.isdisjoint(text[start : m.start()]) or text[max(0, start - 20) : start].rstrip().lower().endswith(_ADDRESSED)


def _digits(m: re.Match) -> str:
    return "+" * (m[0][0] in "Pp") + "".join(DIGIT_WORDS[w[0].lower()] for w in _ONE.finditer(m[0]))


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Finds of the normalised copy that cover a changed character, as source spans."""
    if not any(gate.search(text) for gate in (_UNUSUAL, _SPELLED, _AT_DOT, _AT)):
        return []
    copy = Copy(text)
    copy.replace([(m.start(), m.end(), new) for m in _UNUSUAL.finditer(copy.text) if (new := _lookalike(m[0])) != m[0]])
    copy.replace([(m.start(), m.end(), _digits(m)) for m in _SPELLED.finditer(copy.text)])
    copy.replace([(m.start(), m.end(), "@") for m in _AT.finditer(copy.text) if _stands_for_at(copy.text, m)])
    copy.replace([(d.start(), d.end(), ".") for m in _AFTER_AT.finditer(copy.text) for d in _DOT_WORD.finditer(copy.text, m.start(), m.end())])
    copy.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(copy.text)])
    out = []
    for kind, a, b in plain(copy.text):
        if any(copy.changed[a:b]):
            out.append((kind, copy.starts[a], copy.ends[b - 1]))
    return out


def spans_of(text: str) -> list[tuple[int, int, int, bool]]:
    """``(kind number, start, end, base)`` of all finds, sorted."""
    base = plain(text)
    # a disguise may leave a part of an identifier plain: the whole is added to it
    meets = lambda d: [(a, b) for k, a, b in base if k == d[0] and a < d[2] and d[1] < b]
    added = [d for d in disguised(text) if all(d[1] <= a and b <= d[2] and b - a < d[2] - d[1] for a, b in meets(d))]
    return sorted([(*s, True) for s in base] + [(*s, False) for s in added])


_SPAN = pa.list_(pa.struct([("order", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """Add ``pii``: an array of ``order, start, end, base``; ``order`` is the place in ``KINDS``."""
    docs = docs.drop("pii")
    element = T.StructType([T.StructField("order", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", T.ArrayType(element))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [[dict(zip(("order", "start", "end", "base"), s)) for s in spans_of(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _SPAN)], names=[*part.schema.names, "pii"])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """Replace every find by its kind in angle brackets and set ``n_chars`` to the new length."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t if t is None else masked(t) for t in part.column("text").to_pylist()]
                columns = dict(zip(part.schema.names, part.columns)) | {"text": pa.array(texts, part.schema.field("text").type)}
                if "n_chars" in columns:
                    lengths = [n if t is None else len(t) for t, n in zip(texts, part.column("n_chars").to_pylist())]
                    columns["n_chars"] = pa.array(lengths, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def masked(text: str) -> str:
    """The text with its finds replaced; of overlapping finds the first one, longest, names the place."""
    out, at = [], 0
    for start, end, kind in sorted(((a, b, k) for k, a, b, _ in spans_of(text)), key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])), ",")


def op8_offset_preserving_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])

    def found_of(order: int) -> Column:
        return F.size(F.filter("pii", lambda s: s["base"] & (s["order"] == order))).cast("long")

    counts = [found_of(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    n_added = F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), n_added)
