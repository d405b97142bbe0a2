"""Operator 5: language by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to three bytes with the counts of the bytes that
follow. The probability of a byte is that of its longest known context; a byte new to a context
pays the context's escape (method C: distinct / (total + distinct)) and goes on to the next shorter
one, without the bytes that the longer one had (exclusion), down to a uniform choice of 256. The
statistics are frozen after learning, so the code length of every byte in every context and language
is computed once into a table, and a text's exact code lengths are sums of table rows. Languages are
dealt into blocks of ``BLOCK_LANGUAGES``, each with a table of its own over the bytes that any block
knows, so a code length is the same in every block; a task holds one table at a time.

Learning uses at most ``MAX_TEXTS`` distinct texts of a language in expectation, drawn by a hash, all
where there are no more; their
counts are made by Spark tasks and merged by a sum. Prediction reads whole texts.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if nothing could be
learned (an empty table, no ``lang``); ties go to the first language by name; a text of any length
is scored whole; rows that repeat are scored alike; a zero byte counts as a byte of value one, since
zero stands for the start of a text; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.text import slices
from ledgerscope.session import materialize, small

ORDER = 3
#: Documented bound: texts learned from, by language, in expectation.
MAX_TEXTS = 400
#: Contexts that occur less often are left to the shorter ones; languages of a table.
LEAST_COUNT, BLOCK_LANGUAGES = 2, 4
UNDECIDED = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learning_texts(docs: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """``lang, text``: about ``max_texts`` texts of each language, by a hash of the text."""
    known = docs.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.withColumn("drawn", F.xxhash64("text", F.lit(5)))
    sizes = materialize(known.groupBy("lang").agg(F.approx_count_distinct("drawn").alias("texts")), "languages")
    share = F.lit(float(max_texts)) / F.col("texts")
    known = known.join(small(sizes), "lang")
    return known.filter(F.pmod("drawn", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text").dropDuplicates()


def coded(text: str) -> bytes:
    return text.encode().replace(b"\0", b"\1")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of runs of four bytes by language; a text begins after three zero bytes."""
    counts: dict[str, dict] = {}
    for batch in batches:
        for part in slices(batch):
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                raw = b"".join(b"\0\0\0" + coded(t) for t, x in zip(part.column("text").to_pylist(), langs) if x == lang)
                b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
                grams = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                grams = grams[(grams & 0xFF) != 0]
                own = counts.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in np.unique(grams, return_counts=True))):
                    own[g] = own.get(g, 0) + n
    for lang, own in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])


class Model:
    """Frozen code lengths: ``cost[context, symbol, language]`` in bits."""

    def __init__(self, rows: list[tuple[str, int, int]], symbols: list[int] | None = None):
        self.languages = sorted({r[0] for r in rows})
        trees = []
        for lang in self.languages:
            levels: list[dict[int, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
            for _, gram, n in (r for r in rows if r[0] == lang):
                symbol, context = gram & 0xFF, gram >> 8
                for o in range(ORDER + 1):
                    followers = levels[o].setdefault(context & ((1 << 8 * o) - 1), {})
                    followers[symbol] = followers.get(symbol, 0) + n
            trees.append([levels[0], *({c: f for c, f in level.items() if sum(f.values()) >= LEAST_COUNT} for level in levels[1:])])
        symbols = symbols if symbols is not None else sorted({s for t in trees for f in t[0].values() for s in f})
        # two symbols more: one stands for all bytes never seen, the last for the start of a text
        self.code = np.full(256, len(symbols), dtype=np.int32)
        self.code[symbols] = np.arange(len(symbols))
        self.code[0] = len(symbols) + 1
        self.width = len(symbols) + 2
        w = self.width
        contexts = sorted({(o, c) for t in trees for o in range(ORDER + 1) for c in t[o]})
        self.cost = np.zeros((len(contexts) or 1, w, len(trees)), dtype=np.float32)
        row = {c: i for i, c in enumerate(contexts)}
        for at, (o, c) in enumerate(contexts):
            for k, tree in enumerate(trees):
                self.cost[at, :, k] = self._bits(tree, o, c)
        # the row of each context of three coded bytes: its own, or the longest suffix with one
        base = np.array([row.get((0, 0), 0)], dtype=np.int32)
        for o in range(1, ORDER + 1):
            base = np.tile(base, w)
            for (oo, c), i in row.items():
                if oo == o:
                    parts = [self.code[(c >> 8 * j) & 0xFF] for j in range(o)]
                    base[sum(int(p) * w**j for j, p in enumerate(parts))] = i
        self.rows = base

    def _bits(self, tree: list[dict], order: int, context: int) -> np.ndarray:
        """Code lengths of all symbols after a context, with exclusion on the way down."""
        out = np.full(self.width, np.nan)
        spent = 0.0
        out_of: set[int] = set()
        for o in range(order, -1, -1):
            followers = {s: n for s, n in tree[o].get(context & ((1 << 8 * o) - 1), {}).items() if s not in out_of}
            if not followers:
                continue
            total, distinct = sum(followers.values()), len(followers)
            for s, n in followers.items():
                out[self.code[s]] = spent - np.log2(n / (total + distinct))
            spent -= np.log2(distinct / (total + distinct))
            out_of |= followers.keys()
        out[np.isnan(out)] = spent + np.log2(256 - len(out_of))
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        raw = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts), dtype=np.uint8)
        s, w = self.code[raw], self.width
        context = s[2:-1] + w * s[1:-2] + w * w * s[:-3]
        starts = np.cumsum([0, *(len(t) + 3 for t in texts)])
        out = np.zeros((len(texts), len(self.languages)))
        flat = self.cost.reshape(-1, len(self.languages))
        place = self.rows[context].astype(np.int64) * w + s[3:]
        step = 1 << 18
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:] - 3)):
            for at in range(a, b, step):
                out[i] += flat[place[at : min(b, at + step)]].sum(axis=0, dtype=np.float64)
        return out


class Blocks:
    """Models of some languages each; more than one are kept packed and opened in turn."""

    def __init__(self, models: Iterator[Model]):
        self.languages: list[str] = []
        self.packed: list[bytes] = []
        for model in models:
            self.languages += model.languages
            self.packed.append(zlib.compress(pickle.dumps(model), 1))
        self._open: Model | None = None

    def bits(self, steps: list[list[bytes]]) -> list[np.ndarray]:
        """Code length of each text of each step in each language."""
        found: list[list[np.ndarray]] = [[] for _ in steps]
        for packed in self.packed:
            if self._open is None or len(self.packed) > 1:
                self._open = None
                self._open = pickle.loads(zlib.decompress(packed))
            for parts, texts in zip(found, steps):
                parts.append(self._open.bits(texts) if texts else np.zeros((0, len(self._open.languages))))
        return [np.concatenate(parts, axis=1) for parts in found]


def learn(docs: DataFrame, max_texts: int = MAX_TEXTS, block: int = BLOCK_LANGUAGES) -> Blocks:
    """Learn every language of ``docs(text, lang)``. The driver holds the counts of one block at a time."""
    counts = learning_texts(docs, max_texts).mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    symbols = sorted(r["symbol"] for r in counts.select((F.col("gram") % 256).cast("int").alias("symbol")).distinct().collect())
    return Blocks(Model([tuple(r) for r in counts.filter(F.col("lang").isin(languages[at : at + block])).collect()], symbols) for at in range(0, len(languages), block))


def predict(docs: DataFrame, model: Blocks) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to documents: the language of fewest bits, and its share of a
    mean code probability per byte against the other languages."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = list(slices(batch))
            texts = [part.column("text").to_pylist() for part in parts]
            usable = [[i for i, t in enumerate(own) if t and model.languages and any(c.isalpha() for c in t)] for own in texts]
            raw_texts = [[coded(own[i]) for i in at] for own, at in zip(texts, usable)]
            for part, own, raw, bits in zip(parts, usable, raw_texts, model.bits(raw_texts) if model.languages else raw_texts):
                langs, scores = [UNDECIDED] * part.num_rows, [0.0] * part.num_rows
                if own:
                    mean = (bits - bits.min(axis=1, keepdims=True)) / np.array([[len(t)] for t in raw]) ** 0.5
                    shares = 1 / np.exp2(-mean).sum(axis=1)
                    for i, k, p in zip(own, bits.argmin(axis=1), shares):
                        langs[i], scores[i] = model.languages[k], float(p)
                yield pa.RecordBatch.from_arrays([*(c for n, c in zip(part.schema.names, part.columns) if n != "text"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(n for n in part.schema.names if n != "text"), "lang_pred", "score"])

    rest = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lang_pred string", "score double"]))


def op5_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id")))
    model = learn(docs.filter(~F.col("held_out")).select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model)
