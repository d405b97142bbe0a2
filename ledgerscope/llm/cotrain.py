"""Operator 3: document quality by co-training of a text view and a metadata view.

The text view has shares of byte classes, word statistics and hashed words; the metadata view has
the length, the line layout, and hashed language and source. Each view is a logistic regression,
first fitted on a bounded sample of labelled documents. In each round both views score all
unlabelled documents that neither has labelled yet, and the surest texts of each class (``EXCHANGED`` by
class and view, whatever the size of the corpus: a documented bound) get the view's label in the
training set of the other. Copies of a text count once; a text on which the views disagree in a round is
left out of that round; equally sure texts go by the hash of the text. At the end each view is calibrated on labelled
documents kept apart, and the calibrated log odds are added, the prior counted once.

Defined results: a null text counts as empty, null metadata as a bucket of its own; labels that
repeat for a document count by majority, ties as bad; null labels are none; without labels of both
classes every score is 0.5 and everything is kept; rows that repeat are scored alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.text import slices, word_hashes, words
from ledgerscope.session import materialize

#: Documented bound: labelled documents that the views are fitted and calibrated on, in expectation.
MAX_LABELLED = 10_000
ROUNDS, EXCHANGED, SURE = 3, 250, 0.9
RIDGE = 1.0
WORD_BUCKETS, LANG_BUCKETS, SOURCE_BUCKETS = 64, 8, 16
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".,;:'\"?()-", "!", "|<>", "#*$%&", "@/_+=~^\\`[]{}"), 1):
    _CLASS[[ord(c) for c in _chars]] = _i
N_CLASSES = 11


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, text_view, meta_view`` of ``docs(doc_id, text, lang, source, n_chars)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, texts = part.num_rows, part.column("text").fill_null("")
                raw = [t.encode() for t in texts.to_pylist()]
                sizes = np.array([len(r) for r in raw])
                owner = np.repeat(np.arange(n), sizes)
                kinds = np.bincount(owner * N_CLASSES + _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
                flat, counts = words(texts)
                hashed, of = word_hashes(flat), np.repeat(np.arange(n), counts)
                buckets = np.bincount(of * WORD_BUCKETS + (hashed % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
                again = np.bincount(of[1:][(hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])], minlength=n)
                distinct = np.bincount(np.unique(np.stack([of.astype(np.uint64), hashed], axis=1), axis=0)[:, 0].astype(np.int64), minlength=n) if len(of) else np.zeros(n)
                size, total = np.maximum(sizes, 1), np.maximum(counts, 1)
                text = np.column_stack([np.sqrt(kinds / size[:, None]), np.log1p(counts), again / total, distinct / total, np.sqrt(buckets / total[:, None])])
                lines = kinds[:, 5] + 1
                meta = np.column_stack([np.log1p(part.column("n_chars").to_numpy(zero_copy_only=False)), np.log1p(lines), np.log1p(sizes / lines), np.eye(LANG_BUCKETS)[part.column("lang_at").to_numpy(zero_copy_only=False)], np.eye(SOURCE_BUCKETS)[part.column("source_at").to_numpy(zero_copy_only=False)]])
                view = lambda x: pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), view(text), view(meta)], names=["doc_id", "tie", "text_view", "meta_view"])

    text = F.col("text").cast("string")
    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(n)).cast("int")
    shaped = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.nanvl(F.col("n_chars").cast("double"), F.lit(None).cast("double")), F.length(text).cast("double"), F.lit(0.0)).alias("n_chars"),
        bucket("lang", LANG_BUCKETS).alias("lang_at"), bucket("source", SOURCE_BUCKETS).alias("source_at"), F.xxhash64(text).alias("tie"),
    )
    return shaped.withColumn("n_chars", F.greatest("n_chars", F.lit(0.0))).mapInArrow(run, "doc_id long, tie long, text_view array<float>, meta_view array<float>")


class View:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._design(x)
        self.weights = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], RIDGE)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            gradient = z.T @ (p - y) + penalty * self.weights
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -30, 30)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _surest(views: tuple[View, View], taken: list[int]):
    """Of each task, the texts not yet taken that a view is surest of, by view and class.

    Of copies the surest stays, of those that are equally sure the first id.
    """
    gone = np.array(taken, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[pa.RecordBatch]] = [[], [], [], []]
        least = [SURE] * 4
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(batch.column("tie").to_numpy(), gone)))
            for v, name in enumerate(("text_view", "meta_view")):
                if not batch.num_rows:
                    continue
                p = 1 / (1 + np.exp(-views[v].logit(_matrix(batch.column(name)))))
                for label, sure in ((0, 1 - p), (1, p)):
                    at = 2 * v + label
                    best = np.flatnonzero(sure >= least[at])
                    rows = batch.take(pa.array(best))
                    rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(best), at, dtype=np.int32)), pa.array(sure[best]), *rows.columns], names=["of", "sure", *rows.schema.names])
                    both = pa.Table.from_batches([*kept[at], rows]).sort_by([("sure", "descending"), ("tie", "ascending"), ("doc_id", "ascending")])
                    first = np.sort(np.unique(both.column("tie").to_numpy(), return_index=True)[1])[:EXCHANGED]
                    kept[at] = both.take(pa.array(first)).combine_chunks().to_batches()
                    if len(first) == EXCHANGED:
                        least[at] = kept[at][-1].column("sure")[-1].as_py()
        for part in kept:
            yield from part

    return run


def fit(seen: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> dict | None:
    """Views, their calibrations and the prior from ``features`` and ``labels(doc_id, quality)``."""
    votes = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") > 0.5).cast("int").alias("good"))
    votes = materialize(votes, "votes")
    share = min(1.0, max_labelled / max(1, votes.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)
    rows = seen.join(votes.filter(drawn), "doc_id").select("doc_id", "tie", "text_view", "meta_view", "good").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    x = [_matrix(rows.column(c).combine_chunks()) for c in ("text_view", "meta_view")]
    y = rows.column("good").to_numpy()
    apart = rows.column("tie").to_numpy() % 4 == 1
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        return None
    training = [[(x[v][~apart], y[~apart])] for v in (0, 1)]
    unlabelled = seen.join(votes.select("doc_id"), "doc_id", "left_anti")
    stacked = lambda parts: View(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    views = (stacked(training[0]), stacked(training[1]))
    taken = sorted(set(rows.column("tie").to_pylist()))
    for _ in range(rounds):
        found = unlabelled.mapInArrow(_surest(views, taken), "of int, sure double, doc_id long, tie long, text_view array<float>, meta_view array<float>")
        # of copies in several tasks one stays
        found = materialize(found, "surest").groupBy("of", "tie").agg(F.min_by(F.struct("sure", "text_view", "meta_view"), F.struct((-F.col("sure")).alias("sure"), "doc_id")).alias("x")).select("of", "tie", "x.*")
        found = materialize(found, "surest")
        best = None
        for of in range(4):
            top = found.filter(F.col("of") == of).orderBy(F.desc("sure"), "tie").limit(EXCHANGED)
            best = top if best is None else best.union(top)
        gained = best.toArrow().combine_chunks()
        if not gained.num_rows:
            break
        of, tie = (gained.column(c).to_numpy() for c in ("of", "tie"))
        good, bad = (set(tie[of % 2 == label].tolist()) for label in (1, 0))
        agreed = np.array([t not in good or t not in bad for t in tie.tolist()])
        taken += sorted(good ^ bad)
        for v in (0, 1):
            mine = np.flatnonzero(agreed & (of // 2 == v))
            if len(mine):
                column = gained.take(pa.array(mine)).column(("text_view", "meta_view")[1 - v]).combine_chunks()
                training[1 - v].append((_matrix(column), of[mine] % 2))
        if not agreed.any():
            break
        views = (stacked(training[0]), stacked(training[1]))
    calibrated = tuple(View(views[v].logit(x[v][apart])[:, None], y[apart]) for v in (0, 1))
    prior = np.log(y.mean() / (1 - y.mean()))
    return {"views": views, "calibrated": calibrated, "prior": float(prior)}


def score(seen: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, p_text, p_meta, score, kept`` of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            logits = [np.zeros(n), np.zeros(n)]
            both = np.zeros(n)
            if model and n:
                logits = [model["calibrated"][v].logit(model["views"][v].logit(_matrix(batch.column(c)))[:, None]) for v, c in enumerate(("text_view", "meta_view"))]
                both = logits[0] + logits[1] - model["prior"]
            p = [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logits, both)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in p), pa.array(p[2] >= 0.5)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return seen.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = materialize(features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    return score(seen, fit(seen, spark.read.parquet(f"{sf_dir}/labels.parquet")))
