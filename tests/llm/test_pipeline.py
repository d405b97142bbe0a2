import re

import duckdb
import numpy as np

import corpus_pipeline
from ledgerscope.llm import near_dup, pii, quality_rules
from tests.llm import brute


def test_pipeline_is_its_stages(spark, sf_dir):
    """The quality verdict and the added spans are the operators' own; all else is done over in Python."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).select("doc_id", "kept").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if judged[r["doc_id"]]]
    leaders = {i for i, _, c in brute.near_duplicates(sorted(left), corpus_pipeline.NEAR_PERCENT) if i == c}
    left = [d for d in left if d[0] in leaders]
    items = duckdb.connect().execute(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    dirty = {d for d, _ in brute.contained(left, items)}
    assert dirty
    left = [(i, pii.masked(t)) for i, t in left if i not in dirty]
    assert not any(re.search(r"@mail\d\.example", t) for _, t in left)
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(p for i, t in left for p in brute.pieces(i, t))
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_near_duplicates_between_80_and_85_percent_are_linked(spark):
    """Pairs of 0.80 to 0.85 similarity: the stage leaves one document of each, op7's own threshold both."""
    rng = np.random.default_rng(8)
    docs, expected = [], set()
    for i in range(300):
        base = [f"w{rng.integers(0, 10**9)}" for _ in range(104)]
        other = list(base)
        for at in (20, 60)[: 1 + i % 2]:
            other[at] = "edited"
        # two edits leave 90 of 110 shingles; one edit and a shorter end leave 88 of 105
        if i % 2 == 0:
            other = other[:-7]
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        a, b = brute.shingle_set(docs[-2][1]), brute.shingle_set(docs[-1][1])
        assert 0.80 <= len(a & b) / len(a | b) < 0.85
        expected.add(2 * i)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()} == expected
    assert near_dup.without_duplicates(frame).count() == len(docs)


def test_rows_and_not_ids_are_dropped(spark):
    """Repeated and null ids: of each group one row stays, whatever its id's other rows say."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " end"
    rows = [(3, a), (5, a), (5, b), (None, near(b)), (None, near(b)), (None, c), (None, near(c)), (6, a.replace("a", "q")), (7, ""), (7, ""), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dup.without_duplicates(frame).collect())
    # of the texts c and its near copy, both without an id, a hash of the text picks one
    assert [g for g in got if g[1] not in (c, near(c))] == sorted([(3, a), (5, b), (6, a.replace("a", "q")), (7, ""), (7, ""), (8, "")])
    assert len(got) == 7


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path, sf_dir):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "s", 9, "k"), (1, words, "en", "s", 9, "k"), (None, words + " end", None, None, None, None), (None, None, None, None, None, None), (2, "", "en", "s", 0, ""), (3, "mail me: a9@mail.example " + " ".join(f"other{i}" for i in range(40)), "en", "s", 0, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key string"
    for name, table in (("odd", rows), ("empty", [])):
        at = tmp_path / name
        spark.createDataFrame(table, schema).write.parquet(str(at / "documents.parquet"))
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(at / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(at)).toPandas()
        assert sorted(got["doc_id"].fillna(0)) == ([1, 3] if table else [])


def test_thresholds_follow_the_similarity():
    least = near_dup.least_agreement
    assert [least(64, 85), least(128, 85), least(64, 80), least(128, 80)] == [43, 93, 39, 85]
