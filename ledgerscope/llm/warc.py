"""Operator 1: Merkle fixity audit of web archives, with DataFrame functions alone.

``warc_record`` writes a page as a WARC response record; ``laid_out`` gives records their file and
ordered offset. ``merkle_levels`` hashes the records of each range of 64 KiB of offsets (offset,
length and digest of each, in order), then up to 64 neighbouring nodes at a time: ranges to files,
files to one root per replica. ``audit`` compares two replicas from the root down. Each level looks
only at the children of nodes that differ, so intact files and ranges are never opened, and ends at
the records that are changed, missing or extra.

Defined results: null urls and bodies count as empty; a page without ``page_id`` is in file -1;
pages that repeat an id are records of their own, in the order of their digests; equal replicas and
empty ones differ nowhere; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerscope.session import materialize

PAGES_PER_FILE = 256
RANGE_BYTES = 65_536
FANOUT = 64
#: Levels 0 to 3 are ranges of a file (64 KiB, 4 MiB, 256 MiB, 16 GiB), 4 is files, 5 to 7 are groups of files, 8 is the root.
FILES, ROOT = 4, 8


def warc_record(url: Column, page_id: Column, body: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    body = text(body)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), text(page_id),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def fixity(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def laid_out(records: DataFrame, pages_per_file: int = PAGES_PER_FILE) -> DataFrame:
    """Add ``warc_file`` and ``record_offset`` to ``page_id, record_length, digest``.

    A file has the pages of a range of ids, so the running sum of its lengths is a bounded window.
    """
    df = records.withColumn("warc_file", F.coalesce(F.floor(F.col("page_id") / pages_per_file), F.lit(-1)).cast("long"))
    before = Window.partitionBy("warc_file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("record_offset", F.coalesce(F.sum("record_length").over(before), F.lit(0)))


def _group(nodes: DataFrame, file: Column, node: Column, order: str, entry: Column) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), entry.alias("entry"))))
    digest = F.sha2(F.array_join(F.transform(children, lambda c: c["entry"]), ","), 256)
    return nodes.groupBy(file.alias("file"), node.alias("node")).agg(digest.alias("digest"))


def merkle_levels(digests: DataFrame) -> list[DataFrame]:
    """Levels 0 to ``ROOT``, each ``file, node, digest``; from ``FILES`` on ``file`` is 0."""
    entry = F.concat_ws(":", "record_offset", "record_length", "digest")
    levels = [materialize(_group(digests, F.col("warc_file"), F.floor(F.col("record_offset") / RANGE_BYTES), "record_offset", entry), "merkle")]
    for level in range(1, ROOT + 1):
        file, node = _parent(level - 1)
        levels.append(materialize(_group(levels[-1], file, node, "node", F.concat_ws(":", "node", "digest")), "merkle"))
    return levels


def _parent(level: int) -> tuple[Column, Column]:
    """File and node of the parent of a node of a level."""
    if level == ROOT - 1:
        return F.lit(0).cast("long"), F.lit(0).cast("long")
    if level == FILES - 1:
        return F.lit(0).cast("long"), F.col("file")
    return F.col("file"), F.floor(F.col("node") / FANOUT)


def audit(digests_a: DataFrame, digests_b: DataFrame) -> DataFrame:
    """``warc_file, record_offset, record_length, page_id, status, digest_a, digest_b`` of differing records.

    Both inputs have ``warc_file, record_offset, record_length, page_id, digest``.
    """
    a, b = merkle_levels(digests_a), merkle_levels(digests_b)
    open_nodes = None
    for level in range(ROOT, -1, -1):
        x, y = a[level], b[level]
        if open_nodes is not None:
            file, node = _parent(level)
            x, y = (d.withColumns({"open_file": file, "open_node": node}).join(open_nodes, ["open_file", "open_node"], "left_semi") for d in (x, y))
        x, y = x.select("file", "node", F.col("digest").alias("digest_a")), y.select("file", "node", F.col("digest").alias("digest_b"))
        differing = x.join(y, ["file", "node"], "full").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        open_nodes = materialize(differing.select(F.col("file").alias("open_file"), F.col("node").alias("open_node")), "differing")
    keys = ["warc_file", "record_offset"]

    def side(digests: DataFrame, name: str) -> DataFrame:
        placed = digests.withColumns({"open_file": F.col("warc_file"), "open_node": F.floor(F.col("record_offset") / RANGE_BYTES)})
        return placed.join(open_nodes, ["open_file", "open_node"], "left_semi").select(*keys, *(F.col(c).alias(f"{c}_{name}") for c in ("record_length", "page_id", "digest")))

    both = side(digests_a, "a").join(side(digests_b, "b"), keys, "full")
    same = F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("record_length_a").eqNullSafe(F.col("record_length_b"))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    length, page = F.coalesce("record_length_a", "record_length_b"), F.coalesce("page_id_a", "page_id_b")
    return both.filter(~same).select(*keys, length.alias("record_length"), page.alias("page_id"), status.alias("status"), "digest_a", "digest_b")


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Record digests of the archive of ``pages``, and of a copy with known damage.

    The copy has the first character of the body replaced where ``page_id`` leaves 5 by 97, and
    lacks the records where it leaves 7 by 101. One pass hashes both; only digests are shuffled.
    """
    page_id, html = F.col("page_id").cast("long"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    damaged = F.when(F.coalesce(F.pmod("page_id", F.lit(97)) == 5, F.lit(False)) & (html != ""), F.concat(F.lit("#"), F.substring(html, 2, 2147483647))).otherwise(html)
    one, two = warc_record(F.col("url"), page_id, html), warc_record(F.col("url"), page_id, damaged)
    hashed = pages.select(page_id.alias("page_id"), F.octet_length(one).cast("long").alias("record_length"), F.octet_length(two).cast("long").alias("copy_length"), fixity(one).alias("digest"), fixity(two).alias("copy_digest"))
    rows = materialize(laid_out(hashed), "records")
    kept = ["warc_file", "record_offset", "record_length", "page_id", "digest"]
    copy = rows.filter(F.coalesce(F.pmod("page_id", F.lit(101)) != 7, F.lit(True))).withColumn("record_length", F.col("copy_length")).withColumn("digest", F.col("copy_digest"))
    return rows.select(kept), copy.select(kept)


def op1_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(*replicas(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


OP1_SQL = """
with records as (
  select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10) || 'Content-Length: ' as head,
    coalesce(html, '') as html,
    case when page_id % 97 = 5 and html <> '' then '#' || substr(html, 2) else coalesce(html, '') end as damaged,
    chr(13) || chr(10) || chr(13) || chr(10) as gap
  from pages
), hashed as (
  select page_id, head || strlen(html) || gap || html || gap as a, head || strlen(damaged) || gap || damaged || gap as b, page_id % 101 = 7 as lost
  from records
), laid as (
  select page_id, lost, strlen(a) as record_length, sha256(a) as digest_a, sha256(b) as digest_b, coalesce(cast(floor(page_id / 256) as bigint), -1) as warc_file
  from hashed
), placed as (
  select *, coalesce(sum(record_length) over (partition by warc_file order by page_id, digest_a rows between unbounded preceding and 1 preceding), 0)::bigint as record_offset
  from laid
)
select warc_file, record_offset, record_length, page_id, case when lost then 'missing' else 'changed' end as status, digest_a, case when not lost then digest_b end as digest_b
from placed where lost or digest_a <> digest_b
"""
