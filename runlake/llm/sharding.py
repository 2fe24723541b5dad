"""Sharding by extendible hashing (operator 1).

The hash of a document is the first 60 bits of the MD5 of its ``doc_id``. A bucket is a prefix of these bits; it starts as
the whole corpus, and only a bucket over the byte limit splits on its next bit, until every bucket fits. The directory
therefore has one row per shard (``depth``, ``prefix``), of different depths.

Byte counts are gathered once per *cell* (all documents with the same first bits, with partial sums before the shuffle) and
added up along the prefixes, so the documents are read twice whatever the depth. Cells that are still over the limit are
looked at again with more bits, and only they.

Documents that share all 60 bits (repeated ``doc_id``, or none) cannot be told apart by more bits. If they exceed the limit
together they get overflow pages, as in any hash file: a page number from running totals over equal parts of the page range,
so that no task needs them all. A single document above the limit is a shard of its own (``oversized``).

Null ``doc_id`` hashes as the word ``null``; null or empty text has 0 bytes. Extra columns pass through; the columns that are
added are in one struct ``shard`` (``shard_`` if there is such a column). An empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.llm.common import columns_of, cut, documents, free_name

BITS, STEP = 60, 12
#: Production limit for the text of a shard: what one read request of an object store brings.
SHARD_BYTES = 1 << 20


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _first(bits: str, have: int, keep: Column | int) -> Column:
    """The first ``keep`` of the ``have`` bits in column ``bits``."""
    return F.call_function("shiftright", F.col(bits), (F.lit(have) - keep).cast("int"))


def level(rows: DataFrame, limit: int, known: int, deep: int) -> tuple[DataFrame, DataFrame]:
    """For (bits, bytes) of buckets that are over the limit at ``known`` bits: where each cell of ``deep`` bits belongs
    (cell, depth, prefix, shard_bytes, shard_docs; nowhere yet if still over the limit), and the cells that are still over."""
    cells = rows.groupBy(_first("bits", BITS, deep).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
    by_depth = cut(cells).select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(known), F.lit(deep))).alias("depth"))
    by_depth = by_depth.withColumn("prefix", _first("cell", deep, F.col("depth")))
    buckets = cut(by_depth.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")))
    # prefix sums fall with depth, so the shallowest bucket that fits is the one that no split goes beyond
    fits = by_depth.join(buckets.filter(F.col("shard_bytes") <= limit), ["depth", "prefix"])
    place = fits.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("at"))
    still = buckets.filter((F.col("depth") == deep) & (F.col("shard_bytes") > limit))
    return place.select("cell", "at.*"), still.select(F.col("prefix").alias("cell"), "shard_bytes", "shard_docs")


def sharded(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """``docs`` with a struct ``shard``: depth, prefix, page, shard_bytes, shard_docs (over all pages), n_bytes, oversized."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") if size is None else size
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), hash_bits(F.col(key)).alias("bits"), size.alias("bytes"))
    left = rows.select("bits", "bytes")
    total = left.agg(F.sum("bytes")).first()[0] or 0
    known, deep = 0, min(BITS, (total // limit).bit_length() + 5)
    out = None
    while True:
        place, still = level(left, limit, known, deep)
        here = place.select(F.col("cell").alias(f"cell_{deep}"), F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias(f"at_{deep}"))
        base = rows if out is None else out
        out = base.withColumn(f"cell_{deep}", _first("bits", BITS, deep)).join(here, f"cell_{deep}", "left")
        if deep == BITS or still.isEmpty():
            break
        left = left.withColumn("cell", _first("bits", BITS, deep)).join(still.select("cell"), "cell", "left_semi").select("bits", "bytes")
        known, deep = deep, min(BITS, deep + STEP)
    found = F.coalesce(*[F.col(c) for c in out.columns if c.startswith("at_")])
    out = out.select("row", "bits", "bytes", found.alias("at"), F.lit(0).cast("long").alias("page"))
    if deep == BITS and not still.isEmpty():
        out = out.filter("at IS NOT NULL").unionByName(overflow(out.filter("at IS NULL").drop("at", "page"), still, limit))
    shard = F.struct("at.*", "page", F.col("bytes").alias("n_bytes"), (F.col("bytes") > limit).alias("oversized"))
    return out.select("row.*", shard.alias(free_name(docs, "shard")))


def overflow(rows: DataFrame, still: DataFrame, limit: int) -> DataFrame:
    """Pages for buckets that more bits cannot split. Each partition fills pages of its own: of half the limit by running
    total, and one for each document above that. ``page`` is unique in its bucket, with the partition in its upper bits."""
    spread = cut(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).withColumn("part", F.spark_partition_id()).withColumn("nr", F.monotonically_increasing_id()))
    running = Window.partitionBy("bits", "part").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    half = max(1, limit // 2)
    page = F.shiftleft(F.col("part").cast("long"), 32) + 2 * F.floor(F.sum("bytes").over(running) / half) + (F.col("bytes") > half).cast("long")
    at = F.struct(F.lit(BITS).alias("depth"), F.col("cell").alias("prefix"), "shard_bytes", "shard_docs")
    return spread.withColumn("page", page).join(still, F.col("bits") == F.col("cell")).select("row", "bits", "bytes", at.alias("at"), "page")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write each shard as one folder of Parquet, named by its bits; the rows of a shard meet in one task."""
    shard = free_name(docs, "shard")
    at = F.col(shard)
    bits = F.right(F.lpad(F.conv(at["prefix"].cast("string"), 10, 2), F.lit(BITS), F.lit("0")), at["depth"])
    page = F.when(at["page"] != 0, F.concat(F.lit("-"), at["page"].cast("string"))).otherwise("")
    rows = sharded(docs, limit).withColumn(shard, F.concat(F.lit("s"), bits, page))
    rows.repartition(shard).write.partitionBy(shard).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharded(docs, size=F.col("n_bytes")).select("doc_id", "n_bytes", "shard.depth", "shard.prefix", "shard.page", "shard.shard_bytes", "shard.shard_docs", "shard.oversized")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS bits FROM documents),
by_depth AS (SELECT d.*, depth::INTEGER AS depth, bits >> (60 - depth)::INTEGER AS prefix FROM d, range(0, 41) AS t(depth)),
buckets AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM by_depth GROUP BY depth, prefix),
fits AS (
  SELECT b.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nr
  FROM by_depth b JOIN buckets USING (depth, prefix) WHERE shard_bytes <= 1048576)
SELECT doc_id, n_bytes, depth, prefix, 0::BIGINT AS page, shard_bytes, shard_docs, n_bytes > 1048576 AS oversized
FROM fits WHERE nr = 1
"""
