"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the document id. It starts as one bucket;
only buckets over the byte limit split on another bit, until every shard fits. Bytes per hash prefix
are summed at a depth that the total suggests, and rolled up to every shorter prefix at once: a
document's bucket is its shortest prefix that fits. Prefixes still over the limit at that depth go on
with more bits, they alone. What shares all bits (rows repeating an id, or one document over the
limit) can't be split by hashing: such rows are dealt into numbered parts within the limit, and a
single document larger than the limit is a shard of its own.

Built of DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

LIMIT = 1 << 20
HASH_BITS = 60
STEP = 20  # most bits that one pass looks at; the directory of a pass has 2**STEP prefixes at most


def hash_bits(column):
    """The first 60 bits of the MD5 of the id as text, as a long; null ids hash as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _leaves(cells: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """(cell, bytes) at `depth` bits -> (cell, bits, fits): the shortest prefix over `start` bits that fits."""
    upward = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("bits"))
    prefix = F.expr(f"shiftright(cell, {depth} - bits)")
    sums = upward.groupBy("bits", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    fits = upward.select("cell", "bits", prefix.alias("prefix")).join(sums.where(F.col("bytes") <= limit), ["bits", "prefix"])
    return cells.join(fits.groupBy("cell").agg(F.min("bits").alias("bits")), "cell", "left").select("cell", "bits")


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bytes, bits, prefix, part, shard) per row of `docs`.

    bytes: UTF-8 length (null text: 0); shard: the prefix as a bit string (empty for the only bucket
    of a small table), followed by `-part` where one hash value alone exceeds the limit. Null ids
    hash alike. Other columns are ignored; an empty table gives an empty table.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(id_col).alias("id"), size.alias("bytes"), hash_bits(F.col(id_col)).alias("h")), "hashes")
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    depth, start, open_, placed = min(STEP, max(4, math.ceil(math.log2(total / limit + 1)) + 4)), 0, sized, []
    while True:
        cell = F.expr(f"shiftright(h, {HASH_BITS - depth})")
        cells = open_.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"))
        leaves = materialize(_leaves(cells, start, depth, limit), "directory")
        found = open_.withColumn("cell", cell).join(leaves, "cell").select("id", "bytes", "h", "bits")
        placed.append(found.where("bits is not null"))
        if leaves.where("bits is null").isEmpty():
            break
        open_ = materialize(found.where("bits is null").drop("bits"), "oversized")
        if depth == HASH_BITS:
            placed.append(open_.withColumn("bits", F.lit(HASH_BITS)))
            break
        start, depth = depth + 1, min(HASH_BITS, depth + STEP)
    out = placed[0]
    for rows in placed[1:]:
        out = out.unionByName(rows)
    over = placed[1:] and placed[-1].groupBy("h").agg(F.sum("bytes").alias("b"), F.max("bits").alias("d")).where(f"b > {limit} and d = {HASH_BITS}").select("h")
    if depth == HASH_BITS and len(placed) > 1:
        out = _parts(out, over, limit)
    else:
        out = out.withColumn("part", F.lit(None).cast("long"))
    prefix = F.expr(f"shiftright(h, {HASH_BITS} - bits)")
    bits = F.when(F.col("bits") > 0, F.lpad(F.bin(prefix), F.col("bits"), F.lit("0"))).otherwise("")
    name = F.concat(bits, F.coalesce(F.concat(F.lit("-"), F.col("part").cast("string")), F.lit("")))
    return out.select("id", "bytes", "bits", prefix.alias("prefix"), "part", name.alias("shard"))


def _parts(rows: DataFrame, over: DataFrame, limit: int) -> DataFrame:
    """Number the parts of the hash values in `over`: rows of one size fill parts of their own, so
    that a rank among equals, taken in salted slices, is all that is needed."""
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    salted = materialize(salted.join(over.withColumn("hot", F.lit(True)), "h", "left"), "parts")
    hot = salted.where("hot")
    slices = hot.groupBy("h", "bytes", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("h", "bytes").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    sizes = hot.groupBy("h", "bytes").count().withColumn("n", F.ceil(F.col("count") / each))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("bytes").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("h", "bytes", first.alias("first"))
    place = F.row_number().over(Window.partitionBy("h", "bytes", "salt").orderBy("bytes")) - 1
    ranked = hot.withColumn("place", place).join(slices.select("h", "bytes", "salt", before.alias("before")), ["h", "bytes", "salt"]).join(starts, ["h", "bytes"])
    numbered = ranked.select("id", "bytes", "h", "bits", (F.col("first") + F.floor((F.col("place") + F.col("before")) / each)).cast("long").alias("part"))
    return numbered.unionByName(salted.where("hot is null").select("id", "bytes", "h", "bits", F.lit(None).cast("long").alias("part")))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "bytes", F.col("bits").cast("int").alias("bits"), "shard")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
levels AS (SELECT d.*, b.bits, h >> ({HASH_BITS} - b.bits) AS prefix FROM d, (SELECT unnest(range(0, 31)) AS bits) b),
sums AS (SELECT bits, prefix, sum(bytes) AS total FROM levels GROUP BY ALL),
leaf AS (SELECT doc_id, any_value(bytes) AS bytes, any_value(h) AS h, min(bits) AS bits
         FROM levels JOIN sums USING (bits, prefix) WHERE total <= {LIMIT} GROUP BY doc_id)
SELECT doc_id, bytes, bits::INTEGER AS bits,
       CASE WHEN bits = 0 THEN '' ELSE lpad(bin(h >> ({HASH_BITS} - bits)), bits::INTEGER, '0') END AS shard
FROM leaf
"""
