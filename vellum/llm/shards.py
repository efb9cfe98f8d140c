"""Groups of rows that share a key, settled in shards: linear in the members of a connected group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their first two columns -> tables of whole groups, of `least` rows if there are as
    many, and the groups' bounds."""
    kept: list[pa.RecordBatch] = []
    rows, last = 0, False
    batches = iter(batches)
    while not last:
        b = next(batches, None)
        last = b is None
        if b is not None and b.num_rows:
            kept.append(b)
            rows += b.num_rows
        if not kept or not last and rows < least:
            continue
        t = pa.Table.from_batches(kept)
        key, shard = (t.column(i).to_numpy() for i in (0, 1))
        bounds = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (shard[1:] != shard[:-1])) + 1, [rows]])
        kept, rows = [], 0
        if not last:  # the last group may go on in the next batch
            kept = t.slice(bounds[-2]).combine_chunks().to_batches()
            rows, bounds = int(bounds[-1] - bounds[-2]), bounds[:-1]
        if len(bounds) > 1:
            yield t.slice(0, bounds[-1]), bounds


def group_links(members: DataFrame, shards: Column, join: Callable[[DataFrame], DataFrame], run: Callable, known: DataFrame | None = None) -> DataFrame:
    """(key, node, and what `shards` needs) -> (a, b) links found by `run` in the groups of a key.

    join() adds the columns that `run` needs after (key, shard, home, node, root). Groups of one shard
    are settled at once; where a group has several, a member meets its own shard first, and those
    outside the group's largest component so far then visit the others. `known` (node, root) names components
    found before: a row's root is then known, and the links that tie them are among those returned.
    """
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    counts = members.groupBy("key").agg(F.count("*").alias("m"), shards.alias("n")).where("m > 1").select("key", "n")
    counts = materialize(counts, "group-sizes")

    def found(rows: DataFrame) -> DataFrame:
        placed = join(rows).repartition("key", "shard").sortWithinPartitions("key", "shard", "node")
        return placed.mapInArrow(run, "a long, b long")

    dealt = members.select("key", "node").join(counts, "key").withColumn("shard", own)
    root = F.col("node")
    if known is not None:
        dealt, root = dealt.join(known, "node", "left"), F.coalesce("root", "node")
    fresh = found(dealt.select("key", "shard", F.lit(1).alias("home"), "node", root.alias("root")))
    if known is not None:
        fresh = fresh.unionByName(known.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    first = materialize(fresh, "group-links")
    large = counts.where("n > 1")
    if large.isEmpty():
        return first
    roots = connected_components(first)
    split = members.select("key", "node").join(large, "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = materialize(split, "large-groups")
    most = split.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("several")).where("several > 1")
    split = split.join(most.select("key", F.col("top.root").alias("main")), "key").withColumn("own", own)
    visits = F.when(F.col("root") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    rows = split.select("key", F.explode(visits).alias("shard"), "own", "node", "root")
    second = found(rows.select("key", "shard", (F.col("own") == F.col("shard")).cast("int").alias("home"), "node", "root"))
    return materialize(first.unionByName(second), "group-links")
