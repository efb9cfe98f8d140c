"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the fractional number of copies its source's target asks for. The whole
part is certain; the fractions are rounded by the pivotal method: two documents meet, mass moves
from one to the other in a random direction, with the odds that keep each document's expected
copies and in the amount that keeps the words of both together, until one of them is integral. The
other meets the next one. Blocks of a source's documents, largest first, are combined this way by a
fold; each block leaves at most one fractional document, and these meet again in blocks, level by
level, until a source has one left, which a last draw settles. A source's words thus differ from its
target by less than the size of that one document. Draws come from hashes of ids, so reruns agree.

Built of DataFrame functions only. Blocks hold about BLOCK documents of like size, whatever a
source's share of all rows, so a hot source is spread over as many blocks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

BLOCK = 128
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9  # a fraction this near to 0 or 1 is integral


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target: `share` of all sizes by weight, none above `most` times
    its source's size, the excess going to the others by weight. Weights repeat over the sources by
    code point, null last. The table has a row for each source, so it is small beside the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("w", w).withColumn("limit", most * F.col("source_size"))
    # Sources reach their limits in the order of limit / weight; level is what a unit of weight gets when all before are at theirs.
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    at_limit = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.lit(share) * F.sum("source_size").over(whole) - at_limit) / rest
    leveled = named.withColumn("level", F.when(level <= F.col("limit") / F.col("w"), level))
    return leveled.select("source", "source_size", F.least("limit", F.col("w") * F.coalesce(F.max("level").over(whole), F.lit(float("inf")))).alias("target"))


def _draw(seed: int, *cols: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / float(1 << 52)


def _meet(state: Column, x: Column) -> Column:
    """One pivotal step of the fold: the unit carried in `state` meets unit `x`."""
    c = state["carried"]
    a, b = c["p"], x["p"]
    ratio = c["size"] / x["size"]  # mass of x that weighs as much as one copy of c
    up = F.least(1 - a, b / ratio)  # c may gain as much
    down = F.least(a, (1 - b) / ratio)
    step = F.when(x["u"] * (up + down) < down, up).otherwise(-down)
    snap = lambda p: F.when(p < EDGE, 0.0).when(p > 1 - EDGE, 1.0).otherwise(p)
    new_c = F.struct(c["key"].alias("key"), c["size"].alias("size"), snap(a + step).alias("p"), c["u"].alias("u"))
    new_x = F.struct(x["key"].alias("key"), x["size"].alias("size"), snap(b - step * ratio).alias("p"), x["u"].alias("u"))
    c_done = (new_c["p"] == 0.0) | (new_c["p"] == 1.0)
    met = F.struct(
        F.when(c_done, new_x).otherwise(new_c).alias("carried"),
        F.concat(state["settled"], F.array(F.when(c_done, new_c).otherwise(new_x))).alias("settled"),
    )
    return F.when(c.isNull(), F.struct(x.alias("carried"), state["settled"].alias("settled"))).otherwise(met)


UNIT = "struct<key:struct<id:{kind},copy:long>,size:double,p:double,u:double>"


def _round_blocks(units: DataFrame, kind: str) -> DataFrame:
    """(source, block, key, size, p, u) -> per block its units with p settled but for one at most."""
    unit = UNIT.format(kind=kind)
    rows = units.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("o"), "key", "size", "p", "u"))).alias("us"))
    ordered = F.transform("us", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["p"].alias("p"), x["u"].alias("u")).cast(unit))
    start = F.struct(F.lit(None).cast(unit).alias("carried"), F.array().cast(f"array<{unit}>").alias("settled"))
    folded = F.aggregate(ordered, start, lambda s, x: _meet(s, x).cast(f"struct<carried:{unit},settled:array<{unit}>>"))
    both = rows.select("source", "block", folded.alias("f")).select("source", "block", F.explode(F.concat("f.settled", F.array("f.carried"))).alias("x"))
    return both.select("source", "block", "x.*")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) per row of `docs`.

    size: words of the text (null and empty: 0); copies: times the mix takes it, 0 to 2. Documents
    of size 0 add nothing: they get as many copies as is certain. Null sources form one source, the
    last. Rows that repeat an id are rounded each on their own. Other columns are ignored; an empty
    table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    again = Window.partitionBy("id", "source", "size").orderBy("size")
    sized = materialize(sized.withColumn("copy", F.row_number().over(again).cast("long")), "sizes")
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "targets")
    t = targets.withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    asked = sized.join(F.broadcast(t) if _few(targets) else t, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    asked = asked.withColumn("sure", F.floor(F.col("rate") + EDGE)).withColumn("p", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))

    key = F.struct("id", "copy")
    bin_ = F.floor(F.log2(F.col("size").cast("double")) * 2)
    open_ = asked.where((F.col("size") > 0) & (F.col("p") > EDGE))
    fill = open_.groupBy("source", bin_.alias("bin")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("blocks")).withColumnRenamed("source", "s")
    units = (
        open_.withColumn("bin", bin_)
        .join(fill.withColumnRenamed("bin", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .select("source", F.struct(F.col("bin").cast("long").alias("bin"), F.pmod(F.xxhash64(F.lit(seed), "id", "copy"), F.col("blocks")).alias("no")).alias("block"), key.alias("key"), F.col("size").cast("double").alias("size"), "p", _draw(seed + 1, F.col("id"), F.col("copy")).alias("u"))
    )
    settled, level = [], 0
    while True:
        done = materialize(_round_blocks(units, kind), "rounded")
        settled.append(done.where("p = 0 or p = 1"))
        rest = done.where("p > 0 and p < 1")
        if rest.groupBy("source").count().where("count > 1").isEmpty():
            break
        level += 1
        # Blocks of a size bin meet first, then the bins of a source.
        most = rest.groupBy("source", "block.bin").count().agg(F.max("count")).first()[0]
        nxt = F.struct(F.col("block.bin").alias("bin"), F.floor(F.col("block.no") / BLOCK).alias("no")) if most > 1 else F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("no"))
        units = rest.select("source", nxt.alias("block"), "key", "size", "p", _draw(seed + 1 + level, F.col("key.id"), F.col("key.copy")).alias("u"))
    last = rest.withColumn("p", F.when(_draw(seed + 99, F.col("key.id"), F.col("key.copy")) < F.col("p"), 1.0).otherwise(0.0))
    rounded = last
    for part in settled:
        rounded = rounded.unionByName(part)
    extra = rounded.where("p = 1").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("key.id").alias("i"), F.col("key.copy").alias("c"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("copy") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    copies = F.col("sure").cast("long") + F.col("c").isNotNull().cast("long")
    return asked.join(extra, same, "left").select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _few(targets: DataFrame) -> bool:
    """Whether the table of sources may be broadcast."""
    return targets.count() <= 10_000


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs` as mixed: each row as often as the mix takes it, with all its columns.

    A row finds its copies by id, source and number of words; rows alike in all three share theirs,
    the first of them by text taking one more where they don't divide.
    """
    took = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).groupBy("id", "source", "size").agg(F.sum("copies").alias("k"), F.count("*").alias("rows"))
    took = took.select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "k", "rows").where("k > 0")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # The caller's row is one column, so its names meet none of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    single = rows.join(took.where("rows = 1"), same).select("row", F.col("k").alias("each"))
    nth = F.row_number().over(Window.partitionBy("i", "s", "z").orderBy(F.xxhash64(F.col("row").getField(text_col))))
    several = rows.join(took.where("rows > 1"), same).withColumn("nth", nth)
    several = several.select("row", (F.floor(F.col("k") / F.col("rows")) + (F.col("nth") <= F.col("k") % F.col("rows")).cast("long")).alias("each")).where("each > 0")
    return single.unionByName(several).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "each"))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
