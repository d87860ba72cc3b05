"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL
functions only.

Each source is dealt into blocks of documents, in an order drawn from a hash
of the id.  Time is counted in slots of one block.  With integer shares
``s`` of a period of ``P`` slots (``P`` = sum of the shares), block ``k`` of a
source is released in slot ``k*P div s`` and is due by the end of slot
``ceil((k+1)*P/s) - 1``; every slot takes, of the released blocks, the one
with the earliest deadline (ties: the smaller source name).  Shares sum to the
period, so every deadline is met, and in every prefix of the schedule each
source is less than one block from its target weight.  All windows begin anew
with each period, so one period (at most about ``resolution`` slots, a bound
that does not depend on the data) is scheduled, and the slot of any block
follows from its number.

A source that has run out leaves its later slots empty, so the others go on
in the proportion of their weights.  Every document is placed exactly once.

Without given weights, a source of n documents weighs n ** power (power 0.5
lifts small sources).  A source of at least one slot a period is a pool of its
own.  Lighter ones, however many, form pools ``<rest:c>`` of n sources of
about equal weight (c: quarters of powers of two, so the common weight is
within 19 % of a source's own): in the m slots of such a pool, block k of its
r-th source (by name hash) is released at k*n and due by (k+1)*n - 1, and
earliest-deadline-first is then the closed form k*n + r.  As the pool itself
is less than one block from its weight, so is each of its sources from the n-th
part of it.  Nothing is computed source after source, so any number of
sources is scheduled.  Sources that weigh nothing, or that given weights do not
name, have no target and share the pool ``<rest>``; a null source is
``<none>``.  A pool has one slot a period at least.

Hot sources: the documents' order numbers come from counts per (source, hash
prefix), so no group holds more than a small part of a source; sources within
a pool are numbered likewise.

Defined results: null ids sort by the hash of the empty text; repeated rows
each get a place of their own.  Only ``id_col`` and ``source_col`` decide;
other columns only break ties between rows of one id.  Very long texts pass
through unread.  An empty table gives an empty result.  Columns of ``docs``
named as the appended ones are replaced by ``place`` and kept by ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook.llm.common import spread, stored

REST, NONE = "<rest>", "<none>"


CLASSES = 128  # weight classes below one slot, four for each halving


def _source(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(NONE))


def _ahead(counts: DataFrame, of: str) -> DataFrame:
    """(``of``, part, ahead): the rows of ``of`` in the parts before, from (``of``, part, n)."""
    return counts.select(of, "part", (F.sum("n").over(Window.partitionBy(of).orderBy("part")) - F.col("n")).alias("ahead"))


def _digits(rows: int) -> int:
    """Hex digits of a hash that tell about 10,000 rows apart."""
    return max(2, math.ceil(math.log(max(rows, 1) / 10_000, 16)))


def members(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, resolution: int = 1000,
            source_col: str = "source") -> DataFrame:
    """(source, slots, pool, r, n) of every source: its weight in slots, its
    pool and its number among the n sources that take turns there."""
    counts = docs.groupBy(_source(source_col).alias("source")).agg(F.count(F.lit(1)).alias("docs"))
    if weights is None:
        weighed = stored(counts.select("source", F.pow(F.col("docs").cast("double"), F.lit(float(power))).alias("weight")), "weights")
        total, rows = weighed.agg(F.sum("weight"), F.count(F.lit(1))).first()  # one row
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else F.create_map()
        of = F.try_element_at(given.cast("map<string,double>"), F.col("source")) if weights else F.lit(0.0)
        weighed = stored(counts.select("source", F.coalesce(of, F.lit(0.0)).alias("weight")), "weights")
        total, rows = sum(weights.values()), weighed.count()
    slots = F.col("weight") * resolution / F.lit(total or 1.0)
    light = F.floor(F.log2("slots") * 4 + 1e-9).cast("int")
    # A source that is named like such a pool gets one more "<".
    name = F.when(F.col("source").rlike("^<+rest"), F.concat(F.lit("<"), F.col("source"))).otherwise(F.col("source"))
    pool = (F.when(F.col("slots") >= 1, name).when(F.col("slots") <= 0, REST)
            .otherwise(F.concat(F.lit("<rest:"), F.greatest(light, F.lit(-CLASSES)).cast("string"), F.lit(">"))))
    named = (weighed.withColumn("slots", slots).withColumn("pool", pool).withColumn("h", F.md5(F.col("source").cast("binary")))
             .withColumn("part", F.substring("h", 1, _digits(rows))))
    taking = F.col("pool").startswith("<rest:")
    turns = named.where(taking)
    parts = turns.groupBy("pool", "part").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("pool", "part").orderBy("h", "source")
    # At most CLASSES + 1 pools are broadcast.
    numbered = (turns.withColumn("rank", F.row_number().over(within)).join(_ahead(parts, "pool"), ["pool", "part"])
                .join(F.broadcast(parts.groupBy("pool").agg(F.sum("n").alias("n"))), "pool")
                .select("source", "slots", "pool", (F.col("ahead") + F.col("rank") - 1).alias("r"), "n"))
    alone = named.where(~taking).select("source", "slots", "pool", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("n"))
    return alone.unionByName(numbered)


def pools(sources: DataFrame) -> DataFrame:
    """(pool, share) from ``members``: at most ``resolution`` + ``CLASSES`` + 2 rows."""
    return sources.groupBy("pool").agg(F.greatest(F.lit(1), F.round(F.sum("slots"))).cast("long").alias("share"))


def one_period(shares: DataFrame) -> DataFrame:
    """(pool, k, slot) of every block of one period, for ``shares`` with the
    columns pool and share (at most a few thousand rows): one row of arrays,
    the slots filled one after the other by a SQL aggregate."""
    packed = shares.select("pool", "share").groupBy().agg(
        F.sort_array(F.collect_list(F.struct("pool", "share"))).alias("pools"), F.sum("share").alias("period"))
    filled = packed.where(F.size("pools") > 0).selectExpr("pools", "period", """
        aggregate(
          sequence(0L, period - 1),
          named_struct('done', transform(pools, p -> 0L), 'taken', cast(array() as array<struct<i:int,k:bigint>>)),
          (a, t) -> transform(
            array(array_min(filter(transform(a.done, (d, i) -> if(
                d < pools[i].share and (d * period) div pools[i].share <= t,
                named_struct('due', ((d + 1) * period + pools[i].share - 1) div pools[i].share, 'i', i), null)), x -> x is not null)).i),
            pick -> named_struct(
              'done', transform(a.done, (d, i) -> if(i = pick, d + 1, d)),
              'taken', concat(a.taken, array(named_struct('i', pick, 'k', a.done[pick])))))[0],
          a -> a.taken) as taken""")
    return filled.selectExpr("pools", "posexplode(taken) as (slot, b)").selectExpr("pools[b.i].pool as pool", "b.k as k", "cast(slot as bigint) as slot")


def _placed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, resolution: int = 1000, block: int = 16,
            id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., then pool, block, slot and place."""
    sources = stored(members(docs, weights, power, resolution, source_col), "sources")
    shares = stored(pools(sources), "pools")
    period = shares.agg(F.sum("share")).first()[0]  # one row
    digits = _digits(docs.count())

    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    own = {c: f"c{i}" for i, c in enumerate(columns)}
    # At most resolution sources have a slot of their own: these are broadcast, with the hot ones among them.
    single = sources.where(F.col("slots") >= 1).select(F.col("source").alias("single"), "pool")
    keyed = (plain.withColumn("source_", _source(own[source_col])).join(F.broadcast(single), F.col("source_") == F.col("single"), "left")
             .withColumn("h", F.md5(F.coalesce(F.col(own[id_col]).cast("string"), F.lit("")).cast("binary")))
             .withColumn("part", F.substring("h", 1, digits)))
    turns = sources.where(F.col("pool").startswith("<rest:")).select(F.col("source").alias("taking"), F.col("pool").alias("of"), "r", "n")
    if turns.isEmpty():
        dealt = keyed.withColumn("unit", F.col("single")).withColumn("r", F.lit(0)).withColumn("n", F.lit(1))
    else:
        heavy = keyed.where(F.col("single").isNotNull()).withColumn("unit", F.col("single")).withColumn("r", F.lit(0)).withColumn("n", F.lit(1))
        light = (keyed.where(F.col("single").isNull()).join(turns, F.col("source_") == F.col("taking"), "left")
                 .withColumn("unit", F.col("taking")).withColumn("pool", F.col("of")).fillna(0, ["r"]).fillna(1, ["n"]))
        dealt = heavy.unionByName(light.select(*heavy.columns))
    # Without a unit: the pool of the sources without weight.
    keyed = dealt.select(*plain.columns, "h", "part", F.coalesce(F.concat(F.lit("source "), "unit"), F.lit("rest")).alias("unit"),
                         F.coalesce("pool", F.lit(REST)).alias("pool"), "r", "n")
    counts = keyed.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("unit", "part").orderBy("h", own[id_col], F.xxhash64(*plain.columns))
    numbered = (keyed.withColumn("rank", F.row_number().over(within)).join(_ahead(counts, "unit"), ["unit", "part"])
                .withColumn("number", F.col("ahead") + F.col("rank") - 1)
                .withColumn("block", F.floor(F.col("number") / block).cast("long") * F.col("n") + F.col("r"))
                # The schedule and the shares have as many rows as one period has slots.
                .join(F.broadcast(shares), "pool").withColumn("k", F.col("block") % F.col("share")))
    placed = numbered.join(F.broadcast(one_period(shares)), ["pool", "k"])
    return placed.select(
        *plain.columns, "pool", "block",
        (F.expr("block div share") * F.lit(period or 1) + F.col("slot")).alias("slot"), (F.col("number") % block).alias("place"))


def place(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``__pool``, ``__block`` (its number within the pool),
    ``__slot`` and ``__place`` (within the block) appended."""
    added = ["__pool", "__block", "__slot", "__place"]
    own = [c for c in docs.columns if c not in added]
    return _placed(docs.select(*own), **options).toDF(*own, *added)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order: range-partitioned and sorted by
    slot, so files written from it, read in order, follow the schedule."""
    placed = _placed(docs, **options)
    order = ["slot", "place"]
    dealt = placed.repartitionByRange(spread(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
