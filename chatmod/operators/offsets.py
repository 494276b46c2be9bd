"""What of a topic has been counted: ledgers of offsets, and subtracting them from a delivery.

Two forms, both merged by union and both read only where a delivery touches them:

* runs — intervals ``lo .. hi`` of consecutive offsets per topic partition, one or a few for each micro-batch
  of a topic; ``merge_runs`` joins runs that overlap or meet, so the ledger of an unbroken history is one row per
  partition however long it is;
* bitmaps — one bit per offset in buckets of 32,768, for deliveries full of holes; buckets that are full are folded
  into runs of buckets, so here too the state follows the holes, not the history.

A delivery is joined by (partition, bucket of 32,768 offsets), never by partition alone: a partition that holds a
third of all records is many keys. The ledger is cut down to the buckets a delivery touches before the join, and is
broadcast only after its size was checked.

Records without an offset or partition cannot have been recorded and always count as new.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmod.session import bounded_broadcast

BUCKET = 1 << 15                    # offsets of one bitmap (the size of Spark's bitmap aggregates)
LONG = 64                           # runs over more buckets are not cut up
TOUCHED_BROADCAST_ROWS = 100_000    # ledger rows that a delivery touches, broadcast up to this many


def _bucket(offset: str = "offset") -> Column:
    return F.shiftright(F.col(offset), 15)


def _known(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.col("offset").isNotNull()
    for k in keys:
        cond &= F.col(k).isNotNull()
    return records.where(cond)


# -- runs -----------------------------------------------------------------------------------------------------------

def merge_runs(runs: DataFrame, keys: Sequence[str] = ("partition",)) -> DataFrame:
    """Disjoint runs (keys, lo, hi) that cover the same offsets: overlapping and adjacent ones are joined.

    Runs are joined among those that begin in the same bucket of offsets first. Across buckets, one row per bucket tells
    how far the runs before it reach and where the last of them began, so no task sorts the runs of a whole partition."""
    keys = list(keys)
    begun = [*keys, "__bucket"]
    order = Window.partitionBy(*begun).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.select(*keys, "lo", "hi", _bucket("lo").alias("__bucket")).withColumn("__new", F.coalesce((F.col("lo") > reach + 1).cast("int"), F.lit(1)))
    numbered = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = numbered.groupBy(*begun, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (islands.groupBy(*begun).agg(F.max("hi").alias("__top"), F.max("lo").alias("__last"))
               .withColumn("__reach", F.max("__top").over(earlier))
               .withColumn("__begins", F.when(F.col("__reach").isNull() | (F.col("__last") > F.col("__reach") + 1), F.col("__last")))
               .withColumn("__from", F.max("__begins").over(earlier))
               .select(*[F.col(k).alias(f"__of_{k}") for k in begun], "__reach", "__from"))
    same = F.lit(True)
    for k in begun:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    start = F.when(F.col("lo") <= F.col("__reach") + 1, F.col("__from")).otherwise(F.col("lo"))
    whole = islands.join(buckets, same).withColumn("__start", start)
    return whole.groupBy(*keys, "__start").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__start")


def offset_runs(records: DataFrame, keys: Sequence[str] = ("partition",)) -> DataFrame:
    """The runs of consecutive offsets in ``records`` (keys, lo, hi).

    Found bucket by bucket first, so that the offsets of one partition are not sorted in one task; what is left to
    be joined across buckets is a few runs per bucket."""
    keys = list(keys)
    one = _known(records, keys).select(*keys, "offset").distinct().withColumn("__bucket", _bucket())
    place = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy("offset"))
    islands = one.withColumn("__run", F.col("offset") - place).groupBy(*keys, "__bucket", "__run").agg(
        F.min("offset").alias("lo"), F.max("offset").alias("hi"))
    return merge_runs(islands.select(*keys, "lo", "hi"), keys)


def outside_runs(records: DataFrame, runs: DataFrame, keys: Sequence[str] = ("partition",)) -> DataFrame:
    """The records that lie in none of ``runs``: an anti-join by containment. ``runs`` must be disjoint (``merge_runs``).

    What the runs hold of the buckets that ``records`` touch becomes bitmaps, so a ledger full of holes costs one look at
    one bit per record."""
    keys = list(keys)
    first, last = F.shiftright("lo", 15), F.shiftright("hi", 15)
    cut = runs.select(*keys, "lo", "hi", first.alias("__first"), last.alias("__last"))
    short, long = cut.where(F.col("__last") - F.col("__first") < LONG), cut.where(F.col("__last") - F.col("__first") >= LONG)
    pieces = short.select(*keys, F.explode(F.sequence("__first", "__last")).alias("bucket"), "lo", "hi")
    # the buckets inside a long run are a run of full ones
    ends = F.array(F.col("__first"), F.col("__last"))
    pieces = pieces.unionByName(long.select(*keys, F.explode(ends).alias("bucket"), "lo", "hi"))
    touched = _known(records, keys).select(*keys, _bucket().alias("bucket")).distinct()
    inside = pieces.join(touched, [*keys, "bucket"], "left_semi").select(
        *keys, "bucket", F.greatest("lo", F.col("bucket") * BUCKET).alias("lo"), F.least("hi", F.col("bucket") * BUCKET + (BUCKET - 1)).alias("hi"))
    offsets = inside.select(*keys, F.explode(F.sequence("lo", "hi")).alias("offset"))
    full = long.select(*keys, (F.col("__first") + 1).alias("bucket"), (F.col("__last") - 1).alias("last_bucket"), F.lit(None).cast("binary").alias("bits"))
    return unseen(records, offset_bitmaps(offsets, keys).unionByName(full), keys)


# -- bitmaps --------------------------------------------------------------------------------------------------------

def offset_bitmaps(records: DataFrame, keys: Sequence[str] = ("partition",)) -> DataFrame:
    """One bit per offset of ``records``: (keys, bucket, last_bucket, bits). Combined in every task before the shuffle."""
    keys = list(keys)
    bits = F.bitmap_construct_agg((F.col("offset") - _bucket() * BUCKET)).alias("bits")
    found = _known(records, keys).groupBy(*keys, _bucket().alias("bucket")).agg(bits)
    return found.select(*keys, "bucket", F.col("bucket").alias("last_bucket"), "bits")


def merge_bitmaps(state: DataFrame, keys: Sequence[str] = ("partition",)) -> DataFrame:
    """The union of states: one row per bucket with holes (bits), and one per run of full buckets (bits null)."""
    keys = list(keys)
    whole = state.where("bits is null").select(*keys, F.col("bucket").alias("lo"), F.col("last_bucket").alias("hi"))
    united = state.where("bits is not null").groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    full = F.bitmap_count("bits") == BUCKET
    runs = merge_runs(whole.unionByName(united.where(full).select(*keys, F.col("bucket").alias("lo"), F.col("bucket").alias("hi"))), keys)
    holes = united.where(~full)
    # a bucket with holes that lies in a run of full ones is full
    inside = F.col("bucket").between(F.col("__lo"), F.col("__hi"))
    for k in keys:
        inside &= F.col(k) == F.col(f"__{k}")
    covers = runs.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    holes = holes.join(bounded_broadcast(covers, TOUCHED_BROADCAST_ROWS), inside, "left_anti")
    return holes.select(*keys, "bucket", F.col("bucket").alias("last_bucket"), "bits").unionByName(
        runs.select(*keys, F.col("lo").alias("bucket"), F.col("hi").alias("last_bucket"), F.lit(None).cast("binary").alias("bits")))


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1


def unseen(records: DataFrame, state: DataFrame, keys: Sequence[str] = ("partition",)) -> DataFrame:
    """The records whose bit is not set in ``state``. Only the buckets that the records touch are read of it."""
    keys = list(keys)
    touched = _known(records, keys).select(*keys, _bucket().alias("bucket")).distinct()
    own = state.where("bits is not null").join(touched, [*keys, "bucket"], "left_semi").select(*keys, "bucket", "bits")
    same = F.col("bucket").between(F.col("__lo"), F.col("__hi"))
    for k in keys:
        same &= F.col(k) == F.col(f"__{k}")
    runs = state.where("bits is null").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bucket").alias("__lo"), F.col("last_bucket").alias("__hi"))
    full = touched.join(bounded_broadcast(runs, TOUCHED_BROADCAST_ROWS), same, "left_semi").select(*keys, "bucket", F.lit(None).cast("binary").alias("bits"))
    near = own.unionByName(full).groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bucket").alias("__bucket")).agg(
        F.bitmap_or_agg("bits").alias("__bits"), F.bool_or(F.col("bits").isNull()).alias("__full"))
    near = bounded_broadcast(near, TOUCHED_BROADCAST_ROWS // 32)        # 4 KB each
    match = _bucket() == F.col("__bucket")
    for k in keys:
        match &= F.col(k) == F.col(f"__{k}")
    place = (F.col("offset") - _bucket() * BUCKET).cast("int")
    return records.join(near, match & (F.col("__full") | _bit(F.col("__bits"), place)), "left_anti")


def first_deliveries(records: DataFrame, order: Sequence[str] = ("batch_id",), keys: Sequence[str] = ("partition",),
                     state: DataFrame | None = None) -> DataFrame:
    """The first record (by ``order``) of every offset that ``state`` does not hold; records without offset all stay."""
    keys = list(keys)
    fresh = records if state is None else unseen(records, state, keys)
    rank = F.row_number().over(Window.partitionBy(*keys, "offset").orderBy(*order))
    known = F.col("offset").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    kept = fresh.where(known).withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return kept.unionByName(fresh.where(~known))
