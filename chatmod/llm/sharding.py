"""Balanced sharding by label propagation, in DataFrame operations only.

Documents are linked if they share a key (by default the digest of the text), and a link is cut if its two
documents lie in different shards. Documents start in a shard by hash. In every round each group of linked
documents counts its members per shard (the neighbours' labels) and takes the fullest shard that still has
room; members elsewhere move there, larger gains first, while the quota of the target lasts. Members of one
group in one shard are interchangeable, so the state of a round is one counted cell per group and shard,
and a group of a third of all rows is a few cells. Documents without links fill what is left, so that row
counts of shards differ by at most one (law ``rows``).

Numbering never sorts a whole shard or group in one task: rows are numbered within (key, sub-bucket) and
the counts of the few sub-buckets are added up.

Defined cases: null texts count no bytes and are one group; null ids take part; rows that repeat are linked
like other equal texts; an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmod.llm.frames import cut

SHARDS = 24
ROUNDS = 40             # a bound only: rounds end when nothing moves
SUB = 1024              # sub-buckets of a numbering
MOVE_SUB = 64           # and of the moves of a round


def _numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 within ``keys``, in an arbitrary but fixed order."""
    sub = df.withColumn("__sub", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SUB)).cast("int"))
    sub = sub.repartition(*keys, "__sub")       # rows dealt by the keys alone would meet in one task
    counts = sub.groupBy(*keys, "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*keys, "__sub").orderBy("doc_id", "digest"))
    return (sub.withColumn("__row", own).join(counts, [*keys, "__sub"])
            .withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__sub", "__before", "__row"))


def _settle(cells: DataFrame, room: list[int]) -> DataFrame:
    """One round: cells (digest, shard, n) after every group has moved towards its fullest shard with room."""
    shards = len(room)
    free = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("shard") + 1)
    group = Window.partitionBy("digest")
    ranked = cells.withColumn("free", free).withColumn("tie", F.xxhash64("digest", "shard"))
    # the target: most members among the shards with room, ties by hash
    best = F.max(F.when(F.col("free") > 0, F.struct("n", "tie", "shard"))).over(group)
    ranked = ranked.withColumn("best", best)
    gains = F.struct("n", "tie") < F.struct("best.n", "best.tie")
    moving = ranked.where(gains).select("digest", F.col("shard").alias("from"), F.col("best.shard").alias("to"), "n",
                                        F.col("best.n").alias("gain"))
    # larger gains first (by powers of two) while the room of the target lasts
    moving = moving.withColumn("level", F.floor(F.log2("gain")).cast("int")).withColumn(
        "sub", F.pmod(F.xxhash64("digest"), F.lit(MOVE_SUB)).cast("int"))
    parts = moving.groupBy("to", "level", "sub").agg(F.sum("n").alias("all"))     # at most shards * 63 * MOVE_SUB rows
    ahead = Window.partitionBy("to").orderBy(F.desc("level"), "sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("all").over(ahead), F.lit(0))).drop("all")
    same = Window.partitionBy("to", "level", "sub").orderBy("digest", "from").rowsBetween(Window.unboundedPreceding, -1)
    moving = moving.withColumn("same", F.coalesce(F.sum("n").over(same), F.lit(0))).join(F.broadcast(parts), ["to", "level", "sub"])
    room_to = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("to") + 1)
    taken = F.least("n", F.greatest(F.lit(0), room_to - F.col("earlier") - F.col("same")))
    moved = moving.withColumn("k", taken).where("k > 0")
    change = moved.select("digest", F.explode(F.array(
        F.struct(F.col("from").alias("shard"), (-F.col("k")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("k").alias("n")))).alias("c"))
    after = cells.select("digest", "shard", "n").union(change.select("digest", "c.shard", "c.n"))
    return after.groupBy("digest", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None,
                    shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot): every row in a shard of equal row counts, linked rows
    together where quotas allow. ``link``: the key that links documents (default: the text's digest)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(text, 256) if link is None else F.sha2(F.coalesce(link.cast("string"), F.lit("")), 256)
    base = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                           F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("digest")))
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    start = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(shards)).cast("int").alias("shard")
    groups = base.groupBy("digest").agg(F.count("*").alias("members")).where("members > 1")
    cells = cut(base.groupBy("digest", start).agg(F.count("*").alias("n")).join(groups.select("digest"), "digest", "left_semi"))
    for _ in range(rounds):
        used = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}    # at most ``shards`` rows
        after = cut(_settle(cells, [quota[s] - used.get(s, 0) for s in range(shards)]))
        if after.exceptAll(cells).isEmpty():
            break
        cells = after

    # members of a group take the places of its cells in order of their number
    places = cut(cells.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells")))   # at most ``shards`` each
    linked = _numbered(base.join(places.select("digest"), "digest", "left_semi"), ["digest"], "__at").join(places, "digest")
    ends = F.transform("cells", lambda c, i: F.aggregate(F.slice("cells", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    linked = linked.withColumn("shard", F.element_at("cells", F.size(F.filter(ends, lambda e: e <= F.col("__at"))) + 1)["shard"])
    alone = base.join(places.select("digest"), "digest", "left_anti")
    columns = ["doc_id", "size", "text_crc32", "digest"]

    used = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    if any(used.get(s, 0) > quota[s] for s in range(shards)):       # the start by hash was uneven and nothing moved away
        limit = F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard") + 1)
        linked = cut(_numbered(linked.select(*columns, "shard"), ["shard"], "__at").withColumn("over", F.col("__at") >= limit))
        alone = alone.select(columns).union(linked.where("over").select(columns))
        linked = linked.where("not over")
        used = {s: min(n, quota[s]) for s, n in used.items()}
    filled, ends = 0, []
    for s in range(shards):
        filled += quota[s] - used.get(s, 0)
        ends.append(F.lit(filled).cast("long"))
    alone = _numbered(alone.withColumn("__all", F.lit(0)), ["__all"], "__at")
    alone = alone.withColumn("shard", F.size(F.filter(F.array(*ends), lambda e: e <= F.col("__at"))))
    columns.append("shard")
    return _numbered(cut(linked.select(columns).union(alone.select(columns))), ["shard"], "slot")
