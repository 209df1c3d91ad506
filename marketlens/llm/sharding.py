"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

DataFrame and SQL functions only. The ring has ``SLOTS`` slots. Every shard
owns ``vnodes`` of them by hash; a slot belongs to the next owned slot
clockwise. A document's slot is the high bits of ``xxhash64(doc_id)``
(documents without doc_id hash their text), so shard membership depends on
the key, and more shards take only arcs of the ring from the others.

No shard may hold more than its capacity. Documents of a full shard continue
clockwise to the next virtual node with room, in ring order; the room a shard
has left is dealt evenly to its slots. With ``slack`` 0 the
capacities are n/shards rounded down or up and sum to n, so all counts are at
most one apart; a larger slack moves fewer documents.

Work: one shuffle of the rows by slot and part to number them; a slot's rows
are dealt to ``PARTS`` parts by a hash of id and text, and part counts give the
offsets, so a doc_id (or its absence) that holds a third of the rows is not one
task; only rows equal in doc_id and text are. All decisions are made
on per-slot counts, at most ``SLOTS`` rows whatever the input size, and come
back as a broadcast of pieces (slot, rows from..to, shard, slot offset), at
most 4 * SLOTS of them.

Empty input gives no rows. Rows equal in doc_id and text are interchangeable
neighbours on the ring. Columns of the input are kept; ``shard`` and ``slot``
replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import store

SLOTS = 1 << 16
VNODES = 256
PARTS = 64  # parts of a slot whose rows are numbered apart


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(ring_slot, shard) of every slot; virtual nodes that meet on a slot leave it to the smallest shard."""
    owned = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("long").alias("copy"))
        .select("shard", F.pmod(F.xxhash64(F.lit("vnode"), "shard", "copy"), F.lit(SLOTS)).alias("ring_slot"))
        .groupBy("ring_slot").agg(F.min("shard").alias("shard"))
    )
    ahead = Window.orderBy(F.col("ring_slot").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = spark.range(SLOTS).withColumnRenamed("id", "ring_slot").join(owned, "ring_slot", "left")
    first = owned.agg(F.min_by("shard", "ring_slot"))
    return slots.select("ring_slot", F.coalesce(F.last("shard", ignorenulls=True).over(ahead), first.scalar()).alias("shard"))


def placements(counts: DataFrame, shards: int, vnodes: int, slack: float) -> DataFrame:
    """Pieces (ring_slot, from_row, to_row, shard, first_slot) from the counts (ring_slot, n)."""
    loads = ring(counts.sparkSession, shards, vnodes).join(counts, "ring_slot", "left").na.fill(0, ["n"])
    whole_ring = Window.partitionBy()
    clockwise = Window.orderBy("ring_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_shard = Window.partitionBy("shard")
    along_shard = of_shard.orderBy("ring_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(whole_ring)
    # with slack 0 the first (total mod shards) shards hold one row more than the rest
    room = F.ceil(total / shards * (1 + slack)) if slack else F.floor(total / shards) + (F.col("shard") < total % shards).cast("long")
    homes = (
        loads.withColumn("room", room.cast("long"))
        .withColumn("home_start", F.sum("n").over(along_shard) - F.col("n"))
        .withColumn("stay", F.greatest(F.lit(0), F.least("n", F.col("room") - F.col("home_start"))))
        .withColumn("over", F.col("n") - F.col("stay"))
        .withColumn("held", F.sum("stay").over(of_shard))
        # the shard's room left, dealt evenly to its slots
        .withColumn("free", F.col("room") - F.col("held"))
        .withColumn("_slots", F.count(F.lit(1)).over(of_shard))
        .withColumn("_nth", F.row_number().over(of_shard.orderBy("ring_slot")) - 1)
        .withColumn("free", F.floor(F.col("free") / F.col("_slots")) + (F.col("_nth") < F.col("free") % F.col("_slots")).cast("long"))
    )
    # Overflowing rows queue up along the ring; each slot takes what it has room for. Rows that have left the queue
    # by slot i: out(i) = min(in(i), out(i-1) + free(i)) = free_sum(i) + min(0, min over j <= i of in(j) - free_sum(j)).
    # What is still queued at the end goes round once more, into the room that the first lap left.
    walked = (
        homes.withColumn("came", F.sum("over").over(clockwise))
        .withColumn("_frees", F.sum("free").over(clockwise))
        .withColumn("left", F.col("_frees") + F.least(F.lit(0), F.min(F.col("came") - F.col("_frees")).over(clockwise)))
        .withColumn("took", F.col("left") - F.coalesce(F.lag("left").over(Window.orderBy("ring_slot")), F.lit(0)))
        .withColumn("queued", F.max("came").over(whole_ring) - F.max("left").over(whole_ring))
        .withColumn("_room2", F.sum(F.col("free") - F.col("took")).over(clockwise))
        .withColumn("left2", F.least("queued", "_room2"))
        .withColumn("took2", F.col("left2") - F.least(F.col("queued"), F.col("_room2") - F.col("free") + F.col("took")))
        .withColumn("first_lap", F.max("left").over(whole_ring))
    )
    stays = walked.where("stay > 0").select(
        "ring_slot", F.lit(0).cast("long").alias("from_row"), F.col("stay").alias("to_row"), "shard", F.col("home_start").alias("first_slot"))
    taken = walked.select("shard", "held", F.explode(F.array(
        F.struct((F.col("left") - F.col("took")).alias("at"), F.col("took").alias("n")),
        F.struct((F.col("first_lap") + F.col("left2") - F.col("took2")).alias("at"), F.col("took2").alias("n")))).alias("t"))
    taken = taken.where("t.n > 0").select("shard", "held", "t.at", "t.n").withColumn(
        "first_slot", F.col("held") + F.sum("n").over(of_shard.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    # both the slots' overflows and the shards' takings cut the stream 0..total overflow into intervals; overlay the cuts
    cuts = walked.where("over > 0").select(
        (F.col("came") - F.col("over")).alias("at"), F.col("came").alias("end"),
        F.struct("ring_slot", F.col("stay").alias("row"), (F.col("came") - F.col("over")).alias("at")).alias("source"), F.lit(None).alias("target"),
    ).unionByName(taken.select(
        "at", (F.col("at") + F.col("n")).alias("end"), F.lit(None).alias("source"),
        F.struct("shard", "first_slot", "at").alias("target")))
    stream = Window.orderBy("at")
    met = cuts.groupBy("at").agg(F.first("source", ignorenulls=True).alias("source"), F.first("target", ignorenulls=True).alias("target"), F.max("end").alias("end"))
    moves = (
        met.withColumn("source", F.last("source", ignorenulls=True).over(stream)).withColumn("target", F.last("target", ignorenulls=True).over(stream))
        .withColumn("to", F.coalesce(F.lead("at").over(stream), "end"))
        .select(F.col("source.ring_slot"), (F.col("source.row") + F.col("at") - F.col("source.at")).alias("from_row"),
                (F.col("source.row") + F.col("to") - F.col("source.at")).alias("to_row"), F.col("target.shard"),
                (F.col("target.first_slot") + F.col("at") - F.col("target.at")).alias("first_slot"))
    )
    return stays.unionByName(moves)


def assign_shards(docs: DataFrame, shards: int = 40, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """``docs`` (doc_id, text, any others) with shard (int) and slot (long, gapless from 0 in each shard)."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.lit("no id"), "text"))
    placed = docs.drop("shard", "slot").withColumn("__key", key).withColumn("__tie", F.crc32(F.col("text").cast("binary")))
    placed = placed.withColumn("__slot", F.shiftrightunsigned("__key", 65 - SLOTS.bit_length()))
    placed = placed.withColumn("__part", F.pmod(F.xxhash64("__key", "__tie"), F.lit(PARTS)).cast("int"))
    parts = store(placed.groupBy("__slot", "__part").agg(F.count(F.lit(1)).alias("n")))
    counts = parts.groupBy(F.col("__slot").alias("ring_slot")).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("__slot").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("__slot", "__part").orderBy("__key", "doc_id", "__tie")
    pieces = placements(counts, shards, vnodes, slack).toDF("__at", "__from", "__to", "shard", "__first")
    rows = placed.withColumn("__nth", (F.row_number().over(order) - 1).cast("long")).join(offsets, ["__slot", "__part"])
    rows = rows.withColumn("__row", F.col("__before") + F.col("__nth"))
    return (
        rows.join(F.broadcast(pieces), (F.col("__slot") == F.col("__at")) & (F.col("__row") >= F.col("__from")) & (F.col("__row") < F.col("__to")))
        .withColumn("slot", F.col("__first") + F.col("__row") - F.col("__from"))
        .drop("__key", "__tie", "__slot", "__part", "__before", "__nth", "__row", "__at", "__from", "__to", "__first")
    )
