"""Shards by balanced label propagation, in DataFrame operations only.

Documents that share a link key are neighbours (all of them, through the key; no pairs are made). Linked documents are
dealt evenly to the shards. In each round every key's documents look at where their neighbours are: those where few are
want to go where most are, among the shards with room; a shard lets in those with most neighbours there first and stops
at its quota. Documents of one key in one shard have the same neighbours and want the same, so the state
is one row for each (key, shard) with a number of documents, however many documents share a key. At the end the numbers
are dealt out to the documents of each key, the documents without links fill what is left of each quota, and row counts
differ by one at most. Quotas hold after every round; rounds only lower the number of links that are cut.

A null text has size 8, crc 0 and the key of the empty text, which is linked to empty texts. An empty table gives no rows.
Rows that repeat a doc_id are placed each for itself, rows without doc_id get no place; ties between shards go to a hash of key and shard. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseframe.llm.common import Written, drop_all, numbered, whole_texts

SHARDS = 24
#: Rounds end when one moves fewer than this share of the linked documents, and after ROUNDS at the latest.
SETTLED, ROUNDS = 0.001, 40


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> Written:
    """Moves documents between shards: cells (key, shard, n) in, the same out, no shard above its quota."""
    state = Written(cells, "cells")
    everyone = state.df.agg(F.sum("n")).first()[0] or 0
    for _ in range(rounds):
        now = state.df
        filled = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row for each shard
        room = [q - filled.get(s, 0) for s, q in enumerate(quotas)]
        room_of = F.array(*(F.lit(r).cast("long") for r in room))
        free = F.element_at(room_of, F.col("shard") + 1)
        # A key's cells, those in shards with room first, by size: the last goes to the first, the next to last to the
        # second, up to the middle, so that copies beyond one shard's quota fill several shards at once. Cells in full
        # shards that are larger than any with room stay out of this.
        key = W.partitionBy("key")
        sized = now.withColumn("open", free > 0).withColumn("most", F.max(F.when(F.col("open"), F.col("n"))).over(key))
        # A key whose shards are all full sends its smallest cell ahead to a shard that has room for the whole key.
        vacant = [s for s, r in enumerate(room) if r > 0]
        ahead_of = F.element_at(F.array(*map(F.lit, vacant or [0])), F.pmod(F.xxhash64("key", "shard"), F.lit(len(vacant) or 1)).cast("int") + 1)
        stuck = sized.where("most IS NULL").withColumn("total", F.sum("n").over(key)).withColumn("place", F.row_number().over(key.orderBy("n", "shard")))
        stuck = stuck.where("place = 1 AND total > n").withColumn("to", ahead_of).where(F.col("total") <= F.element_at(room_of, F.col("to") + 1))
        stuck = stuck.select("key", "shard", "n", "to", F.lit(0).cast("long").alias("there"))
        sized = sized.where(F.col("open") | (F.col("n") <= F.col("most")))
        sized = sized.withColumn("place", F.row_number().over(key.orderBy(F.desc("open"), F.desc("n"), F.xxhash64("key", "shard"), "shard")))
        sized = sized.withColumn("across", F.count(F.lit(1)).over(key) + 1 - F.col("place"))
        targets = sized.where("open").select("key", F.col("place").alias("across"), F.col("shard").alias("to"), F.col("n").alias("there"))
        movers = sized.where("place > across").join(targets, ["key", "across"]).where("n <= there").select("key", "shard", "n", "to", "there")
        movers = movers.unionByName(stuck)
        # The place of each in its shard's queue: those with most neighbours there first, by classes, then by hash.
        queued = movers.withColumn("class", F.lit(40) - F.floor(F.log2(F.col("there") + 1)).cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(32)).cast("int"))
        sizes = queued.groupBy("to", "class", "part").agg(F.sum("n").alias("total"))
        ahead = sizes.select("to", "class", "part", F.coalesce(F.sum("total").over(W.partitionBy("to").orderBy("class", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        within = F.coalesce(F.sum("n").over(W.partitionBy("to", "class", "part").orderBy(F.desc("there"), "key", "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        into = F.element_at(room_of, F.col("to") + 1)
        placed = queued.withColumn("within", within).join(F.broadcast(ahead), ["to", "class", "part"])  # at most shards x 40 x 32 rows
        moved = placed.withColumn("go", F.greatest(F.lit(0), F.least("n", into - F.col("ahead") - F.col("within")))).where("go > 0")
        moved = Written(moved.select("key", "shard", "to", "go"), "moves")
        going = moved.df.agg(F.sum("go")).first()[0] or 0
        if not going:
            moved.drop()
            break
        leave = moved.df.select("key", "shard", (-F.col("go")).alias("n"))
        enter = moved.df.select("key", F.col("to").alias("shard"), F.col("go").alias("n"))
        new = now.unionByName(leave).unionByName(enter).groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        following = Written(new, "cells")
        state.drop()
        moved.drop()
        state = following
        if going < SETTLED * everyone:
            break
    return state


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all documents; equal texts are linked."""
    texts = whole_texts(docs)
    rows = texts.select(
        "doc_id",
        (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text", F.octet_length("text")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = Written(rows, "rows").df  # read by the result
    total = rows.count()
    quotas = _quotas(total, shards)

    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    stored = Written(rows.join(groups.where("copies > 1"), "key").select("row", "key"), "linked")
    linked = stored.df
    dealt = numbered(linked, [], "row", "number", total).withColumn("shard", F.pmod("number", F.lit(shards)).cast("int"))
    state = propagate(dealt.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n")), quotas, rounds)
    cells = state.df

    # Each key's documents, in any order, take the key's places shard by shard.
    places = F.array_sort(F.collect_list(F.struct("shard", "n")))
    ends = cells.groupBy("key").agg(places.alias("places")).withColumn("ends", F.transform("places", lambda p, i: F.struct(p["shard"].alias("shard"), F.aggregate(F.slice("places", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("end"))))
    ranked = numbered(linked, ["key"], "row", "rank", total, few_groups=False)
    own = ranked.join(ends.select("key", "ends"), "key").select("row", F.filter("ends", lambda e: F.col("rank") < e["end"])[0]["shard"].alias("shard"))
    own = Written(own, "linked-shards").df
    drop_all(stored, state)

    filled = {r["shard"]: r["n"] for r in own.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds, reached = [], 0
    for s, quota in enumerate(quotas):
        reached += quota - filled.get(s, 0)
        bounds.append(reached)
    single = numbered(rows.join(groups.where("copies = 1"), "key", "left_semi").select("row"), [], "row", "number", total)
    single = single.select("row", F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b <= F.col("number"))).alias("shard"))

    placed = rows.drop("key").join(own.unionByName(single), "row")
    slotted = numbered(placed, ["shard"], "row", "slot", total // shards + 1)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
